"""Propagation between branches: fan-out, loop detection, merging, what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.checkpoint import settle
from stratalog.functions.vocabulary import STATEMENT

#: Rounds of propagation at most; commit ids end cycles before.
MAX_HOPS = 100


def fan_out(commits: DataFrame, routes: DataFrame) -> DataFrame:
    """A delivery of each commit to each destination of its branch.  routes: src, dst."""
    return commits.join(routes, commits.branch_id == routes.src).drop("src")


def unseen(deliveries: DataFrame, seen: DataFrame) -> DataFrame:
    """Deliveries whose commit the destination has not seen.  seen: dst, commit_id."""
    fresh = deliveries.join(seen, ["dst", "commit_id"], "left_anti")
    return fresh.dropDuplicates(["dst", "commit_id"])


def propagate(commits: DataFrame, routes: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """commit_id, origin, dst and hop: where each commit goes, and after how many hops it first gets there.

    A merged commit keeps its id, so a branch that has seen it, its own to begin with, drops it.
    """
    reached = settle(commits.select("commit_id", F.col("branch_id").alias("origin"), F.col("branch_id").alias("dst"), F.lit(0).alias("hop")))
    newest = reached
    for hop in range(1, hops + 1):
        sent = newest.withColumnRenamed("dst", "src").join(routes, "src").select("commit_id", "origin", "dst", F.lit(hop).alias("hop")).distinct()
        newest = settle(sent.join(reached.select("commit_id", "dst"), ["commit_id", "dst"], "left_anti").select("commit_id", "origin", "dst", "hop"))
        if newest.isEmpty():
            break
        reached = reached.union(newest)
    return reached.where("hop > 0")


def received(netted: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The changes that each destination applies: its own and those that arrived, with their origin."""
    own = netted.select(F.col("branch_id").alias("dst"), F.col("branch_id").alias("origin"), "commit_seq", *STATEMENT, "net")
    named = arrivals.select("origin", "commit_seq", "dst")
    there = netted.withColumnRenamed("branch_id", "origin").join(named, ["origin", "commit_seq"])
    return own.union(there.select("dst", "origin", "commit_seq", *STATEMENT, "net"))


def merged_state(changes: DataFrame) -> DataFrame:
    """Each destination's graph: changes in the order of commit_seq and origin, removals before additions in a commit."""
    last = F.max_by("net", F.struct("commit_seq", "origin", "net"))
    return changes.groupBy("dst", *STATEMENT).agg(last.alias("_net")).where("_net = 1").drop("_net")


def merge_commits(arrivals: DataFrame) -> DataFrame:
    """Merge commits: id and message of the merged one, the local branch, and the local predecessor in arrival order."""
    from pyspark.sql import Window as W

    order = W.partitionBy("dst").orderBy("commit_seq", "origin")
    return arrivals.withColumn("preceding_id", F.lag("commit_id", 1, "").over(order)).withColumnRenamed("dst", "branch_id")


def with_status(deliveries: DataFrame, mergers: DataFrame) -> DataFrame:
    """Deliveries are recorded, and rejected where the destination has no merger.  mergers: dst."""
    known = mergers.select("dst").distinct().withColumn("_m", F.lit(True))
    return deliveries.join(known, "dst", "left").withColumn("status", F.when(F.col("_m"), "ACCEPTED").otherwise("REJECTED")).drop("_m")


def pending_forward(commits: DataFrame, cursors: DataFrame) -> DataFrame:
    """Commits after the last one forwarded on each route; all where none was.  cursors: src, dst, last_seq."""
    routed = commits.join(cursors, commits.branch_id == cursors.src)
    return routed.where(F.col("last_seq").isNull() | (F.col("commit_seq") > F.col("last_seq"))).select("src", "dst", "commit_seq", "commit_id")


def pending_merge(deliveries: DataFrame, merged: DataFrame) -> DataFrame:
    """Recorded deliveries that no merge commit answers."""
    return deliveries.join(merged, ["dst", "commit_id"], "left_anti")


def existing(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """branch_id, there: whether each branch asked for has commits."""
    there = commits.select("branch_id").distinct().withColumn("_there", F.lit(True))
    return asked.join(there, "branch_id", "left").select("branch_id", F.coalesce("_there", F.lit(False)).alias("there"))


def pending_preliminary(preliminary: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits written ahead that the log does not have."""
    return preliminary.join(commits.select("commit_id"), "commit_id", "left_anti")
