"""Commits: nested and long form, JSON parts, splitting and joining, suffixes of the log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V
from stratalog.sources.oplog import WEEK_MS

#: Statements of a batch, and bytes of a part.
BATCH, PAYLOAD = 8_000, 1_000_000


def commit_id(branch: Column, seq: Column) -> Column:
    return F.concat_ws("-", F.lit("c"), branch.cast("string"), seq.cast("string"))


def log(netted: DataFrame) -> DataFrame:
    """branch_id, commit_seq, commit_id, preceding_id and ts of each commit, in log order."""
    commits = netted.select("branch_id", "commit_seq").distinct().withColumn("commit_id", commit_id(F.col("branch_id"), F.col("commit_seq")))
    before = F.lag("commit_id", 1, "").over(W.partitionBy("branch_id").orderBy("commit_seq"))
    return commits.withColumn("preceding_id", before).withColumn("ts", F.col("commit_seq").cast("long") * WEEK_MS)


def nest(netted: DataFrame) -> DataFrame:
    """Nested commits (the columns of COMMIT_DDL, branch_id and seq)."""
    empty = F.lit(None).cast("string")
    statement = F.struct(empty.alias("containingsubject"), F.col("subject"), empty.alias("containmentpredicate"), F.col("predicate"), F.col("datatype"), F.col("object"))
    side = lambda sign: F.transform(F.array_sort(F.collect_list(F.when(F.col("net") == sign, F.struct(F.col("first_seq").alias("at"), statement.alias("s"))))), lambda x: x["s"])
    sides = netted.groupBy("branch_id", "commit_seq").agg(side(1).alias("addedStatements"), side(-1).alias("removedStatements"))
    named = sides.join(log(netted), ["branch_id", "commit_seq"])
    return named.select(
        F.col("branch_id").cast("string").alias("branch_id"),
        F.col("commit_seq").cast("long").alias("seq"),
        F.col("commit_id").alias("commitId"),
        F.col("branch_id").cast("string").alias("originatingBranchId"),
        F.lit("").alias("commitMessage"),
        F.col("preceding_id").alias("precedingCommitId"),
        F.col("ts").alias("timeStamp"),
        "addedStatements",
        "removedStatements",
    )


def flatten(commits: DataFrame) -> DataFrame:
    """Operation rows of nested commits: additions in order, then removals (pos goes on)."""
    adds = commits.select("*", F.posexplode("addedStatements").alias("pos", "s"), F.lit("ADD").alias("op"))
    removes = commits.select("*", F.posexplode("removedStatements").alias("p", "s"), F.lit("REMOVE").alias("op")).withColumn("pos", F.col("p") + F.size("addedStatements")).drop("p")
    return adds.unionByName(removes).select("branch_id", "seq", F.col("commitId").alias("commit_id"), F.col("precedingCommitId").alias("preceding_id"), F.col("timeStamp").alias("ts"), "op", "pos", "s.*")


def rows(netted: DataFrame) -> DataFrame:
    """Operation rows of commits, as `flatten` gives them, with message; no commit has to fit in one row."""
    named = netted.join(log(netted), ["branch_id", "commit_seq"])
    pos = (F.row_number().over(W.partitionBy("branch_id", "commit_seq").orderBy(F.desc("net"), "first_seq")) - 1).cast("int")
    null = F.lit(None).cast("string")
    return named.select(
        F.col("branch_id").cast("string").alias("branch_id"), F.col("commit_seq").cast("long").alias("seq"), "commit_id", "preceding_id", "ts", F.lit("").alias("message"), F.when(F.col("net") > 0, "ADD").otherwise("REMOVE").alias("op"), pos.alias("pos"),
        null.alias("containingsubject"), "subject", null.alias("containmentpredicate"), "predicate", "datatype", "object",
    )


def batches(netted: DataFrame, size: int = BATCH) -> DataFrame:
    """batch_id (from 1) and total_batches for each row of a commit: additions, then removals, `size` to a batch.

    A commit of at most `size` statements is one batch.  Ranks of a large commit are dealt by
    sorting within it; the order is that of op, statement.
    """
    by = W.partitionBy("branch_id", "commit_seq")
    rank = F.row_number().over(by.orderBy(F.desc("net"), *V.STATEMENT))
    return netted.withColumn("batch_id", (F.floor((rank - 1) / size) + 1).cast("int")).withColumn("total_batches", F.ceil(F.count(F.lit(1)).over(by) / size).cast("int"))


def _parts(rows: DataFrame, keys: list[str], order: list[Column], limit: int, size: int) -> DataFrame:
    """bytes, part (from 1) and oversized of each row: parts of at most `size` rows and `limit` bytes, in order.

    Rows that begin in the same half of a limit share a part, unless one of them is longer than
    half a limit, which is a part of its own.  So running sums decide, and no commit has to be
    in memory.  A statement over the limit cannot be cut: its part is marked.
    """
    half = limit // 2
    by = W.partitionBy(*keys).orderBy(*order)
    body = F.octet_length(F.to_json(F.struct("subject", "predicate", "datatype", "object"))) + 1
    sized = rows.withColumn("bytes", body.cast("long")).withColumn("_rank", F.row_number().over(by))
    placed = sized.withColumn("_cell", F.floor((F.sum("bytes").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")) / half)).withColumn("_batch", F.floor((F.col("_rank") - 1) / size))
    before = lambda c: F.lag(c).over(by)
    new = (F.col("_rank") == 1) | (F.col("bytes") > half) | (before("bytes") > half) | (before("_cell") != F.col("_cell")) | (before("_batch") != F.col("_batch"))
    return placed.withColumn("_new", new.cast("int")).withColumn("part", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("long")).withColumn("oversized", F.col("bytes") > limit).drop("_rank", "_cell", "_batch", "_new")


def split_rows(rows: DataFrame, size: int = BATCH, limit: int = PAYLOAD) -> DataFrame:
    """Events (EVENT_DDL) of operation rows as `flatten` gives them, with message: parts bounded in statements and bytes, all with the commit's metadata."""
    keys = ["branch_id", "seq", "commit_id"]
    parts = _parts(rows, keys, [F.col("pos")], limit, size)
    side = lambda op: F.transform(F.array_sort(F.collect_list(F.when(F.col("op") == op, F.struct(F.col("pos"), _statement().alias("s"))))), lambda x: x["s"])
    grouped = parts.groupBy(*keys, "preceding_id", "ts", "message", "part").agg(side("ADD").alias("added"), side("REMOVE").alias("removed"))
    total = F.max("part").over(W.partitionBy(*keys)).cast("int")
    return _events(grouped.withColumn("_total", total))


def _statement() -> Column:
    return F.struct("containingsubject", "subject", "containmentpredicate", "predicate", "datatype", "object")


def _events(grouped: DataFrame) -> DataFrame:
    body = F.struct(
        F.col("commit_id").alias("commitId"), F.col("branch_id").alias("originatingBranchId"), F.col("message").alias("commitMessage"), F.col("preceding_id").alias("precedingCommitId"), F.col("ts").alias("timeStamp"),
        F.col("added").alias("addedStatements"), F.col("removed").alias("removedStatements"),
    )
    key = F.concat_ws("/", "branch_id", "commit_id", F.lit(uuid.uuid5(uuid.NAMESPACE_URL, "commit").hex))
    return grouped.select("branch_id", "seq", key.alias("commitUUID"), F.col("part").cast("int").alias("batchId"), F.col("_total").alias("totalBatches"), F.to_json(body).alias("body"))


def split(commits: DataFrame, size: int = BATCH, limit: int = PAYLOAD) -> DataFrame:
    """Nested commits as events; a commit without statements is one event."""
    messages = commits.select("branch_id", "seq", F.col("commitId").alias("commit_id"), F.col("commitMessage").alias("message"))
    some = split_rows(flatten(commits).join(messages, ["branch_id", "seq", "commit_id"]), size, limit)
    empty = commits.where((F.size("addedStatements") == 0) & (F.size("removedStatements") == 0))
    none = F.lit(None).cast(f"array<struct<{V.STATEMENT_DDL.replace(' STRING', ':string')}>>")
    empty = empty.select("branch_id", "seq", F.col("commitId").alias("commit_id"), F.col("precedingCommitId").alias("preceding_id"), F.col("timeStamp").alias("ts"), F.col("commitMessage").alias("message"), F.lit(1).alias("part"), F.coalesce(none, F.array()).alias("added"), F.coalesce(none, F.array()).alias("removed"), F.lit(1).alias("_total"))
    return some.union(_events(empty))


def rejoin_rows(events: DataFrame) -> DataFrame:
    """Operation rows of complete events, as `flatten` gives them with message: no commit has to fit in one row."""
    whole = events.groupBy("branch_id", "commitUUID").agg(F.count_distinct("batchId").alias("_n"), F.max("totalBatches").alias("_all")).where("_n = _all").select("branch_id", "commitUUID")
    parsed = events.join(whole, ["branch_id", "commitUUID"], "left_semi").dropDuplicates(["branch_id", "commitUUID", "batchId"]).withColumn("c", F.from_json("body", V.COMMIT_DDL))
    sides = [parsed.select("branch_id", "seq", "batchId", "c", F.posexplode(f"c.{name}").alias("_p", "s"), F.lit(op).alias("op")) for name, op in (("addedStatements", "ADD"), ("removedStatements", "REMOVE"))]
    rows = sides[0].union(sides[1])
    pos = (F.row_number().over(W.partitionBy("branch_id", "c.commitId").orderBy("op", "batchId", "_p")) - 1).cast("int")
    return rows.withColumn("pos", pos).select("branch_id", "seq", F.col("c.commitId").alias("commit_id"), F.col("c.precedingCommitId").alias("preceding_id"), F.col("c.timeStamp").alias("ts"), F.col("c.commitMessage").alias("message"), "op", "pos", "s.*")


def rejoin_events(events: DataFrame) -> DataFrame:
    """Nested commits of complete events; the first part's metadata holds, parts of incomplete ones wait."""
    parsed = events.withColumn("c", F.from_json("body", V.COMMIT_DDL))
    sides = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("batchId").alias("at"), F.col(f"c.{name}").alias("s")))), lambda x: F.coalesce(x["s"], F.array())))
    first = lambda name: F.min_by(f"c.{name}", "batchId").alias(name)
    grouped = parsed.groupBy("branch_id", "commitUUID").agg(
        F.min("seq").alias("seq"), F.count_distinct("batchId").alias("_n"), F.max("totalBatches").alias("_all"),
        *[first(x) for x in ("commitId", "originatingBranchId", "commitMessage", "precedingCommitId", "timeStamp")],
        sides("addedStatements").alias("addedStatements"), sides("removedStatements").alias("removedStatements"),
    )
    return grouped.where("_n = _all").drop("_n", "_all", "commitUUID")


def payload_parts(netted: DataFrame, limit: int = PAYLOAD, size: int = BATCH) -> DataFrame:
    """part (from 1), bytes and oversized of each row of a commit, additions first."""
    return _parts(netted, ["branch_id", "commit_seq"], [F.desc("net"), *map(F.col, V.STATEMENT)], limit, size)


def suffix(commits: DataFrame, commit: str | None, inclusive: bool, id_column: str = "commitId", order: str = "seq") -> DataFrame:
    """Commits from, or after, the one named; none if it is unknown, all if it is null."""
    if commit is None:
        return commits
    start = commits.where(F.col(id_column) == commit).agg(F.max(order).alias("_from"))
    held = F.col(order) >= F.col("_from") if inclusive else F.col(order) > F.col("_from")
    return commits.join(F.broadcast(start), held).drop("_from")  # one row


def last(commits: DataFrame, keys: list[str]) -> DataFrame:
    """The last commit of each group."""
    return commits.groupBy(*keys).agg(F.max_by("commit_id", "commit_seq").alias("commit_id"))
