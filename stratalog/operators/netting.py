"""Netting of add and remove operations, and what follows from it.

A statement's operations within a transaction are a walk on {-1, 0, +1} that stops at the
ends; where it ends is the net change.  Such walks compose (x -> clamp(x + c, lo, hi)), so
operations are folded in chunks of the sequence first and a hot statement never has to fit
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions.vocabulary import STATEMENT

TRANSACTION = ["branch_id", "commit_seq"]
#: Sequence numbers of a chunk.
CHUNK = 65_536


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1), F.least(F.lit(1), x))


def net(ops: DataFrame, group: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """group, statement, net (+1 or -1) and first_seq; statements without a net change are left out."""
    keys = [*(TRANSACTION if group is None else group), *STATEMENT]
    step = lambda w, x: F.struct((w["c"] + x["delta"]).alias("c"), _clamp(w["lo"] + x["delta"]).alias("lo"), _clamp(w["hi"] + x["delta"]).alias("hi"))
    start = F.struct(F.lit(0).alias("c"), F.lit(-1).alias("lo"), F.lit(1).alias("hi"))
    walks = ops.groupBy(*keys, F.floor(F.col("seq") / chunk).alias("_chunk")).agg(
        F.aggregate(F.sort_array(F.collect_list(F.struct("seq", "delta"))), start, step).alias("walk"), F.min("seq").alias("first_seq")
    )
    follow = lambda x, w: F.greatest(w["walk"]["lo"], F.least(w["walk"]["hi"], x + w["walk"]["c"]))
    folded = walks.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("_chunk", "walk"))), F.lit(0), follow).cast("int").alias("net"), F.min("first_seq").alias("first_seq"))
    return folded.where("net <> 0")


def with_op(netted: DataFrame) -> DataFrame:
    """op in place of net."""
    return netted.withColumn("op", F.when(F.col("net") > 0, "ADD").otherwise("REMOVE")).drop("net")


def counts(netted: DataFrame) -> DataFrame:
    """n_add and n_remove of each transaction."""
    return netted.groupBy(*TRANSACTION).agg(F.count_if(F.col("net") > 0).alias("n_add"), F.count_if(F.col("net") < 0).alias("n_remove"))


def first_occurrences(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Set semantics in insertion order: the smallest seq of each key."""
    return ops.groupBy(*keys).agg(F.min("seq").alias("seq"))


def effective(netted: DataFrame) -> DataFrame:
    """Changes that change the graph: an add of an absent statement, a remove of a present one."""
    before = F.coalesce(F.lag("net").over(W.partitionBy("branch_id", *STATEMENT).orderBy("commit_seq")), F.lit(-1))
    return netted.withColumn("_before", before).where("net <> _before").drop("_before")


def without_effectless(ops: DataFrame, group: list[str] | None = None) -> DataFrame:
    """group, statement, op of both sides of a commit after services ran on it.

    ops: delta and `by_service`.  A statement on both sides goes from both if a service put it
    on either of them.
    """
    keys = [*(TRANSACTION if group is None else group), *STATEMENT]
    side = lambda delta, service: F.max((F.col("delta") == delta) & (F.col("by_service") == F.lit(service)))
    sides = ops.groupBy(*keys).agg(side(1, False).alias("base_add"), side(-1, False).alias("base_remove"), side(1, True).alias("add"), side(-1, True).alias("remove"))
    added, removed = F.col("base_add") | F.col("add"), F.col("base_remove") | F.col("remove")
    kept = sides.where(~(added & removed & ~(F.col("base_add") & F.col("base_remove"))))
    each = F.array_compact(F.array(F.when(added, "ADD"), F.when(removed, "REMOVE")))
    return kept.select(*keys, F.explode(each).alias("op"))
