"""Graph states from net changes: latest, as of a commit, compared, undone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.statements import same_statement
from stratalog.functions.vocabulary import STATEMENT


def snapshot(netted: DataFrame, until: int | None = None, order: tuple[str, ...] = ("commit_seq",), keys: tuple[str, ...] = ("branch_id",)) -> DataFrame:
    """The statements whose last change adds them; a commit removes before it adds."""
    seen = netted if until is None else netted.where(F.col("commit_seq") <= until)
    last = F.max_by("net", F.struct(*order, "net"))
    return seen.groupBy(*keys, *STATEMENT).agg(last.alias("_net")).where("_net = 1").drop("_net")


def of_branch(state: DataFrame, branch: int) -> DataFrame:
    return state.where(F.col("branch_id") == branch).select(*STATEMENT)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statements of one graph only, with the side that has them.  Both sides in one aggregation."""
    both = a.select(*STATEMENT, F.lit(1).alias("_side")).union(b.select(*STATEMENT, F.lit(2).alias("_side")))
    only = both.groupBy(*STATEMENT).agg(F.bit_or("_side").alias("_sides")).where("_sides < 3")
    return only.select(*STATEMENT, F.when(F.col("_sides") == 1, "left").otherwise("right").alias("side"))


def undo(netted: DataFrame) -> DataFrame:
    """The inverse commit: sides swapped."""
    return netted.withColumn("net", -F.col("net"))


def apply(state: DataFrame, netted: DataFrame) -> DataFrame:
    """A graph after a commit: removals first, then additions."""
    removed, added = netted.where("net < 0"), netted.where("net > 0").select(*STATEMENT)
    left = state.alias("s").join(removed.alias("r"), same_statement(state, removed), "left_anti")
    return left.select(*STATEMENT).union(added).distinct()
