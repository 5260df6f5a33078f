"""Time travel without iteration: revert, play forward, widen the scope.

The state before the first change is decided by each statement's earliest row, the state at a
time by its latest row up to then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions.statements import same_statement
from stratalog.functions.vocabulary import STATEMENT
from stratalog.operators.history import in_scope, order_key, since


def _decided(state: DataFrame, verdict: DataFrame) -> DataFrame:
    """The state with the statements of the verdict (statement, present) put right."""
    kept = state.join(verdict, same_statement(state, verdict), "left_anti").select(*STATEMENT)
    return kept.union(verdict.where("present").select(*STATEMENT))


def revert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state before all these rows: an added statement is absent, a removed one present."""
    first = rows.groupBy(*STATEMENT).agg(F.min_by("op", order_key()).alias("_op")).withColumn("present", F.col("_op") == "REMOVE")
    return _decided(state, first)


def forward(state: DataFrame, rows: DataFrame, until: int) -> DataFrame:
    """The reverted state after playing all rows with ts <= until."""
    last = rows.where(F.col("ts") <= until).groupBy(*STATEMENT).agg(F.max_by("op", order_key()).alias("_op")).withColumn("present", F.col("_op") == "ADD")
    return _decided(state, last)


def steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """step (from 1), ts and n_entries: the timestamps that playing forward stops at."""
    stops = rows.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n_entries"))
    return stops.withColumn("step", F.row_number().over(W.partitionBy(*keys).orderBy("ts")) if keys else F.row_number().over(W.orderBy("ts")))


def next_timestamp(stops: DataFrame, step: int) -> int:
    """The timestamp that the next step plays, -1 when all are played."""
    found = stops.where(F.col("step") > step).agg(F.min("ts")).first()[0]
    return -1 if found is None else found


class Session:
    """A replay of one branch: revert once, then play forward, widening the scope on the way."""

    def __init__(self, state: DataFrame, rows: DataFrame, scope: DataFrame):
        self._all, self.scope = rows, scope.select("subject", "predicate").distinct()
        self.rows, self.state, self.at, self.done = in_scope(rows, scope), state, None, False

    def revert(self) -> DataFrame:
        self.base = self.state = revert(self.state, self.rows)
        self.at = None
        return self.state

    def play_forward(self) -> DataFrame:
        """The entries of the next timestamp, now applied; none at the end."""
        later = self.rows if self.at is None else self.rows.where(F.col("ts") > self.at)
        found = later.agg(F.min("ts")).first()[0]
        if found is None:
            self.done = True
            return self.rows.limit(0)
        self.at = found
        self.state = forward(self.base, self.rows, found)
        return self.rows.where(F.col("ts") == found).orderBy(order_key())

    def widen(self, scope: DataFrame) -> None:
        """Adds to the scope: the new part alone is reverted to the present point of the replay."""
        if self.done:
            raise ValueError("the replay has ended")
        new = scope.select("subject", "predicate").distinct().join(self.scope, ["subject", "predicate"], "left_anti")
        rows = in_scope(self._all, new)
        self.base = revert(self.base, rows)
        self.rows, self.scope = self.rows.union(rows), self.scope.union(new)
        self.state = self.base if self.at is None else forward(self.base, self.rows, self.at)


def widen(state: DataFrame, rows: DataFrame, scope: DataFrame, more: DataFrame, at: int) -> DataFrame:
    """A state replayed up to, not including, `at`, after its scope was widened: only rows of the new part from `at` on are undone."""
    new = more.select("subject", "predicate").join(scope, ["subject", "predicate"], "left_anti")
    return revert(state, since(in_scope(rows, new), at))
