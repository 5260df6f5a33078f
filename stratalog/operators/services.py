"""Services run to a fixpoint over a commit.

A service gets the commit's operations, those new to it, and the graph as it stands, and
returns more operations.  They become visible to the next service at once; the loop ends when
a whole round adds nothing, or after `MAX_ROUNDS`.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V
from stratalog.functions.checkpoint import settle
from stratalog.functions.statements import same_statement
from stratalog.functions.vocabulary import STATEMENT
from stratalog.operators.netting import net

MAX_ROUNDS = 100
#: (commit operations, operations new to the service, graph) -> operations (statement, delta)
Service = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
OPS = [*STATEMENT, "delta", "seq"]


def fixpoint(ops: DataFrame, state: DataFrame, services: list[Service], rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame, int]:
    """The commit's operations (statement, delta, seq), the graph after it, and the rounds run.

    ops: statement, delta, seq.  New operations follow the old ones in sequence.
    """
    for service in services:
        if isinstance(service, Handler):
            service.begin()
    done = settle(ops.select(*OPS))
    graph = settle(_after(state, done))
    at, seen = 1 + (done.agg(F.max("seq")).first()[0] or 0), [-1] * len(services)
    for n in range(1, rounds + 1):
        changed = False
        for k, service in enumerate(services):
            new = settle(service(done, done.where(F.col("seq") > seen[k]), graph).select(*STATEMENT, "delta").distinct().withColumn("seq", F.lit(at).cast("long") + F.when(F.col("delta") < 0, 0).otherwise(1)))
            seen[k] = at + 1
            if new.isEmpty():
                continue
            changed, at = True, at + 2
            done = settle(done.union(new))
            graph = settle(_after(graph, new))
        if not changed:
            return done, graph, n
    warnings.warn(f"services did not settle in {rounds} rounds", stacklevel=2)
    return done, graph, rounds


def _after(state: DataFrame, ops: DataFrame) -> DataFrame:
    last = ops.groupBy(*STATEMENT).agg(F.max_by("delta", "seq").alias("_d"))
    kept = state.join(last, same_statement(state, last), "left_anti").select(*STATEMENT)
    return kept.union(last.where("_d > 0").select(*STATEMENT))


def commit_of(ops: DataFrame) -> DataFrame:
    """The net commit of a transaction's operations."""
    return net(ops, group=[])


class Handler:
    """What services and mergers have in common: a name, a configuration and a logger.

    Subclasses implement __call__.  A handler that counts anything starts anew with each commit,
    in `begin`.
    """

    def __init__(self, name: str, config: dict | None = None):
        self.name, self.config, self.log = name, dict(config or {}), logging.getLogger(f"{__name__}.{name}")

    def begin(self) -> None:
        """A commit's run begins."""

    def describe(self, position: int) -> list[tuple[str, str, str, str]]:
        """The handler's configuration as statements (subject, predicate, object, datatype); positions start at 1."""
        subject = f"{V.META}handler/{self.name}"
        rows = [(subject, V.META + "handler/position", str(position), V.XSD + "int")]
        return rows + [(subject, f"{V.META}handler/{k}", str(v), V.XSD + "string") for k, v in sorted(self.config.items())]


class _SignFlip(Handler):
    def __init__(self, predicate: str, sign: int, limit: int):
        super().__init__("sign-flip", {"predicate": predicate, "sign": sign, "limit": limit})
        self.predicate, self.sign, self.limit, self.left = predicate, sign, limit, limit

    def begin(self) -> None:
        self.left = self.limit

    def __call__(self, _: DataFrame, new: DataFrame, graph: DataFrame) -> DataFrame:
        value = F.col("object").try_cast("long")
        held = graph.where((F.col("predicate") == self.predicate) & (value * self.sign > 0))
        if self.left <= 0:
            held = held.limit(0)
        self.left -= 1
        flip = (-self.sign * (F.abs(value) + 1)).cast("string")
        return held.withColumn("delta", F.lit(-1)).union(held.withColumn("object", flip).withColumn("delta", F.lit(1)))


def sign_flip(predicate: str, sign: int, limit: int = 10) -> Service:
    """A number of this sign becomes one of the other sign, larger by 1, up to `limit` times in a commit."""
    return _SignFlip(predicate, sign, limit)


def undo_all() -> Service:
    """Takes back everything that is new."""

    def run(done: DataFrame, new: DataFrame, graph: DataFrame) -> DataFrame:
        return commit_of(new).select(*STATEMENT, (-F.col("net")).alias("delta"))

    return run


def flag(predicate: str, value: str, add: bool) -> Service:
    """Adds a flag to every new subject, or removes it where it is."""

    def run(_: DataFrame, new: DataFrame, graph: DataFrame) -> DataFrame:
        flagged = new.select("subject").distinct().select("subject", F.lit(predicate).alias("predicate"), F.lit(value).alias("object"), F.lit(None).cast("string").alias("datatype"))
        if add:
            return flagged.join(graph, same_statement(flagged, graph), "left_anti").withColumn("delta", F.lit(1))
        return flagged.join(graph, same_statement(flagged, graph), "left_semi").withColumn("delta", F.lit(-1))

    return run


class Registry:
    """Names of services and the factories that make them from (branch, configuration)."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[[str, dict], Service]] = {}

    def register(self, name: str, factory: Callable[[str, dict], Service]) -> None:
        self._factories[name] = factory

    def unregister(self, name: str) -> None:
        self._factories.pop(name, None)

    def get(self, name: str) -> Callable[[str, dict], Service] | None:
        return self._factories.get(name)

    def build(self, branch: str, configured: list[tuple[str, dict]]) -> list[Service]:
        """Services in configured order; an unknown name is an error."""
        missing = [n for n, _ in configured if n not in self._factories]
        if missing:
            raise LookupError(f"no factory for {', '.join(missing)}")
        return [self._factories[n](branch, c) for n, c in configured]
