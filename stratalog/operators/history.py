"""The history of resources: change rows by container, scopes, time ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.vocabulary import STATEMENT
from stratalog.operators.commits import commit_id
from stratalog.sources.oplog import WEEK_MS


def history(netted: DataFrame) -> DataFrame:
    """branch_id, commit_id, ts, seq, op, statement, container and container_prop of every change.

    Within a timestamp additions come before removals, as a commit lists them.
    """
    has = set(netted.columns)
    owner = F.coalesce(F.col("containingsubject"), F.col("subject")) if "containingsubject" in has else F.col("subject")
    prop = F.coalesce(F.col("containmentpredicate"), F.col("predicate")) if "containmentpredicate" in has else F.col("predicate")
    return netted.select(
        "branch_id",
        commit_id(F.col("branch_id"), F.col("commit_seq")).alias("commit_id"),
        (F.col("commit_seq").cast("long") * WEEK_MS).alias("ts"),
        F.col("first_seq").alias("seq"),
        F.when(F.col("net") > 0, "ADD").otherwise("REMOVE").alias("op"),
        *STATEMENT,
        owner.alias("container"),
        prop.alias("container_prop"),
    )


def order_key():
    """Total order of history rows: time, additions before removals, sequence."""
    return F.struct(F.col("ts"), (F.col("op") == "REMOVE").alias("late"), F.col("seq"))


def of_resource(rows: DataFrame, branch: int, resource: str) -> DataFrame:
    return rows.where((F.col("branch_id") == branch) & (F.col("container") == resource))


def of_resources(rows: DataFrame, branch: int, resources: list[str]) -> DataFrame:
    return rows.where((F.col("branch_id") == branch) & F.col("container").isin(resources))


def in_scope(rows: DataFrame, scope: DataFrame, raw: bool = False) -> DataFrame:
    """Rows whose container and property, or raw subject and predicate, are in scope (subject, predicate)."""
    a, b = ("subject", "predicate") if raw else ("container", "container_prop")
    wanted = scope.select(F.col("subject").alias("_s"), F.col("predicate").alias("_p")).distinct()
    return rows.join(wanted, (F.col(a) == F.col("_s")) & (F.col(b) == F.col("_p")), "left_semi")


def since(rows: DataFrame, ts: int) -> DataFrame:
    return rows.where(F.col("ts") >= ts)


def subjects(rows: DataFrame) -> DataFrame:
    """Which resources each commit touches."""
    return rows.where(F.col("subject").startswith("http")).select("branch_id", "commit_id", "subject").distinct()
