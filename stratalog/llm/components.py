"""Connected components of an undirected graph: by alternating large and small stars, or in one task if it is small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import narrow, tasks_for


def _large(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour, or to itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them.  Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()


#: Types of nodes that Python orders as Spark does.
_ORDERED = (T.IntegralType, T.StringType, T.BinaryType)


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The components of edges that one task takes on, by union-find under the smallest node."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict = {}

        def top(x):
            while over[x] != x:
                over[x] = over[over[x]]
                x = over[x]
            return x

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(over.setdefault(a, a)), top(over.setdefault(b, b))
                over[max(x, y)] = min(x, y)
        if over:
            yield pa.RecordBatch.from_arrays([pa.array(list(over), arrow), pa.array([top(x) for x in over], arrow)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b).

    Edges for one task need no rounds, each of which costs the driver some plans.  Else each round
    is cut from its lineage, and their number grows with the logarithm of the size.  Nulls, loops
    and repeated edges are ignored.
    """
    known = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known, state = narrow(known), None
    while True:
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tasks = tasks_for(2 * now[0])
        if tasks == 1 and isinstance(known.schema["a"].dataType, _ORDERED):
            return _in_one_task(known)
        if now == state or not now[0]:
            break
        state = now
        known = narrow(_small(_large(known, tasks), tasks))
    return known.select(F.col("a").alias("node"), F.col("b").alias("component")).union(known.select(F.col("b"), F.col("b")).distinct()).coalesce(tasks)


def extend(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, component) after more edges (a, b).  Only components that the edges join are worked on."""
    joined = edges.join(labels.alias("x"), F.col("a") == F.col("x.node"), "left").join(labels.alias("y"), F.col("b") == F.col("y.node"), "left")
    between = joined.select(F.coalesce("x.component", "a").alias("a"), F.coalesce("y.component", "b").alias("b"))
    moved = narrow(components(between)).toDF("_from", "_to")
    old = labels.join(moved, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = moved.join(labels, F.col("_from") == F.col("node"), "left_anti").toDF("node", "component")
    return narrow(old.union(new))
