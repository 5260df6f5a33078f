"""The log operators as Structured Streaming queries; each gives what its batch twin gives on the same log.

Operations of a transaction may arrive in several micro-batches.  Netting keeps the walk of
each statement as state, so no operation is read twice and none is held back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.functions.vocabulary import STATEMENT
from stratalog.sources.oplog import operations

KEYS = ["branch_id", "commit_seq", *STATEMENT]


def read_events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def read_log(spark: SparkSession, path: str, ddl: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(path)


def _folder(spark: SparkSession) -> str:
    from stratalog.functions.checkpoint import settle  # noqa: F401  (the same folder as checkpoints)

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        settle(spark.range(1))
    return f"{context.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, write=None, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns the table it made.

    write(batch, number, path) puts a micro-batch in the table at path.
    """
    spark = stream.sparkSession
    folder = folder or _folder(spark)
    table = f"{folder}/table"

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces what it wrote before.
        (write or (lambda b, n, p: b.write.mode("overwrite").parquet(f"{p}/batch={n}")))(batch, number, table)

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", table).parquet(table)


def net_walks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The clamped walk of a statement over all its operations so far; operations of a micro-batch go by seq."""
    at = state.get[0] if state.exists else 0
    rows = pd.concat(list(frames)).sort_values("seq")
    for d in rows["delta"]:
        at = max(-1, min(1, at + int(d)))
    state.update((at,))
    yield pd.DataFrame([(*key, at, int(rows["seq"].max()))], columns=[*KEYS, "net", "upto"])


def net_stream(ops: DataFrame) -> DataFrame:
    """Updates of each statement's net change: the last one by `upto` holds."""
    kinds = {f.name: f.dataType.simpleString() for f in ops.schema.fields}
    out = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", net int, upto long"
    return ops.groupBy(*KEYS).applyInPandasWithState(net_walks, out, "at int", "update", GroupStateTimeout.NoTimeout)


def net_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net changes of the events stream."""
    from stratalog.functions.shipping import ship

    ship(spark)
    updates = run_once(net_stream(operations(read_events(spark, sf_dir))), mode="update")
    return updates.groupBy("branch_id", "commit_seq", *STATEMENT).agg(F.max_by("net", "upto").alias("net")).where("net <> 0")


def dedup_stream(deliveries: DataFrame) -> DataFrame:
    """Deliveries whose commit has not been seen at its destination: the state is the seen set."""
    return deliveries.dropDuplicates(["dst", "commit_id"])


def merge_dedup(deliveries: DataFrame) -> DataFrame:
    """The deliveries of a batch table as a stream, each commit once for each destination."""
    spark = deliveries.sparkSession
    folder = _folder(spark)
    deliveries.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(deliveries.schema).parquet(f"{folder}/in")
    return run_once(dedup_stream(stream), folder=folder).drop("batch")


def snapshot_stream(changes: DataFrame) -> DataFrame:
    """The last change of each statement (an aggregation in complete mode)."""
    return changes.groupBy("branch_id", *STATEMENT).agg(F.max_by("net", F.struct("commit_seq", "net")).alias("net"))


def snapshot(changes: DataFrame) -> DataFrame:
    """The live statements of a batch table of net changes, kept by a stream."""
    spark = changes.sparkSession
    folder = _folder(spark)
    changes.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(changes.schema).parquet(f"{folder}/in")
    whole = run_once(snapshot_stream(stream), write=lambda b, n, p: b.write.mode("overwrite").parquet(f"{p}/batch=0"), mode="complete", folder=folder)
    return whole.where("net = 1").drop("net", "batch")


def index_history(changes: DataFrame, buckets: int = 64) -> DataFrame:
    """The history of a batch table of net changes, indexed by a stream: clustered by a bucket of the container."""
    from stratalog.operators import history

    spark = changes.sparkSession
    folder = _folder(spark)
    changes.write.parquet(f"{folder}/in")
    stream = history.history(spark.readStream.schema(changes.schema).parquet(f"{folder}/in"))

    def put(batch: DataFrame, number: int, path: str) -> None:
        bucket = F.pmod(F.xxhash64("container"), F.lit(buckets))
        batch.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return run_once(stream, write=put, folder=folder).drop("batch")


def of_container(index: DataFrame, container: str, buckets: int = 64) -> DataFrame:
    """A container's history; the bucket prunes the files to read."""
    bucket = index.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(container)), F.lit(buckets)).alias("b")).first().b
    return index.where((F.col("bucket") == bucket) & (F.col("container") == container))
