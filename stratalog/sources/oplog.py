"""The change log that stands in for captured changes: one operation for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.vocabulary import XSD

#: Events' weeks are commits; the first one starts here.
EPOCH_US, WEEK_US = 1_704_067_200_000_000, 604_800_000_000
WEEK_MS = WEEK_US // 1000


def operations(events: DataFrame) -> DataFrame:
    """seq, branch_id, commit_seq, late (second half of the week), statement and delta (+1 add, -1 remove)."""
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    return events.select(
        F.col("event_id").alias("seq"),
        F.expr("cast((user_id div 10) % 3 as int)").alias("branch_id"),
        F.floor(us / WEEK_US).cast("int").alias("commit_seq"),
        (F.pmod(us, F.lit(WEEK_US)) >= WEEK_US // 2).alias("late"),
        F.concat(F.lit("http://ex/artifact/"), F.expr("cast(user_id % 10 as string)")).alias("subject"),
        F.concat(F.lit("http://ex/p#"), F.col("event_type")).alias("predicate"),
        (k % 5).cast("string").alias("object"),
        F.lit(XSD + "int").alias("datatype"),
        F.when(F.floor(k / 5) % 2 == 0, 1).otherwise(-1).cast("int").alias("delta"),
    )


def read_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(spark.read.parquet(f"{sf_dir}/events.parquet"))
