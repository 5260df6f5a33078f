"""The commit log, the delivery log, snapshots and named state as tables; statements as JSON and N-Triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V


def statement_json() -> Column:
    """A statement as JSON: containment only where it differs, a datatype only for literals."""
    return F.struct(
        F.nullif(F.col("containingsubject"), F.col("subject")).alias("containingsubject"),
        F.col("subject"),
        F.nullif(F.col("containmentpredicate"), F.col("predicate")).alias("containmentpredicate"),
        F.col("predicate"),
        F.col("datatype"),
        F.col("object"),
    )


def encode(commits: DataFrame) -> DataFrame:
    """branch_id, seq and the commit as a JSON body.  commits has the columns of COMMIT_DDL and branch_id, seq."""
    fields = [c.split()[0] for c in ("commitId", "originatingBranchId", "commitMessage", "precedingCommitId", "timeStamp", "addedStatements", "removedStatements")]
    return commits.select("branch_id", "seq", F.to_json(F.struct(*fields)).alias("body"))


def decode(events: DataFrame) -> DataFrame:
    return events.select("branch_id", "seq", F.from_json("body", V.COMMIT_DDL).alias("c")).select("branch_id", "seq", "c.*")


class CommitLog:
    """An append-only log in Parquet, a directory for each branch.

    Readers get commits oldest first by `seq`; Parquet statistics prune suffix scans.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        """events: EVENT_DDL."""
        events.select("branch_id", "seq", "commitUUID", "batchId", "totalBatches", "body").repartitionByRange("branch_id", "seq").sortWithinPartitions("branch_id", "seq").write.mode("append").partitionBy("branch_id").parquet(self.path)

    def events(self) -> DataFrame:
        """All events; none if nothing was ever appended."""
        try:
            return self.spark.read.schema(V.EVENT_DDL).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], V.EVENT_DDL)
            raise

    def commits(self, branch: str | None = None) -> DataFrame:
        """Whole commits, multi-part ones joined again."""
        from stratalog.operators.commits import rejoin_events

        events = self.events() if branch is None else self.events().where(F.col("branch_id") == branch)
        return rejoin_events(events)

    def rows(self, branch: str | None = None) -> DataFrame:
        """Operation rows of whole commits."""
        from stratalog.operators.commits import rejoin_rows

        return rejoin_rows(self.events() if branch is None else self.events().where(F.col("branch_id") == branch))

    def heads(self, branch: str) -> DataFrame:
        """commitId, commitMessage, precedingCommitId, timeStamp and seq of a branch's whole commits, without statements."""
        kinds = "commitId STRING, commitMessage STRING, precedingCommitId STRING, timeStamp BIGINT"
        parsed = self.events().where(F.col("branch_id") == branch).select("commitUUID", "seq", "batchId", "totalBatches", F.from_json("body", kinds).alias("c"))
        whole = parsed.groupBy("commitUUID").agg(F.min("seq").alias("seq"), F.min_by("c", "batchId").alias("c"), F.count_distinct("batchId").alias("_n"), F.max("totalBatches").alias("_all"))
        return whole.where("_n = _all").select("c.*", "seq")

    def after(self, branch: str, commit_id: str | None) -> DataFrame:
        """Commits of a branch after the one named, exclusively; all for null."""
        from stratalog.operators.commits import suffix

        return suffix(self.commits(branch), commit_id, inclusive=False)

    def drop(self, branch: str) -> None:
        """Removes a branch's events."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/branch_id={branch}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Snapshots:
    """Named graphs on disk."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, statements: DataFrame) -> None:
        statements.select(*V.STATEMENT).distinct().write.mode("overwrite").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame | None:
        """None if there is no such graph."""
        try:
            return self.spark.read.schema("subject STRING, predicate STRING, object STRING, datatype STRING").parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def remove(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return bool(folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def latest_state(writes: DataFrame) -> DataFrame:
    """key, value: the last write of each key.  writes: key, value, seq."""
    return writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


class Deliveries:
    """The delivery log: which commit of which branch reached which branch, in order, and what became of it."""

    SCHEMA = V.DELIVERY_DDL + ", status STRING"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, deliveries: DataFrame) -> None:
        """deliveries: the columns of SCHEMA; a record is never split."""
        deliveries.select("seq", "commitId", "sendingBranchId", "receivingBranchId", "status").write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        """All records; none if nothing was ever appended."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def after(self, branch: str, commit_id: str | None) -> DataFrame:
        """Deliveries to a branch after that of the commit named, exclusively; all for null."""
        from stratalog.operators.commits import suffix

        return suffix(self.all().where(F.col("receivingBranchId") == branch), commit_id, inclusive=False)


_LITERAL = r'"((?:[^"\\]|\\.)*)"'
_TRIPLE = r"^\s*(<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(<([^>]*)>|_:(\S+)|" + _LITERAL + r"(\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(#.*)?$"
#: What stands behind a backslash, and what it means.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
#: Strings of a language have this datatype and the language behind it.
LANG_STRING = V.RDF + "langString"


def unescape(text: Column) -> Column:
    r"""Escapes of N-Triples, each read once from left to right; \\u and \\U give characters by number."""
    signs = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def read(part: Column) -> Column:
        code = F.conv(F.substring(part, 3, 8), 16, 10).cast("int")
        # A code point as UTF-32: four bytes, highest first.
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(part.rlike(r"^\\[uU]"), wide).when(part.startswith("\\"), F.coalesce(F.try_element_at(signs, F.substring(part, 2, 1)), part)).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.concat_ws("", F.transform(parts, read))).otherwise(text)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, meant in ESCAPES.items():
        if sign not in ("\\", "'"):
            out = F.replace(out, F.lit(meant), F.lit("\\" + sign))
    return out


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Statements of an N-Triples file; lines that are none are left out, and a missing file has none.

    The datatype of a string in a language is `LANG_STRING`, an @ and the language.
    """
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    g = lambda i: F.nullif(F.regexp_extract("value", _TRIPLE, i), F.lit(""))
    is_literal = F.regexp_extract("value", _TRIPLE, 5).startswith('"')
    tagged = F.concat(F.lit(LANG_STRING + "@"), g(11))
    return text.where(F.col("value").rlike(_TRIPLE)).select(
        F.coalesce(g(2), g(3)).alias("subject"),
        g(4).alias("predicate"),
        F.when(is_literal, unescape(F.regexp_extract("value", _TRIPLE, 8))).otherwise(F.coalesce(g(6), g(7))).alias("object"),
        F.when(is_literal, F.coalesce(g(10), tagged, F.lit(V.XSD + "string"))).alias("datatype"),
    )


def write_triples(statements: DataFrame, path: str) -> None:
    node = lambda c: F.when(F.col(c).startswith("http"), F.concat(F.lit("<"), F.col(c), F.lit(">"))).otherwise(F.concat(F.lit("_:"), F.col(c)))
    kind = F.col("datatype")
    suffix = F.when(kind.startswith(LANG_STRING + "@"), F.concat(F.lit("@"), F.substring_index(kind, "@", -1))).otherwise(F.concat(F.lit("^^<"), kind, F.lit(">")))
    literal = F.concat(F.lit('"'), escape(F.col("object")), F.lit('"'), suffix)
    line = F.concat_ws(" ", node("subject"), F.concat(F.lit("<"), F.col("predicate"), F.lit(">")), F.when(kind.isNotNull(), literal).otherwise(node("object")), F.lit("."))
    statements.select(line.alias("value")).write.mode("overwrite").text(path)
