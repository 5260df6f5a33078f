"""What the training-data operators share: folds, checkpoints, and text held as numpy arrays.

Texts reach Python as UTF-8 bytes.  A slice of documents is one byte array with a line
feed after each document, so words never cross documents; words, their hashes and their
documents are found with whole-array operations.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at once, unless one document is longer.
SLICE_BYTES = 2 << 20
#: Words are maximal runs of anything but these.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1


def fold(column: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (a null id counts as an empty text)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; Spark removes it when nothing refers to it.

    Shuffle files of what is now cut off stay until the driver's garbage is collected, which a
    loop of small steps may not cause for long, so it is asked for here, from time to time.
    """
    _shared_folder(df.sparkSession)
    cut = df.checkpoint()
    if time.monotonic() - _released[0] > RELEASE_SECONDS:
        release(df.sparkSession)
    return cut


#: Least seconds between two releases in a loop of steps, and when the last one was.
RELEASE_SECONDS = 1.5
_released = [0.0]


def release(spark: SparkSession, rounds: int = 1) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more.

    What Python drops, the driver's JVM drops a moment later, so files of the last step go in a second round.
    """
    for k in range(rounds):
        time.sleep(0.5 if k else 0)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    _released[0] = time.monotonic()


#: Rows of a small table that one task takes on.
TASK_ROWS = 100_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def narrow(df: DataFrame) -> DataFrame:
    """As settle, in as many partitions as the rows need at most: few rows make few files, and what fits one task needs no shuffle."""
    held = df.persist()
    tasks = tasks_for(held.count())
    cut = settle(held.coalesce(tasks)).coalesce(tasks)
    held.unpersist()
    return cut


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, for rows with texts."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As stored, and the folder of the table, for `discard`."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body) -> Column:
    """body of the value, which is made once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Marked for broadcast if it has at most `limit` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix(11, 256)
_STEP = int(_splitmix(12, 1)[0]) & ~3 | 3
_BACK = pow(_STEP, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[which] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, at_column: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts (column `text` or the one at a place, bytes or strings, null is empty) in pieces of about `limit` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text") if at_column is None else at_column)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):  # the same bytes, not copied
            column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
        if column.null_count:
            column = pc.fill_null(column, b"")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(column):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(at, end - at), column.slice(at, end - at).to_pylist()
            at = end


class Words:
    """The words of a slice: byte positions, documents and hashes."""

    def __init__(self, texts: list[bytes], table: bytes | None = None, spaces: bytes = SPACES):
        """table: bytes are translated with it first (it must not touch line feeds)."""
        self.n_docs = len(texts)
        data = b"\n".join(texts) + b"\n"
        if table is not None:
            data = data.translate(table)
        self.data, self.buf = data, np.frombuffer(data, np.uint8)
        gap = np.zeros(256, bool)
        gap[list(spaces)] = True
        inside = ~gap[self.buf]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc_start = np.concatenate(([0], np.cumsum(lengths)))
        self.bounds = np.searchsorted(self.starts, self.doc_start)
        self.counts = np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        n = len(self.buf)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.buf] * _power("up", _STEP, n), dtype=np.uint64)))
            return mix64((sums[self.ends] - sums[self.starts]) * _power("down", _BACK, n)[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def hash_bytes(word: bytes) -> int:
    """The hash that Words gives to this word."""
    return int(Words([word], spaces=b"\n").hashes()[0])


def lower_table() -> bytes:
    """Lower-cases A-Z and leaves every other byte."""
    return bytes(range(256)).lower()


def sums_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between successive bounds."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


class Lookup:
    """An open-addressing table from 64-bit keys (not 0) to their positions, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.int64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        self.probes = 0
        number, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], number[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, number, slot = keys[rest], number[rest], self._next(slot[rest])
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if it is not there."""
        keys = np.ascontiguousarray(keys).view(np.int64)
        slot = self._slot(keys)
        got = self.keys[slot]
        found = np.where(got == keys, self.at[slot], -1)
        open_ = np.flatnonzero((got != keys) & (got != 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = self._next(slot[open_])
            got = self.keys[slot[open_]]
            same = got == keys[open_]
            found[open_[same]] = self.at[slot[open_[same]]]
            open_ = open_[~same & (got != 0)]
        return found
