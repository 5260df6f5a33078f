"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio between corpora.

The ratio model has two multinomials over hashed byte 4-grams: the trusted target
(documents labelled good) and the raw corpus (all documents).  A document's score is the
mean log ratio of its grams, so length does not matter, and one fixed threshold decides for
every document.  Grams never cross documents and ratios are added in fixed point, so a score
depends on the text and the model alone.

The raw multinomial counts all documents.  The target is learned from at most `SAMPLE`
good documents, chosen by a hash of the id; fewer documents make no difference to the rest.

Defined results: null and empty texts have no words and fail the base rule; repeated rows
are documents of their own; without any good label the ratio is 0 for all and only the base
rule decides; an empty table gives an empty result.  Null labels and labels of unknown
documents are ignored.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import SPACES, Words, slices, sums_by_doc, text_bytes

#: Labelled good documents that the target multinomial is learned from, at most.
SAMPLE = 20_000
#: Buckets of the hashed grams (a power of two) and bytes of a gram.
BITS = 15
#: Bits behind the point of a log ratio.
FIXED = 20
#: Mean log ratio under which a document is not kept.
THRESHOLD = -0.5
_RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Words of a repeated window.
WINDOW = 5


def _grams(buf: np.ndarray) -> np.ndarray:
    """The bucket of the 4-gram that starts at each byte but the last three."""
    if len(buf) < 4:
        return np.zeros(0, np.int64)
    b = buf.astype(np.uint32)
    code = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _inside(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Which grams lie in one document with its line feed, and where each document's grams begin."""
    n = max(0, len(words.buf) - 3)
    inside = np.ones(n, bool)
    for k in (1, 2, 3):
        last = words.doc_start[1:] - k
        inside[last[(last >= 0) & (last < n)]] = False
    return inside, np.minimum(words.doc_start, n)


def gram_counts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, raw, target: grams of all documents, and of those whose doc_id is in `target`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for rows, texts in slices(batches):
            words = Words(texts)
            inside, bounds = _inside(words)
            grams = _grams(words.buf)
            total[0] += np.bincount(grams[inside], minlength=1 << BITS)
            good = np.asarray(rows.column(1).to_pylist(), bool)
            if good.any():
                some = np.repeat(good, np.diff(bounds)) & inside
                total[1] += np.bincount(grams[some], minlength=1 << BITS)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    ids = F.broadcast(target.select(F.col("doc_id").alias("_id")).distinct().withColumn("_good", F.lit(True)))
    rows = docs.select("doc_id", text_bytes().alias("text")).join(ids, F.col("doc_id") == F.col("_id"), "left")
    counts = rows.select("text", F.coalesce("_good", F.lit(False)).alias("_good")).mapInArrow(run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratio(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The log ratio of each bucket, in 2**-FIXED nats.  Its size is fixed, 2**BITS numbers."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    counts = np.zeros((2, 1 << BITS))
    for row in gram_counts(docs, good).toLocalIterator():
        counts[:, row.bucket] = row.raw, row.target
    if not counts[1].sum():
        return np.zeros(1 << BITS, np.int64)
    raw, target = counts + 0.5
    # A gram of the target is a gram of the corpus: smoothing the target towards the corpus keeps rare grams neutral.
    target = target + 2000 * raw / raw.sum()
    return np.round((np.log(target / target.sum()) - np.log(raw / raw.sum())) * (1 << FIXED)).astype(np.int64)


def _rules(words: Words, texts: list[bytes]) -> list[np.ndarray]:
    """The counts of the base rules for each document."""
    n = words.n_docs
    widths = np.concatenate(([0], np.cumsum((words.buf & 0xC0) != 0x80)))  # code points
    chars = sums_by_doc(widths[words.ends] - widths[words.starts], words.bounds)
    marks = np.zeros(256, bool)
    marks[list(b"#*$%&|<>")] = True
    symbols = sums_by_doc(marks[words.buf], words.doc_start)
    lines = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            full = [x for x in t.split(b"\n") if x.strip(SPACES)]
            lines[i] = len(full) - len(set(full))
    repeats = np.zeros(n, np.int64)
    h, doc = words.hashes(), words.docs()
    if len(h) >= WINDOW:
        with np.errstate(over="ignore"):
            mixed = np.zeros(len(h) - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)]
                mixed ^= mixed >> np.uint64(29)
            whole = doc[WINDOW - 1 :] == doc[: len(mixed)]
            mixed = mixed + doc[: len(mixed)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(whole)
        order = at[np.argsort(mixed[at])]
        same = mixed[order[1:]] == mixed[order[:-1]]
        twice = np.zeros(len(mixed), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for k in range(WINDOW):
            covered[k : k + len(mixed)] |= twice
        repeats = sums_by_doc(covered, words.bounds)
    return [words.counts.astype(np.int64), chars, symbols, lines, repeats]


def quality(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, llr (mean log ratio) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for rows, texts in slices(batches):
            words = Words(texts)
            inside, bounds = _inside(words)
            n = sums_by_doc(inside, bounds)
            sums = sums_by_doc(np.where(inside, table[_grams(words.buf)], 0), bounds)
            llr = sums / np.maximum(n, 1) / (1 << FIXED)
            counts = _rules(words, texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts), pa.array(llr)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    rows = docs.select("doc_id", text_bytes().alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_RULES}, llr double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
