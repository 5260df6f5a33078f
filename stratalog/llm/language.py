"""Language identification by multilingual mixture inference.

Byte 3-grams of lower-cased letters are hashed into buckets; each language has a smoothed
multinomial over them, learned from labelled documents.  Grams never cross documents.  A
document is a mixture of languages: expectation-maximisation over its grams estimates the
proportions, and the language set grows from the likeliest language by the one that adds most,
as long as the penalised likelihood rises (half a log of the grams for each language).  The
prediction is the set's largest language, the score its proportion.

A document is known to be in learned languages if its grams are about as likely as grams of
the predicted language are: not less likely, on average, by `STRANGE` nats and by `SIGMAS`
standard errors, grams of one word or code taken as one observation.

Defined results: a null text or one without a letter is `und` with score 0 and not known, as
is every text if there is nothing to learn from.  Ties go to the first language by code point.
Of more than `LANGS` languages those with most grams are learned, so the model has a bounded
size.  Repeated rows are scored each; rows with a null lang or text teach nothing; other
columns are ignored, or kept by `known_only`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import settle, slices, text_bytes

#: Buckets of the hashed grams, as a power of two.
BITS = 15
#: Rounds of expectation-maximisation.
ROUNDS = 12
#: Proportion under which a language is not tried as a member of the set.
LEAST = 0.05
#: Languages learned at most.
LANGS = 256
#: Nats a gram, and standard errors, by which the grams of a document in unlearned languages are too unlikely.
STRANGE, SIGMAS = 2.0, 6.0
#: Grams that are strange or not together, as those of a code or an address.
TOGETHER = 16
#: Stands between documents; no UTF-8 text has it.
_BETWEEN = 0xFF
#: Nats of the penalty for each language more, in half log grams.
PENALTY = 4.0
UNKNOWN = "und"


def _table() -> np.ndarray:
    """Letters lower-cased; other ASCII is a blank."""
    t = np.full(256, 32, np.uint32)
    for c in range(ord("a"), ord("z") + 1):
        t[c] = t[c - 32] = c
    t[128:] = np.arange(128, 256)
    return t


_LETTER = _table()


def _codes(text: bytes) -> np.ndarray:
    """The buckets of the 3-grams of the text, or of texts with " \\xff " between them; runs of blanks are taken as one."""
    b = _LETTER[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    apart = b == _BETWEEN
    if apart.any():
        code = code[~(apart[:-2] | apart[1:-1] | apart[2:])]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over documents with a lang and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, texts in slices(batches):
            langs = rows.column(1).to_pylist()
            for lang in set(langs):
                have = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                have += np.bincount(_codes(b" \xff ".join(t for t, x in zip(texts, langs, strict=True) if x == lang)), minlength=1 << BITS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.where("lang is not null and text is not null").select(text_bytes().alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their probabilities of each bucket; a row of 2**BITS for each language."""
    grams = settle(gram_counts(docs))
    top = grams.groupBy("lang").agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), "lang").limit(LANGS).select("lang")
    langs = sorted((r.lang for r in top.collect()), key=lambda x: x.encode())
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    number, n = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), 1 << BITS))
    for row in grams.where(F.col("lang").isin(langs)).toLocalIterator():
        n[number[row.lang], row.bucket] = row.n
    every = (n.sum(0) + 0.1) / (n.sum() + 0.1 * n.shape[1])
    p = (n + 50 * every) / (n.sum(1, keepdims=True) + 50)  # towards all languages, with the weight of 50 grams
    return langs, 0.999 * p + 0.001 * every


def typical(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the log probability of a gram of each language."""
    mean = (p * np.log(p)).sum(1)
    return mean, (p * np.log(p) ** 2).sum(1) - mean**2


def _mix(p: np.ndarray, n: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions after some rounds, and the log-likelihood under them."""
    total = n.sum()
    for _ in range(rounds):
        theta = theta * (p @ (n / (theta @ p))) / total
    return theta, float(n @ np.log(theta @ p))


def infer(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages in the chosen set, 0 for the others, and the log-likelihood.  p: languages x grams."""
    theta, _ = _mix(p, n, np.full(len(p), 1 / len(p)), ROUNDS)
    order = np.argsort(-theta, kind="stable")
    tries = [i for i in order if theta[i] >= LEAST] or [order[0]]
    cost = PENALTY * 0.5 * np.log(n.sum() + 1)
    alone = [float(n @ np.log(p[i])) for i in tries]
    first = int(np.argmax(alone))
    chosen, part, fit_ = [tries[first]], np.ones(1), alone[first]
    while len(chosen) < len(tries):
        found = []
        for i in tries:
            if i not in chosen:
                some = [*chosen, i]
                found.append((*_mix(p[some], n, theta[some] / theta[some].sum(), ROUNDS // 2), some))
        best = max(found, key=lambda x: x[1])
        if best[1] - cost <= fit_:
            break
        part, fit_, chosen = best
    out = np.zeros(len(p))
    out[chosen] = part
    return out, fit_


def _predict(text: bytes, letter: bool, langs: list[str], table: np.ndarray, usual: tuple[np.ndarray, np.ndarray]) -> tuple[str, float, list[str], bool]:
    codes = _codes(text) if letter and langs else ()
    if not len(codes):
        return UNKNOWN, 0.0, [], False
    if len(codes) > 1 << BITS:
        n = np.bincount(codes, minlength=1 << BITS)
        each = np.flatnonzero(n)
        n = n[each]
    else:
        each, n = np.unique(codes, return_counts=True)
    theta, fit_ = infer(table[each].T, n.astype(np.float64))
    order = [i for i in np.argsort(-theta, kind="stable") if theta[i] > 0]
    mean, variance = usual[0][order[0]], usual[1][order[0]]
    known = fit_ / len(codes) >= mean - max(STRANGE, SIGMAS * np.sqrt(variance * TOGETHER / len(codes)))
    return langs[order[0]], float(min(1.0, theta[order[0]])), [langs[i] for i in order], bool(known)


def _identified(docs: DataFrame, carry: list[str], langs: list[str], p: np.ndarray) -> DataFrame:
    """The columns to carry, by position, then lang_pred, score, lang_set and known under free names."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, p.T.copy(), typical(p)))
    names = ["lang_pred", "score", "lang_set", "known"]
    letter = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\p{L}")
    # A text that is carried as a string is not sent a second time as bytes.
    place = next((i for i, c in enumerate(carry) if c.lower() == "text" and docs.schema[c].dataType == T.StringType()), len(carry))
    width = len(carry)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], *[text_bytes().alias("text")] * (place == width), letter.alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, usual = shared.value
        for part, texts in slices(batches, at_column=place):
            found = [_predict(t, x, langs, table, usual) for t, x in zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)]
            pred, score, sets, known = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(known, pa.bool_())], [*part.schema.names[:width], *names])

    kinds = [T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.BooleanType()]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:width], *map(T.StructField, names, kinds)]))


def identify(docs: DataFrame, langs: list[str], p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, lang_set (the chosen languages, largest first) and known of every text."""
    return _identified(docs, ["doc_id"], langs, p).withColumnRenamed("c0", "doc_id")


def known_only(docs: DataFrame, langs: list[str], p: np.ndarray) -> DataFrame:
    """The documents whose languages are known, as they are; all of them if nothing was learned."""
    if not langs:
        return docs
    rows = _identified(docs, docs.columns, langs, p).where("known")
    return rows.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
