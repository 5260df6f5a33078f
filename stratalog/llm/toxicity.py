"""Toxicity by noisy-channel deobfuscation.

Words may be disguised: digits and signs for letters, letters repeated, signs or blanks put
between them.  A disguised word is a lattice of the letters that each sign may stand for, of
repeats and of signs that may be left out; Viterbi decoding under a character trigram model
finds the likeliest spelling.  A plain word is a lattice with one path; if it weighs nothing
and has a doubled letter, its spelling with repeats left out counts.  A run of spaced letters
is cut into its likeliest words under that model and the lexicon.  The restored words
are scored: a lexicon of word beginnings and whole words, weighted by the lower bound of
their log odds in toxic documents, and a logistic regression over what a document's words
weigh.

The character model counts all documents.  The lexicon and the regression are fitted on at
most `SAMPLE` labelled rows, chosen by a hash of the id, the lexicon keeping at most
`LEXICON` entries.

Defined results: null and empty texts score as a document without words; with labels of one
kind only, or none, the score is the share of toxic labels; null labels teach nothing and of
several labels of one document the largest counts; repeated rows are scored each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import slices, stored, text_bytes

SAMPLE, LEXICON = 16_000, 20_000
#: Toxic documents that an entry of the lexicon must occur in, however many there are.
LEAST = 3
#: Lengths of the word beginnings in the lexicon; whole words are there too.
BEGINNINGS = range(3, 9)
#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs in nats: a sign read as a letter, left out, and a repeated letter left out.
READ, SKIP, REPEAT = 0.5, 2.0, 0.7
#: Words remembered by a worker.
CACHED = 500_000
_EDGE = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$€£]+$|_+$|^_+")
_SPACED = re.compile(r"(?<!\S)(?:\S(?:\s+|[._*-])){3,}\S(?!\S)")
_GAPS = re.compile(r"[\s._*-]")
_TRIPLE, _DOUBLE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
_DOUBLES = re.compile(r"(.)\1+")
#: Longest word that a run of spaced letters is cut into, and cost of a cut in nats.
LONGEST, CUT = 24, 1.0
_LETTERS = 28


def _letter(c: str) -> int:
    """0 is a blank, 27 any letter beyond a-z."""
    return ord(c) - 96 if "a" <= c <= "z" else 27


def _byte_letters() -> np.ndarray:
    t = np.zeros(256, np.int64)
    for c in range(97, 123):
        t[c] = t[c - 32] = c - 96
    t[0xC3:0xF8] = 27
    t[0x80:0xC0] = -1  # inside a character
    t[0xFF] = _LETTERS  # between documents; no UTF-8 text has it
    return t


_BYTE_LETTERS = _byte_letters()


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents: a fixed number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS**3, np.int64)
        for _, texts in slices(batches):
            x = _BYTE_LETTERS[np.frombuffer(b" " + b" \xff ".join(texts) + b" ", np.uint8)]
            x = x[x >= 0]
            x = x[(x > 0) | np.concatenate(([True], x[:-1] > 0))]
            code = (x[:-2] * _LETTERS + x[1:-1]) * _LETTERS + x[2:]
            apart = x == _LETTERS
            total += np.bincount(code[~(apart[:-2] | apart[1:-1] | apart[2:])], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    out = np.zeros(_LETTERS**3)
    for row in docs.select(text_bytes().alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.code] = row.n
    return out.reshape((_LETTERS,) * 3)


def _conditional(counts: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of a letter after two others."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + _LETTERS)
    two = counts.sum(0) + 5 * one
    two /= two.sum(-1, keepdims=True)
    three = counts + 5 * two[None]
    return three / three.sum(-1, keepdims=True)


@dataclass
class Model:
    """Costs of letters after two others, weights of beginnings ("ab") and whole words ("abc$"), regression."""

    cost: np.ndarray
    weights: dict[str, float]
    beta: np.ndarray

    def __post_init__(self) -> None:
        # Leaving repeats out keeps the word without any repeats, so only words that begin like an entry need decoding.
        self.single = {_DOUBLES.sub(r"\1", g.rstrip("$")) for g in self.weights}

    def restore(self, token: str) -> str:
        """The likeliest word behind a lower-case token."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before = ""
        for c in token:
            new: dict[tuple[int, int], tuple[float, str]] = {}
            letters, read = (c, 0.0) if c.isalpha() else (SIGNS.get(c, ""), READ)
            leave = REPEAT if c == before and c.isalpha() else None if c.isalpha() else SKIP if c in SIGNS else 0.2
            for (a, b), (so_far, word) in paths.items():
                steps = [((b, _letter(x)), so_far + read + self.cost[a, b, _letter(x)], word + x) for x in letters]
                if leave is not None:
                    steps.append(((a, b), so_far + leave, word))
                for state, value, path in steps:
                    if state not in new or value < new[state][0]:
                        new[state] = (value, path)
            paths, before = new, c
        return min((so_far + self.cost[a, b, 0], word) for (a, b), (so_far, word) in paths.items())[1]

    def weight(self, core: str) -> float:
        """The weight of a plain word, at least 0."""
        return max([self.weights.get(core + "$", 0.0), *(self.weights.get(core[:k], 0.0) for k in BEGINNINGS if k <= len(core))])

    def may_weigh(self, single: str) -> bool:
        """Whether a word without repeats begins with an entry without repeats."""
        return any(single[:k] in self.single for k in range(1, len(single) + 1))

    def word(self, raw: str) -> tuple[str, float]:
        """The restored word and its weight, at least 0."""
        core = _EDGE.sub("", raw.lower())
        if not core.isalpha() or _TRIPLE.search(core):
            if not any(c.isalpha() for c in core):
                return "", 0.0
            core = self.restore(core)
        best = self.weight(core)
        if not best and _DOUBLE.search(core) and self.may_weigh(_DOUBLES.sub(r"\1", core)):
            other = self.restore(core)
            if weight := self.weight(other):
                return other, weight
        return core, best

    def cut(self, run: str) -> list[str]:
        """The likeliest words of a run of letters without blanks; words of the lexicon are likelier by their weight."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        ways: list[list[float]] = []
        for i in range(len(run)):
            a, b, so_far, costs = 0, 0, CUT * (i > 0), []
            for c in run[i : i + LONGEST]:
                x = _letter(c)
                so_far, a, b = so_far + self.cost[a, b, x], b, x
                costs.append(so_far + self.cost[a, b, 0])
            ways.append(costs)
        for j in range(1, len(run) + 1):
            best.append(min((best[i][0] + ways[i][j - i - 1] - self.weights.get(run[i:j] + "$", 0.0), i) for i in range(max(0, j - LONGEST), j)))
        words, j = [], len(run)
        while j:
            words.append(run[best[j][1] : j])
            j = best[j][1]
        return words[::-1]

    def hits(self, raw: str) -> list[tuple[str, float]]:
        """The words of positive weight behind a raw word or, after a blank, a run of spaced letters."""
        found = [self.word(raw.strip())]
        if raw[0] == " ":
            run = _EDGE.sub("", raw.strip().lower())
            for core in {run, self.restore(run)} if any(c.isalpha() for c in run) else ():
                found += [self.word(w) for w in (self.cut(core) if core.isalpha() else ())]
        return [x for x in dict.fromkeys(found) if x[1] > 0]


def words_of(text: str) -> set[str]:
    """Distinct raw words, and runs of letters with blanks or signs between them, joined after a blank."""
    words = set(text.split())
    for m in _SPACED.finditer(text):
        words.add(" " + _GAPS.sub("", m.group()))
    return words


def _features(words: list[float], n: int) -> list[float]:
    top = sorted(words, reverse=True)[:5]
    return [1.0, top[0] if top else 0.0, math.fsum(top), min(len(words), 10), math.fsum(words) / np.sqrt(n + 10.0), np.log1p(n) / 5]


WIDTH = 6


class Scorer:
    """Features of documents; the weights of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def features(self, text: str) -> list[float]:
        words, known = words_of(text), self.known
        if len(known) > CACHED:
            known.clear()
        found: dict[str, float] = {}
        for w in [w for w in words if w not in known]:
            known[w] = self.model.hits(w) or None
        for hits in map(known.__getitem__, words):
            if hits:
                found.update(hits)
        return _features(list(found.values()), len(words))


def sample_labels(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, toxic of at most `limit` labelled documents, chosen by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> tuple[dict[str, float], int, int]:
    """Weights of beginnings and words, and the toxic and other rows.  rows: text (bytes), toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            grams = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([counts[1][g] for g in grams], pa.int64()), pa.array([counts[0][g] for g in grams], pa.int64())], ["gram", "t", "n"])

        counts = [Counter(), Counter()]
        for part, texts in slices(batches):
            for text, toxic in zip(texts, part.column(1).to_pylist(), strict=True):
                cores = {_EDGE.sub("", w.lower()) for w in text.decode("utf-8", "replace").split()}
                grams = {w + "$" for w in cores if w.isalpha()}
                for k in BEGINNINGS:
                    grams.update(w[:k] for w in cores if len(w) >= k)
                counts[toxic > 0].update(grams)
                counts[toxic > 0][""] += 1
            if len(counts[0]) + len(counts[1]) > CACHED:
                yield flush()
                counts = [Counter(), Counter()]
        yield flush()

    counts = rows.mapInArrow(run, "gram string, t long, n long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).persist()
    total = counts.where("gram = ''").first()
    t, n = (total.t, total.n) if total else (0, 0)
    if not t or not n:
        counts.unpersist()
        return {}, t, n
    odds = F.log((F.col("t") + 0.5) / (t + 1.0)) - F.log((F.col("n") + 0.5) / (n + 1.0))
    low = odds - 1.5 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    best = counts.where((F.col("gram") != "") & (F.col("t") >= LEAST)).withColumn("w", low).where("w > 1").orderBy(F.desc("w"), "gram").limit(limit)
    weights = {r.gram: r.w for r in best.collect()}
    counts.unpersist()
    return weights, t, n


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id and toxic of the documents to learn from; the character model learns from all docs."""
    sample = sample_labels(labels).select(F.col("doc_id").alias("_id"), "toxic")
    rows = stored(docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", F.col("toxic").cast("long").alias("toxic")))
    weights, t, n = learn_lexicon(rows)
    prior = np.array([np.log((t + 0.5) / (n + 0.5))] + [0.0] * (WIDTH - 1))
    corpus = _conditional(letter_counts(docs))
    lexical = np.zeros((_LETTERS,) * 3)
    for gram, w in weights.items():
        if gram.endswith("$"):
            x = [0, 0, *map(_letter, gram[:-1]), 0]
            for a, b, c in zip(x, x[1:], x[2:], strict=False):
                lexical[a, b, c] += w
    model = Model(-np.log(0.5 * corpus + 0.5 * _conditional(lexical)), weights, prior)
    if not t or not n:
        return model
    x, y = [], []
    for row in features(rows, model, "toxic").toLocalIterator():
        x.append(row.features)
        y.append(row.toxic > 0)
    model.beta = _regression(np.array(x), np.array(y, float))
    return model


def features(rows: DataFrame, model: Model, column: str) -> DataFrame:
    """A column and the features of each row's text (bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part, texts in slices(batches):
            found = [scorer.features(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], [column, "features"])

    return rows.select(column, "text").mapInArrow(run, f"{column} {rows.schema[column].dataType.simpleString()}, features array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text: the probability that it is toxic."""
    found = features(docs.select("doc_id", text_bytes().alias("text")), model, "doc_id")
    z = sum((F.element_at("features", i + 1) * float(b) for i, b in enumerate(model.beta)), F.lit(0.0))
    return found.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score"))
