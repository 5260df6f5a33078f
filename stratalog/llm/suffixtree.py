"""Language-model scoring with a probabilistic suffix tree over words.

A text is its lower-cased words and one end.  States are contexts: the root, the word before
a token, and the two words before it.  Every context of the training texts is a candidate,
so the tree grows with the corpus.  A context is retained if its smoothed next-word
distribution diverges from its suffix's, by at least `DIVERGENCE` nats times its count; the
suffixes of what is retained are retained.  Distributions are smoothed towards the suffix's
in proportion to the number of different next words, down to the add-one unigrams of the
root, and each token is scored at its longest retained suffix.  The probabilities of all words and of one
unknown word add up to 1.

The tree is never in one place.  A context that has a word rarer than 1/`HEAVY` of the tokens
lives in the bucket of that word (the last one, if both are rarer), where its suffix lives
too.  Frequent words, at most `HEAVY`, are numbered.  Slices of documents send their distinct contexts with next words to the buckets, sorted
and packed; a bucket counts, tests and smooths, and answers each slice with two numbers for
each of them.

A context of frequent words alone is in no bucket, but what follows it is: with `whole`, as the
query has it, the bucket of each word counts it after every frequent word and after every two.
How often a context occurs and how many different words follow are added up over all buckets, at
most HEAVY * (2 * HEAVY + 1) cells, and broadcast; two frequent words are tested like other
contexts, one is always retained.  Tests, there and in buckets, know rarer next words as one class:
each has the mean probability of the class.  Without `whole`, scores know them so as well, and two
frequent words in a row are scored at the last of them.

Words are told apart by 64-bit hashes and, among the rarer words around one word, by 24 bits of
them, or 32 if there are so many tokens that 24 could confuse more than 1 in `CLEAR` of them.

Defined results: null and empty texts are one end; repeated rows count and are scored each;
with nothing to learn from, counts are 0 and every token has probability 1; a null `train` is
false; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import Words, lower_table, mix64, release, settle, slices, sums_by_doc, text_bytes

HEAVY = 1_000
#: Least gain of a retained context over its suffix, in nats.
DIVERGENCE = 2.0
#: Bytes of text in a slice and tokens in a bucket, about.
SLICE, BUCKET = 8 << 20, 1 << 20
CLEAR = 64
#: Gains of pairs of frequent words are added up in this many parts of a nat, whatever their order.
FIXED = 1 << 20
#: Distinct words that a task counts before it passes them on.
HELD = 2_000_000
#: The hash of the end, as of a word.
END = mix64(np.array([2], np.uint64))[0]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of these texts, ends included, and bounds by text."""
    words = Words(texts, lower_table())
    bounds = words.bounds + np.arange(words.n_docs + 1)
    tokens = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[bounds[1:] - 1] = False
    tokens[inside] = words.hashes()
    return tokens, bounds


def _before(tokens: np.ndarray, bounds: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
    """The token before each and the one before that; ends stand before a text."""
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[bounds[:-1]] = two[bounds[:-1]] = fill
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = fill
    return one, two


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """hash, c: occurrences of each token in training documents."""

    def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([n for _, n in held]), len(code)).astype(np.int64)

    def batch(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["hash", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in slices(batches):
            held.append(np.unique(_tokens(texts)[0], return_counts=True))
            if sum(len(h) for h, _ in held) > HELD:
                held = [merge(held)]
                if len(held[0][0]) > HELD // 2:
                    yield batch(*held[0])
                    held = []
        if held:
            yield batch(*merge(held))

    return docs.where(train).select(text_bytes().alias("text")).mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


@dataclass
class Whole:
    """What follows frequent words, among all words; a pair of word i and then j is i * h + j.

    Word i comes before frequent word j n[i, j] times; sums are occurrences of a context and
    different words after it (`kinds`), 0 if the pair is not retained.
    """

    n: np.ndarray
    sums: np.ndarray
    kinds: np.ndarray
    pair_sums: np.ndarray
    pair_kinds: np.ndarray


@dataclass
class Frequent:
    """Root and states of the frequent words: what every task knows.

    A word w has u(w) = (c + 1) / size at the root.  After frequent word i it has
    p[i, j] + rest[i] * u(w) if it is frequent word j, else (other[i] + rest[i]) * u(w).
    """

    hashes: np.ndarray  # sorted
    u: np.ndarray
    size: float
    mean: float  # u of other words, on average
    p: np.ndarray
    other: np.ndarray
    rest: np.ndarray
    whole: Whole | None = None

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is not frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def after(self, i: np.ndarray, j: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Probability of words j (-1: not frequent) with u at the root after frequent words i."""
        if not len(i):
            return np.zeros(0)
        return np.where(j >= 0, self.p[i, j], self.other[i] * u) + self.rest[i] * u


def _root(hashes: np.ndarray, c: np.ndarray, tokens: int, types: int) -> Frequent:
    h, size = len(hashes), float(tokens + types + 1)
    u = (c + 1) / size
    others = max(1, types + 1 - h)
    return Frequent(hashes, u, size, max(1.0 - u.sum(), 1e-12) / others, np.zeros((h, h)), np.zeros(h), np.ones(h))


def _states(root: Frequent, n: np.ndarray) -> Frequent:
    """n[i, j]: frequent words j after frequent words i; n[i, h]: other words."""
    h = len(root.hashes)
    kinds = (n > 0).sum(1)
    all_ = np.maximum(n.sum(1) + kinds, 1e-12)
    rest = np.where(kinds > 0, kinds / all_, 1.0)
    return replace(root, p=n[:, :h] / all_[:, None], other=n[:, h] / all_ / max(1.0 - root.u.sum(), 1e-12), rest=rest)


def frequent_states(docs: DataFrame, hashes: np.ndarray, c: np.ndarray, tokens: int, types: int) -> Frequent:
    """docs: the training documents; hashes (sorted) and c of the frequent words."""
    h, blank = len(hashes), _root(hashes, c, tokens, types)
    if not h:
        return blank
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(h * (h + 1), np.int64)
        for _, texts in slices(batches):
            hashed, bounds = _tokens(texts)
            j = shared.value.of(hashed)
            i, _ = _before(j, bounds, shared.value.of(np.array([END]))[0])
            some = i >= 0
            total += np.bincount(i[some] * (h + 1) + np.where(j[some] < 0, h, j[some]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = docs.select(text_bytes().alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(h * (h + 1))
    n[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return _states(blank, n.reshape(h, h + 1))


def _pack(arrays: list[np.ndarray]) -> bytes:
    """The arrays as compressed bytes, by planes of equal significance, most of which are sorted or small."""
    sizes = np.array([len(a) for a in arrays], np.uint32).tobytes()
    raw = sizes + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8]), "zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.uint32, len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word; it never falls with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _falls(token: np.ndarray, one: np.ndarray, two: np.ndarray, h: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, frequent words before it) as one number each; the tokens and, of each of those, its place.

    one and two: numbers of the words before; what has any word two counts as h there, if some.  The
    words before are told by one * (h + 1) + two.
    """
    first, second = np.flatnonzero((one >= 0) & some), np.flatnonzero((one >= 0) & (two >= 0))
    at = np.concatenate((first, second))
    last = np.concatenate((np.full(len(first), h), two[second]))
    falls, fall = np.unique((token[at] * h + one[at]) * (h + 1) + last, return_inverse=True)
    return falls, at, fall


#: Words, and how many contexts stand before each; the contexts, and how often.
_FALLS = [np.uint64, np.uint32, np.uint32, np.uint64]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts and how often, each pair once, sorted."""
    word, context, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((context, word))
    word, context, n = word[order], context[order], n[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
    at = np.flatnonzero(new)
    return word[at], context[at], np.add.reduceat(n, at) if len(at) else n


def _fall_blob(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> bytes:
    words, per = np.unique(word, return_counts=True)
    return _pack([words, per.astype(np.uint32), context, n])


def _fall_arrays(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, per, context, n = _unpack(blob, _FALLS)
    return np.repeat(words, per), context, n


def whole_states(docs: DataFrame, hashes: np.ndarray, c: np.ndarray, tokens: int, types: int, buckets: int, divergence: float) -> Frequent:
    """As frequent_states, and what follows one frequent word and two, among all words."""
    h, root = len(hashes), _root(hashes, c, tokens, types)
    if not h:
        return replace(root, whole=Whole(root.p, *(np.zeros(0) for _ in range(4))))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(root)

    def batch(word: np.ndarray, before: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = np.searchsorted(_bucket(word, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(at) > 0).tolist()
        blobs = [_fall_blob(*(x[at[b] : at[b + 1]] for x in (word, before, n))) for b in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, texts in slices(batches):
            hashed, bounds = _tokens(texts)
            words, token = np.unique(hashed, return_inverse=True)
            one, two = _before(shared.value.of(words)[token], bounds, shared.value.of(np.array([END]))[0])
            falls, _, fall = _falls(token, one, two, h, np.ones(len(token), bool))
            held.append((words[falls // (h * (h + 1))], (falls % (h * (h + 1))).astype(np.uint32), np.bincount(fall, minlength=len(falls)).astype(np.uint64)))
            if sum(len(x) for x, _, _ in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield batch(*held[0])
                    held = []
        if held:
            yield batch(*_merged(held))

    def gather(part: pa.Table) -> pa.Table:
        blob = _fall_blob(*_merged([_fall_arrays(x) for x in part.column("blob").to_pylist()]))
        return pa.table({"bucket": part.column("bucket").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    kind = "bucket long, blob binary"
    falls = settle(docs.select(text_bytes().alias("text")).mapInArrow(run, kind).groupBy("bucket").applyInArrow(gather, kind)).select("blob")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Numbers of words, of the two words before (h: any) and how often."""
        for rows in batches:
            for blob in rows.column(0):
                word, before, n = _fall_arrays(blob.as_py())
                yield shared.value.of(word), before.astype(np.int64) // (h + 1), before.astype(np.int64) % (h + 1), n.astype(np.float64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j, one, two, n in parts(batches):
            cells, cell = np.unique(np.where(two == h, one * (h + 1) + np.where(j < 0, h, j), h * (h + 1) + two * h + one), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(cell, n).astype(np.int64)), pa.array(np.bincount(cell))], ["cell", "n", "kinds"])

    sums = falls.mapInArrow(tally, "cell long, n long, kinds long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    n, kinds = np.zeros(h * (2 * h + 1)), np.zeros(h * (2 * h + 1))
    for to, name in ((n, "n"), (kinds, "kinds")):
        to[sums.column("cell").to_numpy()] = sums.column(name).to_numpy()
    singles = h * (h + 1)
    table, kinds1, all2, kinds2 = n[:singles].reshape(h, h + 1), kinds[:singles].reshape(h, h + 1).sum(1), n[singles:], kinds[singles:]
    states = _states(root, table)
    told = context.broadcast((states, all2, kinds2))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, all_, kinds_ = told.value
        for j, one, two, n in parts(batches):
            j, one, two, n = (x[two < h] for x in (j, one, two, n))
            p = known.after(one, j, np.where(j >= 0, known.u[j], known.mean))
            pairs, pair = np.unique(two * h + one, return_inverse=True)
            gain = _gains(pair, len(pairs), n, all_[pairs], kinds_[pairs], p)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.round(gain * FIXED).astype(np.int64))], ["pair", "gain"])

    found = falls.mapInArrow(gains, "pair long, gain long").groupBy("pair").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= round(divergence * FIXED)).toArrow()
    keep = np.zeros(h * h, bool)
    keep[found.column("pair").to_numpy()] = True
    return replace(states, whole=Whole(table[:, :h], table.sum(1) + kinds1, kinds1, np.where(keep, all2 + kinds2, 0), np.where(keep, kinds2, 0)))


class Slice:
    """The tokens of some texts and their distinct contexts with next words, sorted by the word whose bucket they go to.

    A context is `kept` by its last word, or by the one before if the last is frequent (kind 1).
    Runs are (keeper, kind, next word, other word), heads the distinct ones without the other word.
    Falls are words with the frequent words before them, sorted by the word, whose bucket they go to.
    """

    def __init__(self, texts: list[bytes], frequent: Frequent):
        tokens, self.bounds = _tokens(texts)
        self.words, token = np.unique(tokens, return_inverse=True)
        self.token, n = token, len(self.words)
        end = int(np.searchsorted(self.words, END))
        one, two = _before(token, self.bounds, end)
        self.number = frequent.of(self.words)
        heavy = self.number >= 0
        self.one = one
        kind = heavy[one]
        self.at = np.flatnonzero(~(kind & heavy[two]))  # tokens after a run that some bucket keeps
        kind, one, two = kind[self.at], one[self.at], two[self.at]
        self.kind = kind
        keeper, other = np.where(kind, two, one), np.where(kind, one, two)
        heads, head = np.unique((keeper * 2 + kind) * n + token[self.at], return_inverse=True)
        runs, self.run = np.unique(head * n + other, return_inverse=True)
        self.head_keeper, self.head_kind, self.head_word = heads // n // 2, heads // n % 2, heads % n
        self.run_head, self.run_other = runs // n, runs % n
        h = len(frequent.hashes) if frequent.whole else 0
        number = self.number if h else np.full(n, -1)
        self.before = _before(number[token], self.bounds, number[end])
        falls, self.fall_at, self.fall = _falls(token, *self.before, h, number[token] < 0)
        self.fall_word, self.fall_before = falls // max(1, h * (h + 1)), falls % max(1, h * (h + 1))

    def messages(self, train: np.ndarray, buckets: int, mask: int) -> Iterator[tuple[int, bytes]]:
        """What goes to each bucket, and its number.  train: which texts are learned from; mask: bits of a rare word's name."""
        learn = np.repeat(train, np.diff(self.bounds)).astype(np.float64)
        c = np.bincount(self.run, learn[self.at], len(self.run_head)).astype(np.uint32)
        count = np.bincount(self.token, learn, len(self.words)).astype(np.uint32)
        fall_n = np.bincount(self.fall, learn[self.fall_at], len(self.fall_word)).astype(np.uint32)
        falls_of = np.bincount(self.fall_word, minlength=len(self.words)).astype(np.uint32)
        low, number = (self.words & np.uint64(mask)).astype(np.uint32), (self.number + 1).astype(np.uint32)
        heads_of = [np.bincount(self.head_keeper[self.head_kind == k], minlength=len(self.words)).astype(np.uint32) for k in (0, 1)]
        edges = np.arange(buckets + 1)
        word_at = np.searchsorted(_bucket(self.words, buckets), edges)
        head_at = np.searchsorted(_bucket(self.words[self.head_keeper], buckets), edges)
        run_at = np.searchsorted(self.run_head, head_at)
        fall_at = np.searchsorted(self.fall_word, word_at)
        for b in np.flatnonzero(np.diff(word_at) > 0).tolist():
            words, runs, falls = slice(word_at[b], word_at[b + 1]), slice(run_at[b], run_at[b + 1]), slice(fall_at[b], fall_at[b + 1])
            per_head = np.bincount(self.run_head[runs] - head_at[b], minlength=head_at[b + 1] - head_at[b]).astype(np.uint32)
            arrays = [self.words[words], count[words], heads_of[0][words], heads_of[1][words], per_head, c[runs]]
            for near in (self.head_word[head_at[b] : head_at[b + 1]], self.run_other[runs]):
                arrays += [number[near], low[near[number[near] == 0]]]
            yield b, _pack([*arrays, falls_of[words], self.fall_before[falls].astype(np.uint32), fall_n[falls]])

    def _after_frequent(self, whole: Whole, p: np.ndarray, n: np.ndarray) -> None:
        """p at the root becomes p after frequent words.  n: of falls."""
        h, (one, two) = len(whole.n), self.before
        own = np.zeros(len(p))
        single = self.fall_before[self.fall] % max(1, h + 1) == h
        own[self.fall_at[single]] = n[self.fall[single]]
        after = np.flatnonzero(one >= 0)
        i, j = one[after], self.number[self.token[after]]
        own[after] = np.where(j >= 0, whole.n[i, j], own[after])
        p[after] = np.where(whole.sums[i] > 0, (own[after] + whole.kinds[i] * p[after]) / np.maximum(whole.sums[i], 1), p[after])
        at, m = self.fall_at[~single], n[self.fall[~single]]
        pair = two[at] * h + one[at]
        p[at] = np.where(whole.pair_sums[pair] > 0, (m + whole.pair_kinds[pair] * p[at]) / np.maximum(whole.pair_sums[pair], 1), p[at])

    def score(self, frequent: Frequent, c: np.ndarray, kinds: np.ndarray, n: np.ndarray, falls: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> list[np.ndarray]:
        """Tokens, known tokens, base and model score of each text.

        c and kinds: of words, their occurrences and the different words after them (0: the state
        is not retained); n: of heads; falls: of falls; alpha, beta: of runs, p = alpha + beta * p(suffix).
        """
        heavy = self.number >= 0
        c, kinds = c[~heavy], kinds[~heavy]
        u, known = np.empty(len(self.words)), np.ones(len(self.words), np.int64)
        u[heavy], u[~heavy], known[~heavy] = frequent.u[self.number[heavy]], (c + 1) / frequent.size, c > 0
        p = u[self.token]
        base = np.log10(p)
        if frequent.whole:
            self._after_frequent(frequent.whole, p, falls)
            after = np.zeros(0, np.int64)
        else:
            after = np.flatnonzero(heavy[self.one])
        p[after] = frequent.after(self.number[self.one[after]], self.number[self.token[after]], p[after])
        rare = np.cumsum(~heavy) - 1
        keeper = rare[self.head_keeper]
        all_ = np.maximum(c + kinds, 1)[keeper]
        own = (self.head_kind == 0) & (kinds[keeper] > 0)
        a, b = np.where(own, n / all_, 0.0), np.where(own, kinds[keeper] / all_, 1.0)
        head = self.run_head[self.run]
        p[self.at] = alpha[self.run] + beta[self.run] * (a[head] + b[head] * p[self.at])
        return [np.diff(self.bounds), *(sums_by_doc(x, self.bounds) for x in (known[self.token], base, np.log10(p)))]


#: Words, their counts, their heads of kind 0 and 1; of heads, their runs; counts of runs; of heads, then of runs: numbers from 1 of frequent words, names of rare ones; of words, their falls; of falls, the words before and counts.
_MESSAGE = [np.uint64] + [np.uint32] * 12
#: Of words: occurrences, different words after them (0: not retained); occurrences of heads; of runs, their place in a table; alpha and beta in it; occurrences of falls.
_ANSWER = [np.uint64, np.uint32, np.uint32, np.uint32, np.float32, np.float32, np.uint64]


def _gains(owner: np.ndarray, size: int, n: np.ndarray, all_: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Nats by which each context's occurrences are likelier under its smoothed distribution than under p, its suffix's."""
    seen = np.flatnonzero(n > 0)
    o, m = owner[seen], n[seen]
    smooth = (m + kinds[o] * p[seen]) / (all_[o] + kinds[o])
    return np.bincount(o, m * np.log(smooth / p[seen]), size)


def answer(messages: list[bytes], frequent: Frequent, divergence: float = DIVERGENCE) -> list[bytes]:
    """What a bucket answers to each message; most of it are small numbers, and the same over and over."""
    parts = [_unpack(m, _MESSAGE) for m in messages]
    joined = lambda k: np.concatenate([x[k] for x in parts])
    words, word = np.unique(joined(0), return_inverse=True)
    total = np.bincount(word, joined(1), len(words)).astype(np.uint64)
    # The runs of all messages, one after the other; a root is a keeper with a kind.
    root = np.repeat(np.stack((word * 2, word * 2 + 1), 1).reshape(-1), np.stack((joined(2), joined(3)), 1).reshape(-1))
    per_head, c = joined(4), joined(5).astype(np.float64)

    def named(number: np.ndarray, names: np.ndarray) -> np.ndarray:
        out = number.astype(np.uint64)
        out[number == 0] = names.astype(np.uint64) | np.uint64(1 << 32)
        return out

    root, next_ = np.repeat(root, per_head).astype(np.uint64) << np.uint64(33), np.repeat(named(joined(6), joined(7)), per_head)
    heads, head = np.unique(root | next_, return_inverse=True)
    contexts, context = np.unique(root | named(joined(8), joined(9)), return_inverse=True)
    head_of_each = head[np.cumsum(per_head) - per_head]  # of each head of each message
    runs, run = np.unique(head * max(1, len(contexts)) + context, return_inverse=True)
    head, context = runs // max(1, len(contexts)), runs % max(1, len(contexts))  # of each distinct run
    n = np.bincount(run, c, len(runs))
    # The words that follow, at the root.
    name = np.uint64((1 << 33) - 1)
    number = np.where(heads & name < np.uint64(1 << 32), (heads & name).astype(np.int64) - 1, -1)
    u = np.where(number >= 0, frequent.u[number] if len(frequent.u) else 0.0, frequent.mean)
    # One word before: states of the keepers.
    head_root = (heads >> np.uint64(33)).astype(np.int64)
    own = head_root % 2 == 0
    n1, size = np.bincount(head, n, len(heads)), 2 * len(words)
    all1, kinds1 = np.bincount(head_root, n1, size), np.bincount(head_root, n1 > 0, size)
    sum1 = np.maximum(all1 + kinds1, 1)
    alpha1 = n1 / sum1[head_root]
    beta1 = np.where(all1 > 0, kinds1 / sum1, 1.0)
    gain1 = _gains(head_root, size, n1, all1, kinds1, u)
    # Two words before.
    context_root, context_other = (contexts >> np.uint64(33)).astype(np.int64), (contexts & name).astype(np.int64) - 1
    p1 = np.where(own, alpha1 + beta1[head_root] * u, 0.0)[head]
    away = np.flatnonzero(~own[head])
    p1[away] = frequent.after(context_other[context[away]], number[head[away]], u[head[away]])
    all2, kinds2 = np.bincount(context, n, len(contexts)), np.bincount(context, n > 0, len(contexts))
    keep2 = _gains(context, len(contexts), n, all2, kinds2, p1) >= divergence
    keep1 = (gain1 >= divergence) | (np.bincount(context_root, keep2, size) > 0)
    sum2 = np.maximum(all2 + kinds2, 1)
    alpha, beta = np.where(keep2[context], n / sum2[context], 0.0), np.where(keep2, kinds2 / sum2, 1.0)[context]
    tables, pair = np.unique(np.stack((alpha, beta), 1).astype(np.float32).view(np.uint64).reshape(-1), return_inverse=True)
    tables = tables.view(np.float32).reshape(-1, 2)
    after = np.where(keep1, kinds1, 0).astype(np.uint32)[0::2]
    seen = np.where(own, n1, 0).astype(np.uint32)
    _, fall = np.unique((np.repeat(word, joined(10)) << 32) | joined(11).astype(np.int64), return_inverse=True)
    falls = np.bincount(fall, joined(12)).astype(np.uint64)
    out, word_at, head_at, run_at, fall_at = [], 0, 0, 0, 0
    for x in parts:
        some, heads_, runs_ = word[word_at : word_at + len(x[0])], head_of_each[head_at : head_at + len(x[4])], run[run_at : run_at + len(x[5])]
        used, at = np.unique(pair[runs_], return_inverse=True)
        out.append(_pack([total[some], after[some], seen[heads_], at.astype(np.uint32), tables[used, 0], tables[used, 1], falls[fall[fall_at : fall_at + len(x[11])]]]))
        word_at, head_at, run_at, fall_at = word_at + len(x[0]), head_at + len(x[4]), run_at + len(x[5]), fall_at + len(x[11])
    return out


@dataclass
class Scored:
    rows: DataFrame
    tokens: int
    types: int


def score(docs: DataFrame, train: Column, heavy: int = HEAVY, divergence: float = DIVERGENCE, slice_bytes: int = SLICE, bucket_tokens: int = BUCKET, whole: bool = False) -> Scored:
    """doc_id, n_tokens, n_known, base_score and score of every text by a tree of those where `train` holds; and the training tokens and types.

    whole: frequent words, and two in a row, have states over all words.
    """
    context, train = docs.sparkSession.sparkContext, F.coalesce(train, F.lit(False))
    words = settle(word_counts(docs, train))
    tokens, types = (x or 0 for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = words.where(F.col("c") * heavy >= tokens).toArrow()
    hashes, c = top.column("hash").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(hashes)
    size = docs.agg(F.sum(F.octet_length(text_bytes()) + 1)).first()[0] or 0
    n_slices, n_buckets = max(1, -(-size // slice_bytes)), max(1, -(-size // (6 * bucket_tokens)))
    if whole:  # falls are few beside runs
        frequent = whole_states(docs.where(train), hashes[order], c[order], tokens, types, -(-n_buckets // 8), divergence)
    else:
        frequent = frequent_states(docs.where(train), hashes[order], c[order], tokens, types)
    shared = context.broadcast(frequent)
    release(docs.sparkSession, 3)
    mask = 0xFFFFFF if CLEAR * tokens <= heavy << 24 else 0xFFFFFFFF
    place = F.pmod(F.xxhash64("doc_id", text_bytes()), F.lit(n_slices))
    dealt = docs.select("doc_id", text_bytes().alias("text"), train.alias("train"), place.alias("slice"))

    def ask(part: pa.Table) -> pa.Table:
        found = Slice(part.column("text").to_pylist(), shared.value)
        rows = list(found.messages(np.asarray(part.column("train").to_pylist(), bool), n_buckets, mask))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "slice": pa.array([part.column("slice")[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def tell(part: pa.Table) -> pa.Table:
        return pa.table({"bucket": part.column("bucket"), "slice": part.column("slice"), "blob": pa.array(answer(part.column("blob").to_pylist(), shared.value, divergence), pa.binary())})

    kind = "bucket long, slice long, blob binary"
    answers = settle(dealt.select("slice", "text", "train").groupBy("slice").applyInArrow(ask, kind).groupBy("bucket").applyInArrow(tell, kind))

    release(docs.sparkSession, 3)

    def close(part: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("bucket").to_numpy())
        blobs = told.column("blob").to_pylist()
        got = [_unpack(blobs[i], _ANSWER) for i in order.tolist()]
        parts = [(g[0], g[1], g[2], g[6], g[4][g[3]], g[5][g[3]]) for g in got] or [(np.zeros(0),) * 6]
        found = Slice(part.column("text").to_pylist(), shared.value)
        sums = found.score(shared.value, *(np.concatenate(x).astype(np.float64) for x in zip(*parts, strict=True)))
        return pa.table([part.column("doc_id"), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    rows = dealt.select("slice", "doc_id", "text").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(close, kind)
    return Scored(rows, tokens, types)
