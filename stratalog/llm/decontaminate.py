"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and one automaton recognises every run of consecutive words of
any item.  Training words stream through it, which gives at each word the length of the
longest run ending there.  A run of at least a window, or a whole item shorter than a window,
is a hit; hit spans can be removed, and documents that are mostly hit dropped.  Before
streaming, whole-array lookups of short grams find the only stretches where a hit can be.

The automaton is broadcast; its size is bounded because items are taken in blocks of at most
`BLOCK_WORDS` words (or one item), each block a pass over the documents.

Defined results: null and empty texts have no words and no hits; null and wordless items have
no window; items of one id count once, a null item_id counts as an empty one; repeated
documents are scanned each; an empty benchmark hits nothing; other columns are ignored, or
kept as they are by `clean`.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import Words, free_name, settle, slices, text_bytes

BLOCK_WORDS = 200_000


def _normal() -> bytes:
    """ASCII letters lower-cased; digits, letters and all bytes beyond ASCII are words, the rest is not."""
    t = bytearray(range(256)).lower()
    for c in range(128):
        if not chr(c).isalnum():
            t[c] = 10 if c == 10 else 32
    return bytes(t)


NORMAL = _normal()


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """A generalised suffix automaton over word numbers, and the windows that its states stand for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        vocabulary = sorted({w for _, words in items for w in words})
        hashes = Words(vocabulary, spaces=b"\n").hashes() if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {vocabulary[k]: i for i, k in enumerate(order)}
        self.length, self.link, self.next = [0], [-1], [{}]
        runs = [(item, [number[w] for w in words]) for item, words in items if words]
        ends = [self._add(run) for _, run in runs]
        self._windows(runs, ends)
        lengths = [min(window, len(run)) for _, run in runs]
        self.shortest = min(lengths, default=0)
        self.gram = min(3, self.shortest)
        grams = {self._gram(run[i : i + self.gram]) for _, run in runs for i in range(len(run) - self.gram + 1)}
        self.grams = np.array(sorted(grams), np.uint64)

    def _gram(self, numbers: list[int]) -> int:
        x = 0
        for n in numbers:
            x = (x << 21) | (n + 1)
        return x

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, made to hold no longer runs than p's plus one."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _add(self, run: list[int]) -> list[int]:
        """Adds an item; the state after each of its words, found again at the end since states are split."""
        last = 0
        for c in run:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new
        return run

    def _windows(self, runs: list[tuple[str, list[int]]], ends: list[list[int]]) -> None:
        """Which items' windows end in each state."""
        full: dict[int, set[str]] = defaultdict(set)
        short: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item, run in runs:
            if len(run) < self.window:
                state = 0
                for c in run:
                    state = self.next[state][c]
                short[state].append((len(run), item))
                continue
            state, n = 0, 0
            for c in run:
                state, n = self.step(state, n, c)
                if n >= self.window:
                    full[self.top(state)].add(item)
        self.full = {s: tuple(sorted(x)) for s, x in full.items()}
        self.short = {}
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            have = self.short.get(self.link[s], ()) if s else ()
            own = tuple(sorted(set(short.get(s, ()))))
            if have or own:
                self.short[s] = have + own

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The longest run that ends in c, after the longest run of n words at this state."""
        follow = self.next
        while state and c not in follow[state]:
            state = self.link[state]
            n = self.length[state]
        if c in follow[state]:
            return follow[state][c], n + 1
        return 0, 0

    def top(self, state: int) -> int:
        """The state of the last `window` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if no item has it."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def stretches(self, numbers: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
        """The parts of the words, each in one document, where a window can be."""
        g, m = self.gram, len(numbers) - self.gram + 1
        if not g or m <= 0:
            return []
        code, known = np.zeros(m, np.uint64), docs[g - 1 :] == docs[:m]
        for k in range(g):
            part = numbers[k : k + m]
            known &= part >= 0
            code = (code << np.uint64(21)) | (part + 1).astype(np.uint64)
        spots = np.flatnonzero(known)
        at = np.minimum(np.searchsorted(self.grams, code[spots]), len(self.grams) - 1)
        spots = spots[self.grams[at] == code[spots]]
        if not len(spots):
            return []
        new = np.flatnonzero((np.diff(spots, prepend=-9) != 1) | (docs[spots] != docs[np.maximum(spots - 1, 0)]))
        first, last = spots[new], spots[np.append(new[1:], len(spots)) - 1] + g
        long = last - first >= self.shortest
        return list(zip(first[long].tolist(), last[long].tolist(), strict=True))

    def hits(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (merged) of a stretch and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        state = n = 0
        for i, c in enumerate(numbers):
            state, n = self.step(state, n, c)
            reach = 0
            if n >= self.window:
                items.update(self.full[self.top(state)])
                reach = n
            for k, item in self.short.get(state, ()):
                if k <= n:
                    items.add(item)
                    reach = max(reach, k)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [tuple(s) for s in spans], items


def blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of successive blocks of items."""
    items: list[tuple[str, list[bytes]]] = []
    words = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), text_bytes().alias("text")).toLocalIterator():
        item = normal_words(bytes(row.text))
        if items and words + len(item) > limit:
            yield Automaton(items, window)
            items, words = [], 0
        items.append((row.id, item))
        words += len(item)
    yield Automaton(items, window)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


#: Blocks of items that are passed over the documents before these are written.
TOGETHER = 4


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """docs with n_words, hit_spans and hit_items: merged spans of hit words, and the ids of the items.  names: other names for these.

    A span has its first word and the word after its last, and the same as bytes of the text.
    """
    kind = "array<struct<first:long,last:long,from_byte:long,to_byte:long>>"
    out = docs.drop(*names).withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(None).cast(kind), names[2]: F.array().cast("array<string>")})
    column = next(i for i, c in enumerate(out.columns) if c.lower() == "text")
    for k, automaton in enumerate(blocks(benchmark, window)):
        out = _pass(settle(out) if k and k % TOGETHER == 0 else out, automaton, column)
    return out


def _pass(rows: DataFrame, automaton: Automaton, column: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part, texts in slices(batches, at_column=column):
            words = Words(texts, NORMAL)
            spans = {i: [tuple(s.values()) for s in x] for i, x in enumerate(part.column(width - 2).to_pylist()) if x}
            items = {i: set(x) for i, x in enumerate(part.column(width - 1).to_pylist()) if x}
            numbers = table.numbers(words.hashes())
            for first, last in table.stretches(numbers, words.docs()):
                doc = bisect.bisect_right(words.bounds, first) - 1
                found, ids = table.hits(numbers[first:last].tolist())
                base, byte = int(words.bounds[doc]), int(words.doc_start[doc])
                for a, b in found:
                    spans.setdefault(doc, []).append((first + a - base, first + b - base, int(words.starts[first + a]) - byte, int(words.ends[first + b - 1]) - byte))
                if ids:
                    items.setdefault(doc, set()).update(ids)
            merged = []
            for i in range(len(part)):
                each = sorted(spans.get(i, ()))
                by_word, by_byte = _merge([s[:2] for s in each]), _merge([s[2:] for s in each]) if each else []
                if len(by_word) != len(by_byte):  # words that touch are apart in bytes
                    first_byte, last_byte = {s[0]: s[2] for s in reversed(each)}, {}
                    for s in each:
                        last_byte[s[1]] = s[3]
                    by_byte = [(first_byte[a], last_byte[b]) for a, b in by_word]
                merged.append([dict(zip(("first", "last", "from_byte", "to_byte"), (*a, *b), strict=True)) for a, b in zip(by_word, by_byte, strict=True)])
            struct = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "from_byte", "to_byte")]))
            columns = [*part.columns[: width - 3], pa.array(words.counts.astype(np.int64)), pa.array(merged, struct), pa.array([sorted(items.get(i, ())) for i in range(len(part))], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("hit_items")).cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_percent: int = 60) -> DataFrame:
    """The documents with hit spans cut out; those of which more than max_percent of the words are hit go.

    An n_chars column follows the new text.
    """
    n_words, hit_spans, hit_items, new = (free_name(docs, x) for x in ("n_words", "hit_spans", "hit_items", "new"))
    found = scan(docs, benchmark, window, (n_words, hit_spans, hit_items))
    hit = F.aggregate(hit_spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])

    def pieces(both: Column) -> Column:
        """The text between the spans and after the last, each cut out of the bytes."""
        spans, raw, n = both["spans"], both["raw"], F.size(both["spans"])

        def piece(i: Column) -> Column:
            start = F.when(i > 1, F.element_at(spans, F.greatest(i - 1, F.lit(1)))["to_byte"]).otherwise(0)
            end = F.when(i <= n, F.element_at(spans, F.least(i, n))["from_byte"]).otherwise(F.octet_length(raw))
            return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

        return F.transform(F.sequence(F.lit(1), n + 1), piece)

    both = F.struct(F.col(hit_spans).alias("spans"), F.col("text").cast("binary").alias("raw"))
    text = F.when(F.size(hit_spans) > 0, F.concat_ws("", F.element_at(F.transform(F.array(both), pieces), 1))).otherwise(F.col("text"))
    kept = found.where(100 * hit <= max_percent * F.col(n_words)).withColumn(new, text)
    chars = {"n_chars": F.when(F.size(hit_spans) > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return kept.withColumns(chars).withColumn("text", F.col(new)).select(*docs.columns)
