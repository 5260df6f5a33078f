"""Near-duplicate detection by one-permutation hashing with optimal densification.

A document's set is its distinct word shingles, as 64-bit hashes.  One permutation deals
them to `BINS` bins whose minima are the signature; an empty bin borrows from a bin found by
its own sequence of random probes.  Bands of bins are bucket keys.  Equal sets are one class
before anything else, named by a 128-bit hash of the set.

Bands are worked on in a few rounds, and what a round links is one component in the next.
In each bucket with several components only edges to one centre, in the bucket's largest
component, are candidates, so pairs grow with the rows, not with their square.  Candidates
are confirmed on the full sets.  Further rounds take all buckets and, as centre, the row that
meets most rows of other components.  What stars leave mixed is settled by an exact
prefix-filter join of the shingles of its rows.

At 32 bands of 4 bins a pair at the threshold of 0.85 misses all buckets with probability
below 1e-9; all pairs that share a bucket are tested or ruled out, unless links connect them.

Defined results: documents without words or text have n_shingles 0 and are a component of
their own; with fewer words than a shingle the whole sequence is the one shingle; rows of one
doc_id with words are one node, whatever their texts; a row with a null doc_id takes the
component of its equals, or null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import WORD, Words, broadcast_if_small, discard, free_name, lower_table, mix64, narrow, settle, slices, stored_at, text_bytes
from stratalog.llm.components import components, extend

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: First and last band, exclusive, of each round of stars.
ROUNDS = ((0, 2), (2, BANDS))
#: Rounds of stars over all bands, before the pairs that stars leave untested are found by a join.
STARS = 1
#: Classes with more than this share of all rows are broadcast: there are at most so many.
HEAVY = 100_000
#: Edges up to which their table is broadcast, to spare shuffles of texts.
EDGES = 200_000
#: Slots of the sketch of shingle counts that orders prefixes.
SKETCH = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _step(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    return x * _GOLD + h


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words = Words(texts, lower_table())
    h, counts, bounds = words.hashes(), words.counts, words.bounds
    with np.errstate(over="ignore"):
        m = max(0, len(h) - size + 1)
        x = np.full(m, size, np.uint64)
        for k in range(size):
            x = _step(x, h[k : k + m])
        x = mix64(x)
        out = []
        for i in range(words.n_docs):
            n, at = int(counts[i]), int(bounds[i])
            if n >= size:
                out.append(np.unique(x[at : at + n - size + 1]))
            elif n:
                y = np.full(1, n, np.uint64)
                for k in range(n):
                    y = _step(y, h[at + k : at + k + 1])
                out.append(mix64(y))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _densify(sig: np.ndarray) -> np.ndarray:
    """Empty bins borrow the value of the first non-empty bin among their own random probes."""
    rows = np.flatnonzero((sig != _EMPTY).any(1))
    full = sig[rows] != _EMPTY
    out = sig[rows].copy()
    r, b = np.nonzero(~full)
    bins, tries = np.arange(BINS, dtype=np.uint64), 0
    while len(r):
        with np.errstate(over="ignore"):
            probe = mix64(bins * _GOLD + np.uint64(tries + 1)) % np.uint64(BINS) if tries < 16 * BINS else (bins + np.uint64(tries)) % np.uint64(BINS)
        at = probe.astype(np.int64)[b]
        hit = full[r, at]
        out[r[hit], b[hit]] = sig[rows[r[hit]], at[hit]]
        r, b, tries = r[~hit], b[~hit], tries + 1
    sig = sig.copy()
    sig[rows] = out
    return sig


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of the bands of each set (rows of empty sets mean nothing)."""
    n = len(sets)
    sig = np.full((n, BINS), _EMPTY, np.uint64)
    if n:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        place = owner * BINS + (every >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        np.minimum.at(sig.reshape(-1), place, every)
    sig = _densify(sig).reshape(n, BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (n, BANDS)).copy()
        for k in range(ROWS):
            key = _step(key, sig[:, :, k])
        return mix64(key).view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, node (the hash of the set, null if it is empty) and the band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            sets = shingle_sets(texts, size)
            n = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                sums = [(np.sum(mix64(s), dtype=np.uint64), np.sum(mix64(s ^ _GOLD), dtype=np.uint64)) for s in sets]
            nodes = pa.array([int(x).to_bytes(8) + int(y).to_bytes(8) if k else None for k, (x, y) in zip(n, sums, strict=True)], pa.binary())
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(sets)[n > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), nodes, bands], ["doc_id", "mark", "n_shingles", "node", "bands"])

    rows = _marked(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, n_shingles long, node binary, bands array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_bytes()).alias("mark"), text_bytes().alias("text"))


def confirm(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have 100 * intersection >= percent * union.  texts: node, text (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for part, left in slices(batches, at_column=2):
            linked = []
            for x, right in zip(shingle_sets(left, size), part.column(3), strict=True):
                other = right.as_py()
                if other != held[0] or not len(held[1]):
                    held = (other, shingle_sets([other], size)[0])
                y = held[1]
                low, high = sorted((len(x), len(y)))
                if not low or 100 * low < percent * high:
                    linked.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(broadcast_if_small(edges, EDGES), "a")
    other = texts.join(broadcast_if_small(edges.select(F.col("b").alias("node")).distinct(), EDGES), "node", "left_semi")
    two = one.join(other.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    kind = edges.schema["a"].dataType.simpleString()
    return two.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n, comp, own (rows of comp in the bucket) and every (rows of the bucket) of the rows of buckets with several components."""
    now = shared.join(broadcast_if_small(labels, EDGES), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    own = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("own"))
    every = own.groupBy("key").agg(F.sum("own").alias("every"), F.count(F.lit(1)).alias("_comps")).where("_comps > 1").drop("_comps")
    return now.join(own.join(every, "key"), ["key", "comp"])


def _stars(mixed: DataFrame, weigh: bool, percent: int) -> DataFrame:
    """Edges (a, b) of each bucket's rows to a row of its largest component, across components; sizes alone rule out others.

    The centre is the first row or, with weigh, the one that meets most rows of other components in its buckets.
    """
    weight = F.lit(0)
    if weigh:
        mixed = narrow(mixed)
        mixed, weight = mixed.join(mixed.groupBy("node").agg(F.sum(F.col("every") - F.col("own")).alias("weight")), "node"), F.col("weight")
    centre = mixed.groupBy("key").agg(F.max(F.struct("own", "comp", weight.alias("weight"), "node", "n")).alias("c"))
    near = 100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")
    return mixed.join(centre, "key").where((F.col("comp") != F.col("c.comp")) & near).select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b")).distinct()


def prefix_pairs(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) across the components of rest (node, comp) that contain all links, by a prefix-filter join.

    Two sets that are linked share one of the first n - ceil(percent n / 100) + 1 shingles of
    each in any one order.  The order is by a sketch of the shingles' counts, rare ones first,
    then by hash; where both sets are at the shared shingle bounds what they can have in common.
    """
    rows, path = stored_at(texts.join(broadcast_if_small(rest, EDGES), "node").select("node", "comp", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for _, part in slices(batches):
            for x in shingle_sets(part, size):
                np.add.at(total, (x % np.uint64(SKETCH)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    sums = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    shared = rest.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches):
            at, token, place, n = [], [], [], []
            for i, x in enumerate(shingle_sets(found, size)):
                k = len(x) - -(-percent * len(x) // 100) + 1
                first = x[np.lexsort((x, shared.value[(x % np.uint64(SKETCH)).astype(np.int64)]))[:k]]
                at.append(np.full(len(first), i))
                token.append(first)
                place.append(np.arange(len(first)))
                n.append(np.full(len(first), len(x)))
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(place)), pa.array(np.concatenate(n))], ["node", "comp", "token", "at", "n"])

    kind = rest.schema["node"].dataType.simpleString()
    dealt = settle(rows.mapInArrow(prefixes, f"node {kind}, comp {kind}, token long, at long, n long"))
    discard(rest.sparkSession, path)
    several = dealt.groupBy("token").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("token")
    dealt = dealt.join(several, "token", "left_semi")
    x, y = dealt.alias("x"), dealt.alias("y")
    across = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = (100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))
    return x.join(y, across & near & enough).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _classes(signed: DataFrame) -> DataFrame:
    """node, first (its smallest doc_id, null last, and the mark of that row), n, bands and rows of every class of equal sets."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    own = signed.where("node is not null").groupBy("node")
    return own.agg(first, F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))


def _same_id(signed: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of one doc_id."""
    ids = signed.where("node is not null and doc_id is not null").select("doc_id", "node")
    several = ids.groupBy("doc_id").agg(F.min(F.xxhash64("node")).alias("_low"), F.max(F.xxhash64("node")).alias("_high")).where("_low <> _high").select("doc_id")
    if several.isEmpty():
        return ids.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    ids = ids.join(several, "doc_id").distinct()
    return ids.join(ids.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def _linked(classes: DataFrame, given: DataFrame, docs: DataFrame, size: int, percent: int, stars: int) -> DataFrame:
    """node, component of the classes that have links.  given: edges that need no test."""
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("key")
    shared = narrow(banded.join(buckets, "key"))  # rows of buckets with more than one class
    # The texts that any star can need, once: without exact copies and documents that share no bucket.
    wanted = classes.join(shared.select("node").distinct(), "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    rows = _marked(docs)
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "text")
    texts, path = stored_at(texts.dropDuplicates(["node"]))
    labels, tested = narrow(components(given)), shared.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))

    def test(edges: DataFrame) -> bool:
        nonlocal labels, tested
        fresh = narrow(edges.join(tested, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return False
        found, tested = narrow(confirm(fresh, texts, size, percent)), narrow(tested.union(fresh))
        if not found.isEmpty():
            labels = extend(labels, found)
        return True

    for low, high in ROUNDS:
        test(_stars(_mixed(shared.where(F.col("band").between(low, high - 1)), labels), False, percent))
    for _ in range(stars):
        if not test(_stars(_mixed(shared, labels), True, percent)):
            break
    rest = narrow(_mixed(shared, labels).select("node", "comp").distinct())
    if not rest.isEmpty():
        test(prefix_pairs(rest, texts, size, percent))
    discard(docs.sparkSession, path)
    return labels


def _firsts(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """node, first (of its component) and rows of every class."""
    linked = classes.join(labels, "node").select("component", "node", "first")
    lowest = linked.groupBy("component").agg(F.min("first").alias("_first"))
    joined = classes.select("node", "first", "rows").join(linked.select("node", "component").join(lowest, "component").select("node", "_first"), "node", "left")
    return joined.select("node", F.coalesce("_first", "first").alias("first"), "rows")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of every row."""
    signed = settle(signatures(docs, size))
    classes = settle(_classes(signed))
    labels = _linked(classes, _same_id(signed), docs, size, percent, stars)
    firsts = settle(_firsts(classes, labels).select("node", F.col("first.doc_id").alias("component_id"), "rows"))
    signed, total = signed.select("doc_id", "n_shingles", "node"), signed.count()
    hot = F.broadcast(firsts.where(F.col("rows") * HEAVY > total).drop("rows"))  # large groups of copies stay where they are
    some = signed.where("node is not null")
    rows = some.join(hot, "node").unionByName(some.join(hot, "node", "left_anti").join(firsts.drop("rows"), "node"))
    rows = rows.unionByName(signed.where("node is null").withColumn("component_id", F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Only equal and linked texts are a group here: different texts that share a doc_id, or have
    none, stay apart.  Documents without words stay.  Columns may have any names.
    """
    signed = settle(signatures(docs, size))
    classes = settle(_classes(signed))
    labels = _linked(classes, signed.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")), docs, size, percent, STARS)
    one, two = free_name(docs, "key"), free_name(docs, "mark")
    keep = _firsts(classes, labels).select(F.col("first.doc_id").alias(one), F.col("first.mark").alias(two)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = docs.where(text.rlike(WORD)).withColumns({two: F.xxhash64(text_bytes()), one: F.col("doc_id")})
    kept = full.join(keep, full[one].eqNullSafe(keep[one]) & (full[two] == keep[two]), "left_semi").dropDuplicates([one, two])
    return kept.select(*docs.columns).union(docs.where(~text.rlike(WORD)))
