"""The training-data operators against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import common, decontaminate, language, licenses, minhash, mixing, pii, quality, queries, suffixtree, tokens, toxicity
from stratalog.llm.components import components, extend

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, Score string"
SYLLABLES = {"en": "the and of ing ed th on er st re".split(), "fr": "eau eux ou ment tre qu on la des é".split(), "de": "ung sch keit der ein ge zu ß ü en".split()}


def make(rows):
    """Rows with extra columns whose names clash with those of results."""
    return [(i, t, lang, src, len(t) if t is not None else None, "x", "y") for i, t, lang, src in rows]


def prose(r, lang="en", n=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(i, prose(r, lang := r.choice(["en", "en", "fr", "de"]), r.randint(5, 120)), lang, r.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    base = rows[0][1].split()
    for k in range(12):  # near copies, exact copies, chains
        w = list(base)
        w[k % len(w)] = f"edit{k}"
        rows.append((200 + k, " ".join(w), "en", "a"))
    rows += [(300, rows[1][1], "en", "b"), (301, rows[1][1].upper(), "en", "b"), (302, None, None, None), (303, "", "en", "a"), (304, " \n\t ", "en", "a"), (305, "one", "en", "c"), (306, "one", "en", "c"), (307, "ONE two", "fr", "c")]
    rows += [(None, "no id here " * 4, "en", "b"), (308, "12 34 !!", "en", "a"), (309, "word " * 30000, "en", "a"), (310, "x" * 200000, "en", "b"), (1, rows[1][1], rows[1][2], rows[1][3])]
    return spark.createDataFrame(make(rows), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_words_and_hashes_are_those_of_the_texts():
    sample = ["", "  a  bb\tcé\n", "x\x85y z", "日本 語", "a" * 70000]
    w = common.Words([t.encode() for t in sample])
    got = [w.word(i).decode() for i in range(len(w.starts))]
    assert got == [x for t in sample for x in words_of(t)] and w.counts.tolist() == [len(words_of(t)) for t in sample]
    assert [int(h) for h in w.hashes()] == [common.hash_bytes(x.encode()) for x in got]


def test_lookup_finds_its_keys():
    keys = np.random.default_rng(1).integers(1, 1 << 62, 5000)
    table = common.Lookup(keys)
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + 1) == -1).sum() > 4990
    assert (common.Lookup(np.zeros(0, np.int64)).find(keys[:3]) == -1).all()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    first, rest = edges[:30], [e for e in edges[30:] if e[0] is not None]
    grown = extend(components(spark.createDataFrame(first, "a long, b long")), spark.createDataFrame(rest, "a long, b long"))
    assert {x.node: x.component for x in grown.collect()} == got


def test_components_of_small_graphs_take_few_jobs(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(6).shuffle(chain)
    edges = spark.createDataFrame(chain, "a long, b long")
    named = edges.select(*(F.sha2(F.col(x).cast("string"), 256).cast("binary").alias(x) for x in "ab"))
    spark.sparkContext.setJobGroup("small", "small")
    try:
        got = {x.node: x.component for x in components(edges).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("small"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(201), 0) and jobs <= 12, jobs
    small = {bytes(x.node): bytes(x.component) for x in components(named).collect()}
    monkeypatch.setattr(common, "TASK_ROWS", 10)  # now they are worked on by stars
    assert {x.node: x.component for x in components(edges).collect()} == got
    assert {bytes(x.node): bytes(x.component) for x in components(named).collect()} == small
    assert len(small) == 201 and set(small.values()) == {min(small)}


def test_near_duplicates_are_those_of_all_pairs(spark, docs, empty):
    got = minhash.near_duplicates(docs, 3, 85).collect()
    sets = {}
    for i, t in texts(docs):
        w = words_of(lower(t))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.doc_id is None or (r.component_id, r.kept) == (root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert len(got) == docs.count() and minhash.near_duplicates(empty, 3, 85).count() == 0
    kept = [r.doc_id for r in minhash.deduplicate(docs, 3, 85).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({v for v in root.values()}) and kept.count(None) == 1


def test_copies_of_an_original_with_a_large_id_are_one_component(spark):
    r = random.Random(4)
    words, rows = [f"w{r.randint(0, 10**6)}" for _ in range(300)], []
    for k in range(1000):
        w = list(words)
        for i in r.sample(range(300), r.randint(5, 7)):
            w[i] = f"x{r.randint(0, 10**9)}"
        rows.append((k, " ".join(w), "en", "a"))
    rows.append((10**6, " ".join(words), "en", "a"))
    got = minhash.near_duplicates(spark.createDataFrame(make(rows), DOCS), 3, 85)
    assert got.count() == 1001 and got.select("component_id").distinct().count() == 1


def test_pairs_on_a_common_template_are_all_linked(spark):
    """A thousand documents of one template: pairs are linked at 0.87, rows of different pairs stay just below the threshold."""
    r = random.Random(12)
    words, rows = [f"w{r.randint(0, 10**6)}" for _ in range(400)], []
    for k in range(500):
        pair = list(words)
        for i in r.sample(range(400), 3):
            pair[i] = f"x{r.randint(0, 10**9)}"
        for m in range(2):
            w = list(pair)
            for i in r.sample(range(400), 5):
                w[i] = f"x{r.randint(0, 10**9)}"
            rows.append((2 * k + m, " ".join(w), "en", "a"))
    sets = [set(x.tolist()) for x in minhash.shingle_sets([t.encode() for _, t, *_ in rows], 3)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(make(rows), DOCS), 3, 85).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and 200 < len(set(got.values())) < 600


def test_rows_of_one_id_are_one_node_of_classes(spark):
    x, y, z = (prose(random.Random(k), n=40) for k in range(3))
    rows = [(1, x, "en", "a"), (5, x, "en", "a"), (5, y, "en", "b"), (9, y, "en", "a"), (5, "", None, None), (None, z, None, None), (None, y, None, None)]
    frame = spark.createDataFrame(make(rows), DOCS)
    got = collections.Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash.near_duplicates(frame, 3, 85).collect())
    assert got == collections.Counter([(1, True, 1, True), (5, True, 1, False), (5, True, 1, False), (9, True, 1, False), (5, False, 5, True), (None, True, None, False), (None, True, 1, False)])
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in minhash.deduplicate(frame, 3, 85).collect()))
    assert kept == sorted([(False, 1, x), (False, 5, y), (False, 5, ""), (True, 0, z)])


def test_prefix_pairs_contain_all_links(spark):
    r, rows = random.Random(6), []
    for k in range(60):
        w = [f"w{(k % 6) * 1000 + i}" for i in range(100)]
        for i in r.sample(range(100), r.randint(0, 4)):
            w[i] = f"x{r.randint(0, 10**9)}"
        rows.append((k, " ".join(w).encode()))
    texts_ = spark.createDataFrame(rows, "node long, text binary")
    got = {(x.a, x.b) for x in minhash.prefix_pairs(texts_.select("node", F.col("node").alias("comp")), texts_, 3, 85).collect()}
    sets = {i: set(x.tolist()) for i, x in enumerate(minhash.shingle_sets([t for _, t in rows], 3))}
    linked = {(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked and linked <= got and len(got) < 60 * 59 / 2


def test_densified_signatures_keep_the_collision_rate():
    r = np.random.default_rng(2)
    rates = []
    for _ in range(40):
        common_ = r.integers(1, 1 << 63, 30, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((common_, r.integers(1, 1 << 63, 3, dtype=np.uint64)))) for _ in range(2))
        rates.append((minhash.band_keys([a]) == minhash.band_keys([b])).mean())
    assert 0.3 < np.mean(rates) < 0.65  # 30 of 36 in common, four bins to a band: 0.48


def windows(item, size=10):
    return [tuple(item[k : k + size]) for k in range(max(1, len(item) - size + 1))] if item else []


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def test_decontamination_finds_every_window(spark, docs, empty):
    r = random.Random(9)
    some = [t for _, t in texts(docs) if len(t.split()) > 40][:6]
    items = [(k, " ".join(t.split()[3:25]) + ("!" if k % 2 else "")) for k, t in enumerate(some)]
    items += [(10, "One"), (11, None), (12, "?!"), (13, "one TWO"), (14, "word word word"), (15, prose(r)), (15, items[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = collections.defaultdict(set)
    for i, t in items:
        for w in windows(alnum(t or "")):
            known[w].add("" if i is None else str(i))
    sizes = sorted({len(w) for w in known})
    want = []
    for i, t in texts(docs):
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in known:
                    found |= known[x]
                    hit.update(range(k, k + n))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=key) == sorted(want, key=key)
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    old = decontaminate.BLOCK_WORDS
    try:
        blocks = list(decontaminate.blocks(bench, 10, 30))
        assert len(blocks) > 2
    finally:
        decontaminate.BLOCK_WORDS = old
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.report(clean, bench).where("n_hit > 0").count() == 0
    untouched = {x[0] for x in want if not x[2]}
    assert untouched <= {r.doc_id for r in clean.collect()}


def test_texts_are_held_by_slices(spark, monkeypatch):
    """Of a batch of texts no more than a slice is held as objects and arrays at once, and a text goes to Python once."""
    runs, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, real=kind.mapInArrow: runs.append((f, self.schema)) or real(self, f, *a))
    frame = spark.createDataFrame([(1, "one", "en")], "doc_id long, text string, lang string")
    decontaminate.clean(frame, spark.createDataFrame([("q", prose(random.Random(1)))], "item_id string, text string"))
    minhash.confirm(spark.createDataFrame([(2, 1)], "a long, b long"), spark.createDataFrame([(1, b"a"), (2, b"b")], "node long, text binary"), 3, 85)
    text, n = prose(random.Random(2), "en", 30000), 32
    ids, texts = pa.array(range(n)), pa.array([text] * n)
    spans = pa.array([None] * n, pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "from_byte", "to_byte")])))
    batches = [[ids, texts, pa.array(["en"] * n), pa.array([0] * n), spans, pa.array([[]] * n, pa.list_(pa.string()))], [ids, ids, texts.cast(pa.binary()), texts.cast(pa.binary())]]
    assert n * len(text) > 3 * common.SLICE_BYTES
    for (run, schema), columns in zip(runs, batches, strict=True):
        list(run(iter([pa.RecordBatch.from_arrays([c.slice(0, 1) for c in columns], schema.names)])))
        tracemalloc.start()
        for _ in run(iter([pa.RecordBatch.from_arrays(columns, schema.names)])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 * common.SLICE_BYTES, schema.names
    language.known_only(frame, *language.fit(frame))
    assert [f.dataType.simpleString() for f in runs[-1][1]] == ["bigint", "string", "string", "boolean"]


def test_decontamination_in_blocks_gives_the_same(spark, docs, monkeypatch):
    some = [t for _, t in texts(docs) if len(t.split()) > 40][:5]
    bench = spark.createDataFrame([(k, " ".join(t.split()[k : k + 20])) for k, t in enumerate(some * 2)], "item_id long, text string")
    whole = sorted(map(str, decontaminate.report(docs, bench).collect()))
    real = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b, w: real(b, w, 45))
    assert sorted(map(str, decontaminate.report(docs, bench).collect())) == whole


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]


def test_personal_data_spans(spark, empty):
    r = random.Random(4)
    alphabet = ["a.b@c.de", "a@b.co_x@d.org", "@", ".", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345", "+1 (212) 555-0100", "+4", "é𝕏", " ", "-", "  ", "4111111111111111", "\n", "+49.30.123456789012345", "x@y", "%", "0000000000000"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 14))), "en", "a") for i in range(400)]
    rows += [(500, None, None, None), (501, "", None, None), (502, "7 " * 20000, "en", "a"), (503, "9" * 30000, "en", "a"), (504, "a" * 50000, "en", "a"), (505, "a.b@c.de " * 500, "en", "a")]
    docs = spark.createDataFrame(make(rows), DOCS)
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    for i, t, *_ in rows:
        spans = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t, spans, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(got[i].spans.split(",")) | ({""} if not spans else set())
    assert pii.report(empty).count() == 0
    again = {x.doc_id: x.base_sha256 for x in pii.report(docs.repartition(7)).collect()}
    assert again == {i: x.base_sha256 for i, x in got.items()}
    hidden = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert hidden[500] is None and "@c.de" not in hidden[505] and hidden[505].count("[EMAIL]") == 500


def test_personal_data_of_a_long_text_takes_linear_time(spark, tmp_path):
    import time

    took = []
    for n in (2000, 8000, 32000):
        spark.createDataFrame([(1, " ".join(f"é user{k}@ex.org now" for k in range(n)))], "doc_id long, text string").write.parquet(f"{tmp_path}/{n}")
        frame = spark.read.parquet(f"{tmp_path}/{n}")
        start = time.perf_counter()
        assert pii.report(frame).first().n_email == n
        assert pii.redact(frame).first().text == " ".join(["é [EMAIL] now"] * n)
        took.append(time.perf_counter() - start)
    assert took[2] < 60 and took[2] < 16 * max(took[1], 1)


def test_contexts_find_unseen_identifiers(spark):
    r = random.Random(1)
    rows = [(i, f"{prose(r, n=5)} please call the number +1 212 555 {1000 + i} today {prose(r, n=5)}", "en", "a") for i in range(30)]
    rows += [(100, "so please call the number 212-555-7777 today", "en", "a"), (101, "it weighs 212-555-7778 grams", "en", "a")]
    got = {x.doc_id: x.spans for x in pii.report(spark.createDataFrame(make(rows), DOCS)).collect()}
    assert got[100] == "phone:26:38" and got[101] == ""


def test_mixing_meets_its_targets(docs, empty):
    got = mixing.mix(docs, block=4, shard=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block=4, shard=500).collect()))
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words_of(r.text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(size.values()), {}, set(names)
    while True:
        left = total - sum(3 * size[s] for s in names if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * size[s] for s in names}
        over = {s for s in open_ if target[s] > 3 * size[s]}
        if not over:
            break
        open_ -= over
    taken, by_id = collections.Counter(), {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        s = by_id[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= max(20, 0.01 * target[s]) for s in names)
    assert mixing.mix(empty).count() == 0


def test_apportionment_is_highest_quotients(spark):
    r = random.Random(8)
    for seats in (0, 1, 7, 100, 1003):
        weights = [(k, r.randint(1, 1000) * 1.0) for k in range(23)]
        df = spark.createDataFrame([(k, w, seats) for k, w in weights], "item long, w double, seats long")
        got = {x.item: x.quota for x in mixing.apportion(df, [], ["item"], "w", "seats").collect()}
        quotients = sorted(((-w / (2 * n - 1), k) for k, w in weights for n in range(1, seats + 2)))[:seats]
        assert got == {k: sum(1 for _, x in quotients if x == k) for k, _ in weights}


def test_tokens_are_the_librarys(docs, empty):
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(6)
    pieces = ["a", " ", "  ", "\n", "▁", "the", "ing", "日", "é", "!", "==", "\t", "1", "𝕏", "\u0000", "<s>", "aaaa"]
    more = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(500)] + [" " * 70, "ab" * 9000]
    assert tokens.merger(path).count(more) == [len(x) for x in library.encode(more, num_threads=1)]
    for row in tokens.token_counts(docs, path, 100).join(docs.select("doc_id", "text"), "doc_id").collect():
        t = row.text or ""
        n = len(library.encode(t))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(t.encode()), n, n > 100)
    assert tokens.token_counts(empty, path).count() == 0


def test_quality_rules(spark, docs, empty):
    r = random.Random(7)
    extra = [(i, "\n".join(r.choice(["a b c", "d e f g h i", "", " ", "x # y", "a b c"]) for _ in range(r.randint(0, 12))), "en", "a") for i in range(400, 460)]
    all_ = docs.union(spark.createDataFrame(make(extra), DOCS))
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(60)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    ratio = quality.fit_ratio(all_, labels)
    got = collections.defaultdict(list)
    for x in quality.quality(all_, ratio).collect():
        got[x.doc_id].append(x)
    for i, t in texts(all_):
        w = words_of(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        x = got[i][0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed), i
        assert not (failed and x.kept)
    plain = collections.Counter(), collections.Counter()
    good = {i for i in range(60) if i % 3}
    frames = [(i, t.encode() + b"\n") for i, t in texts(all_)]
    for i, t in frames:
        grams = [int(quality._grams(np.frombuffer(t[k : k + 4], np.uint8))[0]) for k in range(len(t) - 3)] if len(t) < 5000 else quality._grams(np.frombuffer(t, np.uint8)).tolist()
        plain[0].update(grams)
        if i in good:
            plain[1].update(grams)
    size = 1 << quality.BITS
    raw, target = ([c[k] + 0.5 for k in range(size)] for c in plain)
    target = [t + 2000 * x / sum(raw) for t, x in zip(target, raw, strict=True)]
    logs = [math.log(t / sum_t) - math.log(x / sum_x) for sum_t, sum_x in [(sum(target), sum(raw))] for t, x in zip(target, raw, strict=True)]
    for i, t in frames:
        grams = quality._grams(np.frombuffer(t, np.uint8)).tolist()
        want = sum(logs[g] for g in grams) / len(grams) if grams else 0.0
        assert abs(got[i][0].llr - want) < 2e-6 and got[i][0].kept == (not got[i][0].base_failed and got[i][0].llr >= quality.THRESHOLD), i
    other = quality.quality(all_.orderBy(F.desc("doc_id")).repartition(7), quality.fit_ratio(all_.repartition(3), labels)).collect()
    assert sorted(map(str, other)) == sorted(str(x) for rows in got.values() for x in rows)
    assert not quality.fit_ratio(all_, labels.limit(0)).any() and quality.quality(empty, ratio).count() == 0
    assert quality.fit_ratio(empty, labels).shape == ratio.shape


def test_language(docs, empty):
    langs, p = language.fit(docs)
    assert langs == ["de", "en", "fr"]
    got = language.identify(docs, langs, p).join(docs.select("doc_id", "lang", "text"), "doc_id").where("doc_id < 120").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.97 and all(0 <= x.score <= 1 for x in got)
    q = language.fit(docs.orderBy(F.desc("doc_id")).repartition(6))
    assert q[0] == langs and (q[1] == p).all()
    plain = collections.defaultdict(collections.Counter)
    for x in docs.where("lang is not null and text is not null").collect():
        plain[x.lang].update(language._codes(x.text.encode()).tolist())
    assert {(x.lang, x.bucket): x.n for x in language.gram_counts(docs).collect()} == {(a, g): n for a, c in plain.items() for g, n in c.items()}
    none = {x.doc_id: x for x in language.identify(docs, langs, p).collect() if x.doc_id in (302, 303, 304, 308)}
    assert {x.lang_pred for x in none.values()} == {"und"} and len(none) == 4
    assert language.identify(empty, langs, p).count() == 0 and language.fit(empty)[0] == []
    assert {x.lang_pred for x in language.identify(docs, *language.fit(empty)).collect()} == {"und"}
    r = random.Random(2)
    both = docs.sparkSession.createDataFrame(make([(1, prose(r, "en", 300) + " " + prose(r, "fr", 200), None, None)]), DOCS)
    assert language.identify(both, langs, p).first().lang_set == ["en", "fr"]


def tree_scores(texts_, heavy, divergence):
    """Plain suffix tree of one and two words before a token.  texts_: tokens and whether to learn from them."""
    counts = collections.Counter(w for tokens_, learn in texts_ if learn for w in tokens_)
    total, kinds = sum(counts.values()), len(counts)
    often = {w for w in counts if counts[w] * heavy >= total}
    u = lambda w: (counts[w] + 1) / (total + kinds + 1)
    rest = max(1 - sum(map(u, often)), 1e-12)
    test_u = lambda w: u(w) if w in often else rest / max(1, kinds + 1 - len(often))
    after, one, two = (collections.defaultdict(collections.Counter) for _ in range(3))

    def moves(tokens_):
        for k, w in enumerate(tokens_):
            a, b = tokens_[k - 1] if k else "\n", tokens_[k - 2] if k > 1 else "\n"
            yield w, a, b, "own" if a not in often else "away" if b not in often else "none"

    for tokens_, learn in texts_:
        for w, a, b, kind in moves(tokens_) if learn else ():
            if a in often:
                after[a][w if w in often else None] += 1
            else:
                one[a][w] += 1
            if kind != "none":
                two[kind, a, b][w] += 1

    def smooth(c, w, p):
        return (c[w] + len(c) * p) / (sum(c.values()) + len(c)) if c else p

    def frequent(a, w, p):
        c = after[a]
        if not c:
            return p
        seen = c[w] if w in often else c[None] * p / rest
        return (seen + len(c) * p) / (sum(c.values()) + len(c))

    def gain(c, p):
        return sum(n * math.log(smooth(c, w, p(w)) / p(w)) for w, n in c.items())

    suffix = lambda kind, a: (lambda w: smooth(one[a], w, test_u(w))) if kind == "own" else (lambda w: frequent(a, w, test_u(w)))
    keep2 = {x for x, c in list(two.items()) if gain(c, suffix(x[0], x[1])) >= divergence}
    keep1 = {a for a, c in list(one.items()) if gain(c, test_u) >= divergence} | {a for kind, a, _ in keep2 if kind == "own"}
    out = []
    for tokens_, _ in texts_:
        score = 0.0
        for w, a, b, kind in moves(tokens_):
            p = frequent(a, w, u(w)) if a in often else smooth(one[a], w, u(w)) if a in keep1 else u(w)
            if (kind, a, b) in keep2:
                p = smooth(two[kind, a, b], w, p)
            score += math.log10(p)
        out.append(score)
    return out, counts


def test_suffix_tree_scores_are_those_of_a_plain_tree(spark, docs, empty):
    train = common.fold("doc_id", 7) != 2
    r = random.Random(3)
    some = ["the", "of", "cat", "sat", "on", "mat", "Über", "x"]
    rows = [(i, " ".join(r.choice(some[: 2 + i % 7]) if r.random() < 0.8 else f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 40))), "en", "a") for i in range(1000, 1150)]
    rows += [(1200 + k, "a passage that is repeated word for word in " + ("some" if k % 2 else "other") + " texts", "en", "a") for k in range(6)]
    every = docs.union(spark.createDataFrame(make(rows), DOCS))
    plain = [(i, [*words_of(lower(t)), "\n"]) for i, t in texts(every)]
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in plain]
    for heavy, divergence in ((1000, 2.0), (30, 2.0), (10, 20.0)):
        want, counts = tree_scores([(w, x) for (_, w), x in zip(plain, learn, strict=True)], heavy, divergence)
        total, kinds = sum(counts.values()), len(counts)
        scored = suffixtree.score(every.repartition(5), train, heavy, divergence, 3000, 400)
        assert (scored.tokens, scored.types) == (total, kinds)
        got = collections.defaultdict(list)
        for x in scored.rows.collect():
            got[x.doc_id].append(x)
        for (i, w), value in zip(plain, want, strict=True):
            base = sum(math.log10((counts[y] + 1) / (total + kinds + 1)) for y in w)
            assert len(got[i]) == sum(j == i for j, _ in plain)
            x = got[i][0]
            assert (x.n_tokens, x.n_known) == (len(w), sum(counts[y] > 0 for y in w)) and math.isclose(x.base_score, base, rel_tol=1e-9), i
            assert math.isclose(x.score, value, rel_tol=1e-5), (i, heavy)
    held = [(value, sum(math.log10((counts[y] + 1) / (total + kinds + 1)) for y in w)) for (_, w), x, value in zip(plain, learn, want, strict=True) if not x]
    assert sum(a for a, _ in held) > sum(b for _, b in held)


def whole_tree_scores(texts_, heavy, divergence):
    """Plain suffix tree with every context of one and two words over every next word; only tests know rarer next words as one class."""
    counts = collections.Counter(w for tokens_, learn in texts_ if learn for w in tokens_)
    total, kinds = sum(counts.values()), len(counts)
    often = {w for w in counts if counts[w] * heavy >= total}
    u = lambda w: (counts[w] + 1) / (total + kinds + 1)
    rest = max(1 - sum(map(u, often)), 1e-12)
    test_u = lambda w: u(w) if w in often else rest / max(1, kinds + 1 - len(often))
    moves = lambda t: [(w, t[k - 1] if k else "\n", t[k - 2] if k > 1 else "\n") for k, w in enumerate(t)]
    one, two, classes = (collections.defaultdict(collections.Counter) for _ in range(3))
    for tokens_, learn in texts_:
        for w, a, b in moves(tokens_) if learn else ():
            one[a][w] += 1
            two[a, b][w] += 1
            classes[a][w if w in often else None] += 1

    def smooth(c, w, p):
        return (c[w] + len(c) * p) / (sum(c.values()) + len(c)) if c else p

    def test_p(a, w):
        if a not in often:
            return smooth(one[a], w, test_u(w))
        c, p = classes[a], test_u(w)
        return ((c[w] if w in often else c[None] * p / rest) + len(c) * p) / (sum(c.values()) + len(c)) if c else p

    def gain(c, p):
        return sum(n * math.log(smooth(c, w, p(w)) / p(w)) for w, n in c.items())

    keep2 = {x for x, c in list(two.items()) if gain(c, lambda w: test_p(x[0], w)) >= divergence}  # noqa: B023
    keep1 = {a for a, c in list(one.items()) if a in often or gain(c, test_u) >= divergence} | {a for a, _ in keep2}
    out = []
    for tokens_, _ in texts_:
        score = 0.0
        for w, a, b in moves(tokens_):
            p = smooth(one[a], w, u(w)) if a in keep1 else u(w)
            score += math.log10(smooth(two[a, b], w, p) if (a, b) in keep2 else p)
        out.append(score)
    return out


def test_suffix_tree_query_keeps_what_follows_frequent_words(spark, docs, tmp_path):
    r = random.Random(4)
    some = ["the", "of", "cat", "sat", "on", "mat", "Über", "x"]
    rows = [(i, " ".join(r.choice(some[: 2 + i % 7]) if r.random() < 0.8 else f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 40))), "en", "a") for i in range(1000, 1150)]
    rows += [(1200 + k, "of the secret of the secret on the record", "en", "a") for k in range(30)]
    every = docs.union(spark.createDataFrame(make(rows), DOCS))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    plain = [(i, [*words_of(lower(t)), "\n"]) for i, t in texts(every)]
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in plain]
    given = [(w, x) for (_, w), x in zip(plain, learn, strict=True)]
    want = dict(zip((i for i, _ in plain), whole_tree_scores(given, suffixtree.HEAVY, suffixtree.DIVERGENCE), strict=True))
    got = {x.doc_id: x.score for x in queries.op7_suffixtree(spark, str(tmp_path)).collect()}
    wrong = [i for i in want if i != 1 and not math.isclose(got[i], want[i], rel_tol=1e-5)]  # two texts have id 1
    assert not wrong, len(wrong)
    train = common.fold("doc_id", 7) != 2
    for heavy, divergence in ((30, 2.0), (10, 20.0)):  # many slices and buckets
        want = whole_tree_scores(given, heavy, divergence)
        got = {x.doc_id: x.score for x in suffixtree.score(every.repartition(5), train, heavy, divergence, 3000, 400, whole=True).rows.collect()}
        assert all(math.isclose(got[i], value, rel_tol=1e-5) for (i, _), value in zip(plain, want, strict=True) if i != 1), heavy
    none = suffixtree.score(docs, F.lit(None).cast("boolean"), whole=True)
    assert {x.score for x in none.rows.collect()} == {0.0} and none.rows.count() == docs.count()
    assert suffixtree.score(docs.limit(0), F.lit(True), whole=True).rows.count() == 0


def test_suffix_tree_without_anything_to_learn_from(docs, empty):
    none = suffixtree.score(docs, F.lit(None).cast("boolean"))
    assert (none.tokens, none.types) == (0, 0) and {(x.score, x.n_known) for x in none.rows.collect()} == {(0.0, 0)} and none.rows.count() == docs.count()
    assert suffixtree.score(empty, F.lit(True)).rows.count() == 0


def test_packing_of_arrays():
    kinds = [np.uint64, np.uint8, np.float32]
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint8), np.array([0.5, 3.0], np.float32)]
    assert all((x == y).all() for x, y in zip(suffixtree._unpack(suffixtree._pack(arrays), kinds), arrays, strict=True))


def test_licenses(spark, docs, empty):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "  "), None, None), (2, "text\nreleased under the MIT licence", None, None), (3, mit + " and more", None, None), (4, None, None, None), (5, "", None, None)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(make(rows), DOCS)).collect()}
    assert got[1].license == "MIT" and got[2].license is None and (got[2].n_notices, got[2].notices) == (1, "MIT")
    assert got[3].license is None and got[4].n_notices == 0 and got[4].digest == got[5].digest
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(11)
    bad = ["idiot", "moron", "loser"]
    rows, labels = [], []
    for i in range(300):
        t, toxic = prose(r, n=40).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                t.insert(r.randint(0, len(t)), r.choice(bad))
        rows.append((i, " ".join(t), "en", "a"))
        labels.append((i, 1, int(toxic)))
    hidden = ["you 1d10t " + prose(r, n=20), "an iiidiiot and a l0s3r " + prose(r, n=20), "such an i d i o t and m.o.r.o.n " + prose(r, n=20)]
    frame = spark.createDataFrame(make(rows + [(900 + k, t, "en", "a") for k, t in enumerate(hidden)]), DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, marks)
    assert [model.word(w)[0] for w in ("1d10t", "iiidiot", "m-o-r-o-n", "plain", "!!")] == ["idiot", "idiot", "moron", "plain", ""]
    got = {x.doc_id: x.score for x in toxicity.score(frame, model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(t) for i, _, t in labels]) > 0.97
    assert min(got[900 + k] for k in range(3)) > 0.5
    assert all(0 <= x.score <= 1 for x in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.fit(frame, marks.where("toxic = 0"))
    assert len({round(x.score, 9) for x in toxicity.score(docs, flat).collect()}) == 1


def test_spaced_and_doubled_letters_are_restored(spark):
    r = random.Random(11)
    bad, rows, labels = ["idiot", "moron", "loser"], [], []
    for i in range(400):
        t, toxic = prose(r, n=40).split(), i % 4 == 0
        for _ in range(3 if toxic else 0):
            t.insert(r.randint(0, len(t)), r.choice(bad))
        rows.append((i, " ".join(t), "en", "a"))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(make(rows), DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    disguised = ["a l o s e r", "y o u i d i o t", "i  d\ti\no  t", "looser", "iidiot", "mmoron", "y o u a r e a m 0 r o n"]
    found = [{core for w in toxicity.words_of("prose " + t + " prose") for core, _ in model.hits(w)} for t in disguised]
    assert found == [{"loser"}, {"idiot"}, {"idiot"}, {"loser"}, {"idiot"}, {"moron"}, {"moron"}]
    hidden = spark.createDataFrame(make([(k, t + " " + prose(r, n=20), "en", "a") for k, t in enumerate(disguised)]), DOCS)
    assert all(x.score > 0.5 for x in toxicity.score(hidden, model).collect())


def test_entire_licences_are_known(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    bsd = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + licenses._BSD_GRANT + "\n\n" + "".join(f"* {c.format(owner='the copyright holder')}\n" for c in licenses._BSD_CLAUSES) + licenses._BSD_END.format(holder="HOLDERS", one="HOLDER")
    rows, want = [(0, bsd, None, None), (1, "code\n# SPDX-License-Identifier: MPL-2.0\n", None, None)], {0: "BSD-3-Clause", 1: None}
    for k, (name, license_) in enumerate(names.items()):
        if not os.path.exists(f"{folder}/{name}"):
            continue
        with open(f"{folder}/{name}") as f:
            rows.append((10 + k, f.read(), None, None))
        want[10 + k] = license_
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(make(rows), DOCS)).collect()}
    assert {i: x.license for i, x in got.items()} == want and got[1].notices == "MPL-2.0"
    found = licenses.known(spark).groupBy("known").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()
    assert not found


def test_every_known_text_has_a_trigger(spark):
    plain = [t.lower() for _, t in (*licenses.KNOWN, *licenses.MORE)]
    assert all(any(x in t for x in licenses.TRIGGERS) for t in plain)
    odd = [(1, "x\nReleased under the MIT Licence.\nreleased UNDER the mit license\n" + licenses.KNOWN[9][1], "en", "a"), (2, "licensed under the licence", None, None), (1, licenses.KNOWN[0][1].replace("\n", " "), None, None)]
    got = sorted((x.doc_id, x.license or "", x.n_notices, x.notices) for x in licenses.scan(spark.createDataFrame(make(odd), DOCS)).collect())
    assert got == [(1, "", 3, "Apache-2.0,MIT"), (1, "MIT", 1, "MIT"), (2, "", 0, "")]


def test_decoded_words_are_the_cheapest_paths():
    """Viterbi decoding against all paths of the lattice, and all ways to cut a run."""
    r = np.random.default_rng(3)
    cost = r.uniform(0.5, 6, (28, 28, 28))
    model = toxicity.Model(cost, {"bad$": 3.0, "ad$": 1.0, "ab": 2.0}, np.zeros(toxicity.WIDTH))

    def paths(token):
        out, before = [(0.0, "")], ""
        for c in token:
            letters, read = (c, 0.0) if c.isalpha() else (toxicity.SIGNS.get(c, ""), toxicity.READ)
            leave = toxicity.REPEAT if c == before and c.isalpha() else None if c.isalpha() else toxicity.SKIP if c in toxicity.SIGNS else 0.2
            new = []
            for value, word in out:
                new += [(value + read, word + x) for x in letters]
                new += [(value + leave, word)] if leave is not None else []
            out, before = new, c
        return out

    def letters_cost(word):
        x = [0, 0, *map(toxicity._letter, word), 0]
        return sum(cost[a, b, c] for a, b, c in zip(x, x[1:], x[2:], strict=False))

    for token in ("a1b", "bb4dd", "0-1", "aaa", "$6!", "é1é", "b.a.d"):
        best = min((value + letters_cost(word), word) for value, word in paths(token))
        assert model.restore(token) == best[1], token

    def cuts(run):
        if not run:
            yield []
        for k in range(1, len(run) + 1):
            for rest in cuts(run[k:]):
                yield [run[:k], *rest]

    for run in ("badab", "abadé", "xyzbad"):
        value = lambda words: sum(letters_cost(w) - model.weights.get(w + "$", 0.0) for w in words) + toxicity.CUT * (len(words) - 1)  # noqa: B023, E731
        assert math.isclose(value(model.cut(run)), min(map(value, cuts(run))), rel_tol=1e-9), run


def test_letter_counts_are_those_of_each_document(docs):
    plain = np.zeros((28,) * 3)
    for _, t in texts(docs):
        codes = [0]
        for c in t:
            x = toxicity._letter(lower(c)) if c.isalpha() or ord(c) >= 0xC0 else 0
            if x or codes[-1]:
                codes.append(x)
        if codes[-1]:
            codes.append(0)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            plain[a, b, c] += 1
    got = toxicity.letter_counts(docs)
    assert (got == plain).all() and (toxicity.letter_counts(docs.repartition(5)) == got).all()


def test_discovered_identifiers_are_those_of_plain_rounds(spark):
    r = random.Random(5)
    seeds = [f"+1 212 555 {1000 + i}" for i in range(20)]
    unseen = [f"212-555-{2000 + i}" for i in range(12)] + [f"user{i}@host" for i in range(5)]
    edges = sorted({(r.choice(seeds + unseen), f"p{r.choice([0, 0, 0, 1, 1, 2, 3])}") for _ in range(150)})
    frame = spark.createDataFrame([(v, [p]) for v, p in edges] * 2, "value string, patterns array<string>")
    fits = {v: {"phone"} if v[0] == "2" else {"email"} for v in unseen}
    size = collections.Counter(p for _, p in edges)
    scores = {(v, "phone"): 1.0 for v, _ in edges if v in seeds}
    for _ in range(pii.ROUNDS):
        sums = collections.Counter()
        for v, p in edges:
            for k in ("phone", "email"):
                sums[p, k] += scores.get((v, k), 0.0)
        sure = {x: s / size[x[0]] * min(1.0, math.log2(s + 1) / math.log2(2 * 5 + 1)) for x, s in sums.items() if s >= 5}
        sure = {x: c for x, c in sure.items() if c >= pii.CONFIDENCE}
        scores = {(v, "phone"): 1.0 for v, _ in edges if v in seeds}
        for v in unseen:
            for k in fits[v]:
                c = [sure[p, k] for x, p in edges if x == v and (p, k) in sure]
                if c:
                    scores[v, k] = 1 - math.prod(max(1 - x, 1e-9) for x in c)
    want = {(v, pii.KINDS.index(k)) for (v, k), s in scores.items() if v in unseen and s >= pii.SCORE}
    assert {(x.value, x.kind) for x in pii.discover(frame).collect()} == want and want


def test_language_sets_grow_by_the_best_language():
    r = np.random.default_rng(1)
    p = r.dirichlet(np.full(40, 0.2), 4) * 0.99 + 0.01 / 40
    for parts in ((1.0, 0, 0, 0), (0.6, 0, 0.4, 0), (0.4, 0.3, 0, 0.3)):
        n = np.bincount(r.choice(40, 600, p=np.array(parts) @ p), minlength=40).astype(float)
        some = n > 0
        theta, value = language.infer(p[:, some], n[some])
        cost = language.PENALTY * 0.5 * math.log(n.sum() + 1)
        best = {}
        for mask in range(1, 16):
            chosen = [i for i in range(4) if mask >> i & 1]
            part, fit = language._mix(p[chosen][:, some], n[some], np.full(len(chosen), 1 / len(chosen)), 300)
            best[mask] = fit - cost * len(chosen)
        found = sum(1 << i for i in range(4) if theta[i] > 0)
        assert found == max(best, key=best.get) == sum(1 << i for i in range(4) if parts[i]) and math.isclose(theta.sum(), 1)


def test_rare_insults_of_a_large_sample_are_learned(spark):
    rows = [(f"plain words {'zounderkite' if k < 8 else 'more'}".encode(), int(k < 900)) for k in range(9000)]
    weights, t, n = toxicity.learn_lexicon(spark.createDataFrame(rows, "text binary, toxic long"))
    assert (t, n) == (900, 8100) and weights["zounderkite$"] > 1
