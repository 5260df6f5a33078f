"""The pipeline, stage by stage, on the smallest tables."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    from test_llm import alnum, plain_spans, windows

    docs = corpus_pipeline.table(spark, SF, "documents")
    known = {w for r in corpus_pipeline.table(spark, SF, "benchmark").collect() for w in windows(alnum(r.text or ""))}
    sizes = {len(w) for w in known}
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        if name != "mixing":
            assert out.columns == docs.columns
        docs, kept[name] = out, {r.doc_id: r.text for r in out.collect()}
    assert set(kept["language"]) == {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t)}
    assert len(kept["near_duplicates"]) < len(kept["language"])
    for t in kept["decontamination"].values():
        w = alnum(t)
        assert not any(tuple(w[k : k + n]) in known for n in sizes for k in range(len(w) - n + 1))
    assert set(kept["pii"]) == set(kept["decontamination"]) and not any(plain_spans(t) for t in kept["pii"].values())
    assert set(kept["mixing"]) <= set(kept["pii"]) and len(kept["mixing"]) > 0.8 * len(kept["pii"])
    again = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == kept["mixing"]


def test_mixed_texts_consist_of_what_is_taken(spark):
    from collections import Counter

    from test_llm import words_of

    docs = corpus_pipeline.table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    size, out, target = Counter(), Counter(), {}
    for r in docs.collect():
        size[r.source] += len(words_of(r.text or ""))
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        w, whole = words_of(r.text), Counter(words_of(texts[r.doc_id]))
        assert len(w) == r.taken and r.n_chars == len(r.text)
        assert all(n <= 3 * whole[x] for x, n in Counter(w).items())
        out[r.source] += len(w)
        target[r.source] = r.target
    assert all(abs(out[s] - target[s]) <= max(20, 0.01 * target[s]) for s in target)
    assert any(out[s] < 0.9 * size[s] for s in target) or any(out[s] > 1.1 * size[s] for s in target)


def _odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns whose names clash with results and helpers."""
    import random

    from test_llm import prose

    r = random.Random(8)
    rows = [(i, prose(r, lang := r.choice(["en", "fr"]), 60), lang, r.choice(["a", "b", None]), 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, "!! 12 34", "en", "a", 8), (None, prose(r, "en", 80), "en", "a", 2), (None, prose(r, "en", 80), "en", None, 2)]
    rows += [rows[3], rows[3], (63, rows[5][1], "en", "b", 1), (7, prose(r, "fr", 70), "fr", "b", 3)]
    rows += [(64, prose(r, "en", 30000), "en", "b", 9), (65, "mail a.b@c.de or +1 (212) 555-0100 " + prose(r, "en", 50), "en", "a", 9), (66, "日本語のテキストです。" * 30, "ja", None, None)]
    clash = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, score string, spans string, _found string, _text string, _key string, key string, n_words int, hit_spans string, passes string, lang_pred string, known string, carry_0 string, found string, mark string, new string, _new string, slice int"
    names = [c.split(" ")[0] for c in clash.split(", ")[5:]]
    return spark.createDataFrame([(*x, *[5 if n in ("n_words", "slice") else f"{n} {x[0]}" for n in names]) for x in rows], clash), names


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    docs, names = _odd(spark)
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or len(out.columns) == len(docs.columns))
        rows = out.collect()
        assert rows and all(getattr(r, n) == (5 if n in ("n_words", "slice") else f"{n} {r.doc_id}") for r in rows for n in names)
        docs = out if name != "mixing" else docs
    ids = [r.doc_id for r in docs.collect()]
    assert not {60, 61, 62} & set(ids) and {64, 65} <= set(ids) and ids.count(3) == 1 and ids.count(7) == 2 and ids.count(None) == 2 and len({5, 63} & set(ids)) == 1
    assert "[EMAIL]" in next(r.text for r in docs.collect() if r.doc_id == 65) and before
    assert {"_size", "source_size", "_target", "taken"} <= set(rows[0].asDict())


def test_stages_of_empty_tables(spark):
    docs, _ = _odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0


def test_unlearned_languages_go(spark):
    import random

    from test_llm import DOCS, make, prose

    r = random.Random(9)
    rows = [(i, prose(r, lang := ("en", "fr")[i % 2], 80), lang, "a") for i in range(200)]
    rows += [(500 + i, prose(r, "de", 80), None, "a") for i in range(5)] + [(600, "Съешь же ещё этих мягких французских булок. " * 20, None, "a"), (601, "xqzj kvwx zzqk jjxv " * 40, None, "a")]
    frame = spark.createDataFrame(make(rows), DOCS)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, frame, SF).collect()}
    assert kept == set(range(200))
    assert corpus_pipeline.identify_language(spark, frame.drop("lang").selectExpr("*", "cast(null as string) lang"), SF).count() == len(rows)
