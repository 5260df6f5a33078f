"""Personal data: exact patterns, and bootstrapped contextual extraction.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern.  They are
the seeds: the words around them are lexical patterns, and patterns and the identifiers that
stand in them form a bipartite graph.  In each round a pattern's confidence in a kind is the
mean score of its identifiers, discounted when few support it, and an unseen identifier's
score is the noisy-or of its patterns' confidences.  Identifiers whose score is high enough
after the last round are spans too.

Everything is DataFrame operations.  Matching is linear in the text: each expression starts
only where a leftmost match can, and takes what it matches without going back.

Defined results: null and empty texts have no spans; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored, or kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import broadcast_if_small, free_name, let, settle

KINDS = ("email", "ip", "card", "phone")
#: Each has the leftmost non-overlapping matches of the plain pattern in the comment, but for
#: those that its digits or parts rule out.  \G is the end of the match before.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: a phone or card number, or a word with a digit or an @.
ITEM = rf"(?:{PATTERNS['phone']}|{PATTERNS['card']}|(?:(?<![^\x20\x09-\x0D])|\G)[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: What an unseen identifier of each kind must look like.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]+([.:-][0-9]+){2,}$",
    "card": r"^([0-9][^0-9A-Za-z]*){12,19}$",
    "phone": r"^\+?[(]?([0-9][^0-9A-Za-z]*){7,15}$",
}
#: Rounds of scoring; distinct seeds that a pattern needs; least confidence of a pattern and score of an identifier.
ROUNDS, SUPPORT, CONFIDENCE, SCORE = 3, 5, 0.6, 0.8
#: Patterns or identifiers up to which their table is broadcast; beyond, it is joined by a shuffle that splits hot keys.
SMALL = 100_000
_SPAN = "array<struct<kind:int,start:long,end:long,value:string>>"


def _scan(n: Column, step, kind: str) -> Column:
    """What step gives for each of 1..n, as an array; step(at, i) gives the next position and an element.

    A fold copies what it holds at each step, so it holds a position and no more than about
    sqrt(n) elements, in blocks of as many.
    """
    none, none_of_none, zero = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>"), F.lit(0).cast("long")

    def add(state: Column, i: Column) -> Column:
        at, element = step(state["at"], i)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(element)).alias("out"))

    def fold(width: Column) -> Column:
        def block(state: Column, first: Column) -> Column:
            return F.aggregate(
                F.sequence(first, F.least(first + width - 1, n)),
                F.struct(state["at"].alias("at"), none.alias("out")),
                add,
                lambda inner: F.struct(inner["at"].alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out")),
            )

        return F.aggregate(F.sequence(F.lit(1), n, width), F.struct(zero.alias("at"), none_of_none.alias("out")), block, lambda s: F.flatten(s["out"]))

    return F.when(n > 0, let(F.ceil(F.sqrt(n)).cast("int"), fold)).otherwise(none)


def _located(text: Column, pattern: str) -> Column:
    """Matches with start and end in code points, and the text between them: prev and next."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,prev:string,next:string>>")

    def place(hits: Column) -> Column:
        hit, n = lambda i: F.element_at(hits, i), F.size(hits)

        def between(pieces: Column) -> Column:
            piece = lambda i: F.element_at(pieces, i)

            def step(at: Column, i: Column) -> tuple[Column, Column]:
                start = at + F.length(piece(i))
                return start + F.length(hit(i)), start

            def rows(starts: Column) -> Column:
                def row(i: Column) -> Column:
                    start = F.element_at(starts, i)
                    return F.struct(start.alias("start"), (start + F.length(hit(i))).alias("end"), hit(i).alias("value"), piece(i).alias("prev"), piece(i + 1).alias("next"))

                return F.transform(F.sequence(F.lit(1), n), row)

            return let(_scan(n, step, "bigint"), rows)

        return F.when(n > 0, let(F.split(text, pattern, -1), between)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return n.between(13, 19) & _luhn(value)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind as listed and then by start."""
    marks = {"email": "@", "ip": ".", "phone": "+"}

    def of(k: int, kind: str) -> Column:
        valid = F.filter(_located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(valid, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        maybe = F.contains(text, F.lit(marks[kind])) if kind in marks else F.lit(True)
        return F.when(maybe, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _word(text: Column, pattern: str) -> Column:
    """A word next to an identifier, lower-cased, digits and punctuation left out."""
    return F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 1)), r"[^\p{L}=:#]", "")


def _items(text: Column) -> Column:
    """Possible identifiers with their lexical patterns."""

    def item(m: Column) -> Column:
        core = F.regexp_replace(m["value"], r"^[^\p{L}0-9+(]+|[^\p{L}0-9)]+$", "")
        skip = F.length(F.regexp_extract(m["value"], r"^([^\p{L}0-9+(]*)", 1))
        before, after = F.right(m["prev"], F.lit(80)), F.left(m["next"], F.lit(40))
        one = _word(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$")
        two = _word(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$")
        then = _word(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")
        start = m["start"] + skip
        patterns = F.array(F.concat(F.lit("L "), two, F.lit(" "), one), F.concat(F.lit("B "), one, F.lit(" _ "), then))
        return F.struct(core.alias("value"), start.alias("start"), (start + F.length(core)).alias("end"), patterns.alias("patterns"))

    return F.filter(F.transform(_located(text, ITEM), item), lambda i: F.length(i["value"]) > 5)


def _kind(value: Column) -> Column:
    """The first base kind that an identifier is or holds, by number."""
    tests = [F.when(value.rlike(PATTERNS[k]) & _valid(k, F.regexp_extract(value, PATTERNS[k], 0)), i) for i, k in enumerate(KINDS)]
    return F.coalesce(*tests)


def discover(items: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, score: float = SCORE) -> DataFrame:
    """value, kind: unseen identifiers that confident patterns point at.  items: value, patterns."""
    kind = _kind(F.col("value"))
    fits = F.array(*[F.when(F.col("value").rlike(SHAPES[k]), i) for i, k in enumerate(KINDS)])
    graph = settle(items.select("value", F.explode("patterns").alias("pattern")).distinct().withColumn("seed", kind).withColumn("fits", F.array_compact(F.when(F.col("seed").isNull(), fits).otherwise(F.array("seed")))))
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = graph.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("s")).distinct()
    unseen = graph.where("seed is null").select("value", "pattern", F.explode("fits").alias("kind"))
    for _ in range(rounds):
        seeds = graph.select("value", "pattern").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("s").alias("s"))
        weight = F.col("s") / F.col("n") * F.least(F.lit(1.0), F.log2(F.col("s") + 1) / F.log2(F.lit(2.0 * support + 1)))
        sure = settle(seeds.where(F.col("s") >= support).join(sizes, "pattern").withColumn("c", weight).where(F.col("c") >= confidence).select("pattern", "kind", "c"))
        found = unseen.join(broadcast_if_small(sure, SMALL), ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("s"))
        scores = settle(graph.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("s")).distinct().union(found.select("value", "kind", "s")))
    held = scores.where(F.col("s") >= score).join(graph.where("seed is null").select("value").distinct(), "value", "left_semi")
    return held.groupBy("value").agg(F.min(F.struct(-F.col("s"), F.col("kind"))).alias("best")).select("value", F.col("best.kind").alias("kind"))


def text_key(text: Column) -> Column:
    """A key of the text: what is found in a text depends on the text alone, given the whole corpus."""
    return F.concat_ws(":", F.xxhash64(text).cast("string"), F.length(text).cast("string"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key (text_key), base (spans of the patterns) and spans (those and the discovered ones) of every row.

    A span has the number of its kind, start and end in code points, and its text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    found = settle(rows.select("doc_id", "row", text_key(F.col("text")).alias("key"), base_spans(F.col("text")).alias("base"), _items(F.col("text")).alias("items")))
    items = found.select("row", "base", F.explode("items").alias("item")).select("row", "base", "item.*")
    known = broadcast_if_small(settle(discover(items.select("value", "patterns"))), SMALL)
    apart = F.forall("base", lambda b: (b["end"] <= F.col("start")) | (b["start"] >= F.col("end")))
    more = items.join(known, "value").where(apart).groupBy("row").agg(F.collect_set(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end", "value")).alias("more"))
    out = found.select("doc_id", "row", "key", "base").join(more, "row", "left")
    return out.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def _joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _is(k: int):
    return lambda kind: F.when(kind == k, kind)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _is(k)))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; an n_chars column follows the new text."""
    key, spans_, new = (free_name(docs, x) for x in ("found", "spans", "new"))
    found = find(docs).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans")).select(F.col("key").alias(key), F.col("spans").alias(spans_))
    joined = docs.join(found, text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(key), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(both: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            s = F.element_at(both["order"], i)
            inside = s["start"] < at  # it overlaps the span before and is hidden with it
            # Four bytes a character, so cutting out does not have to count characters.
            between = F.decode(F.substring(both["wide"], (4 * at + 1).cast("int"), (4 * F.greatest(s["start"] - at, F.lit(0))).cast("int")), "UTF-32")
            return F.greatest(at, s["end"]), F.concat(between, F.when(inside, "").otherwise(F.element_at(names, s["kind"] + 1)))

        return _scan(F.size(both["order"]), step, "string")

    pieces = let(F.struct(order.alias("order"), F.encode(F.col("text"), "UTF-32").alias("wide")), cut)
    last = F.array_max(F.transform(spans_, lambda s: s["end"]))
    hidden = F.col(spans_).isNotNull()
    text = F.concat(F.concat_ws("", pieces), F.substring(F.col("text"), (last + 1).cast("int"), F.lit(2**31 - 1)))
    out = joined.withColumn(new, F.when(hidden, text).otherwise(F.col("text")))
    chars = {"n_chars": F.when(hidden, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).withColumn("text", F.col(new)).select(*docs.columns)
