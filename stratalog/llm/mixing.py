"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get word targets from repeating weights, capped at a number of epochs of their own
size, the excess reshared by weight.  The targets are turned into integer quotas of
equal-token blocks by highest quotients w/(2k-1): over sources, then over groups of a
source's shards, then over the shards of a group, so a step ranks the `FAN` shards of a group
or one row for each FAN * SHARD words of a source.  Within a shard the documents form a seeded
stream cut into blocks; whole passes are taken first and a seeded permutation of the blocks
gives the rest.

Everything is DataFrame operations.  Defined results: null texts have size 0; a null source
is a source of its own, last; repeated rows are documents of their own; an empty table gives
an empty result; if all sizes are 0 every target and every `taken` is 0.  Ties of quotients
go to the first source or shard.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.common import WORD, broadcast_if_small, free_name, let, settle

#: Words of a block.
BLOCK = 16
#: Words of a shard, about.
SHARD = 16_384
#: Shards of a group.
FAN = 1024
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
SOURCES = 100_000
#: Multipliers of the block permutations: primes beyond any number of blocks in a shard.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483563)


def apportion(df: DataFrame, group: list[str], item: list[str], weight: str, seats: str) -> DataFrame:
    """Adds `quota`: the seats of each row's group, dealt to its rows by highest quotients.

    df has a row for each item; `seats` is the same in all rows of a group.  Divisors just
    below and above the exact one bound each quota, so only about two candidate seats a row
    compete.
    """
    by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total, n = F.sum(weight).over(by), F.count(F.lit(1)).over(by)
    share = lambda k: F.when(total > 0, F.floor(F.col(weight).cast("double") * k / total + 0.5)).otherwise(0).cast("long")
    ranged = df.withColumn("_low", share(F.greatest(F.col(seats) - n / 2, F.lit(0.0)))).withColumn("_high", F.when(F.col(seats) > 0, share(F.col(seats) + n / 2)).otherwise(0))
    ranged = ranged.withColumn("_low", F.when(F.col(seats) * 2 > n, F.col("_low")).otherwise(0)).withColumn("_left", F.col(seats) - F.sum("_low").over(by))
    tries = ranged.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    best = F.row_number().over(by.orderBy(F.col("_q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in item], "_k"))
    won = tries.withColumn("_q", F.col(weight).cast("double") / (2 * F.col("_k") - 1)).withColumn("_won", (F.col("_k").isNotNull() & (best <= F.col("_left"))).cast("long"))
    return won.groupBy(*df.columns, "_low").agg(F.sum("_won").alias("_won")).withColumn("quota", F.col("_low") + F.col("_won")).drop("_low", "_won")


def targets(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Adds `target` to (source, source_size): shares by repeating weights, filled up to the caps."""
    one = W.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", w.cast("double")).withColumn("_cap", F.col("source_size") * float(epochs))
    order = one.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(one))
    return filled.withColumn("target", F.least(F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"), F.col("_cap"))).drop("_cap", "_level")


def _draws(block: int, epochs: int) -> tuple[Column, Column]:
    """Whole passes over the document at [_start, _end) of its shard's stream, and the spans (at, n) of its words in the blocks drawn besides."""
    size, words, quota = F.col("_words"), F.col("_end") - F.col("_start"), F.coalesce(F.col("quota"), F.lit(0)) * block
    passes = F.least(F.floor(quota / size), F.lit(epochs)).cast("long")
    blocks = F.greatest(F.floor(size / block), F.lit(1)).cast("long")
    more = F.when(passes >= epochs, 0).otherwise(F.round((quota - passes * size) * blocks / size)).cast("long")
    seeded = F.xxhash64(F.lit("blocks"), "source", "_shard", F.col("_seed"))
    prime = F.element_at(F.array(*map(F.lit, _PRIMES)), (F.pmod(seeded, F.lit(len(_PRIMES))) + 1).cast("int")).cast("long")
    edge = lambda j: F.floor(j * size / blocks).cast("long")
    first = lambda j: F.greatest(F.col("_start"), edge(j))
    drawn = lambda j: F.pmod(j * prime + F.pmod(seeded, blocks), blocks) < more
    at = lambda i: F.floor(((i + 1) * blocks - 1) / size).cast("long")
    span = lambda j: F.struct((first(j) - F.col("_start")).alias("at"), (F.least(F.col("_end"), edge(j + 1)) - first(j)).alias("n"))
    spans = F.filter(F.transform(F.filter(F.sequence(at(F.col("_start")), at(F.col("_end") - 1)), drawn), span), lambda x: x.n > 0)
    some = (words > 0) & (quota > 0)
    return F.when(some, passes).otherwise(0).cast("long"), F.when(some & (more > 0), spans).otherwise(F.array().cast("array<struct<at:bigint,n:bigint>>"))


def drawn_text(text: Column, passes: Column, spans: Column) -> Column:
    """The words that the mix takes of a text: the text once for each pass, then the words of each span, on lines of their own."""
    cut = lambda words: F.transform(spans, lambda x: F.concat_ws(" ", F.slice(words, (x.at + 1).cast("int"), x.n.cast("int"))))
    parts = F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), cut)).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\n", F.array_repeat(text, passes.cast("int")), parts)


def mixed_texts(docs: DataFrame) -> DataFrame:
    """What the mix draws of each document, as its text, repeats included; an n_chars column follows.

    Behind the columns of docs come size, source_size, target and taken, with underscores before
    names that docs has itself.  Documents of which nothing is drawn go.
    """
    rows, names = mix(docs, carry=tuple(docs.columns)).where("taken > 0"), [c.lower() for c in docs.columns]
    columns = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)]
    text = drawn_text(F.col(f"carry_{names.index('text')}").cast("string"), F.col("passes"), F.col("spans"))
    rows = rows.withColumn("_drawn", text)
    columns[names.index("text")] = F.col("_drawn").alias(docs.columns[names.index("text")])
    if "n_chars" in names:
        columns[names.index("n_chars")] = F.length("_drawn").cast(docs.schema["n_chars"].dataType).alias(docs.columns[names.index("n_chars")])
    return rows.select(*columns, *[F.col(c).alias(free_name(docs, c)) for c in ("size", "source_size", "target", "taken")])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, block: int = BLOCK, shard: int = SHARD, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and source for every document, and the columns to carry.

    `taken` counts words, repeats included, and never exceeds `epochs` times the size.  Its
    words are `passes` whole texts and the words of `spans` (at, n), both given where columns
    are carried.  Carried columns are named by their places: carry_0, carry_1 and so on.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    sized = base if carry else settle(base)
    sums = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs))
    seats = F.round(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block).cast("long")
    quotas = apportion(sums.withColumn("_seats", seats), [], ["source"], "target", "_seats").select("source", "source_size", "target", F.col("quota").alias("source_quota"))
    shards = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).cast("long")
    quotas = settle(quotas.withColumn("_shards", shards))
    named = broadcast_if_small(quotas.withColumnRenamed("source", "_source"), SOURCES)
    dealt = sized.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_shards")))
    keys = ["source", "_shard"]
    pieces = dealt.groupBy(*keys, "source_quota").agg(F.sum("size").alias("_words")).where("_words > 0").withColumn("_group", (F.col("_shard") / FAN).cast("long"))
    pieces = settle(pieces)
    groups = pieces.groupBy("source", "_group", "source_quota").agg(F.sum("_words").alias("_group_words"))
    groups = apportion(groups, ["source"], ["_group"], "_group_words", "source_quota").select(F.col("source").alias("_s"), F.col("_group").alias("_g"), F.col("quota").alias("_group_quota"))
    parts = pieces.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g"))).drop("_s", "_g")
    parts = apportion(parts.select(*keys, "_group", "_words", "_group_quota"), ["source", "_group"], ["_shard"], "_words", "_group_quota")
    parts = parts.select(F.xxhash64("source", F.col("source").isNull(), "_shard").alias("_cell"), F.col("source").alias("_s"), F.col("_shard").alias("_n"), "_words", "quota")
    cell = F.xxhash64("source", F.col("source").isNull(), "_shard")
    joined = dealt.withColumn("_cell", cell).join(parts.withColumnRenamed("_cell", "_c"), (F.col("_cell") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_n")), "left")
    stream = W.partitionBy("_cell", *keys).orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = joined.withColumn("_end", F.sum("size").over(stream)).withColumn("_start", F.col("_end") - F.col("size")).withColumn("_seed", F.lit(seed))
    passes, spans = _draws(block, epochs)
    placed = placed.withColumn("_passes", passes).withColumn("_spans", spans)
    taken = F.col("_passes") * F.col("size") + F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x.n)
    draws = [F.col("_passes").alias("passes"), F.col("_spans").alias("spans")] if carry else []
    return placed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.alias("taken"), "source", *draws, *[F.col(f"carry_{i}") for i in range(len(carry))])
