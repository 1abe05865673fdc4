"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is cut into blocks of equal numbers of words. Each shard of the mix hands its blocks to the sources by highest
quotients target / (2k + 1), so every source has an integer quota of blocks per shard. A source's documents stand in
seeded order, and their words are one stream of blocks; its quota is taken from the stream evenly, beginning at a
seeded block, so that what a document gives follows from its place in the stream alone. Places are running sums: over
the slices of a source (``SLICES`` ranges of the seeded order), then within a slice. No task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BITS = 12
SLICES = 1 << SLICE_BITS


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _whole(a: str, b: str, c: str) -> str:
    """a * b div c beyond 64 bits."""
    return f"cast(cast({a} as decimal(19,0)) * cast({b} as decimal(19,0)) div cast({c} as decimal(19,0)) as bigint)"


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds number (place in code point order, null last), target and weight to source, source_size.

    A target is min(most * size, level * weight), with the level at which the targets add up to ``share`` of all sizes:
    what is left when excess is handed on by weight until no target is above its bound. One row per source.
    """
    everything = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") - 1) % len(weights) + 1)
    bound = F.col("source_size") * F.lit(float(most))
    filled = Window.orderBy("ratio", "number")
    before = F.coalesce(F.sum("bound").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    asked = F.sum("source_size").over(everything) * F.lit(float(share))
    return (
        sources.withColumn("number", number)
        .withColumns({"weight": weight, "bound": bound})
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("level", (asked - before) / open_weight)
        .withColumn("target", F.least("bound", F.max("level").over(everything) * F.col("weight")))
        .drop("bound", "ratio", "level")
    )


def apportion(targeted: DataFrame, block_words: int, shards: int) -> DataFrame:
    """Adds ``upto``: blocks of the source in the mix up to the end of each shard, an array of ``shards`` numbers.

    The first n blocks go to the n highest quotients. Rounded shares are right but for a few seats: only the quotients
    near them are listed and ranked, about five for each source and shard.
    """
    total = Window.partitionBy("shard")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / F.lit(block_words)).cast("long")
    ranked = Window.partitionBy("shard").orderBy(F.desc("quotient"), "number")
    listed = (
        targeted.where("target > 0")
        .withColumn("all_seats", seats)
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.expr(f"all_seats * shard div {shards}"))
        .withColumn("fair", F.col("house") * F.col("target") / F.sum("target").over(total))
        .withColumn("near", F.floor(F.col("fair") + 0.5))
        .withColumn("off", F.abs(F.sum("near").over(total) - F.col("house")) + F.count(F.lit(1)).over(total))
        .withColumn("reach", F.lit(2) + F.ceil(F.col("fair") * F.col("off") / F.greatest("house", F.lit(1))))
        .withColumn("base", F.greatest(F.col("near") - F.col("reach"), F.lit(0)))
        .withColumn("open_seats", F.col("house") - F.sum("base").over(total))
    )
    won = (
        listed.withColumn("k", F.explode(F.sequence(F.col("base"), F.col("near") + F.col("reach"))))
        .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
        .withColumn("rank", F.row_number().over(ranked))
        .groupBy("number", "shard")
        .agg((F.first("base") + F.sum((F.col("rank") <= F.col("open_seats")).cast("long"))).alias("blocks"))
        .groupBy("number")
        .agg(F.array_sort(F.collect_list("blocks")).alias("upto"))  # each shard adds blocks, so sorted is by shard
    )
    nothing = F.array_repeat(F.lit(0).cast("long"), shards)
    return targeted.join(won, "number", "left").withColumn("upto", F.coalesce("upto", nothing))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 16,
    shards: int = 4,
    seed: int = 7,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard_words for every row of ``docs``.

    size: words of the text (null: 0). weights: dealt to the sources in code point order, null last as a source of its
    own, from the start again when they run out. share: words of the mix as a part of all words. most: how often a
    source may be used at most (a whole number of times for a single word, rounded up). taken: words the mix takes from
    the document, repeats counted; shard_words: the same for each shard. Documents of size 0 give nothing. Rows with
    equal doc_id, source and size may change places, which leaves the set of result rows as it is; other columns are
    not looked at. An empty table gives no rows. Assumes one row per source fits a task, not one row per document.
    """
    if block_words < 1 or shards < 1 or not weights:
        raise ValueError("block_words, shards and weights must be positive")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    sized = materialise(sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    sized = sized.withColumns({"key": _key(F.col("source")), "slice": F.shiftrightunsigned("order", 64 - SLICE_BITS)})

    slices = materialise(sized.groupBy("source", "key", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    sources = slices.groupBy("source", "key").agg(F.sum("words").alias("source_size"))
    quotas = apportion(targets(sources, weights, share, most), block_words, shards)
    blocks = F.ceil(F.col("source_size") / block_words)
    quotas = (
        quotas.withColumn("blocks", blocks)
        .withColumn("upto", F.transform("upto", lambda n: F.least(n, F.ceil(F.lit(most)) * F.col("blocks"))))
        .withColumn("quota", F.element_at("upto", -1))
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "key"), F.greatest("blocks", F.lit(1))))
        .select("key", "source_size", "target", "blocks", "quota", "start", "upto")
    )
    passed = F.sum("words").over(Window.partitionBy("key").orderBy("slice")) - F.col("words")
    placed = slices.select("key", "slice", passed.alias("passed")).join(quotas, "key")

    order = Window.partitionBy("key", "slice").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = sized.join(placed, ["key", "slice"]).withColumn("to", F.col("passed") + F.sum("size").over(order))
    at = at.withColumn("from", F.col("to") - F.col("size"))

    def copies(block: str) -> str:
        """Blocks taken before a block of the stream; the even choice begins at ``start`` and wraps round."""
        turn = f"({block} + start)"
        first, rest = _whole(f"least({turn}, blocks)", "quota", "blocks"), _whole(f"greatest({turn} - blocks, 0)", "quota", "blocks")
        return f"({first} - {_whole('start', 'quota', 'blocks')} + {rest})"

    def words(place: str) -> Column:
        """Words taken before a place of the stream."""
        block, inside = f"({place} div {block_words})", f"({place} % {block_words})"
        step = f"{copies(f'least({block} + 1, blocks)')} - {copies(block)}"
        return F.expr(f"case when blocks = 0 then 0L else {block_words} * {copies(block)} + {inside} * ({step}) end")

    at = at.withColumns({"given_from": words("`from`"), "given_to": words("`to`")})
    ends = F.transform("upto", lambda n: n * block_words)
    of_shard = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.greatest(
            F.least("given_to", F.when(s == shards, F.col("given_to")).otherwise(F.element_at(ends, s)))
            - F.greatest("given_from", F.when(s == 1, F.lit(0)).otherwise(F.element_at(ends, F.greatest(s - 1, F.lit(1))))),
            F.lit(0),
        ),
    )
    return at.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("given_to") - F.col("given_from")).alias("taken"), of_shard.alias("shard_words"),
    )
