"""Mixing sources to target weights, in blocks of tokens.

Method: the documents of a source, in an order drawn by hash, form one stream of
words, cut into blocks of fixed length.  The mix is made of shards of equally many
slots.  For every shard the number of slots of each source is drawn: the whole part
of its expected number is certain and the remaining slots are multinomial draws from
the fractions, which keeps the totals near the targets.  The slots of a source are
numbered over all shards; the number gives an epoch and an index, and a pseudorandom
permutation of the source's block numbers, another one for each epoch, maps the index
to a block.  So an epoch takes every block once, and no block is taken more often than
the epochs allow.  Slots and documents meet by block number.

Draws and permutations come from hashes of fixed seeds, so runs agree.  Everything is
DataFrame expressions.  Running totals are taken within chunks of bounded size and
over the chunks' totals, so a source that holds most rows is dealt over many tasks.
There may be any number of sources: they are numbered and levelled in ranges, and draws
meet the sources' stretches by cells.  Slots are made in as many tasks as they need.

Rows: a null text has no words.  Null is a source of its own, after all others.
Repeated rows are taken as so many documents.  With no words at all, targets and
taken words are 0.  Other columns are not read and may have any names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import prefix_sums, shuffle_width, stored

#: Words parted by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
MOST_EPOCHS = 3
_CHUNK_ROWS = 4096
#: Slots that one task makes.
_TASK_SLOTS = 16_384
#: Length of the stretch of a source that is due one more slot.
_UNIT = 1 << 32
_ROUNDS = 24
_ORDER, _DRAW, _TURN, _SIDE = 101, 102, 103, 104


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of ``0 .. size - 1`` takes ``index``.

    Swap-or-not: in every round an index and its mirror image around a random point
    change places or not, as a hash of the greater of both says.
    """

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(_TURN), *key, r), size) - x, size)
        side = F.xxhash64(F.lit(_SIDE), *key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(side == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), index.cast("long"), turn)


def running_start(df: DataFrame, key: str, chunk: str, order: list, value: str, into: str) -> DataFrame:
    """Add the total of ``value`` over the earlier rows of the same ``key``.

    ``chunk`` orders parts of bounded size of a key; ``order`` the rows of a part.
    """
    inner = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, chunk).agg(F.sum(value).alias("_total"))
    before = totals.select(key, chunk, F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before"))
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(before, [key, chunk]).withColumn(into, F.col("_before") + F.col("_within")).drop("_before", "_within")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Number, size and target of each ``source``.

    Sources in order of code points, null last, have the given weights in turn and
    share the total size; a target stops at ``most`` times the source's size, and what
    it leaves is shared by the others.  That is the level at which the capped shares
    add up to the total: it is found by going through the sources in the order in which
    a rising level meets their caps.
    """
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = prefix_sums(known, [F.col("source").isNull(), F.col("source")], {"s": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    known = known.withColumns({"w": weight, "cap": F.col("source_size") * most})
    known = prefix_sums(known, [F.col("cap") / F.col("w"), F.col("s")], {"caps": F.col("cap"), "ws": F.col("w")})
    every, weighed = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    at, level = F.col("cap") / F.col("w"), (F.lit(every) - F.col("caps")) / (F.lit(weighed) - F.col("ws"))
    # the first source whose cap the level does not reach
    chosen = known.filter(level <= at).agg(F.min(F.struct(at.alias("at"), F.col("s"), level.alias("level")))).first()[0]
    cap = F.col("cap").cast("double")
    target = F.least(cap, F.lit(float(chosen.level)) * F.col("w")) if chosen else cap
    return known.select("source", F.col("s").cast("int").alias("s"), "source_size", target.alias("target"))


def wanted_slots(sources: DataFrame, block_words: int) -> tuple[DataFrame, float]:
    """Add ``want``, the slots that a source's target comes to, and their sum.

    The last block of a source is short, so a slot holds ``source_size / blocks`` words.
    """
    want = F.coalesce(F.try_divide(F.col("target") * F.ceil(F.col("source_size") / block_words), "source_size"), F.lit(0.0))
    sources = sources.withColumn("want", want)
    return sources, sources.agg(F.coalesce(F.sum("want"), F.lit(0.0))).first()[0]


def _spread(df: DataFrame, slots: int, *by: str) -> DataFrame:
    """Deal rows that stand for ``slots`` slots in all over as many tasks as these need."""
    spark = df.sparkSession
    most = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    return df.repartition(min(-(-slots // _TASK_SLOTS) or 1, most), *by)


def _certain(shares: DataFrame, width: int, first: int, count: int) -> DataFrame:
    """The certain slots of the sources in ``count`` shards of ``width``, from ``first`` on."""
    certain = shares.filter("certain > 0").select("s", F.col("certain").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((count - 1) // _CHUNK_ROWS).cast("long"))).alias("c"))
    start = F.col("c") * _CHUNK_ROWS + first
    shards = F.sequence(start, F.least(start + _CHUNK_ROWS, F.lit(first + count)) - 1)
    return _spread(certain, width * count, "s", "c").select(F.explode(shards).alias("shard"), "s", "n")


def _drawn(shares: DataFrame, width: int, first: int, count: int) -> DataFrame:
    """The slots that are left in each of these shards, drawn by the sources' parts.

    A draw is a point on a line on which every source has a stretch as long as its part.
    Draws and stretches meet in cells of the line.
    """
    shares = stored(prefix_sums(shares.filter("part > 0"), [F.col("s")], {"low": F.col("part")}))
    n, line = shares.agg(F.count("*"), F.coalesce(F.sum("part"), F.lit(0))).first()
    fixed = width - round(line / _UNIT)
    if not n or fixed >= width:
        return shares.select(F.lit(0).cast("long").alias("shard"), "s", F.lit(0).cast("long").alias("n")).limit(0)
    cell = -(-line // n)
    stretches = shares.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(low + part - 1) div {cell}"))))
    shards = _spread(shares.sparkSession.range(count).select((F.col("id") + first).alias("shard")), (width - fixed) * count, "shard")
    draws = shards.select("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width - fixed).cast("long"))).alias("r"))
    draws = draws.withColumn("u", F.pmod(F.xxhash64(F.lit(_DRAW), "shard", "r"), F.lit(line))).withColumn("cell", F.expr(f"u div {cell}"))
    met = draws.join(stretches.select("cell", "s", "low", "part"), "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("part")))
    return met.select("shard", "s", F.lit(1).cast("long").alias("n"))


def slot_counts(sources: DataFrame, wanted: float, shard_slots: int) -> DataFrame:
    """Slots of each source in each shard: ``shard``, ``s``, ``n``."""
    slots = math.ceil(round(wanted, 6))
    full, rest = divmod(slots, shard_slots)
    made = []
    # shards are of one width, apart from the last
    for width, first, count in ((shard_slots, 0, full), (rest, full, 1)):
        if width and count:
            due = F.col("want") / F.lit(wanted) * width
            shares = sources.select("s", F.floor(due + 1e-6).cast("long").alias("certain"), due.alias("due"))
            part = F.greatest(F.floor((F.col("due") - F.col("certain")) * _UNIT), F.lit(0)).cast("long")
            shares = shares.select("s", "certain", part.alias("part"))
            made += [_certain(shares, width, first, count), _drawn(shares, width, first, count)]
    if not made:
        return sources.select(F.lit(0).cast("long").alias("shard"), "s", F.lit(0).cast("long").alias("n")).limit(0)
    return reduce(DataFrame.union, made).groupBy("shard", "s").agg(F.sum("n").alias("n"))


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix: ``shard``, ``s`` (number of the source), ``epoch`` and ``block`` of each slot."""
    sources, wanted = wanted_slots(sources, block_words)
    counts = slot_counts(sources, wanted, shard_slots).withColumn("chunk", F.floor(F.col("shard") / _CHUNK_ROWS))
    numbered = running_start(counts, "s", "chunk", ["shard"], "n", "start")
    blocks = sources.select("s", F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks")).filter("blocks > 0")
    runs = _spread(numbered.join(blocks, "s").select("shard", "s", "blocks", "start", "n"), math.ceil(wanted), "shard", "s")
    each = runs.select("shard", "s", "blocks", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("j"))
    each = each.filter(F.col("j") < most * F.col("blocks")).withColumn("epoch", F.floor(F.col("j") / F.col("blocks")).cast("int"))
    return each.select("shard", "s", "epoch", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("s"), F.col("epoch")).alias("block"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    most: int = MOST_EPOCHS,
) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` words of each document."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.lit(_ORDER), F.col(id_col)).alias("place"), F.monotonically_increasing_id().alias("row")))
    rows = sizes.count()
    sources = stored(source_targets(sizes, weights, most))
    number = sources.select(F.col("source").alias("_source"), "s", "source_size", "target")
    placed = sizes.join(number, sizes.source.eqNullSafe(F.col("_source"))).drop("_source")
    chunks = max(1, math.ceil(rows / _CHUNK_ROWS))
    placed = placed.withColumn("chunk", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * chunks).cast("long"))
    streamed = running_start(placed, "s", "chunk", ["place", "id", "size", "row"], "size", "start").drop("chunk")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    covered = streamed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    times = slots(sources, block_words, shard_slots, most).groupBy("s", "block").agg(F.count("*").alias("times"))
    met = covered.withColumn("overlap", F.when(F.col("size") > 0, overlap).otherwise(0)).join(times, ["s", "block"], "left")
    part = F.sum(F.col("overlap") * F.coalesce("times", F.lit(0)))
    return met.groupBy("row", "id", "source", "size", "source_size", "target").agg(part.cast("long").alias("taken")).drop("row")
