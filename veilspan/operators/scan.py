"""Ordered computations that do not need a whole group in one task.

A plain window over (document) or (document, page) puts all rows of a group
into one task.  Here the ordering column is cut into chunks, so a group of any
size spreads over the cluster:

* ``running``: totals per chunk are aggregated first (map-side combine), the
  short list of chunk totals is scanned, and the rows are scanned per chunk.
* ``with_halo``: each chunk also receives the few rows just before or after
  it, which is enough for any window frame of that many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Width of a chunk in units of the ordering column, hence also the largest
# number of rows per chunk where that column is unique within a group.
CHUNK = 4096

_AGGREGATES = {"sum": F.sum, "max": F.max}


def split_by_count(
    df: DataFrame, keys: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with at most ``limit`` rows, and the rows of larger groups.

    Only counts are shuffled to tell them apart.  There are few large groups,
    so Spark can usually broadcast their keys; where there are none, adaptive
    execution drops whatever is built on the second part.
    """
    keys = list(keys)
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    names = large.select(*keys)
    return df.join(names, keys, "left_anti"), df.join(names, keys, "left_semi")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add exclusive running aggregates over ``order`` within ``keys``.

    ``values`` maps an output column to ``("sum" | "max", expression)``; the
    first row of a group gets 0 for sums and null for maxima.  ``order`` is a
    whole number and unique within a group.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    return _running_by_chunk(chunked, list(keys), order, values).drop("_chunk")


def _running_by_chunk(
    chunked: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """``running`` over rows that carry their ``_chunk``, which is kept.

    The result stays partitioned by (keys, chunk), so a second scan over it
    moves no row again.
    """
    totals = chunked.groupBy(*keys, "_chunk").agg(
        *(_AGGREGATES[how](expr).alias(f"_t_{name}") for name, (how, expr) in values.items())
    )
    before_chunk = (
        W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    bases = totals.select(
        *keys,
        "_chunk",
        *(
            _AGGREGATES[how](f"_t_{name}").over(before_chunk).alias(f"_b_{name}")
            for name, (how, _) in values.items()
        ),
    )
    # Both sides are keyed by (keys, chunk), and so is the window after it.
    joined = chunked.join(bases, [*keys, "_chunk"])
    within = (
        W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    for name, (how, expr) in values.items():
        local = _AGGREGATES[how](expr).over(within)
        if how == "sum":
            combined = F.coalesce(F.col(f"_b_{name}"), F.lit(0)) + F.coalesce(
                local, F.lit(0)
            )
        else:
            combined = F.greatest(F.col(f"_b_{name}"), local)
        joined = joined.withColumn(name, combined)
    return joined.drop(*(f"_b_{name}" for name in values))


def with_halo(
    df: DataFrame, order: str, before: int, after: int = 0, chunk: int = CHUNK
) -> DataFrame:
    """Add ``_chunk`` and ``_own``; rows near a border are repeated next door.

    ``order`` must be dense (0, 1, 2, ..) within a group.  Windows that are
    partitioned by the group and ``_chunk`` then see up to ``before`` rows
    ahead of and ``after`` rows behind each own row.  Keep ``_own`` rows only.
    """
    if chunk < max(before, after):
        raise ValueError("a chunk must be at least as long as its halo")
    position = F.col(order)
    home = F.floor(position / chunk)
    offset = F.pmod(position, F.lit(chunk))
    homes = F.array(F.struct(home.alias("c"), F.lit(True).alias("own")))
    if before:
        homes = F.concat(
            homes,
            F.when(
                offset >= chunk - before,
                F.array(F.struct((home + 1).alias("c"), F.lit(False).alias("own"))),
            ).otherwise(F.slice(homes, 1, 0)),
        )
    if after:
        homes = F.concat(
            homes,
            F.when(
                (offset < after) & (home > 0),
                F.array(F.struct((home - 1).alias("c"), F.lit(False).alias("own"))),
            ).otherwise(F.slice(homes, 1, 0)),
        )
    return (
        df.withColumn("_home", F.explode(homes))
        .withColumn("_chunk", F.col("_home.c"))
        .withColumn("_own", F.col("_home.own"))
        .drop("_home")
    )


def island_starts(
    df: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    island: str,
    touching: bool,
    chunk: int = CHUNK,
) -> DataFrame:
    """``keys, low, _reach, island``: each distinct ``low`` with its farthest end and run.

    Rows with the same ``low`` are aggregated first, so copies of one interval
    never pile up in a task.  With ``touching`` an interval that starts exactly
    where the run ends still belongs to it.

    One scan carries two values, the farthest end and the start of the open run.
    Runs are found per chunk as if nothing came before.  A chunk is then its
    farthest end and the start of its last run, and two chunks compose: the
    later one's last run starts there unless the earlier reach covers it, and
    what covers the last run of a chunk covers all its runs.  Only these pairs
    meet per group; the rows stay where their chunk is.
    """
    keys = list(keys)

    def starts_run(start: Column, before: Column) -> Column:
        gap = start > before if touching else start >= before
        return before.isNull() | gap

    in_chunk = W.partitionBy(*keys, "_chunk").orderBy(low)
    # Rows without a key or a start belong to no run; dropping them here keeps both
    # uses of the chunks below alike, so Spark exchanges them once.
    placed = df.withColumn("_chunk", F.floor(F.col(low) / chunk))
    for name in (*keys, low, "_chunk"):
        placed = placed.filter(F.col(name).isNotNull())
    local = (
        placed.groupBy(*keys, "_chunk", low)
        .agg(F.max(high).alias("_reach"))
        .withColumn(
            "_local", F.max("_reach").over(in_chunk.rowsBetween(W.unboundedPreceding, -1))
        )
    )
    ends = local.groupBy(*keys, "_chunk").agg(
        F.max("_reach").alias("_end"),
        F.max(F.when(starts_run(F.col(low), F.col("_local")), F.col(low))).alias("_last"),
    )
    chunks_before = (
        W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    carried = ends.withColumn("_carried", F.max("_end").over(chunks_before)).select(
        *keys,
        "_chunk",
        "_carried",
        F.max(F.when(starts_run(F.col("_last"), F.col("_carried")), F.col("_last")))
        .over(chunks_before)
        .alias("_open"),
    )
    head = F.when(
        starts_run(F.col(low), F.greatest("_local", "_carried")), F.col(low)
    )
    latest = F.max(head).over(in_chunk.rowsBetween(W.unboundedPreceding, W.currentRow))
    return local.join(carried, [*keys, "_chunk"]).select(
        *keys, low, "_reach", F.coalesce(latest, F.col("_open")).alias(island)
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    island: str,
    touching: bool,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``island``: the first ``low`` of the overlapping run a row belongs to."""
    named = island_starts(df, keys, low, high, island, touching, chunk)
    return df.join(named.drop("_reach"), [*keys, low])


def dense_position(
    df: DataFrame, keys: Sequence[str], order: str, name: str, chunk: int = CHUNK
) -> DataFrame:
    """Add a zero-based dense position by ``order`` within ``keys``."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, chunk)
