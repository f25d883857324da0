"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs no more than the tasks it ran, and
    lets Spark plan what follows with the true size of the table.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's id and text, the same in every scan of a table."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add the totals of ``sums`` over all rows before each row in ``order``.

    Rows are laid out in ranges of the order; each range is summed for itself, and the
    driver sees one total a range.  Equal rows come in any order, as they were stored.
    """
    spark = df.sparkSession
    laid = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    totals = sorted(laid.groupBy("_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).collect())
    bases, so_far = [], dict.fromkeys(sums, 0)
    for row in totals:
        bases.append((row["_part"], *[int(v) for v in so_far.values()]))
        so_far = {name: v + row[name] for name, v in so_far.items()}
    known = spark.createDataFrame(bases, "_part long" + "".join(f", _base_{name} long" for name in sums))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    based = laid.join(F.broadcast(known), "_part")  # one row a range
    based = based.withColumns({name: F.col(f"_base_{name}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})
    return based.select(*df.columns, *sums)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts holds, if the session allows more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


#: A bit filter has 16 bits for each key, and this many at most.
MAX_FILTER_BITS = 1 << 26


def filter_bits(keys: DataFrame, column: str) -> np.ndarray:
    """The bits that the well-mixed 64-bit keys of ``column`` set, as 64-bit words.

    Bits are gathered by word, so what reaches the driver has a bound that does not
    depend on the number of keys.
    """
    bits = min(1 << max(16, (16 * keys.count()).bit_length()), MAX_FILTER_BITS)
    place = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)]))
    words = keys.select(place.alias("p")).select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    table = np.zeros(bits // 64, np.int64)
    for word, value in words.groupBy("word").agg(F.bit_or("bit").alias("value")).toLocalIterator():
        table[word] = value
    return table.view(np.uint64)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of a filter; none of them is missed."""
    keys, mask, found = keys.astype(np.uint64, copy=False), np.uint64(len(table) * 64 - 1), np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & mask
        found &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return found


def bit_filter(keys: DataFrame) -> Callable[[str], Column]:
    """A test that drops most rows whose key is not in the only column of ``keys``."""
    shared = keys.sparkSession.sparkContext.broadcast(filter_bits(keys, keys.columns[0]))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, values.to_numpy(np.int64).view(np.uint64)))

    return lambda name: test(F.col(name))


def components(edges: DataFrame) -> DataFrame:
    """Label (``node``, ``label``) every node of ``edges`` (``a``, ``b``) with the least
    node it can reach.

    Large-star and small-star steps: each node's neighbours are moved to the least
    one among them, which halves paths.  Every step is two grouped minima, whose
    partial results bound what a popular node sends, and a join that Spark may
    split at such a node.  The loop ends when the links no longer change.
    """
    forward = F.col("a") != F.col("b")
    links = stored(edges.select("a", "b").filter(forward).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: greater neighbours of a node go to its least neighbour
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so both sides of the join are dealt for it and Spark can split a hot node
        least = stored(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(forward)
        large = large.distinct()
        # small star: lesser neighbours of a node, and itself, go to its least neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter(forward)
        links = stored(small.distinct())
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before or now[0] == 0:
            break
        before = now
    found = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found.union(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
