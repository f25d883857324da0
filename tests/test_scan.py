"""Chunked scans against plain Python, with chunks short enough to matter."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.operators.detections import merge_span_rows
from veilspan.operators.scan import dense_position, island_starts, islands, running, with_halo


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [("hot", i * 3 + 1, rng.randint(0, 9)) for i in range(300)]
    rows += [(k, i, rng.randint(0, 9)) for k in "abc" for i in rng.sample(range(50), 20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o long, v long"), rows


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_running(spark, chunk):
    df, rows = table(spark)
    out = running(df, ["k"], "o", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, chunk)
    for r in out.collect():
        before = [v for k, o, v in rows if k == r.k and o < r.o]
        assert r.s == sum(before)
        assert r.m == (max(before) if before else None)


@pytest.mark.parametrize("chunk", [4, 64])
def test_dense_position(spark, chunk):
    df, rows = table(spark)
    for r in dense_position(df, ["k"], "o", "p", chunk).collect():
        assert r.p == sum(1 for k, o, _ in rows if k == r.k and o < r.o)


@pytest.mark.parametrize("chunk", [3, 10])
def test_halo_equals_plain_window(spark, chunk):
    df = spark.range(100).select(F.lit("x").alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v"))

    def frame(*keys):
        return W.partitionBy(*keys).orderBy("o").rowsBetween(-3, 2)

    plain = df.withColumn("s", F.collect_list("v").over(frame("k")))
    spread = with_halo(df, "o", before=3, after=2, chunk=chunk)
    pieces = spread.withColumn("s", F.collect_list("v").over(frame("k", "_chunk"))).filter("_own")
    assert sorted(map(tuple, plain.select("o", "s").collect())) == sorted(map(tuple, pieces.select("o", "s").collect()))
    with pytest.raises(ValueError):
        with_halo(df, "o", before=3, chunk=2)


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("chunk", [5, 4096])
def test_islands(spark, touching, chunk):
    rng = random.Random(5)
    rows = [(k, s, s + rng.randint(1, 4)) for k in "ab" for s in (rng.randrange(200) for _ in range(60))]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = {tuple(r) for r in islands(df, ["k"], "s", "e", "i", touching, chunk).collect()}
    want = set()
    for key in "ab":
        head = reach = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if reach is None or (s > reach if touching else s >= reach):
                head, reach = s, e
            reach = max(reach, e)
            want.add((key, s, e, head))
    assert {(k, s, e, i) for k, s, e, i in got} == want


@pytest.mark.parametrize("chunk", [3, 17, 4096])
def test_islands_over_many_chunks(spark, chunk):
    """Intervals longer than several chunks, and runs that end inside the next one."""
    rng = random.Random(chunk)
    rows = [(k, s, s + rng.choice([1, 2, 3, 40, 90])) for k in "abc" for s in (rng.randrange(1500) for _ in range(40))]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = {(r.k, r.s): (r._reach, r.i) for r in island_starts(df, ["k"], "s", "e", "i", False, chunk).collect()}
    want = {}
    for key in "abc":
        head = reach = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if reach is None or s >= reach:
                head, reach = s, e
            reach = max(reach, e)
            want[key, s] = (max(e, want.get((key, s), (0,))[0]), head)
    assert got == want


def test_islands_scan_once(spark, tmp_path):
    """The final plan of merged spans reads its input once: later uses reuse the exchange."""
    spark.range(2000).selectExpr("id % 7 AS k", "id AS start", "id + 3 AS end").write.parquet(str(tmp_path / "t"))
    merged = merge_span_rows(spark.read.parquet(str(tmp_path / "t")), ["k"])
    assert merged.count() == 2000
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") == 1


def test_merge_span_rows_with_copies(spark):
    rows = [("d", 0, 5)] * 50 + [("d", 5, 7), ("d", 9, 10)]
    df = spark.createDataFrame(rows, "doc_id string, start long, end long")
    assert sorted(map(tuple, merge_span_rows(df, ["doc_id"]).collect())) == [("d", 0, 7), ("d", 9, 10)]
