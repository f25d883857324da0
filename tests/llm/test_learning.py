"""Importance resampling, centroid clustering and the quality classifier against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import table, texts

from veilspan.llm import quality_classifier as Q
from veilspan.llm.centroids import Bisectors, clustered, with_inertia
from veilspan.llm.importance import resampled, words_of
from veilspan.llm.quality_classifier import held_out, quality, statistics


@pytest.fixture(params=["1", "9"])
def width(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


# --- importance -------------------------------------------------------------


def plain_features(text, least, most):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def plain_resampled(docs, items, percent, least_words, least, most, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *plain_features(t, least, most)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for _, x in items for f in plain_features(x, least, most)[1])
    whole, target = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (target + buckets))))
    rows = []
    for i, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {}
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop(0) if rank.get(r) else None) for r in rows), key=repr)


ITEMS = [(1, "w1 w2 W3, the straße"), (2, None), (3, ""), (4, "w1 w2 w3 of the of the"), (4, "日本 x1")]


@pytest.mark.parametrize("least,most", [(1, 1), (1, 3), (2, 2)])
def test_importance(spark, width, least, most):
    docs = [*texts(), (None, texts()[8][1]), (None, None)]
    got = resampled(table(spark, docs), table(spark, ITEMS, "item_id long, text string"), 40, 20, least=least, most=most, buckets=997)
    want = plain_resampled(docs, ITEMS, 40, 20, least, most, 997)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[5] is not None for r in want) > 5


def test_importance_of_equal_scores(spark, width):
    """All rows have one weight and one id, so only the limit on ranks tells them apart."""
    docs = [(7, "same words " * 15)] * 40
    ranks = sorted(r.rank for r in resampled(table(spark, docs), table(spark, ITEMS, "item_id long, text string"), 50).collect() if r.rank)
    assert ranks == list(range(1, 21))


def test_importance_of_empty_tables(spark):
    none, some = table(spark, []), table(spark, [(1, "a " * 30), (2, None)])
    assert resampled(none, some).count() == 0
    assert [tuple(r)[:3] for r in resampled(some, none).orderBy("id").collect()] == [(1, 30, 30), (2, 0, 0)]


def test_words_of_odd_texts():
    rows, _, names = words_of(pa.array([None, "", "\x00a\x7fB\x00", "É é", "x" * 3_000_000 + " y", "--"]))
    assert rows.tolist() == [2, 2, 3, 3, 4, 4]
    assert names[:4] == [b"a", b"b", "É".encode(), "é".encode()]


# --- centroids --------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = Counter()
    for _, n, d in found:
        sums[n] += d
    digest = lambda n: hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
    return sorted(((i, n, d, sums[n], sum(sums.values()), digest(n)) for i, n, d in found), key=repr)


def vectors(n, dims, spread=1.0):
    draw = random.Random(11)
    middles = [[draw.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, spread) for x in draw.choice(middles)]) for i in range(n)]
    # copies under other ids and under the same one, and a lattice whose points often lie on a bisector
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [rows[4]] * 3
    rows += [(2000 + i, [float(draw.randrange(-1, 2)) for _ in range(dims)]) for i in range(80)]
    rows += [(None, rows[5][1]), (3000, None), (3001, []), (3002, [1.0] * (dims + 1)), (3003, [None] + [0.0] * (dims - 1))]
    return rows + [(3004, [float("nan")] + [0.0] * (dims - 1)), (3005, [float("-inf")] + [0.0] * (dims - 1))]


@pytest.mark.parametrize("dims,k,kind", [(3, 12, "double"), (8, 40, "double"), (64, 5, "float")])
def test_centroids(spark, width, dims, k, kind):
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(150, dims)]
    df = table(spark, rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("cluster", "v", "distance")})
    assigned, centroids = clustered(df, k=k, rounds=5, dims=dims)
    got = with_inertia(assigned, centroids).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_clusters(rows, k, 5, dims, 256, 2)


def test_centroids_of_few_rows(spark):
    df = table(spark, [(1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assigned, centroids = clustered(df, dims=2)
    assert len(centroids) == 2 and sorted(r.distance for r in assigned.collect()) == [0, 0]
    assigned, centroids = clustered(df.limit(0), dims=2)
    assert with_inertia(assigned, centroids).count() == 0


def test_tournament_is_exact():
    """Integer ties, and numbers that doubles could not add up."""
    draw = np.random.default_rng(3)
    for bound in (2, 1 << 12, 1 << 26):
        centroids, points = draw.integers(-bound, bound, (30, 16)), draw.integers(-bound, bound, (500, 16))
        centroids[20] = centroids[3]
        squares = [[sum(int(a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for x in points]
        assert Bisectors.of(centroids).nearest(points).tolist() == [s.index(min(s)) for s in squares]
    with pytest.raises(ArithmeticError):
        Bisectors.of(centroids).nearest(points * 4)


# --- quality ----------------------------------------------------------------


def graded(n=900):
    draw = random.Random(2)
    words = ["the", "river", "of", "Überweg", "stone", "and", "path", "little", "garden", "to", "a", "mañana"]
    sentence = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(5, 14))).capitalize() + "."
    rows = []
    for i in range(n):
        good = "\n".join(" ".join(sentence() for _ in range(draw.randrange(1, 5))) for _ in range(draw.randrange(1, 6)))
        junk = draw.choice([lambda t: t.replace(" ", draw.choice(["### ", "%%% "])), lambda t: (t.split()[0] + " ") * 60, lambda t: " | ".join(t.split())])
        rows.append((i, junk(good), 0) if i % 5 == 0 else (i, good, 1))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = graded()
    extra = [(5000, None), (5001, ""), (None, rows[1][1]), (5002, "long text. " * 40_000)]
    docs = table(spark, [r[:2] for r in rows] + extra)
    labels = [(i, q) for i, _, q in rows if i % 3] + [(None, 0), (2, None), (7, 1), (7, 1), (9999, 0)]
    got = quality(docs, table(spark, labels, "doc_id long, quality int"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows) + 4
    found = {r.doc_id: r for r in got.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert {i for i, r in found.items() if r.held_out} == {i for i in found if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    unseen = [(found[i].predicted, q) for i, _, q in rows if found[i].held_out]
    assert len(unseen) > 100 and sum(p != q for p, q in unseen) <= 2


def test_quality_ignores_held_out_labels(spark):
    rows = graded(400)
    docs = table(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = ({r.doc_id: r.score for r in quality(docs, x).collect()} for x in (labels, turned))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-6 for i in one)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1)], 0.75), ([(1, 0), (1, 1)], 0.25)])
def test_quality_without_both_classes(spark, labels, score):
    docs = table(spark, [(1, "Some text."), (2, None)])
    got = quality(docs, table(spark, labels, "doc_id long, quality int"))
    assert [r.score for r in got.collect()] == [score, score]
    assert quality(table(spark, []), table(spark, labels, "doc_id long, quality int")).count() == 0


def test_densities_against_their_formula(spark):
    """The model from added sums, and its scores, against whole-sample moments and inverses."""
    rows = graded(300)
    column = pa.array([t for _, t, _ in rows])
    x = statistics(*Q.buffers(column))
    y = np.array([q for *_, q in rows])
    parts = [Q.Sums(m.sum(), x[m].sum(0), x[m].T @ x[m]) for m in (y == 0, y == 1)]
    model = Q.discriminant(*parts, 0.3, 0.1, 0.5)
    own = [np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)]
    shared = (own[0] + own[1]) / (len(y) - 2)
    logs = []
    for k in (0, 1):
        c = 0.7 * (own[k] + shared) / (y == k).sum() + 0.3 * shared
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + (np.diag(shared).mean() * 1e-4 + 1e-9) * np.eye(len(c))
        apart = x - x[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(c), apart) - 0.5 * np.linalg.slogdet(c)[1])
    logit = np.clip(0.5 * (logs[1] - logs[0]) + np.log((y == 1).mean() / (y == 0).mean()), -30, 30)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-logit)), atol=1e-6)


def test_statistics_do_not_depend_on_neighbours():
    """A text has the same statistics alone and among others, whatever the pieces."""
    some = [t or "" for _, t in texts()] + ["é" * 400_000, "a\nb " * 300_000]
    data, starts = Q.buffers(pa.array(some))
    together = np.concatenate([statistics(data, starts[a : b + 1]) for a, b in Q.groups(starts, 5000)])
    for text, row in zip(some, together, strict=True):
        assert np.allclose(statistics(*Q.buffers(pa.array([text])))[0], row)
    assert together.shape == (len(some), Q.FEATURES) and np.isfinite(together).all()
