"""Centroid clustering of integer vectors by a tournament over bisectors.

Method: before a pass over the vectors, every pair of centroids ``i < j`` gets its
bisector as an integer normal ``2 * (c_j - c_i)`` and a threshold
``|c_j|**2 - |c_i|**2``.  A vector on the positive side is nearer to ``j``; one on the
plane goes to ``i``, the smaller number.  A vector then plays ``k - 1`` of these sign
tests: the winner so far meets the next centroid, and the loser is out.  Centroids come
in the order of their numbers, so the winner so far is always the smaller one.  Only the
distance to the last winner is computed.  All numbers are whole and stay below the
bounds of exact arithmetic, so no assignment depends on rounding or on partitioning.

A round is one scan: tasks add up their vectors by centroid, at most ``k`` rows a task
leave it, and ``k`` sums of ``dims`` numbers reach the driver.  Vectors never move.

Rows: vectors of another length, or with a component that is null or not finite, are
left out.  Equal vectors and repeated ids count as often as they come; a null id is
hashed like an empty one.  With fewer kept vectors than centroids each of them is one;
without any the result is empty.  Scaled components beyond ``LARGEST`` raise an
``ArithmeticError``, since distances would no longer be exact.  Other columns are not
read and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored

#: Greatest size of a component after scaling.
LARGEST = 1 << 27
#: Vectors that play a tournament together.
BLOCK = 4096


@dataclass(frozen=True)
class Bisectors:
    """The centroids and the planes between them, pair (i, j) at ``j * (j - 1) / 2 + i``."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Bisectors:
        low, high = np.array([(i, j) for j in range(len(centroids)) for i in range(j)], np.int64).reshape(-1, 2).T
        squares = (centroids * centroids).sum(1)
        return cls(centroids, 2 * (centroids[high] - centroids[low]), squares[high] - squares[low])

    def exact_kind(self, largest: int) -> type:
        """Floats where all sums stay whole numbers below 2**53, else integers."""
        bound = max(largest, int(np.abs(self.centroids).max(initial=0)))
        return np.float64 if self.centroids.shape[1] * 8 * bound**2 < 1 << 53 else np.int64

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each vector, the smaller one of equals."""
        largest = int(np.abs(vectors).max(initial=0))
        if largest > LARGEST:
            raise ArithmeticError(f"a scaled component is beyond {LARGEST}")
        kind = self.exact_kind(largest)
        vectors, normals, thresholds = vectors.astype(kind), self.normals.astype(kind), self.thresholds.astype(kind)
        best = np.zeros(len(vectors), np.int64)
        for at in range(0, len(vectors), BLOCK):
            block, winner = vectors[at : at + BLOCK], best[at : at + BLOCK]
            for j in range(1, len(self.centroids)):
                plane = j * (j - 1) // 2 + winner
                winner[np.einsum("ij,ij->i", block, normals[plane]) > thresholds[plane]] = j
        return best

    def distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[numbers]
        return (apart * apart).sum(1)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``v``, the components times ``scale`` rounded down, of the usable rows."""
    vector = F.col(vector_col)
    unusable = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = df.filter(vector.isNotNull()).filter(F.size(vector) == dims).filter(~unusable)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return usable.select(F.col(id_col).alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _sums(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Per centroid the number of a task's vectors and their sum."""
    planes: Bisectors = shared.value
    k, dims = planes.centroids.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for batch in batches:
        vectors = _matrix(batch.column(0), dims)
        numbers = planes.nearest(vectors)
        order = np.argsort(numbers, kind="stable")
        held, first = np.unique(numbers[order], return_index=True)
        if len(held):
            sums[held] += np.add.reduceat(vectors[order], first, axis=0)
            counts += np.bincount(numbers, minlength=k)
    held = np.flatnonzero(counts)
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    planes: Bisectors = shared.value
    for batch in batches:
        vectors = _matrix(batch.column(1), planes.centroids.shape[1])
        numbers = planes.nearest(vectors)
        columns = [batch.column(0), pa.array(numbers, pa.int32()), pa.array(planes.distances(vectors, numbers))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.orderBy(digest, "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; one that no vector chose stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(Bisectors.of(centroids))
    parts = vectors.select("v").mapInArrow(lambda b: _sums(b, shared), "cluster int, n long, total array<long>")
    total = F.array(*[F.sum(F.col("total")[d].cast("decimal(20,0)")) for d in range(centroids.shape[1])])
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total")).collect():  # at most k rows
        out[row.cluster] = [int(x) // row.n for x in row.total]
    return out


def clustered(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2
) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``cluster`` and ``distance`` of every usable vector, and the centroids."""
    vectors = stored(whole_vectors(df, id_col, vector_col, dims, scale))
    centroids = first_centroids(vectors, k, seed)
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema), np.zeros((0, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    shared = df.sparkSession.sparkContext.broadcast(Bisectors.of(centroids))
    return stored(vectors.mapInArrow(lambda b: _assigned(b, shared), schema)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the distances' sums per cluster and of all, and a digest of the centroid."""
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(n, s, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for n, s in sums.items()]
    by_cluster = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    # one row a centroid
    return assigned.join(F.broadcast(by_cluster), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))
