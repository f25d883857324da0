"""Quality by a regularised quadratic discriminant over document statistics.

Method: each text is described by ``FEATURES`` statistics of its bytes, words and
lines, transformed so that ordinary texts spread like a normal distribution: square
roots of shares, logarithms of lengths.  Each class of labels gets a mean and a
covariance.  The covariance is shrunk towards the one both classes share and then
towards its own diagonal; a Cholesky factor of it is computed once and sent with the
model.  The log-density of a text is then half its squared Mahalanobis distance, a
triangular product, and the factor's log-determinant.  The score is the logistic of the
difference of both log-densities, flattened by a factor, with the classes' shares.

Sums and products of the statistics per label and fold are all that is learnt from, of
all labelled rows that may be used.  The amounts of shrinkage and flattening are those
of the least log-loss over five folds, each judged by the model of the other four; that
is one more scan of the labelled rows' statistics.  What reaches the driver is one row
per label, fold and statistic, or per setting.

Rows: null and empty texts have statistics of no words and are scored like others.
Rows without an id are scored and never learnt from.  Repeated labels of an id count as
low quality if one of them is low.  With only one class of labels its share is the
score; without any labels every score is 0.5.  Other columns are not read and may have
any names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_batches, stored
from .hashing import buffers, document_words, groups, spaced, window_hashes

FOLDS = 5
#: Shrinkage towards the shared covariance and towards the diagonal, and flattening.
POOLED, DIAGONAL, FLAT = (0.1, 0.3, 0.6, 0.9), (0.003, 0.03, 0.2), (1.0, 0.3, 0.1)
#: Log-density differences are kept within this many units.
MOST_LOGIT = 30.0

# kinds of bytes
SPACE, NEWLINE, LOWER, UPPER, DIGIT, STOP, PUNCTUATION, SYMBOL, BEYOND = range(9)
KINDS = 9


def _kinds() -> np.ndarray:
    kinds = np.full(256, SYMBOL, np.uint8)
    kinds[128:] = BEYOND
    for kind, members in (
        (SPACE, b" \t\x0b\x0c\r"),
        (NEWLINE, b"\n"),
        (LOWER, bytes(range(97, 123))),
        (UPPER, bytes(range(65, 91))),
        (DIGIT, b"0123456789"),
        (STOP, b".!?"),
        (PUNCTUATION, b",;:'\"()-"),
    ):
        kinds[list(members)] = kind
    return kinds


_KIND = _kinds()
_PIECE = 1 << 20


def _histograms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text how often each byte occurs, and each kind of byte after each other kind.

    A text is taken to stand between two line ends.
    """
    n = len(starts) - 1
    single, double = np.zeros((n, 256), np.int64), np.zeros((n, KINDS * KINDS), np.int64)
    for at in range(int(starts[0]), int(starts[-1]), _PIECE):
        end = min(at + _PIECE, int(starts[-1]))
        piece = data[at:end]
        owner = np.searchsorted(starts, np.arange(at, end), side="right") - 1
        low, count = int(owner[0]), int(owner[-1] - owner[0] + 1)
        single[low : low + count] += np.bincount((owner - low) * 256 + piece, minlength=256 * count).reshape(count, 256)
        kind = _KIND[piece].astype(np.int64)
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[0] = _KIND[data[at - 1]] if at > 0 else NEWLINE
        before[starts[low : low + count] - at if at <= starts[low] else starts[low + 1 : low + count] - at] = NEWLINE
        double[low : low + count] += np.bincount((owner - low) * KINDS**2 + before * KINDS + kind, minlength=KINDS**2 * count).reshape(count, KINDS**2)
    full = np.flatnonzero(np.diff(starts))
    double[full, _KIND[data[starts[full + 1] - 1]].astype(np.int64) * KINDS + NEWLINE] += 1
    return single, double


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text how many different hashes it has, and how often the commonest one occurs."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[at], np.diff(np.append(at, len(hashes))))
    return np.bincount(owner[at], minlength=n), most


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each text of a byte buffer."""
    n = len(starts) - 1
    single, double = _histograms(data, starts)
    kinds = np.zeros((n, KINDS), np.int64)
    for kind in range(KINDS):
        kinds[:, kind] = single[:, _KIND == kind].sum(1)
    pair = double.reshape(n, KINDS, KINDS)
    size = np.diff(starts)
    hashes, borders = document_words(data, starts, spaced)
    words = np.diff(borders)
    owner = np.repeat(np.arange(n), words)
    different, commonest = _distinct(hashes, owner, n)
    triples = window_hashes(hashes, 3)
    inside = owner[: len(triples)] == owner[2 : len(triples) + 2]
    different_triples, _ = _distinct(triples[inside], owner[: len(triples)][inside], n)
    repeated = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(hashes) > 1 else np.zeros(n, np.int64)
    letters = kinds[:, LOWER] + kinds[:, UPPER] + kinds[:, BEYOND]
    solid = size - kinds[:, SPACE] - kinds[:, NEWLINE]
    lines = kinds[:, NEWLINE] + 1
    ends = pair[:, :, [SPACE, NEWLINE]].sum(2)  # the kinds that words end with
    begins = pair[:, [SPACE, NEWLINE], :].sum(1)
    share = lambda part, whole: np.sqrt(part / np.maximum(whole, 1))
    ratio = lambda part, whole: np.log((part + 1) / (whole + 1))
    p = single / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    return np.stack(
        [
            np.log1p(words),
            ratio(solid, words),
            ratio(words, lines),
            ratio(words, kinds[:, STOP]),
            ratio(different, words),
            ratio(different_triples, np.maximum(words - 2, 0)),
            share(commonest, words),
            share(repeated, words),
            share(kinds[:, SYMBOL], solid),
            share(kinds[:, DIGIT], solid),
            share(kinds[:, PUNCTUATION], solid),
            share(kinds[:, STOP], solid),
            share(kinds[:, BEYOND], solid),
            share(kinds[:, UPPER], letters),
            share(ends[:, SYMBOL], words),
            share(ends[:, STOP], words),
            share(begins[:, UPPER], words),
            share(begins[:, SYMBOL], words),
            share(pair[:, STOP, NEWLINE], lines),
            share(pair[:, NEWLINE, NEWLINE], lines),
            share(pair[:, LOWER, UPPER], letters),
            entropy,
        ],
        axis=1,
    )


FEATURES = 22


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = buffers(batch.column(1))
        for at, end in groups(starts):
            found = statistics(data, starts[at : end + 1])
            columns = [batch.column(0).slice(at, end - at), pa.FixedSizeListArray.from_arrays(found.ravel(), FEATURES).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x"])


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the statistics ``x`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_described, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class ClassDensity:
    mean: np.ndarray
    #: Inverse of the lower Cholesky factor of the covariance, and the log of its determinant.
    whitening: np.ndarray
    log_root: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> ClassDensity:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.solve(factor, np.eye(len(mean))), float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        white = (x - self.mean) @ self.whitening.T
        return -0.5 * (white * white).sum(1) - self.log_root


@dataclass(frozen=True)
class Discriminant:
    """Densities of low and high quality; without both of them a score that is always given."""

    low: ClassDensity | None
    high: ClassDensity | None
    prior: float
    flat: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.prior)
        apart = self.flat * (self.high.log_density(x) - self.low.log_density(x)) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(apart, -MOST_LOGIT, MOST_LOGIT)))


@dataclass
class Sums:
    """Number, sum and sum of products of one class."""

    n: float
    first: np.ndarray
    second: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.first - other.first, self.second - other.second)

    def scatter(self) -> np.ndarray:
        return self.second - np.outer(self.first, self.first) / max(self.n, 1)


def discriminant(low: Sums, high: Sums, pooled: float, diagonal: float, flat: float) -> Discriminant:
    """The model of both classes' sums."""
    if not low.n or not high.n:
        return Discriminant(None, None, (high.n + 0.5) / (low.n + high.n + 1), flat)
    together = (low.scatter() + high.scatter()) / max(low.n + high.n - 2, 1)
    # a statistic that never varies would leave no inverse
    least = np.diag(together).mean() * 1e-4 + 1e-9
    densities = []
    for part in (low, high):
        own = (part.scatter() + together) / part.n  # few rows lean on the shared one
        own = (1 - pooled) * own + pooled * together
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + least * np.eye(len(own))
        densities.append(ClassDensity.of(part.first / part.n, own))
    return Discriminant(*densities, high.n / (low.n + high.n), flat)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), FEATURES)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by label and fold, as numbered values."""
    sums = np.zeros((2 * FOLDS, 1 + FEATURES + FEATURES**2))
    for batch in batches:
        x = _matrix(batch.column(0))
        group = batch.column(1).to_numpy().astype(np.int64) * FOLDS + batch.column(2).to_numpy().astype(np.int64)
        for g in np.unique(group):
            own = x[group == g]
            sums[g] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    g, i = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.int32()), pa.array(sums[g, i])], ["g", "i", "v"])


def class_sums(rows: DataFrame) -> list[list[Sums]]:
    """Per label and fold what all its rows (``x``, ``label``, ``fold``) add up to."""
    table = np.zeros((2 * FOLDS, 1 + FEATURES + FEATURES**2))
    parts = rows.select("x", "label", "fold").mapInArrow(_added, "g int, i int, v double")
    for row in parts.groupBy("g", "i").agg(F.sum("v").alias("v")).collect():  # one number a cell of the table
        table[row.g, row.i] = row.v
    of = lambda r: Sums(r[0], r[1 : 1 + FEATURES], r[1 + FEATURES :].reshape(FEATURES, FEATURES))
    return [[of(table[label * FOLDS + fold]) for fold in range(FOLDS)] for label in (0, 1)]


def _whole(parts: list[Sums]) -> Sums:
    return Sums(sum(p.n for p in parts), sum(p.first for p in parts), sum(p.second for p in parts))


def _losses(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A task's log-loss of every setting, each row judged by the model of the other folds."""
    models: list[list[Discriminant]] = shared.value
    losses = np.zeros(len(models))
    for batch in batches:
        x, label, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for f in np.unique(fold):
            own, high = x[fold == f], label[fold == f] == 1
            for k, by_fold in enumerate(models):
                score = by_fold[f].scores(own)
                losses[k] -= np.log(np.clip(np.where(high, score, 1 - score), 1e-12, 1)).sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(losses)), pa.int32()), pa.array(losses)], ["k", "loss"])


def fit(rows: DataFrame) -> Discriminant:
    """The model of labelled statistics (``x``, ``label``, ``fold``)."""
    parts = class_sums(rows)
    low, high = map(_whole, parts)
    settings = list(itertools.product(POOLED, DIAGONAL, FLAT))
    if not low.n and not high.n:
        return Discriminant(None, None, 0.5, 1.0)
    models = [[discriminant(low - parts[0][f], high - parts[1][f], *setting) for f in range(FOLDS)] for setting in settings]
    shared = rows.sparkSession.sparkContext.broadcast(models)
    lost = rows.select("x", "label", "fold").mapInArrow(lambda b: _losses(b, shared), "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss"))
    best = min(lost.collect(), key=lambda r: (r.loss, r.k), default=None)  # one row a setting
    return discriminant(low, high, *settings[best.k if best else 0])


def held_out(id_column: str) -> Column:
    """Rows whose labels are kept from learning."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(described_rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Statistics, label and fold of the rows that may be learnt from."""
    known = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    return described_rows.join(known, "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(FOLDS)).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of each row."""
    small_batches(docs.sparkSession)
    rows = stored(described(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(fit(stored(labelled(rows, labels, id_col, label_col))))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    scored = rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
