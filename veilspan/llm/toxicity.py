"""Toxic documents by weak supervision.

Method: many voters look at a text and either fire or stay silent.  Lexicon voters
fire on words, word beginnings and word endings that go with toxic rows of the
labelled sample, more than with texts of their kind: rows are compared within texts of
the same most frequent word, which parts languages and genres.  Each family is dealt
over several voters.  Pattern voters fire on
how such words stand in the text and on its typography.  A generative label model
then estimates, without labels, how often each voter fires in toxic and in clean
documents, from how the votes of all documents fall together; voters that fire
together more than the classes explain share their weight.  A linear classifier
over the lexicon and the patterns is trained on the posterior labels.

What grows with the corpus stays in Spark.  Votes are packed into a number of
``VOTERS`` bits, so the count of each combination, which is all the label model
needs, has at most ``2 ** VOTERS`` rows at any size.  The lexicon and the classifier
are fitted on at most ``sample_rows`` labelled rows, chosen by a hash of their ids; a
lexicon entry is held by ``LEAST_SHARE`` of the toxic sample rows, so
their number is bounded by the number of words of a text over that share.

Rows: null and empty texts have no votes and get the score of a text without any
lexicon word.  Rows without an id are scored and never learnt from.  Repeated
labels of an id count as toxic if one of them is.  Without a toxic label every
text scores 0.  Other columns are not read and may have any names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_batches, stored

SAMPLE_ROWS = 60_000
#: Least rows and least share of the toxic sample that hold a lexicon entry.
LEAST_ROWS, LEAST_SHARE = 3, 0.005
#: Least share of toxic rows among those with an entry, and least log-likelihood ratio
#: of their number against that expected of texts of their kind.
LEAST_PRECISION, LEAST_RATIO = 0.8, 20.0
#: A kind of text with fewer sample rows is taken together with all others.
LEAST_KIND = 50

FAMILIES = ("word", "begin4", "begin5", "end4")
FOLDS = 3
PATTERNS = ("several", "repeated", "dense", "close", "masked", "shouted")
#: Patterns that are no count of entries; only these are features of the classifier.
OWN_PATTERNS = (4, 5)
VOTERS = len(FAMILIES) * FOLDS + len(PATTERNS)

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@$#]+[^\W\d_]")
_PIECE = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end at white space where there is some."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def _family_values(words: set[str]) -> list[set[str]]:
    longer = {w for w in words if len(w) > 4}
    return [words, {w[:4] for w in longer}, {w[:5] for w in longer}, {w[-4:] for w in longer}]


def features(text: str | None) -> set[tuple[int, str]]:
    """Family and value of everything in a text that may be a lexicon entry."""
    words: set[str] = set()
    for piece in _pieces(text or ""):
        words.update(_WORD.findall(piece.lower()))
    return {(k, v) for k, values in enumerate(_family_values(words)) for v in values}


@dataclass(frozen=True)
class Lexicon:
    """Entries by family, each with its number."""

    entries: tuple[dict[str, int], ...]

    @property
    def size(self) -> int:
        return sum(map(len, self.entries))

    def _holds(self, word: str) -> bool:
        word_entries, begin4, begin5, end4 = self.entries
        return word in word_entries or (len(word) > 4 and (word[:4] in begin4 or word[:5] in begin5 or word[-4:] in end4))

    def look(self, text: str | None) -> tuple[int, list[int]]:
        """The voters that fire on a text, as bits, and the numbers of the entries it holds."""
        votes, found, held = 0, set(), Counter()
        count = last = 0
        close = masked = shouted = False
        for piece in _pieces(text or ""):
            words = _WORD.findall(piece.lower())
            distinct = set(words)
            new = [(k, v) for k, (values, known) in enumerate(zip(_family_values(distinct), self.entries, strict=True)) for v in values & known.keys()]
            for k, v in new:
                found.add(self.entries[k][v])
                votes |= 1 << (k * FOLDS + zlib.crc32(v.encode()) % FOLDS)
            if new:
                marked = {w for w in distinct if self._holds(w)}
                for i, w in enumerate(words, count + 1):
                    if w in marked:
                        close |= last > 0 and i - last <= 12
                        last = i
                        held[w] += 1
            count += len(words)
            masked = masked or bool(_MASKED.search(piece))
            shouted = shouted or "!!" in piece
        hits = sum(held.values())
        patterns = (len(held) > 1, hits > len(held), 100 * hits >= count > 0, close, masked, shouted)
        for i, fires in enumerate(patterns, len(FAMILIES) * FOLDS):
            votes |= int(fires) << i
        return votes, sorted(found)


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic documents, and how often each voter fires in either class."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    shares: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fires = _bits(votes)
        fired = np.log(self.toxic) - np.log(self.clean)
        silent = np.log1p(-self.toxic) - np.log1p(-self.clean)
        logit = math.log(self.prior / (1 - self.prior)) + (np.where(fires, fired, silent) * self.shares).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _bits(votes: np.ndarray) -> np.ndarray:
    return (np.asarray(votes, np.int64)[:, None] >> np.arange(VOTERS)) & 1 > 0


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 4, steps: int = 40) -> LabelModel:
    """Expectation maximisation over the counted combinations of votes.

    It starts from the share of lexicon voters that fire.  After every round the
    voters' correlations within each class are measured, and a voter that agrees
    with others beyond what the class explains has its weight divided among them.
    """
    fires = _bits(votes)
    weights = counts.astype(float)
    posterior = np.clip(fires[:, : len(FAMILIES) * FOLDS].sum(1) / 3, 0.001, 0.999)
    shares, correlations = np.ones(VOTERS), np.zeros((VOTERS, VOTERS))
    model = None
    for _ in range(rounds):
        for _ in range(steps):
            toxic, clean = weights * posterior, weights * (1 - posterior)
            rates = [np.clip((c @ fires + s) / (c.sum() + 1), 1e-4, 1 - 1e-4) for c, s in ((toxic, 0.5), (clean, 0.01))]
            prior = float(np.clip(toxic.sum() / weights.sum(), 1e-4, 0.5))
            model = LabelModel(prior, *rates, shares, correlations)
            posterior = model.posterior(votes)
        correlations = np.zeros((VOTERS, VOTERS))
        for c, rate in ((weights * posterior, model.toxic), (weights * (1 - posterior), model.clean)):
            spread = np.sqrt(rate * (1 - rate))
            together = (fires * c[:, None]).T @ fires / max(c.sum(), 1)
            phi = (together - np.outer(rate, rate)) / np.outer(spread, spread)
            correlations = np.maximum(correlations, np.clip(phi, 0, 1) * (c.sum() > 0))
        np.fill_diagonal(correlations, 0)
        shares = 1 / (1 + (correlations**2).sum(1))
    return LabelModel(model.prior, model.toxic, model.clean, shares, correlations)


def fit_classifier(entries: list[list[int]], votes: np.ndarray, targets: np.ndarray, size: int, steps: int = 600) -> np.ndarray:
    """Weights of a logistic model over entries, patterns and a constant.

    Toxic and clean targets have the same total weight in the loss, so the score
    of a text does not sink because toxic ones are rare.
    """
    n = len(targets)
    rows = np.repeat(np.arange(n), [len(e) for e in entries])
    columns = np.array([c for e in entries for c in e], np.int64)
    more = np.nonzero(_bits(votes)[:, [len(FAMILIES) * FOLDS + i for i in OWN_PATTERNS]])
    rows, columns = np.concatenate([rows, more[0]]), np.concatenate([columns, more[1] + size])
    width = size + len(OWN_PATTERNS)
    balance = targets / max(targets.sum(), 1e-9) + (1 - targets) / max((1 - targets).sum(), 1e-9)
    balance /= balance.sum()
    weights, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        logit = np.bincount(rows, weights[columns], n) + weights[-1]
        slope = balance * (1 / (1 + np.exp(-logit)) - targets)
        gradient = np.append(np.bincount(columns, slope[rows], width), slope.sum())
        gradient[:-1] += 1e-5 * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    labels: LabelModel | None

    def _logit(self, votes: int, entries: list[int]) -> float:
        logit = self.weights[-1] + self.weights[entries].sum()
        for k, i in enumerate(OWN_PATTERNS):
            if votes >> (len(FAMILIES) * FOLDS + i) & 1:
                logit += self.weights[self.lexicon.size + k]
        return logit

    def score(self, votes: int, entries: list[int]) -> float:
        """The score of a text that was looked at."""
        if not self.lexicon.size:
            return 0.0
        return float(1 / (1 + math.exp(-min(40.0, max(-40.0, self._logit(votes, entries))))))

    def scores(self, text: Column) -> Column:
        """The score of each text, between 0 and 1."""

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([self.score(*self.lexicon.look(t)) for t in texts], dtype="float64")

        return scored(text)

    def scores_of(self, votes: Column, entries: Column) -> Column:
        """The score of each text from what was seen in it."""

        @F.pandas_udf("double")
        def scored(votes: pd.Series, entries: pd.Series) -> pd.Series:
            return pd.Series([self.score(v, list(e)) for v, e in zip(votes, entries, strict=True)], dtype="float64")

        return scored(votes, entries)


def held_out(id_column: str) -> Column:
    """Rows whose labels are kept from learning."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def kind_of(text: str | None) -> str:
    """The most frequent word of a text, the first in the alphabet among several."""
    counts: Counter = Counter()
    for piece in _pieces(text or ""):
        counts.update(_WORD.findall(piece.lower()))
    return min(counts, key=lambda w: (-counts[w], w)) if counts else ""


def _count_features(batches: Iterator[pa.RecordBatch], wanted: frozenset | None, shares: dict[str, float], overall: float) -> Iterator[pa.RecordBatch]:
    """How many rows have a feature, and how many of those would be toxic if they were
    like other texts of their kind; for the wanted features if these are given."""
    counts: Counter = Counter()
    expected: Counter = Counter()

    def made() -> pa.RecordBatch:
        keys = list(counts)
        columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([v for _, v in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([expected[k] for k in keys], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["family", "value", "n", "expected"])

    for batch in batches:
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            share = shares.get(kind, overall)
            found = features(text)
            for key in found if wanted is None else found & wanted:
                counts[key] += 1
                expected[key] += share
            if len(counts) > 500_000:
                yield made()
                counts.clear()
                expected.clear()
    if counts:
        yield made()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Entries that go with the toxic rows of a bounded sample (``text``, ``toxic``)."""
    none = Lexicon(tuple({} for _ in FAMILIES))
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, rows = sizes.get(1, 0), sum(sizes.values())
    if not toxic or toxic == rows:
        return none
    kinds = sample.groupBy("kind").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= LEAST_KIND).collect()
    shares, overall = {r.kind: r.t / r.n for r in kinds}, toxic / rows
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * toxic))

    def counted(value: int, wanted: frozenset | None) -> DataFrame:
        texts = sample.filter(F.col("toxic") == value).select("text", "kind")
        found = texts.mapInArrow(lambda b: _count_features(b, wanted, shares, overall), "family int, value string, n long, expected double")
        return found.groupBy("family", "value").agg(F.sum("n").alias("n"), F.sum("expected").alias("expected"))

    common = {(r.family, r.value): (r.n, r.expected) for r in counted(1, None).filter(F.col("n") >= least).collect()}
    beside = {(r.family, r.value): (r.n, r.expected) for r in counted(0, frozenset(common)).collect()}
    chosen = []
    for key, (n, of_toxic) in common.items():
        m, of_clean = beside.get(key, (0, 0.0))
        expected = of_toxic + of_clean
        rest = n + m - expected
        ratio = 2 * (n * math.log(n / expected) + (m * math.log(m / rest) if m else 0)) if expected > 0 else math.inf
        if n > expected and n >= LEAST_PRECISION * (n + m) and ratio >= LEAST_RATIO:
            chosen.append(key)
    entries: tuple[dict[str, int], ...] = tuple({} for _ in FAMILIES)
    for number, (family, value) in enumerate(sorted(chosen)):
        entries[family][value] = number
    return Lexicon(entries)


def _looked(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    """What the lexicon finds in the last column, in its place."""
    for batch in batches:
        seen = [lexicon.value.look(t) for t in batch.columns[-1].to_pylist()]
        columns = [*batch.columns[:-1], pa.array([v for v, _ in seen], pa.int64()), pa.array([e for _, e in seen], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "votes", "entries"])


def drawn_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``text``, ``toxic`` and ``kind`` of at most ``rows`` labelled documents."""
    known = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    # at most so many ids, so they may be sent to every task
    drawn = stored(known.orderBy(F.xxhash64("id", F.lit(97)), "id").limit(rows))

    @F.pandas_udf("string")
    def kind(texts: pd.Series) -> pd.Series:
        return pd.Series([kind_of(t) for t in texts], dtype=object)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    return stored(own.select("text", "toxic", kind("text").alias("kind")))


def fit(lexicon: Lexicon, looked: DataFrame, sample: DataFrame) -> ToxicityModel:
    """Label model from the votes of all documents, and classifier from the sample."""
    if not lexicon.size:
        return ToxicityModel(lexicon, np.zeros(len(OWN_PATTERNS) + 1), None)
    counted = looked.groupBy("votes").count().collect()  # at most 2 ** VOTERS rows
    model = fit_label_model(np.array([r[0] for r in counted]), np.array([r[1] for r in counted]))
    seen = look_at(sample.select("text"), lexicon).collect()
    votes = np.array([r.votes for r in seen])
    return ToxicityModel(lexicon, fit_classifier([r.entries for r in seen], votes, model.posterior(votes), lexicon.size), model)


def look_at(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``votes`` and ``entries`` in the place of the last column."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(lambda b: _looked(b, shared), f"{kept}{', ' * bool(kept)}votes long, entries array<int>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Lexicon, label model and classifier, from the labels that may be learnt from and
    the texts of all documents."""
    small_batches(docs.sparkSession)
    sample = drawn_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    lexicon = learn_lexicon(sample)
    return fit(lexicon, look_at(docs.select(F.col(text_col).alias("text")), lexicon), sample)


def scored_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, score_col: str = "score") -> DataFrame:
    """``docs`` with a ``score_col``.

    Every text is looked at once: the rows are written with what was seen in them, and the
    model that this leads to scores them as written.
    """
    small_batches(docs.sparkSession)
    sample = drawn_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    lexicon = learn_lexicon(sample)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    looked = stored(look_at(plain.select("*", plain[f"c{docs.columns.index(text_col)}"].alias("looked")), lexicon))
    model = fit(lexicon, looked, sample)
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return looked.select(*named, model.scores_of(F.col("votes"), F.col("entries")).alias(score_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of each row."""
    small_batches(docs.sparkSession)
    sample = drawn_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    lexicon = learn_lexicon(sample)
    looked = stored(look_at(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lexicon))
    model = fit(lexicon, looked, sample)
    scored = looked.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), model.scores_of(F.col("votes"), F.col("entries")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
