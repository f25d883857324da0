"""From raw documents to a training mix, in five stages.

Every stage takes the documents that its predecessor kept, as a table that was written
and read again, and works on all of them.  The first four return documents, with their
columns as they came; the last one returns the mix.

All stages: documents are rows with ``doc_id``, ``text`` and ``source``; other columns
are carried along and may have any names.  Null and empty texts are documents without
words or lines: they have nothing toxic, common, copied or leaked and stay to the end,
where they take no words.  Rows without an id are kept, never learnt from and copies of
nothing.  Rows that are repeated go or stay together, but for near dedup, which cannot
tell rows of one id apart and keeps or drops them all.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.decontaminate import contamination
from veilspan.llm.frames import row_key, stored
from veilspan.llm.line_dedup import without_common_lines
from veilspan.llm.minhash import near_duplicates
from veilspan.llm.mixing import mixed
from veilspan.llm.toxicity import scored_rows

TOXIC_SCORE = 0.7
LINE_DOCUMENTS = 10
NEAR_PERCENT = 80
WINDOW_WORDS = 10


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no operator uses, and the name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(plain).alias(c) for c, plain in names.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_SCORE``."""
    plain, names = _plain(docs)
    # the labels' columns are read by name, so the id keeps its own
    rows = plain.withColumnRenamed(names["doc_id"], "doc_id")
    scored = scored_rows(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), text_col=names["text"], score_col="score")
    return _named(scored.filter(F.col("score") < TOXIC_SCORE), names | {"doc_id": "doc_id"})


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ``LINE_DOCUMENTS`` of them or more have.

    ``n_chars`` follows the text.  A document that loses all its lines stays, empty.
    """
    plain, names = _plain(docs)
    kept = without_common_lines(plain, names["doc_id"], names["text"], min_docs=LINE_DOCUMENTS)
    if "n_chars" in names:
        kept = kept.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return _named(kept, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates, and those without an id."""
    plain, names = _plain(docs)
    found = near_duplicates(plain, names["doc_id"], names["text"], percent=NEAR_PERCENT)
    copies = found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(names["doc_id"])).distinct()
    return _named(plain.join(copies, names["doc_id"], "left_anti"), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    plain, names = _plain(docs)
    found = contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["doc_id"], names["text"], window=WINDOW_WORDS)
    hit = found.filter("n_hit > 0").select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row")).distinct()
    same = F.col(names["doc_id"]).eqNullSafe(F.col("hit_id")) & (row_key(names["doc_id"], names["text"]) == F.col("hit_row"))
    return _named(plain.join(hit, same, "left_anti"), names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The learnt scores of the first stage have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is a table in the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
