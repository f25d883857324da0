"""Publication of finished documents in one step.

A publication is a folder of its own below the target: the rows, and a list of its
contents with a digest for each document, made from what was really written.  The
target's file ``current`` names the folder that counts.  Replacing that file by a rename
is the only commit: whatever fails before it leaves the former publication as it was,
and readers never see half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CURRENT = "current"


class NotPublished(Exception):
    """The target has no publication, or its rows do not have their digests."""


def _files(spark: SparkSession, path: str):
    """The file context of a path, and a maker of Hadoop paths."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    return context, fs


def _digest(columns: Sequence[str]) -> Column:
    """One digest of the columns of a row; a null is not an empty text."""
    fields = F.struct(*(F.col(c).cast("string").alias(c) for c in columns))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)


def _contents(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.select(*keys, _digest(columns).alias("sha256"))


def stage(documents: DataFrame, target: str, keys: Sequence[str] = ("doc_id",)) -> str:
    """Write the rows and their list of contents below ``target``; nothing counts yet."""
    spark = documents.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    documents.write.parquet(f"{target}/{version}/rows")
    written = spark.read.schema(documents.schema).parquet(f"{target}/{version}/rows")
    _contents(written, keys, documents.columns).write.parquet(f"{target}/{version}/contents")
    return version


def commit(spark: SparkSession, target: str, version: str) -> None:
    """Make a staged version the one that counts, by one rename."""
    context, fs = _files(spark, target)
    flags = spark._jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
    none = spark.sparkContext._gateway.new_array(fs.Options.CreateOpts, 0)
    draft = fs.Path(f"{target}/.{version}")
    out = context.create(draft, flags, none)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    context.rename(draft, fs.Path(f"{target}/{_CURRENT}"), overwrite)


def publish(documents: DataFrame, target: str, keys: Sequence[str] = ("doc_id",)) -> str:
    """Publish the verified documents of ``documents`` (``passed``) as a whole.

    Returns the name of the new version.
    """
    version = stage(documents.filter(F.coalesce("passed", F.lit(False))), target, keys)
    commit(documents.sparkSession, target, version)
    return version


def current_version(spark: SparkSession, target: str) -> str:
    context, fs = _files(spark, target)
    path = fs.Path(f"{target}/{_CURRENT}")
    if not context.util().exists(path):
        raise NotPublished(target)
    return spark.read.text(f"{target}/{_CURRENT}").first()[0]


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the publication that counts."""
    return spark.read.parquet(f"{target}/{current_version(spark, target)}/rows")


def read_contents(spark: SparkSession, target: str) -> DataFrame:
    """Its list of contents: the keys and ``sha256`` of each document."""
    return spark.read.parquet(f"{target}/{current_version(spark, target)}/contents")


def changed_contents(spark: SparkSession, target: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents whose rows are missing, added or not as they were published."""
    keys = list(keys)
    rows = read_published(spark, target)
    now = _contents(rows, keys, rows.columns).groupBy(*keys, "sha256").agg(F.count("*").alias("n"))
    listed = read_contents(spark, target).groupBy(*keys, "sha256").agg(F.count("*").alias("_n"))
    both = now.join(listed, [*keys, "sha256"], "full_outer")
    return both.filter(~F.coalesce(F.col("n") == F.col("_n"), F.lit(False))).select(*keys).distinct()
