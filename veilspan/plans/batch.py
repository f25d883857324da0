"""A directory of text files from reading to the summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.paths import is_supported
from veilspan.functions.paths import output_path as file_output_path
from veilspan.operators.batch import batch_summary, output_collisions
from veilspan.plans.text import sanitize_texts
from veilspan.schemas import DEFAULT_MAX_PASSES
from veilspan.sources.files import read_files, read_texts, route_files, write_sanitized


def supported_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Supported files with their ``route``.

    Images, PDFs and Word documents go through the page plan once their lines
    and boxes have been recognised; texts can go through ``sanitize_directory``.
    """
    files = read_files(spark, path, recursive).filter(is_supported("path"))
    return route_files(files).drop("error")


def sanitize_directory(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    recursive: bool = False,
    max_passes: int = DEFAULT_MAX_PASSES,
    semantic: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sanitize all text files below a path and return the one-row summary.

    The results are one table, partitioned by ``status``.  Every supported file is
    a row: one that cannot be read, whose output name another file claims too, or
    whose kind needs recognised pages, has the status ``failed`` and an ``error``.
    The summary reads what was written.

    Names that are used twice are found on the listing, and the texts are read
    after that, so no content is shuffled for it.
    """
    listed = supported_files(spark, input_path, recursive).select(
        "path", "route", file_output_path("path", F.lit(output_path)).alias("output_path")
    )
    shared = output_collisions(listed).select("output_path", F.lit(True).alias("_shared"))
    errors = listed.join(shared, "output_path", "left").select(
        "path",
        "output_path",
        F.when(F.col("_shared"), "output name is used more than once")
        .when(F.col("route") != "text", F.concat("route", F.lit(" files need recognised pages")))
        .alias("refused"),
    )
    refused = errors.filter(F.col("refused").isNotNull())
    texts = read_texts(supported_files(spark, input_path, recursive).filter("route = 'text'"), output_path)
    checked = texts.join(refused.select("path"), "path", "left_anti").select("path", "output_path", "text", "error")
    done = sanitize_texts(
        checked.filter(F.col("error").isNull()).select("path", "output_path", "text"),
        max_passes=max_passes,
        semantic=semantic,
    ).select(
        "path",
        "output_path",
        "sanitized_text",
        "redaction_passes",
        "detections",
        "remaining",
        F.lit(None).cast("string").alias("error"),
        "status",
    )
    failed = (
        checked.filter(F.col("error").isNotNull())
        .select("path", "output_path", "error")
        .unionByName(refused.select("path", "output_path", F.col("refused").alias("error")))
        .withColumn("status", F.lit("failed"))
    )
    write_sanitized(done.unionByName(failed, allowMissingColumns=True), output_path)
    return batch_summary(spark.read.schema("error string, status string").parquet(output_path))
