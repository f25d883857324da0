"""Batch-level reporting: numbering, outcome summary, output collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.session import materialize


def number_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Position in path order (1-based) and the total number of files.

    The files are range-partitioned by path, so each task numbers its own
    slice; only one count per slice meets in the small window that turns those
    counts into offsets.
    """
    # Materialised, because two separate range shuffles may cut differently.
    ordered = materialize(
        files.repartitionByRange(path).withColumn("_slice", F.spark_partition_id())
    )
    local = ordered.withColumn(
        "_rank", F.row_number().over(W.partitionBy("_slice").orderBy(path))
    )
    sizes = ordered.groupBy("_slice").agg(F.count("*").alias("_size"))
    # One row per slice, so this unpartitioned window is a few thousand rows.
    offsets = sizes.select(
        "_slice",
        F.coalesce(
            F.sum("_size").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
        F.sum("_size").over(W.partitionBy()).alias("total"),
    )
    return (
        local.join(offsets, "_slice")
        .withColumn("position", F.col("_rank") + F.col("_offset"))
        .drop("_slice", "_rank", "_offset")
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: processed, passed, needing review, failed and the exit code.

    ``results`` has ``status`` (null on failure) and ``error``; a failing file
    is a row here and never fails the job.
    """
    failed = F.col("error").isNotNull()
    passed = ~failed & (F.col("status") == "passed")
    return results.agg(
        F.count("*").alias("processed"),
        F.count_if(passed).alias("passed"),
        F.count_if(~failed & ~passed).alias("review_required"),
        F.count_if(failed).alias("failed"),
    ).withColumn(
        "exit_code",
        F.when(F.col("review_required") + F.col("failed") > 0, 1).otherwise(0),
    )


def output_collisions(files: DataFrame, output: str = "output_path") -> DataFrame:
    """Output names that several inputs would write to."""
    return files.groupBy(output).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
