"""Audit of a published file tree for things that must not be in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import paths as P


def audit_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """Problems of a tree given by its relative file paths.

    ``kind`` is ``sensitive_directory`` (reported once, its content is not
    looked at further) or ``forbidden_file``.  Directories that are local or
    generated are left out, before their name is tested for sensitivity.
    """
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    lowered = F.transform(directories, F.lower)
    kinds = F.transform(
        lowered,
        lambda d: F.when(
            d.isin(*P.SKIPPED_DIRECTORIES) | d.startswith(P.SKIPPED_PREFIX), "skipped"
        )
        .when(d.isin(*P.SENSITIVE_DIRECTORIES), "sensitive")
        .otherwise("plain"),
    )
    located = (
        files.select(
            F.col(path).alias("_path"), directories.alias("_dirs"), kinds.alias("_kinds")
        )
        .withColumn("_sensitive", F.array_position("_kinds", "sensitive").cast("int"))
        .withColumn("_skipped", F.array_position("_kinds", "skipped").cast("int"))
    )
    reached = (F.col("_skipped") == 0) | (
        (F.col("_sensitive") > 0) & (F.col("_sensitive") < F.col("_skipped"))
    )
    forbidden = P.suffix("_path").isin(*P.FORBIDDEN_SUFFIXES) & ~F.col("_path").isin(
        *P.ALLOWED_FILES
    )
    return (
        located.filter(reached)
        .select(
            F.when(F.col("_sensitive") > 0, "sensitive_directory")
            .when(forbidden, "forbidden_file")
            .alias("kind"),
            F.when(
                F.col("_sensitive") > 0,
                F.array_join(F.slice("_dirs", F.lit(1), F.col("_sensitive")), "/"),
            )
            .otherwise(F.col("_path"))
            .alias("path"),
        )
        .filter(F.col("kind").isNotNull())
        .distinct()
    )


def audit_summary(problems: DataFrame) -> DataFrame:
    return problems.agg(
        F.count_if(F.col("kind") == "sensitive_directory").alias("sensitive_directories"),
        F.count_if(F.col("kind") == "forbidden_file").alias("forbidden_files"),
    ).withColumn(
        "exit_code",
        F.when(F.col("sensitive_directories") + F.col("forbidden_files") > 0, 1).otherwise(0),
    )
