"""Outcome of the redact-and-verify loop, computed without looping.

After redaction pass ``k`` the verifier reports the rows with ``pass_no = k``.
A report leads to a further pass only if it names something not applied
before.  A key is new in the first pass that reports it, so the passes that
bring something new are known from one aggregation, and the number of passes
is one more than the unbroken run of such passes from the first one on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_reports(
    found: DataFrame, keys: Sequence[str], known: DataFrame | None = None
) -> DataFrame:
    """Per (subject, type, box) not ``known``: first pass and its row count.

    Copies of one report are folded before anything else is shuffled.
    """
    identity = [*keys, "detection_type", "bbox"]
    folded = found.groupBy(*identity, "pass_no").agg(
        F.count("*").alias("rows"), F.max("confidence").alias("confidence")
    )
    if known is not None:
        folded = folded.join(known.select(*identity).distinct(), identity, "left_anti")
    return folded.groupBy(*identity).agg(
        F.min("pass_no").alias("first_pass"),
        F.min_by("rows", "pass_no").alias("rows"),
        F.min_by("confidence", "pass_no").alias("confidence"),
    )


def pass_outcomes(
    subjects: DataFrame,
    found: DataFrame,
    new_reports: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """Per subject: ``redaction_passes``, what was added, and what remains.

    ``subjects`` holds the keys and ``max_passes``.  ``added_keys`` counts
    distinct boxes, ``added_rows`` counts reports including copies.
    """
    keys = list(keys)
    per_pass = (
        new_reports.groupBy(*keys, "first_pass")
        .agg(F.count("*").alias("n_keys"), F.sum("rows").alias("n_rows"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("first_pass", "n_keys", "n_rows")).alias("_new"))
    )
    run = F.aggregate(
        F.sequence(F.lit(1), F.col("max_passes")),
        F.lit(1),
        lambda done, k: F.when(
            (done == k)
            & (k < F.col("max_passes"))
            & F.exists("_new", lambda p: p["first_pass"] == k),
            k + 1,
        ).otherwise(done),
    )
    staged = subjects.join(per_pass, keys, "left").withColumn(
        "redaction_passes", F.when(F.col("_new").isNull(), F.lit(1)).otherwise(run)
    )

    def added(field: str):
        used = F.filter("_new", lambda p: p["first_pass"] < F.col("redaction_passes"))
        return F.aggregate(
            F.coalesce(F.transform(used, lambda p: p[field]), F.array().cast("array<bigint>")),
            F.lit(0).cast("bigint"),
            lambda a, n: a + n,
        )

    reported = found.groupBy(*keys, F.col("pass_no").alias("redaction_passes")).agg(
        F.count("*").alias("_remaining")
    )
    return (
        staged.withColumn("added_keys", added("n_keys"))
        .withColumn("added_rows", added("n_rows"))
        .drop("_new")
        .join(reported, [*keys, "redaction_passes"], "left")
        .withColumn("remaining_count", F.coalesce("_remaining", F.lit(0)))
        .withColumn("detectors_clear", F.col("remaining_count") == 0)
        .drop("_remaining")
    )
