"""Counting, deduplicating and reporting over detection tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.scan import island_starts
from veilspan.schemas import DETECTION_TYPES


def explode_detections(df: DataFrame, keys: Sequence[str], detections: str) -> DataFrame:
    """One row per text detection; the matched text itself is never carried."""
    return explode_rows(df, keys, F.col(detections)).select(
        *keys, "d.detection_type", "d.start", "d.end", "d.confidence"
    )


def add_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters cannot make Spark compute again.

    A filter on a computed column is moved below the projection that computes
    it, with a copy of the expression; over a chain of such columns the copies
    multiply.  A generator keeps filters on its output where they are.
    """
    named = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline_outer(F.array(named)))


def explode_rows(df: DataFrame, keys: Sequence[str], array: Column) -> DataFrame:
    """``keys`` and one element ``d`` per row.

    Spark would guard a plain explode with a filter on the array and move that
    filter, with a copy of the whole array expression, below the projections
    that compute it.  The outer form has no such filter, so the array is
    computed once; the rows of empty arrays are removed afterwards.
    """
    return df.select(*keys, F.explode_outer(array).alias("d")).filter(F.col("d").isNotNull())


def _by_type(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seven counters per row as seven rows."""
    pairs = F.array(
        *(F.struct(F.lit(t).alias("detection_type"), F.col(t).alias("n")) for t in DETECTION_TYPES)
    )
    return wide.select(*keys, F.inline(pairs))


def count_by_type(detections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Detections per type with zeros for absent types, in one aggregation.

    Without ``keys`` there are seven rows even for an empty input.
    """
    wide = detections.groupBy(*keys).agg(
        *(F.count_if(F.col("detection_type") == t).alias(t) for t in DETECTION_TYPES)
    )
    return _by_type(wide, keys)


def count_array_by_type(df: DataFrame, keys: Sequence[str], detections: str) -> DataFrame:
    """Per-type counts straight from the arrays, without exploding them.

    Each row adds seven small numbers, so the shuffle carries one short record
    per group and task, whatever the number of detections.
    """

    def number(kind: str) -> Column:
        return F.size(F.filter(detections, lambda d: d["detection_type"] == kind))

    wide = df.groupBy(*keys).agg(*(F.sum(number(t)).alias(t) for t in DETECTION_TYPES))
    return _by_type(wide, keys)


def missing_types(counts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected categories that a controlled input did not produce."""
    return counts.filter(F.col("detection_type").isin(*expected) & (F.col("n") == 0))


def dedupe_text(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    return detections.groupBy(*keys, "detection_type", "start", "end").agg(
        F.max("confidence").alias("confidence")
    )


def dedupe_boxes(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    return detections.groupBy(*keys, "detection_type", "bbox").agg(
        F.max("confidence").alias("confidence")
    )


def merge_span_rows(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Physical spans per document; touching spans merge."""
    marked = island_starts(detections, keys, "start", "end", "merged_start", touching=True)
    return marked.groupBy(*keys, "merged_start").agg(F.max("_reach").alias("merged_end"))


def verification_report(
    subjects: DataFrame, remaining: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``remaining_count`` and ``passed`` for every subject, found or not."""
    counted = remaining.groupBy(*keys).agg(F.count("*").alias("_n"))
    return subjects.select(*keys).join(counted, list(keys), "left").select(
        *keys,
        F.coalesce("_n", F.lit(0)).alias("remaining_count"),
        F.col("_n").isNull().alias("passed"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
