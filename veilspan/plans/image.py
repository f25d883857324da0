"""Redact-and-verify over pages, and the document results built from them.

Recognition models are not part of this library: what they read or see arrives
as tables, one row per page and pass.  ``pass_no`` 0 is the original image and
``pass_no`` k the output of redaction pass k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan import schemas as S
from veilspan.functions.paths import fingerprint
from veilspan.operators.boxes import (
    face_boxes,
    image_detections,
    signature_boxes,
)
from veilspan.operators.detections import explode_rows
from veilspan.operators.lines import page_text_detections
from veilspan.operators.passes import first_reports, pass_outcomes


def detect_pages(
    pages: DataFrame,
    keys: Sequence[str],
    raw_faces: DataFrame | None = None,
    raw_signatures: DataFrame | None = None,
    semantic: Column | None = None,
    line_semantic: Column | None = None,
) -> DataFrame:
    """Every detector over page rows: text in the row, boxes from raw tables.

    ``keys`` may include ``pass_no``, which verifies redacted pages the same
    way.
    """
    text = explode_rows(
        pages, keys, page_text_detections("items", semantic, line_semantic)
    ).select(*keys, "d.*")
    faces = face_boxes(raw_faces, keys) if raw_faces is not None else None
    signatures = (
        signature_boxes(raw_signatures, keys) if raw_signatures is not None else None
    )
    return image_detections(text, faces, signatures, keys)


def sanitize_pages(
    pages: DataFrame,
    detections: DataFrame,
    keys: Sequence[str],
    max_passes: int = S.DEFAULT_MAX_PASSES,
) -> DataFrame:
    """Outcome of the redact-and-verify loop for every page.

    ``detections`` holds all passes.  Adds ``redaction_passes``,
    ``applied_count``, ``remaining_count`` and ``passed``.
    """
    if max_passes < 1:
        raise ValueError("max_passes must be at least 1")
    keys = list(keys)
    initial = detections.filter(F.col("pass_no") == 0)
    found = detections.filter(F.col("pass_no").between(1, max_passes))
    new = first_reports(found, keys, known=initial)
    outcomes = pass_outcomes(
        pages.select(*keys).withColumn("max_passes", F.lit(max_passes)), found, new, keys
    )
    first = initial.groupBy(*keys).agg(F.count("*").alias("_initial"))
    return outcomes.join(first, keys, "left").select(
        *keys,
        "redaction_passes",
        (F.coalesce("_initial", F.lit(0)) + F.col("added_rows")).alias("applied_count"),
        "remaining_count",
        F.col("detectors_clear").alias("passed"),
    )


def applied_page_detections(
    detections: DataFrame, outcomes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The detections that end up redacted: the first pass and what was new later.

    Copies within one pass are kept as reported, as ``n`` on a single row.
    """
    keys = list(keys)
    initial = detections.filter(F.col("pass_no") == 0)
    identity = [*keys, "detection_type", "bbox"]
    first = initial.groupBy(*identity).agg(
        F.lit(0).alias("pass_no"), F.count("*").alias("n"), F.max("confidence").alias("confidence")
    )
    later = (
        first_reports(detections.filter(F.col("pass_no") > 0), keys, known=initial)
        .join(outcomes.select(*keys, "redaction_passes"), keys)
        .filter(F.col("first_pass") < F.col("redaction_passes"))
        .select(*identity, F.col("first_pass").alias("pass_no"), F.col("rows").alias("n"), "confidence")
    )
    return first.unionByName(later)


# --- documents --------------------------------------------------------------


def document_results(
    pages: DataFrame, documents: DataFrame, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Page outcomes rolled up per document; Word documents are no different.

    ``documents`` carries ``text_layer_empty``.  A document passes when all its
    pages do and no extractable text is left; failed pages stay rows, see
    ``failed_pages``.  A page without a verdict was not verified and counts as
    failed.  A document without pages, or pages without a document, do not pass.
    """
    rolled = pages.groupBy(*keys).agg(
        F.count("*").alias("page_count"),
        F.count_if(~_verified()).alias("failed_page_count"),
        F.sum("redaction_passes").alias("redaction_passes"),
    )
    joined = rolled.join(documents, list(keys), "full_outer")
    for count in ("page_count", "failed_page_count", "redaction_passes"):
        joined = joined.withColumn(count, F.coalesce(count, F.lit(0)))
    return joined.withColumn(
        "passed",
        F.coalesce(F.col("text_layer_empty"), F.lit(False))
        & (F.col("page_count") > 0)
        & (F.col("failed_page_count") == 0),
    )


def _verified() -> Column:
    return F.coalesce(F.col("passed"), F.lit(False))


def failed_pages(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return pages.filter(~_verified()).select(*keys, "page_no", "remaining_count")


def held_back_pages(
    pages: DataFrame, documents: DataFrame, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Why a document is not published: ``page_no`` and ``reason``, a row each.

    ``documents`` holds ``document_results``.  ``page_no`` is null where the reason
    concerns the document as a whole.
    """
    keys = list(keys)
    held = publishable(documents)[1]
    reason = F.when(F.col("passed").isNull(), "page_not_verified").otherwise("detections_remain")
    by_page = (
        pages.filter(~_verified())
        .join(held.select(*keys), keys, "left_semi")
        .select(*keys, "page_no", reason.alias("reason"))
    )
    whole = F.array_compact(
        F.array(
            F.when(F.col("page_count") == 0, "no_pages"),
            F.when(F.col("text_layer_empty").isNull(), "text_layer_not_checked"),
            F.when(~F.col("text_layer_empty"), "text_layer_left"),
        )
    )
    of_document = explode_rows(held, keys, whole).select(
        *keys, F.lit(None).cast(pages.schema["page_no"].dataType).alias("page_no"), F.col("d").alias("reason")
    )
    return by_page.unionByName(of_document)


def publishable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split documents into those to publish and those held back.

    A document is published as a whole or not at all.
    """
    ok = F.coalesce(F.col("passed"), F.lit(False))
    return documents.filter(ok), documents.filter(~ok)


# --- review plans -----------------------------------------------------------


def plans_from_detections(
    pages: DataFrame,
    numbered: DataFrame,
    keys: Sequence[str],
    margin: int = S.DEFAULT_MARGIN,
    max_passes: int = S.DEFAULT_MAX_PASSES,
) -> tuple[DataFrame, DataFrame]:
    """Revision 0 of a review plan per page: ``(plans, regions)``.

    ``pages`` carries ``source_sha256, image_width, image_height``; a null or
    changed fingerprint is found by ``source_mismatches``.  ``numbered`` holds
    detections with their ``region_id``.  The plan id derives from the page
    key, so running the job again gives the same plans.
    """
    plan_id = F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 32).alias("plan_id")
    plans = pages.select(
        *keys,
        plan_id,
        F.lit(0).alias("revision"),
        "source_sha256",
        "image_width",
        "image_height",
        F.lit(margin).alias("redaction_margin"),
        F.lit(max_passes).alias("max_redaction_passes"),
    )
    regions = numbered.select(
        plan_id,
        F.lit(0).alias("revision"),
        "region_id",
        "bbox",
        F.lit("automatic").alias("provenance"),
        F.lit("retain").alias("action"),
        "detection_type",
        "confidence",
        F.lit(False).alias("geometry_modified"),
    )
    return plans, regions


def image_identity(images: DataFrame, content: str = "content") -> DataFrame:
    """Add ``source_sha256`` of the image bytes."""
    return images.withColumn("source_sha256", fingerprint(content))
