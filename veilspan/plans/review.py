"""Export of reviewed images and the session workflow around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.boxes import redaction_rectangles
from veilspan.operators.passes import first_reports, pass_outcomes
from veilspan.operators.review import (
    blocked_by_removal,
    document_export,
    export_gate,
    exportable_sessions,
    page_status,
    plan_counts,
    source_mismatches,
)

_KEY = ["plan_id"]


def source_gate(
    plans: DataFrame, before: DataFrame, after: DataFrame | None = None
) -> DataFrame:
    """Plans that must not be exported: ``plan_id, revision, reason``.

    ``before`` and ``after`` describe the source files when the export starts and when
    its output is about to be published, see ``source_mismatches``.  An output made
    while the source changed is made of bytes nobody reviewed.
    """
    refused = source_mismatches(plans, before).withColumn("reason", F.lit("source_changed"))
    if after is None:
        return refused
    changed = source_mismatches(plans, after).join(refused.select("plan_id"), "plan_id", "left_anti")
    return refused.unionByName(changed.withColumn("reason", F.lit("source_changed_during_export")))


def _active(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("action") == "retain")


def _new_reports(plans: DataFrame, regions: DataFrame, found: DataFrame) -> DataFrame:
    """What the verifier reports that is neither applied nor meant to stay visible."""
    known = _active(regions).filter(
        F.col("detection_type").isNotNull() & F.col("confidence").isNotNull()
    ).select("plan_id", "detection_type", "bbox")
    blocked = blocked_by_removal(found, regions, plans)
    return first_reports(found, _KEY, known=known.unionByName(blocked))


def export_reviewed(
    plans: DataFrame,
    regions: DataFrame,
    found: DataFrame,
    sources: DataFrame | None = None,
    sources_after: DataFrame | None = None,
) -> DataFrame:
    """Result of redacting and verifying each plan's active regions.

    ``found`` holds the verifier's reports ``plan_id, pass_no, detection_type,
    bbox, confidence``; ``pass_no`` 1 follows the redaction of the active
    regions.  A report is remediated unless its key is already known or a
    reviewer chose to keep that place visible.  With ``sources`` the plans that
    ``source_gate`` names have no result.
    """
    if sources is not None:
        refused = source_gate(plans, sources, sources_after)
        plans = plans.join(refused.select("plan_id", "revision"), ["plan_id", "revision"], "left_anti")
    new = _new_reports(plans, regions, found)
    outcomes = pass_outcomes(
        plans.select("plan_id", F.col("max_redaction_passes").alias("max_passes")),
        found,
        new,
        _KEY,
    ).select(
        "plan_id",
        "redaction_passes",
        F.col("added_keys").alias("remediation_count"),
        "remaining_count",
        "detectors_clear",
    )
    counts = plan_counts(regions)
    joined = (
        plans.select("plan_id", "revision")
        .join(outcomes, _KEY)
        .join(counts, ["plan_id", "revision"], "left")
    )
    named = {
        "applied_region_count": "active_region_count",
        "automatic_removal_count": "automatic_removal_count",
        "automatic_geometry_adjustment_count": "automatic_geometry_adjustment_count",
        "manual_addition_count": "manual_addition_count",
    }
    return joined.select(
        "plan_id",
        F.col("revision").alias("plan_revision"),
        "redaction_passes",
        "remediation_count",
        "remaining_count",
        "detectors_clear",
        *(F.coalesce(source, F.lit(0)).alias(name) for name, source in named.items()),
    ).withColumn(
        "status",
        page_status(
            "detectors_clear",
            F.col("automatic_removal_count"),
            F.col("automatic_geometry_adjustment_count"),
        ),
    )


def remediated_detections(
    plans: DataFrame, regions: DataFrame, found: DataFrame, exports: DataFrame
) -> DataFrame:
    """What was redacted beside the reviewed regions: one row per plan, type and box.

    ``pass_no`` is the verification that reported it; its highest confidence there
    counts.
    """
    new = _new_reports(plans, regions, found)
    return new.join(exports.select("plan_id", "redaction_passes"), _KEY).filter(
        F.col("first_pass") < F.col("redaction_passes")
    ).select("plan_id", F.col("first_pass").alias("pass_no"), "detection_type", "bbox", "confidence")


def remaining_detections(found: DataFrame, exports: DataFrame) -> DataFrame:
    """What the last verification of each export still reports, as reported."""
    last = exports.select("plan_id", F.col("redaction_passes").alias("pass_no"))
    return found.join(last, ["plan_id", "pass_no"]).select(
        "plan_id", "pass_no", "detection_type", "bbox", "confidence"
    )


def export_detections_by_page(
    plans: DataFrame, regions: DataFrame, found: DataFrame, exports: DataFrame, pages: DataFrame
) -> DataFrame:
    """Remediated and remaining detections with the page they lie on.

    ``pages`` gives ``plan_id, session_id, page_number``; ``outcome`` is
    ``remediated`` or ``remaining``.
    """
    rows = remediated_detections(plans, regions, found, exports).withColumn(
        "outcome", F.lit("remediated")
    ).unionByName(remaining_detections(found, exports).withColumn("outcome", F.lit("remaining")))
    return rows.join(pages.select("plan_id", "session_id", "page_number"), _KEY)


def export_rectangles(
    plans: DataFrame, regions: DataFrame, found: DataFrame, exports: DataFrame
) -> DataFrame:
    """Every rectangle that an export paints: active regions and remediations.

    ``origin`` tells them apart; the margin is that of the plan, and ``region_id`` is
    null for a remediation.
    """
    made = exports.select("plan_id", F.col("plan_revision").alias("revision"))
    own = _active(regions).join(made, ["plan_id", "revision"]).select(
        "plan_id", "region_id", "detection_type", "bbox", F.lit("plan").alias("origin")
    )
    later = remediated_detections(plans, regions, found, exports).select(
        "plan_id", F.lit(None).cast("string").alias("region_id"), "detection_type", "bbox", F.lit("remediation").alias("origin")
    )
    margins = plans.select("plan_id", "redaction_margin")
    painted = own.unionByName(later).join(margins, _KEY)
    return redaction_rectangles(painted, plans, _KEY, F.col("redaction_margin")).drop("redaction_margin")


def export_sessions(
    pages: DataFrame,
    plans: DataFrame,
    expected: DataFrame,
    page_exports: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    """Document results of the sessions that pass the export gate.

    ``pages``, ``plans`` and ``expected`` feed the gate; ``page_exports`` has
    one result per ``session_id, page_number``.  A page without a result of its
    current plan was not verified: it counts among the pages, and its session does not
    pass.  ``missing_page_count`` says how many there are.
    """
    key = ["session_id", "page_number"]
    gate = export_gate(pages, plans, expected)
    allowed = exportable_sessions(pages, gate, expected)
    wanted = pages.select(*key).distinct().join(allowed, "session_id", "left_semi")
    current = plans.select(*key, F.col("revision").alias("plan_revision"))
    results = page_exports.join(current, [*key, "plan_revision"], "left_semi")
    every = wanted.join(results, key, "left")
    missing = every.groupBy("session_id").agg(F.count_if(F.col("plan_revision").isNull()).alias("missing_page_count"))
    return document_export(every, documents).join(missing, "session_id")
