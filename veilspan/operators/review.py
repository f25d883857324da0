"""Human review: plans, revisions, override rules and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan import schemas as S
from veilspan.functions.boxes import (
    bbox_is_valid,
    bbox_is_within,
    boxes_intersect,
    confidence_is_valid,
    expand_bbox,
)
from veilspan.functions.paths import SHA256
from veilspan.functions.text import strip
from veilspan.operators.detections import explode_rows

# --- fixed values -----------------------------------------------------------
DETECTION_LABELS = {
    "tckn": "Identity number",
    "phone": "Phone number",
    "email": "Email address",
    "person": "Person name",
    "address": "Postal address",
    "face": "Face",
    "signature": "Signature",
}
MANUAL_LABEL = "Manual privacy region"
OTHER_LABEL = "Detection"
# status -> (eyebrow, title, description, tone, download label)
STATUS_PRESENTATION = {
    "passed": (
        "Verification complete",
        "Configured detectors are clear",
        "The exported pixels were scanned again and no remaining detections were found. "
        "This is not a legal guarantee that every sensitive item was identified.",
        "clear",
        "Download reviewed output",
    ),
    "verified_with_human_overrides": (
        "Human override recorded",
        "Detectors are clear, with overrides",
        "The exported pixels scanned clear, but one or more automatic regions were deliberately "
        "kept visible. Review those decisions before sharing the output.",
        "caution",
        "Download output with overrides",
    ),
    "review_required": (
        "Further review required",
        "Detections remain in the output",
        "The verifier still found sensitive regions after export. This artifact must not be "
        "represented or shared as verified safe output.",
        "danger",
        "Download review artifact",
    ),
}
# ----------------------------------------------------------------------------

# Side of the tiles that box intersection joins meet in, in pixels.
TILE = 512

REGION_COLUMNS = (
    "region_id",
    "bbox",
    "provenance",
    "action",
    "detection_type",
    "confidence",
    "geometry_modified",
)


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds."""
    return F.array_compact(
        F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items()))
    )


def _is_null_or_blank(value: str) -> Column:
    return F.col(value).isNull() | (strip(value) == "")


# --- validation -------------------------------------------------------------


def region_violations(regions: DataFrame, plans: DataFrame) -> DataFrame:
    """Broken region rules, one row per (plan, revision, region, rule)."""
    key = ["plan_id", "revision"]
    sized = regions.join(plans.select(*key, "image_width", "image_height"), key)
    automatic = F.col("provenance") == "automatic"
    manual = F.col("provenance") == "manual"
    rules = {
        "blank_region_id": _is_null_or_blank("region_id"),
        "unknown_provenance": ~F.coalesce(
            F.col("provenance").isin(*S.PROVENANCES), F.lit(False)
        ),
        "unknown_action": ~F.coalesce(F.col("action").isin(*S.ACTIONS), F.lit(False)),
        "unknown_type": F.col("detection_type").isNotNull()
        & ~F.col("detection_type").isin(*S.DETECTION_TYPES),
        "automatic_without_type_or_confidence": automatic
        & (F.col("detection_type").isNull() | F.col("confidence").isNull()),
        "manual_with_confidence": manual & F.col("confidence").isNotNull(),
        "manual_geometry_modified": manual & F.col("geometry_modified"),
        "confidence_out_of_range": F.col("confidence").isNotNull()
        & ~confidence_is_valid("confidence"),
        "invalid_box": ~bbox_is_valid("bbox"),
        "outside_image": bbox_is_valid("bbox")
        & ~bbox_is_within("bbox", F.col("image_width"), F.col("image_height")),
    }
    found = explode_rows(sized, [*key, "region_id"], _broken(rules))
    return found.withColumnRenamed("d", "rule")


def plan_violations(plans: DataFrame) -> DataFrame:
    rules = {
        "blank_plan_id": _is_null_or_blank("plan_id"),
        "negative_revision": F.col("revision") < 0,
        "bad_fingerprint": ~F.coalesce(F.lower("source_sha256").rlike(SHA256), F.lit(False)),
        "empty_image": (F.col("image_width") <= 0) | (F.col("image_height") <= 0),
        "negative_margin": F.col("redaction_margin") < 0,
        "no_pass_allowed": F.col("max_redaction_passes") < 1,
    }
    found = explode_rows(plans, ["plan_id", "revision"], _broken(rules))
    return found.withColumnRenamed("d", "rule")


def source_mismatches(plans: DataFrame, files: DataFrame) -> DataFrame:
    """Plans whose bound source is not the given file.

    ``files`` holds ``plan_id, source_sha256, image_width, image_height`` of
    what is about to be used; a plan whose file is missing is a mismatch.
    """
    bound = ("source_sha256", "image_width", "image_height")
    now = files.select("plan_id", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in bound))
    same = F.col("_there").isNotNull()
    for column in bound:
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return plans.join(now, "plan_id", "left").filter(~same).select("plan_id", "revision")


# --- revisions --------------------------------------------------------------


def _requests(
    decisions: DataFrame, geometry_updates: DataFrame, manual_regions: DataFrame
) -> DataFrame:
    """All change requests in one table, by ``kind``."""
    columns = ("plan_id", "expected_revision")
    no_box = F.lit(None).cast(S.BBOX).alias("bbox")
    no_text = F.lit(None).cast("string")
    return (
        decisions.select(
            *columns, F.lit("decision").alias("kind"), "region_id", no_box, F.col("action").alias("action"), no_text.alias("detection_type")
        )
        .unionByName(
            geometry_updates.select(
                *columns, F.lit("geometry_update").alias("kind"), "region_id", F.col("bbox").cast(S.BBOX).alias("bbox"), no_text.alias("action"), no_text.alias("detection_type")
            )
        )
        .unionByName(
            manual_regions.select(
                *columns, F.lit("manual").alias("kind"), no_text.alias("region_id"), F.col("bbox").cast(S.BBOX).alias("bbox"), no_text.alias("action"), "detection_type"
            )
        )
    )


def _judged_requests(
    plans: DataFrame,
    regions: DataFrame,
    decisions: DataFrame,
    geometry_updates: DataFrame,
    manual_regions: DataFrame,
) -> DataFrame:
    """The requests with what is wrong about each, ``broken`` as an array of reasons.

    A requested box, type or action has to follow the rules of the regions it
    becomes; see ``region_violations``.
    """
    current = plans.select("plan_id", "revision", "image_width", "image_height")
    known = (
        regions.join(plans.select("plan_id", "revision"), ["plan_id", "revision"], "left_semi")
        .groupBy("plan_id", "region_id")
        .agg(F.count("*").alias("_known"))
    )
    same = W.partitionBy("plan_id", "kind", "region_id")
    asked = (
        _requests(decisions, geometry_updates, manual_regions)
        .withColumn("_times", F.count("*").over(same))
        .join(current, "plan_id", "left")
        .join(known, ["plan_id", "region_id"], "left")
    )
    boxed, named = F.col("kind") != "decision", F.col("kind") != "manual"
    for_plan = {
        "unknown_plan": F.col("revision").isNull(),
        "stale_revision": F.col("revision").isNotNull()
        & ~F.col("expected_revision").eqNullSafe(F.col("revision")),
    }
    for_region = {
        **{
            f"{word}_{kind}{end}": (F.col("kind") == kind) & condition
            for kind in ("decision", "geometry_update")
            for word, end, condition in (
                ("duplicate", "", F.col("_times") > 1),
                ("unknown", "_region", F.col("_known").isNull()),
            )
        },
        "ambiguous_region": named & (F.coalesce("_known", F.lit(0)) > 1),
        "unknown_action": ~boxed & ~F.coalesce(F.col("action").isin(*S.ACTIONS), F.lit(False)),
        "unknown_type": F.col("detection_type").isNotNull()
        & ~F.col("detection_type").isin(*S.DETECTION_TYPES),
        "invalid_box": boxed & ~bbox_is_valid("bbox"),
        "outside_image": boxed
        & bbox_is_valid("bbox")
        & ~F.coalesce(bbox_is_within("bbox", F.col("image_width"), F.col("image_height")), F.lit(True)),
    }
    return asked.withColumn("_plan_reasons", _broken(for_plan)).withColumn(
        "_region_reasons", _broken(for_region)
    )


def revision_violations(
    plans: DataFrame,
    regions: DataFrame,
    decisions: DataFrame,
    geometry_updates: DataFrame,
    manual_regions: DataFrame,
) -> DataFrame:
    """Why change requests cannot be applied to the current plans.

    Columns ``plan_id, region_id, reason``; ``region_id`` is null for a stale
    revision or an unknown plan, which concern the request as a whole, and for
    what is wrong with a manual region.
    """
    asked = _judged_requests(plans, regions, decisions, geometry_updates, manual_regions)
    none = F.lit(None).cast("string")
    reasons = F.concat(
        F.transform("_plan_reasons", lambda r: F.struct(none.alias("region_id"), r.alias("reason"))),
        F.transform("_region_reasons", lambda r: F.struct(F.col("region_id"), r.alias("reason"))),
    )
    found = explode_rows(asked, ["plan_id"], reasons)
    return found.select("plan_id", "d.region_id", "d.reason").distinct()


def revise_plans(
    plans: DataFrame,
    regions: DataFrame,
    decisions: DataFrame,
    geometry_updates: DataFrame,
    manual_regions: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Next revision of every plan with a valid request: ``(plans, regions)``.

    ``plans`` and ``regions`` hold the current revision of each plan.  Requests
    with any violation are left out as a whole.  ``manual_regions`` carries a
    ``request_no`` that tells equal requests of one plan apart.
    """
    asked = _judged_requests(plans, regions, decisions, geometry_updates, manual_regions)
    clean = (F.size("_plan_reasons") == 0) & (F.size("_region_reasons") == 0)
    accepted = (
        asked.groupBy("plan_id", "revision")
        .agg(F.bool_and(clean).alias("_clean"))
        .filter("_clean")
        .select("plan_id", "revision")
    )
    next_plans = plans.join(accepted, ["plan_id", "revision"], "left_semi").withColumn(
        "revision", F.col("revision") + 1
    )
    # A region has at most one decision and one move here, as others are refused.
    changes = decisions.select("plan_id", "region_id", F.col("action").alias("_action"))
    moves = geometry_updates.select("plan_id", "region_id", F.col("bbox").alias("_bbox"))
    moved = (
        (F.col("provenance") == "automatic")
        & F.col("_bbox").isNotNull()
        & ~F.col("_bbox").eqNullSafe(F.col("bbox"))
    )
    revised = (
        regions.join(accepted, ["plan_id", "revision"], "left_semi")
        .join(changes, ["plan_id", "region_id"], "left")
        .join(moves, ["plan_id", "region_id"], "left")
        .select(
            "plan_id",
            (F.col("revision") + 1).alias("revision"),
            "region_id",
            F.coalesce("_bbox", "bbox").alias("bbox"),
            "provenance",
            F.coalesce("_action", "action").alias("action"),
            "detection_type",
            "confidence",
            (F.col("geometry_modified") | moved).alias("geometry_modified"),
        )
    )
    name = F.sha2(F.concat_ws("|", "plan_id", "expected_revision", "request_no"), 256)
    added = manual_regions.join(accepted.select("plan_id"), "plan_id", "left_semi").select(
        "plan_id",
        (F.col("expected_revision") + 1).alias("revision"),
        F.concat(F.lit("manual-"), F.substring(name, 1, 32)).alias("region_id"),
        "bbox",
        F.lit("manual").alias("provenance"),
        F.lit("retain").alias("action"),
        "detection_type",
        F.lit(None).cast("double").alias("confidence"),
        F.lit(False).alias("geometry_modified"),
    )
    return next_plans, revised.unionByName(added)


# --- counts, overrides and status -------------------------------------------


def plan_counts(
    regions: DataFrame, keys: Sequence[str] = ("plan_id", "revision")
) -> DataFrame:
    automatic = F.col("provenance") == "automatic"
    active = F.col("action") == "retain"
    return regions.groupBy(*keys).agg(
        F.count_if(active).alias("active_region_count"),
        F.count_if(automatic & ~active).alias("automatic_removal_count"),
        F.count_if(automatic & F.col("geometry_modified")).alias(
            "automatic_geometry_adjustment_count"
        ),
        F.count_if(active & ~automatic).alias("manual_addition_count"),
    )


def _tiles(box: Column) -> list[Column]:
    def side(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / TILE), F.floor((high - 1) / TILE)))

    return [side(box["x1"], box["x2"]), side(box["y1"], box["y2"])]


def _tiled(df: DataFrame, box: str) -> DataFrame:
    across, down = _tiles(F.col(box))
    return df.withColumn("_tx", across).withColumn("_ty", down)


def blocked_by_removal(
    detections: DataFrame, regions: DataFrame, plans: DataFrame
) -> DataFrame:
    """Distinct ``(plan_id, detection_type, bbox)`` a reviewer chose to keep visible.

    A detection is blocked when it meets the scope of a removed automatic
    region of its type, that is the region's box grown by the plan's margin.
    Boxes meet per image tile, so the semi join has equality keys and never
    lists pairs.
    """
    removed = regions.filter(
        (F.col("provenance") == "automatic") & (F.col("action") == "remove")
    )
    scopes = (
        removed.join(
            plans.select(
                "plan_id", "revision", "image_width", "image_height", "redaction_margin"
            ),
            ["plan_id", "revision"],
        )
        .select(
            "plan_id",
            "detection_type",
            expand_bbox(
                "bbox", F.col("redaction_margin"), "image_width", "image_height"
            ).alias("scope"),
        )
        .filter(F.col("scope").isNotNull())
        .distinct()
    )
    identity = ["plan_id", "detection_type", "bbox"]
    left = _tiled(detections.select(*identity).distinct(), "bbox").alias("d")
    right = _tiled(scopes, "scope").alias("s")
    on = (
        (F.col("d.plan_id") == F.col("s.plan_id"))
        & (F.col("d.detection_type") == F.col("s.detection_type"))
        & (F.col("d._tx") == F.col("s._tx"))
        & (F.col("d._ty") == F.col("s._ty"))
        & boxes_intersect("d.bbox", "s.scope")
    )
    return left.join(right, on, "left_semi").select(*identity).distinct()


def page_status(clear: Column | str, removals: Column | str, moves: Column | str) -> Column:
    clear, removals, moves = (
        F.col(c) if isinstance(c, str) else c for c in (clear, removals, moves)
    )
    # what is not known to be clear was not verified
    return (
        F.when(~F.coalesce(clear & removals.isNotNull() & moves.isNotNull(), F.lit(False)), "review_required")
        .when((removals > 0) | (moves > 0), "verified_with_human_overrides")
        .otherwise("passed")
    )


def document_export(
    pages: DataFrame, documents: DataFrame, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Document-level export result from page results.

    ``documents`` gives ``text_layer_empty`` (null for plain images); only an
    explicit false demands a review.  A page without a verdict, without a status or
    with detections left was not verified, and neither was its document.  Lists stay
    rows: see ``plans.review.export_detections_by_page``.
    """
    keys = list(keys)
    overridden = F.col("status") == "verified_with_human_overrides"
    clear = F.col("detectors_clear") & (F.col("remaining_count") == 0) & F.col("status").isin("passed", "verified_with_human_overrides")
    rolled = pages.groupBy(*keys).agg(
        F.count("*").alias("page_count"),
        F.bool_and(F.coalesce(clear, F.lit(False))).alias("detectors_clear"),
        F.bool_or(overridden).alias("_overridden"),
        F.max("plan_revision").alias("plan_revision"),
        *(
            F.sum(c).alias(c)
            for c in (
                "redaction_passes",
                "automatic_removal_count",
                "automatic_geometry_adjustment_count",
                "manual_addition_count",
                "applied_region_count",
                "remaining_count",
            )
        ),
    )
    status = (
        F.when(
            ~F.col("detectors_clear") | (F.col("text_layer_empty") == F.lit(False)),
            "review_required",
        )
        .when(F.col("_overridden"), "verified_with_human_overrides")
        .otherwise("passed")
    )
    return (
        rolled.join(documents.select(*keys, "text_layer_empty"), keys, "left")
        .withColumn("status", status)
        .withColumn("passed", F.col("status") == "passed")
        .drop("_overridden")
    )


# --- sessions ---------------------------------------------------------------


def current_plans(plan_log: DataFrame) -> DataFrame:
    """Latest plan entry per page of a ``session_id, page_number, seq, revision`` log."""
    return plan_log.groupBy("session_id", "page_number").agg(
        F.max_by("revision", "seq").alias("revision"), F.max("seq").alias("seq")
    )


def session_states(pages: DataFrame, plan_log: DataFrame, exports: DataFrame) -> DataFrame:
    """uploaded, analyzed or exported; later plan changes void an export.

    An export entry of a session without a plan does not count.
    """
    planned = plan_log.groupBy("session_id").agg(F.max("seq").alias("_planned"))
    exported = exports.groupBy("session_id").agg(F.max("seq").alias("_exported"))
    state = (
        F.when(
            F.col("_exported") > F.col("_planned"),
            "exported",
        )
        .when(F.col("_planned").isNotNull(), "analyzed")
        .otherwise("uploaded")
    )
    return (
        pages.groupBy("session_id")
        .agg(F.count_distinct("page_number").alias("page_count"))
        .join(planned, "session_id", "left")
        .join(exported, "session_id", "left")
        .select("session_id", "page_count", state.alias("state"))
    )


def export_gate(pages: DataFrame, plans: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages that forbid an export: ``session_id, page_number, reason``.

    The expected revisions must name exactly the pages of the session, each of
    them once, every page must be analysed, and its revision must be the current one.
    """
    key = ["session_id", "page_number"]
    have = pages.select(*key, F.lit(True).alias("_page")).join(
        plans.select(*key, "revision"), key, "left"
    )
    want = expected.groupBy(*key).agg(
        F.max("revision").alias("_expected"), F.count("*").alias("_times")
    )
    reason = (
        F.when(F.col("_page").isNull(), "unknown_page")
        .when(F.col("_times") > 1, "duplicate_page")
        .when(F.col("_expected").isNull(), "missing_page")
        .when(F.col("revision").isNull(), "not_analyzed")
        .when(F.col("revision") != F.col("_expected"), "stale_revision")
    )
    return (
        have.join(want, key, "full_outer")
        .select(*key, reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def exportable_sessions(pages: DataFrame, gate: DataFrame, expected: DataFrame) -> DataFrame:
    """Sessions that were asked for and that nothing forbids to export."""
    asked = pages.select("session_id").distinct().join(
        expected.select("session_id").distinct(), "session_id", "left_semi"
    )
    return asked.join(gate.select("session_id"), "session_id", "left_anti")


def delete_sessions(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows of a review table without those of deleted sessions."""
    return table.join(deleted.select("session_id"), "session_id", "left_anti")


# --- labels -----------------------------------------------------------------


def region_label(detection_type: Column | str, provenance: Column | str) -> Column:
    kind = F.col(detection_type) if isinstance(detection_type, str) else detection_type
    origin = F.col(provenance) if isinstance(provenance, str) else provenance
    labels = F.create_map(*(F.lit(v) for pair in DETECTION_LABELS.items() for v in pair))
    return F.when(kind.isNotNull(), labels[kind]).otherwise(
        F.when(origin == "manual", MANUAL_LABEL).otherwise(OTHER_LABEL)
    )


def status_presentation(status: Column | str) -> Column:
    """``struct<eyebrow,title,description,tone,download_label>`` for a status."""
    value = F.col(status) if isinstance(status, str) else status
    fields = ("eyebrow", "title", "description", "tone", "download_label")
    shown = [
        F.create_map(
            *(F.lit(v) for key, row in STATUS_PRESENTATION.items() for v in (key, row[i]))
        )[value].alias(field)
        for i, field in enumerate(fields)
    ]
    return F.struct(*shown)
