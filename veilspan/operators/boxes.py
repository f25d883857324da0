"""Detector boxes: clean-up, overlap merging, redaction rectangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan import schemas as S
from veilspan.functions.boxes import (
    clean_raw_bbox,
    expand_bbox,
    expand_face_bbox,
    expand_signature_bbox,
    greedy_merge,
    rotate_bbox_back,
)
from veilspan.operators.detections import explode_rows
from veilspan.operators.scan import dense_position, islands


def top_boxes(
    raw: DataFrame, keys: Sequence[str], k: int = S.FACE_TOP_K, salts: int = 64
) -> DataFrame:
    """The ``k`` best-scored boxes per image and rotation, as the detector keeps.

    Ranked in two steps, so that the last one sees ``salts * k`` boxes at most.
    """
    groups = [*keys, "rotation"]

    def best(df: DataFrame, *by: str) -> DataFrame:
        ranked = W.partitionBy(*by).orderBy(F.desc("score"), "idx")
        return (
            df.withColumn("_rank", F.row_number().over(ranked))
            .filter(F.col("_rank") <= k)
            .drop("_rank")
        )

    salted = raw.withColumn("_salt", F.pmod(F.hash("idx"), F.lit(salts)))
    return best(best(salted, *groups, "_salt").drop("_salt"), *groups)


def face_boxes(
    raw: DataFrame,
    keys: Sequence[str],
    threshold: float = S.SCORE_THRESHOLDS["face"],
    iou: float = S.FACE_IOU,
    top_k: int = S.FACE_TOP_K,
) -> DataFrame:
    """Raw face boxes of all rotations as merged detections.

    Input: keys, ``rotation``, ``idx``, ``x``, ``y``, ``w``, ``h``, ``score``,
    ``image_width`` and ``image_height`` of the unrotated image.
    """
    turned = F.col("rotation").isin(90, 270)
    grown = expand_face_bbox(
        "x", "y", "w", "h",
        F.when(turned, F.col("image_height")).otherwise(F.col("image_width")),
        F.when(turned, F.col("image_width")).otherwise(F.col("image_height")),
    )

    placed = top_boxes(raw.filter(F.col("score") >= threshold), keys, top_k).select(
        *keys,
        F.struct("rotation", "idx").alias("idx"),
        F.col("score").alias("confidence"),
        rotate_bbox_back(grown, "rotation", "image_width", "image_height").alias("bbox"),
    )
    return merge_boxes(placed, keys, iou, "face")


def signature_boxes(
    raw: DataFrame,
    keys: Sequence[str],
    threshold: float = S.SCORE_THRESHOLDS["signature"],
    iou: float = S.SIGNATURE_IOU,
) -> DataFrame:
    """Raw signature boxes (corner, extent) as merged detections."""
    size = (F.col("image_width"), F.col("image_height"))
    cleaned = clean_raw_bbox(
        "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"), *size
    )
    boxes = (
        raw.filter(F.col("score") >= threshold)
        .withColumn("_box", cleaned)
        .filter(F.col("_box").isNotNull())
        .select(
            *keys,
            "idx",
            F.col("score").alias("confidence"),
            expand_signature_bbox("_box", *size).alias("bbox"),
        )
    )
    return merge_boxes(boxes, keys, iou, "signature")


def merge_boxes(
    boxes: DataFrame, keys: Sequence[str], iou: float, detection_type: str
) -> DataFrame:
    """Greedy overlap merge per image.

    The merge depends on its order and must see all boxes that may influence each other.
    Every image is cut into bands that no box spans: boxes of different bands never
    influence each other, so each band is folded in a row of its own.
    """
    banded = islands(
        boxes.withColumn("_top", F.col("bbox.y1").cast("long")).withColumn(
            "_bottom", F.col("bbox.y2").cast("long")
        ),
        keys,
        "_top",
        "_bottom",
        "_band",
        touching=False,
    )
    merged = banded.groupBy(*keys, "_band").agg(
        greedy_merge(
            "collect_list(named_struct('confidence', confidence, 'idx', idx, 'bbox', bbox))", iou
        ).alias("m")
    )
    return explode_rows(merged, keys, F.col("m")).select(
        *keys,
        F.lit(detection_type).alias("detection_type"),
        "d.bbox",
        "d.confidence",
    )


def image_detections(
    text: DataFrame,
    faces: DataFrame | None,
    signatures: DataFrame | None,
    keys: Sequence[str],
) -> DataFrame:
    """Union of all detectors; text hits arrive deduplicated, boxes stay as are."""
    columns = [*keys, "detection_type", "bbox", "confidence"]
    result = text.select(*columns)
    for other in (faces, signatures):
        if other is not None:
            result = result.unionByName(other.select(*columns))
    return result


def redaction_rectangles(
    detections: DataFrame,
    pages: DataFrame,
    keys: Sequence[str],
    margin: Column | int = S.DEFAULT_MARGIN,
) -> DataFrame:
    """Black rectangle per detection: grown by the margin, cut at the border.

    The fill includes the right and lower edge, hence the covered area.
    ``valid`` is false where a box lies outside the image, or where the size of
    the image is not known.
    """
    sized = detections.join(
        pages.select(*keys, "image_width", "image_height"), list(keys), "left"
    )
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    rect = expand_bbox("bbox", margin, "image_width", "image_height")
    out = sized.withColumn("rect", rect)
    width = F.least(F.col("image_width") - 1, F.col("rect.x2")) - F.col("rect.x1") + 1
    height = F.least(F.col("image_height") - 1, F.col("rect.y2")) - F.col("rect.y1") + 1
    return out.withColumn("valid", F.col("rect").isNotNull()).withColumn(
        "covered", width.cast("long") * height
    )


def number_regions(
    detections: DataFrame, keys: Sequence[str], order: str, name: str = "region_id"
) -> DataFrame:
    """``auto-0001``, ``auto-0002``, .. in the order of a unique whole number."""
    placed = dense_position(detections, keys, order, "_position")
    return placed.withColumn(
        name, F.format_string("auto-%04d", F.col("_position") + 1)
    ).drop("_position")
