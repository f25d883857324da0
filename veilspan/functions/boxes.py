"""Column functions over pixel boxes ``struct<x1,y1,x2,y2:int>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, let_sql
from veilspan.schemas import BBOX


def _col(value: Column | str | int | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def make_bbox(x1, y1, x2, y2) -> Column:
    return F.struct(
        *(
            _col(v).cast("int").alias(name)
            for name, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))
        )
    )


def bbox_width(box) -> Column:
    box = _col(box)
    return box["x2"] - box["x1"]


def bbox_height(box) -> Column:
    box = _col(box)
    return box["y2"] - box["y1"]


def bbox_is_valid(box) -> Column:
    """Non-negative origin and positive extent; false when anything is null."""
    box = _col(box)
    return F.coalesce(
        (box["x1"] >= 0)
        & (box["y1"] >= 0)
        & (box["x2"] > box["x1"])
        & (box["y2"] > box["y1"]),
        F.lit(False),
    )


def span_length(start, end) -> Column:
    return _col(end) - _col(start)


def span_is_valid(start, end) -> Column:
    start, end = _col(start), _col(end)
    return F.coalesce((start >= 0) & (end > start), F.lit(False))


def confidence_is_valid(confidence) -> Column:
    return F.coalesce(_col(confidence).between(0.0, 1.0), F.lit(False))


def require(condition: Column, value: Column, message: str) -> Column:
    """Strict mode: fail the job on the first row that breaks a rule."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def _clamped(x1, y1, x2, y2, width, height) -> Column:
    return make_bbox(
        F.greatest(F.lit(0), x1.cast("int")),
        F.greatest(F.lit(0), y1.cast("int")),
        F.least(_col(width), x2.cast("int")),
        F.least(_col(height), y2.cast("int")),
    )


def expand_bbox(box, margin, width, height) -> Column:
    """Grow by ``margin`` and clamp to the image; null when nothing is left.

    Null also stands for a negative margin or an empty image, which the
    validity rules report separately.
    """
    box, margin = _col(box), _col(margin)
    grown = _clamped(
        box["x1"] - margin,
        box["y1"] - margin,
        box["x2"] + margin,
        box["y2"] + margin,
        width,
        height,
    )
    usable = (margin >= 0) & (_col(width) > 0) & (_col(height) > 0)
    return let(grown, lambda g: F.when(usable & bbox_is_valid(g), g))


def expand_face_bbox(
    x, y, w, h, width, height, horizontal: float = 0.25, vertical: float = 0.30
) -> Column:
    """Grow a float face box by a share of its size, outwards-rounded."""
    x, y, w, h = (_col(v).cast("double") for v in (x, y, w, h))
    return _clamped(
        F.floor(x - w * horizontal),
        F.floor(y - h * vertical),
        F.ceil(x + w + w * horizontal),
        F.ceil(y + h + h * vertical),
        width,
        height,
    )


def rotate_bbox_back(box, rotation, width, height) -> Column:
    """Undo a clockwise rotation of 0/90/180/270; null for other angles.

    ``width`` and ``height`` describe the unrotated image.
    """
    box, rotation = _col(box), _col(rotation)
    width, height = _col(width), _col(height)
    turned = (
        F.when(
            rotation == 90,
            make_bbox(box["y1"], height - box["x2"], box["y2"], height - box["x1"]),
        )
        .when(
            rotation == 180,
            make_bbox(
                width - box["x2"],
                height - box["y2"],
                width - box["x1"],
                height - box["y1"],
            ),
        )
        .when(
            rotation == 270,
            make_bbox(width - box["y2"], box["x1"], width - box["y1"], box["x2"]),
        )
    )
    return F.when(rotation == 0, box).otherwise(
        let(
            turned,
            lambda t: F.when(
                t.isNotNull(),
                _clamped(t["x1"], t["y1"], t["x2"], t["y2"], width, height),
            ),
        )
    )


def expand_signature_bbox(
    box, width, height, horizontal: float = 0.10, vertical: float = 0.20
) -> Column:
    box = _col(box)
    dx, dy = bbox_width(box) * horizontal, bbox_height(box) * vertical
    return _clamped(
        F.floor(box["x1"] - dx),
        F.floor(box["y1"] - dy),
        F.ceil(box["x2"] + dx),
        F.ceil(box["y2"] + dy),
        width,
        height,
    )


def clean_raw_bbox(x1, y1, x2, y2, width, height) -> Column:
    """Outwards-rounded and clamped detector box; null when degenerate."""
    x1, y1, x2, y2 = (_col(v).cast("double") for v in (x1, y1, x2, y2))
    box = _clamped(F.floor(x1), F.floor(y1), F.ceil(x2), F.ceil(y2), width, height)
    return let(
        box, lambda b: F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b)
    )


def boxes_intersect(a, b) -> Column:
    """Strict overlap: boxes that merely touch do not intersect."""
    a, b = _col(a), _col(b)
    return (
        (a["x1"] < b["x2"])
        & (b["x1"] < a["x2"])
        & (a["y1"] < b["y2"])
        & (b["y1"] < a["y2"])
    )


def spans_overlap(start_a, end_a, start_b, end_b) -> Column:
    return (_col(start_a) < _col(end_b)) & (_col(start_b) < _col(end_a))


def union_bbox(a, b) -> Column:
    a, b = _col(a), _col(b)
    return make_bbox(
        F.least(a["x1"], b["x1"]),
        F.least(a["y1"], b["y1"]),
        F.greatest(a["x2"], b["x2"]),
        F.greatest(a["y2"], b["y2"]),
    )


def enclosing_bbox(boxes: Column) -> Column:
    """Smallest box around all boxes of an array; null for an empty array."""
    enclosed = make_bbox(
        F.array_min(F.transform(boxes, lambda b: b["x1"])),
        F.array_min(F.transform(boxes, lambda b: b["y1"])),
        F.array_max(F.transform(boxes, lambda b: b["x2"])),
        F.array_max(F.transform(boxes, lambda b: b["y2"])),
    )
    return F.when(F.size(boxes) > 0, enclosed)


def _iou_sql(a: str, b: str) -> str:
    width = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    height = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    inter = f"(cast({width} AS bigint) * {height})"
    areas = " + ".join(
        f"cast({r}.x2 - {r}.x1 AS bigint) * ({r}.y2 - {r}.y1)" for r in (a, b)
    )
    return (
        f"CASE WHEN {width} <= 0 OR {height} <= 0 THEN 0.0D"
        f" ELSE {inter} / ({areas} - {inter}) END"
    )


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box columns; 0 for disjoint boxes."""
    return F.expr(_iou_sql(a, b))


def greedy_merge(boxes: str, threshold: float) -> Column:
    """Merge ``array<struct<confidence,idx,bbox>>`` by overlap, best score first.

    Each box joins the first cluster whose box it overlaps enough; the cluster
    then grows to cover it.  The outcome depends on the order, so ties in the
    score are settled by ``idx``.  ``boxes`` is an SQL expression.
    """
    ordered = (
        f"transform(array_sort(transform({boxes}, b -> named_struct("
        "'rank', -b.confidence, 'idx', b.idx, 'bbox', b.bbox))),"
        " b -> named_struct('bbox', b.bbox, 'confidence', -b.rank))"
    )
    grown = (
        "named_struct('bbox', named_struct("
        "'x1', least(c.bbox.x1, box.bbox.x1), 'y1', least(c.bbox.y1, box.bbox.y1),"
        " 'x2', greatest(c.bbox.x2, box.bbox.x2), 'y2', greatest(c.bbox.y2, box.bbox.y2)),"
        " 'confidence', greatest(c.confidence, box.confidence))"
    )
    position = (
        f"cast(array_position(transform(clusters, c -> {_iou_sql('box.bbox', 'c.bbox')}"
        f" >= {threshold!r}D), true) AS int)"
    )
    placed = let_sql(
        position,
        lambda hit: f"CASE WHEN {hit} = 0 THEN concat(clusters, array(box)) ELSE"
        f" transform(clusters, (c, i) -> CASE WHEN i + 1 = {hit} THEN {grown} ELSE c END) END",
    )
    return F.expr(
        f"aggregate({ordered}, cast(array() AS array<struct<bbox:{BBOX},confidence:double>>),"
        f" (clusters, box) -> {placed})"
    )


# --- geometry edits of the review screen ------------------------------------


def _round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def _clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, _col(low)), _col(high))


def translate_bbox(box, dx, dy, width, height) -> Column:
    """Move a box, keeping its size and keeping it inside the image."""
    box = _col(box)
    w, h = bbox_width(box), bbox_height(box)
    x1 = _clamp(_round_half_up(box["x1"] + _col(dx)), 0, _col(width) - w)
    y1 = _clamp(_round_half_up(box["y1"] + _col(dy)), 0, _col(height) - h)
    return make_bbox(x1, y1, x1 + w, y1 + h)


def resize_bbox(box, handle, x, y, width, height, minimum: int = 2) -> Column:
    """Drag one corner (nw, ne, se, sw) to a point, keeping a minimum size."""
    box, handle = _col(box), _col(handle)
    px = _clamp(_round_half_up(_col(x)), 0, width)
    py = _clamp(_round_half_up(_col(y)), 0, height)
    left, top = handle.isin("nw", "sw"), handle.isin("nw", "ne")
    return make_bbox(
        F.when(left, _clamp(px, 0, box["x2"] - minimum)).otherwise(box["x1"]),
        F.when(top, _clamp(py, 0, box["y2"] - minimum)).otherwise(box["y1"]),
        F.when(left, box["x2"]).otherwise(_clamp(px, box["x1"] + minimum, width)),
        F.when(top, box["y2"]).otherwise(_clamp(py, box["y1"] + minimum, height)),
    )


def normalize_drag(x_start, y_start, x_end, y_end, width, height) -> Column:
    """Outwards-rounded box spanned by a drag between two points."""
    xs, ys, xe, ye = (_col(v) for v in (x_start, y_start, x_end, y_end))
    return make_bbox(
        _clamp(F.floor(F.least(xs, xe)), 0, width),
        _clamp(F.floor(F.least(ys, ye)), 0, height),
        _clamp(F.ceil(F.greatest(xs, xe)), 0, width),
        _clamp(F.ceil(F.greatest(ys, ye)), 0, height),
    )


def client_point_to_image(client, origin, extent, image_extent) -> Column:
    """One screen coordinate in image pixels; null for an empty canvas."""
    scaled = (_col(client) - _col(origin)) / _col(extent) * _col(image_extent)
    return F.when(_col(extent) > 0, _clamp(scaled, 0.0, _col(image_extent)))


def bbox_is_usable(box, minimum: int = 2) -> Column:
    return (bbox_width(box) >= minimum) & (bbox_height(box) >= minimum)


def bbox_is_within(box, width, height) -> Column:
    box = _col(box)
    return (
        bbox_is_valid(box) & (box["x2"] <= _col(width)) & (box["y2"] <= _col(height))
    )
