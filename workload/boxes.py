"""Queries over detector boxes, rectangles, pixels and redaction passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import boxes as B
from veilspan.operators import boxes as O
from veilspan.operators import detections as D
from veilspan.operators.pixels import fill_rectangles
from veilspan.operators.passes import first_reports
from veilspan.plans import image as I
from workload.common import BOX_SQL, Derived, flat_box

PAGE = ["doc_id", "page_no"]

# Raw boxes of faces and signatures; a page has about twenty, in clusters.
RAW = Derived(
    "events",
    (
        (
            "user_id AS doc_id",
            "cast(event_id % 3 AS bigint) AS page_no",
            "CASE WHEN event_type IN ('click', 'view', 'error') THEN 'face' ELSE 'signature' END AS kind",
            "cast(90 * (event_id % 4) AS int) AS rotation",
            "event_id AS idx",
            "cast(((event_id * 37) % 5) * 120 + event_id % 23 AS double) + 0.25 AS x",
            "cast(((event_id * 91) % 4) * 150 + event_id % 19 AS double) + 0.5 AS y",
            "cast(40 + event_id % 60 AS double) AS w",
            "cast(50 + event_id % 50 AS double) AS h",
            "cast((event_id * 7919) % 1000 AS double) / 1000 AS score",
            "cast(1000 AS int) AS image_width",
            "cast(800 AS int) AS image_height",
        ),
    ),
)

# Pairs of whole-number boxes; some touch, some overlap, some are broken.
PAIRS = Derived(
    "events",
    (
        (
            "event_id",
            "cast(event_id % 60 AS int) AS ax1", "cast(event_id % 47 AS int) AS ay1",
            "cast(event_id % 60 + 5 + event_id % 31 AS int) AS ax2",
            "cast(event_id % 47 + event_id % 29 AS int) AS ay2",
            "cast((event_id * 7) % 60 AS int) AS bx1", "cast((event_id * 3) % 47 AS int) AS by1",
            "cast((event_id * 7) % 60 + 10 AS int) AS bx2", "cast((event_id * 3) % 47 + 12 AS int) AS by2",
            "cast(event_id % 13 - 2 AS int) AS margin",
            "cast(70 AS int) AS width", "cast(60 AS int) AS height",
            "cast(90 * (event_id % 4) AS int) AS rotation",
            "cast(event_id % 41 AS double) / 10 - 2 AS dx",
            "cast(event_id % 53 AS double) / 10 - 2.5 AS dy",
            "cast(event_id % 120 AS double) / 100 - 0.1 AS score",
        ),
    ),
)
P = PAIRS.sql()


def _pairs(spark, sf):
    df = PAIRS.df(spark, sf)
    return df.select(
        "*",
        B.make_bbox("ax1", "ay1", "ax2", "ay2").alias("a"),
        B.make_bbox("bx1", "by1", "bx2", "by2").alias("b"),
    )


def _long(expr, name):
    return expr.cast("long").alias(name)


def bbox_measures(spark, sf):
    return _pairs(spark, sf).select(
        "event_id",
        _long(B.bbox_width("a"), "width"),
        _long(B.bbox_height("a"), "height"),
        _long(B.span_length("ax1", "ax2"), "span_length"),
        B.bbox_is_valid("a").alias("valid"),
        B.span_is_valid("ay1", "ay2").alias("span_valid"),
        B.confidence_is_valid("score").alias("confidence_valid"),
        B.bbox_is_usable("a").alias("usable"),
        B.bbox_is_within("a", "width", "height").alias("within"),
    )


MEASURES_SQL = f"""
    SELECT event_id, cast(ax2 - ax1 AS bigint) AS width, cast(ay2 - ay1 AS bigint) AS height,
      cast(ax2 - ax1 AS bigint) AS span_length,
      ax1 >= 0 AND ay1 >= 0 AND ax2 > ax1 AND ay2 > ay1 AS valid, ay1 >= 0 AND ay2 > ay1 AS span_valid,
      score BETWEEN 0 AND 1 AS confidence_valid, ax2 - ax1 >= 2 AND ay2 - ay1 >= 2 AS usable,
      ax1 >= 0 AND ay1 >= 0 AND ax2 > ax1 AND ay2 > ay1 AND ax2 <= width AND ay2 <= height AS within
    FROM {P}"""


def expanded_boxes(spark, sf):
    df = _pairs(spark, sf).withColumn("g", B.expand_bbox("a", F.col("margin"), "width", "height"))
    return df.select("event_id", F.col("g").isNotNull().alias("ok"), *flat_box("g"))


EXPANDED_SQL = f"""
    SELECT event_id, ok, cast(CASE WHEN ok THEN x1 END AS bigint) AS x1, cast(CASE WHEN ok THEN y1 END AS bigint) AS y1,
      cast(CASE WHEN ok THEN x2 END AS bigint) AS x2, cast(CASE WHEN ok THEN y2 END AS bigint) AS y2
    FROM (SELECT *, margin >= 0 AND x2 > x1 AND y2 > y1 AS ok FROM (SELECT event_id, margin,
      greatest(0, ax1 - margin) AS x1, greatest(0, ay1 - margin) AS y1,
      least(width, ax2 + margin) AS x2, least(height, ay2 + margin) AS y2 FROM {P}) AS g) AS h"""


def overlaps(spark, sf):
    df = _pairs(spark, sf).filter(B.bbox_is_valid("a"))
    union = B.union_bbox("a", "b")
    return df.select(
        "event_id",
        B.boxes_intersect("a", "b").alias("intersect"),
        B.spans_overlap("ax1", "ax2", "bx1", "bx2").alias("spans_overlap"),
        F.round(B.iou("a", "b"), 9).alias("iou"),
        *(union[c].cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")),
    )


OVERLAPS_SQL = f"""
    SELECT event_id, iw > 0 AND ih > 0 AS intersect, iw > 0 AS spans_overlap,
      round(CASE WHEN iw > 0 AND ih > 0 THEN cast(iw * ih AS double)
        / ((ax2-ax1)*(ay2-ay1) + (bx2-bx1)*(by2-by1) - iw * ih) ELSE 0.0 END, 9)::double AS iou,
      cast(least(ax1,bx1) AS bigint) AS x1, cast(least(ay1,by1) AS bigint) AS y1,
      cast(greatest(ax2,bx2) AS bigint) AS x2, cast(greatest(ay2,by2) AS bigint) AS y2
    FROM (SELECT *, least(ax2,bx2) - greatest(ax1,bx1) AS iw, least(ay2,by2) - greatest(ay1,by1) AS ih
      FROM {P}) AS q WHERE ax2 > ax1 AND ay2 > ay1"""


def rotated_boxes(spark, sf):
    box = B.rotate_bbox_back("b", "rotation", F.lit(100), F.lit(80))
    return _pairs(spark, sf).withColumn("r", box).select("event_id", *flat_box("r"))


ROTATED_SQL = f"""
    SELECT event_id,
      cast(greatest(0, CASE rotation WHEN 0 THEN bx1 WHEN 90 THEN by1 WHEN 180 THEN 100 - bx2 ELSE 100 - by2 END) AS bigint) AS x1,
      cast(greatest(0, CASE rotation WHEN 0 THEN by1 WHEN 90 THEN 80 - bx2 WHEN 180 THEN 80 - by2 ELSE bx1 END) AS bigint) AS y1,
      cast(CASE rotation WHEN 0 THEN bx2 WHEN 90 THEN least(100, by2) WHEN 180 THEN least(100, 100 - bx1) ELSE least(100, 100 - by1) END AS bigint) AS x2,
      cast(CASE rotation WHEN 0 THEN by2 WHEN 90 THEN least(80, 80 - bx1) WHEN 180 THEN least(80, 80 - by1) ELSE least(80, bx2) END AS bigint) AS y2
    FROM {P}"""


def grown_faces(spark, sf):
    df = RAW.df(spark, sf).filter("kind = 'face'")
    box = B.expand_face_bbox("x", "y", "w", "h", "image_width", "image_height")
    return df.withColumn("b", box).select("idx", *flat_box("b"))


FACE_BOX = """cast(greatest(0, floor(x - w * 0.25::double)) AS bigint) AS x1,
      cast(greatest(0, floor(y - h * 0.3::double)) AS bigint) AS y1,
      cast(least(WW, ceil(x + w + w * 0.25::double)) AS bigint) AS x2,
      cast(least(HH, ceil(y + h + h * 0.3::double)) AS bigint) AS y2"""
GROWN_SQL = (
    "SELECT idx, " + FACE_BOX.replace("WW", "image_width").replace("HH", "image_height")
    + f" FROM {RAW.sql()} WHERE kind = 'face'"
)


def cleaned_signatures(spark, sf):
    df = RAW.df(spark, sf).filter("kind = 'signature'").withColumn(
        "x", F.col("x") - F.when(F.col("idx") % 5 == 0, 700.0).otherwise(0.0)
    )
    size = ("image_width", "image_height")
    clean = B.clean_raw_bbox("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"), *size)
    kept = df.withColumn("c", clean).filter(F.col("c").isNotNull())
    return kept.withColumn("b", B.expand_signature_bbox("c", *size)).select("idx", *flat_box("b"))


def _signature_sql(source: str) -> str:
    return f"""(
      SELECT *, cast(greatest(0, floor(cx1 - (cx2 - cx1) * 0.1::double)) AS bigint) AS x1,
        cast(greatest(0, floor(cy1 - (cy2 - cy1) * 0.2::double)) AS bigint) AS y1,
        cast(least(image_width, ceil(cx2 + (cx2 - cx1) * 0.1::double)) AS bigint) AS x2,
        cast(least(image_height, ceil(cy2 + (cy2 - cy1) * 0.2::double)) AS bigint) AS y2
      FROM (SELECT *, greatest(0, floor(x)) AS cx1, greatest(0, floor(y)) AS cy1,
        least(image_width, ceil(x + w)) AS cx2, least(image_height, ceil(y + h)) AS cy2
        FROM {source}) AS c WHERE cx2 > cx1 AND cy2 > cy1) AS sig"""


CLEANED_SQL = "SELECT idx, x1, y1, x2, y2 FROM " + _signature_sql(
    "(SELECT idx, x - CASE WHEN idx % 5 = 0 THEN 700.0 ELSE 0.0 END::double AS x, y, w, h,"
    f" image_width, image_height FROM {RAW.sql()} WHERE kind = 'signature') AS moved"
)

# --- merging ----------------------------------------------------------------


def _merged(spark, sf, kind):
    raw = RAW.df(spark, sf).filter(F.col("kind") == kind)
    return (O.face_boxes if kind == "face" else O.signature_boxes)(raw, PAGE)


def merged_faces(spark, sf):
    return _merged(spark, sf, "face").select(*PAGE, "detection_type", *flat_box(), "confidence")


def merged_signatures(spark, sf):
    return _merged(spark, sf, "signature").select(*PAGE, "detection_type", *flat_box(), "confidence")


def _merge_sql(boxes: str, order: str, threshold: float, kind: str) -> str:
    """Fold the boxes of each page one by one, best score first."""
    overlap = (
        "(least(c.x2, b.x2) - greatest(c.x1, b.x1)) > 0 AND (least(c.y2, b.y2) - greatest(c.y1, b.y1)) > 0"
        " AND cast((least(c.x2, b.x2) - greatest(c.x1, b.x1)) * (least(c.y2, b.y2) - greatest(c.y1, b.y1)) AS double)"
        " / ((c.x2-c.x1)*(c.y2-c.y1) + (b.x2-b.x1)*(b.y2-b.y1)"
        " - (least(c.x2, b.x2) - greatest(c.x1, b.x1)) * (least(c.y2, b.y2) - greatest(c.y1, b.y1)))"
        f" >= {threshold}::double"
    )
    return f"""(
      WITH RECURSIVE boxes AS MATERIALIZED (
        SELECT doc_id, page_no, x1, y1, x2, y2, score,
          row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, {order}) AS rn FROM {boxes}),
      sizes AS (SELECT doc_id, page_no, max(rn) AS n FROM boxes GROUP BY doc_id, page_no),
      fold AS (
        SELECT doc_id, page_no, 1::bigint AS n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}}] AS cl
        FROM boxes WHERE rn = 1
        UNION ALL
        SELECT doc_id, page_no, rn, CASE WHEN hit = 0
            THEN list_append(cl, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}})
            ELSE list_transform(cl, lambda c, i: CASE WHEN i = hit THEN {{'x1': least(c.x1, x1), 'y1': least(c.y1, y1),
              'x2': greatest(c.x2, x2), 'y2': greatest(c.y2, y2), 'score': greatest(c.score, score)}} ELSE c END) END
        FROM (SELECT b.*, f.cl, coalesce(list_position(list_transform(f.cl, lambda c: {overlap}), true), 0) AS hit
          FROM fold f JOIN boxes b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.rn = f.n + 1) AS step)
      SELECT doc_id, page_no, '{kind}' AS detection_type, c.x1 AS x1, c.y1 AS y1, c.x2 AS x2, c.y2 AS y2,
        c.score AS confidence
      FROM (SELECT f.doc_id, f.page_no, unnest(f.cl) AS c FROM fold f
        JOIN sizes s ON s.doc_id = f.doc_id AND s.page_no = f.page_no AND s.n = f.n) AS u)"""


_TURNED = (
    "CASE WHEN rotation IN (90, 270) THEN image_height ELSE image_width END",
    "CASE WHEN rotation IN (90, 270) THEN image_width ELSE image_height END",
)
FACES = f"""(
      SELECT doc_id, page_no, rotation, idx, score,
        greatest(0, CASE rotation WHEN 0 THEN x1 WHEN 90 THEN y1 WHEN 180 THEN image_width - x2 ELSE image_width - y2 END) AS x1,
        greatest(0, CASE rotation WHEN 0 THEN y1 WHEN 90 THEN image_height - x2 WHEN 180 THEN image_height - y2 ELSE x1 END) AS y1,
        CASE rotation WHEN 0 THEN x2 WHEN 90 THEN y2 WHEN 180 THEN image_width - x1 ELSE image_width - y1 END AS x2,
        CASE rotation WHEN 0 THEN y2 WHEN 90 THEN image_height - x1 WHEN 180 THEN image_height - y1 ELSE x2 END AS y2
      FROM (SELECT doc_id, page_no, rotation, idx, score, image_width, image_height,
        {FACE_BOX.replace("WW", _TURNED[0]).replace("HH", _TURNED[1])}
        FROM {RAW.sql()} WHERE kind = 'face' AND score >= 0.45) AS g) AS faces"""
SIGNATURES = _signature_sql(
    f"(SELECT * FROM {RAW.sql()} WHERE kind = 'signature' AND score >= 0.25) AS scored"
)
MERGED_FACES = _merge_sql(FACES, "rotation, idx", 0.35, "face")
MERGED_SIGNATURES = _merge_sql(SIGNATURES, "idx", 0.5, "signature")


def top_boxes(spark, sf):
    raw = RAW.df(spark, sf).filter("kind = 'face'")
    return O.top_boxes(raw, PAGE, k=2).select(*PAGE, F.col("rotation").cast("long").alias("rotation"), "idx", "score")


TOP_SQL = f"""
    SELECT doc_id, page_no, cast(rotation AS bigint) AS rotation, idx, score FROM {RAW.sql()} WHERE kind = 'face'
    QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, rotation ORDER BY score DESC, idx) <= 2"""

# --- detections of all kinds ------------------------------------------------

# Text boxes of the same pages, again and again at the same few places.
TEXT_BOXES = Derived(
    "events",
    (
        (
            "user_id AS doc_id", "cast(event_id % 3 AS bigint) AS page_no", "event_id",
            "CASE WHEN event_type IN ('click', 'view') THEN 'phone' WHEN event_type = 'error'"
            " THEN 'email' ELSE 'person' END AS detection_type",
            "cast((event_id % 5) * 190 AS int) AS x1", "cast((event_id % 7) * 110 AS int) AS y1",
            "cast((event_id % 5) * 190 + 180 AS int) AS x2", "cast((event_id % 7) * 110 + 30 AS int) AS y2",
            "cast((event_id * 31) % 100 AS double) / 100 AS confidence",
        ),
    ),
)


def _text_boxes(spark, sf):
    return TEXT_BOXES.df(spark, sf).select(
        *PAGE, "event_id", "detection_type", B.make_bbox("x1", "y1", "x2", "y2").alias("bbox"), "confidence"
    )


def deduplicated_boxes(spark, sf):
    return D.dedupe_boxes(_text_boxes(spark, sf), PAGE).select(
        *PAGE, "detection_type", *flat_box(), "confidence"
    )


DEDUPED = (
    f"SELECT doc_id, page_no, detection_type, {BOX_SQL}, max(confidence) AS confidence"
    f" FROM {TEXT_BOXES.sql()} GROUP BY doc_id, page_no, detection_type, x1, y1, x2, y2"
)


def _all_detections(spark, sf):
    return O.image_detections(
        D.dedupe_boxes(_text_boxes(spark, sf), PAGE),
        _merged(spark, sf, "face"),
        _merged(spark, sf, "signature"),
        PAGE,
    )


ALL = f"""({DEDUPED} UNION ALL SELECT * FROM {MERGED_FACES} AS f
      UNION ALL SELECT * FROM {MERGED_SIGNATURES} AS s) AS everything"""


def image_detections(spark, sf):
    return _all_detections(spark, sf).select(*PAGE, "detection_type", *flat_box(), "confidence")


def type_counts(spark, sf):
    return D.count_by_type(_all_detections(spark, sf), ["doc_id"]).select(
        "doc_id", "detection_type", "n"
    )


TYPE_COUNTS_SQL = f"""
    SELECT p.doc_id, t.detection_type, count(a.doc_id) AS n FROM (SELECT DISTINCT doc_id FROM {ALL}) AS p
    CROSS JOIN (VALUES ('tckn'), ('phone'), ('email'), ('person'), ('address'), ('face'), ('signature')) AS t(detection_type)
    LEFT JOIN {ALL} AS a ON a.doc_id = p.doc_id AND a.detection_type = t.detection_type
    GROUP BY p.doc_id, t.detection_type""".replace(") AS everything AS a", ") AS a")


def redaction_rectangles(spark, sf):
    pages = RAW.df(spark, sf).select(*PAGE, "image_width", "image_height").distinct()
    pages = pages.filter("doc_id % 7 <> 3")  # some pages have no known size
    rects = O.redaction_rectangles(_all_detections(spark, sf), pages, PAGE)
    return rects.select(*PAGE, "detection_type", *flat_box("rect"), "valid", "covered")


RECTANGLES_SQL = f"""
    SELECT doc_id, page_no, detection_type, x1, y1, x2, y2, coalesce(x2 > x1 AND y2 > y1, false) AS valid,
      (least(999, x2) - x1 + 1) * (least(799, y2) - y1 + 1) AS covered
    FROM (SELECT doc_id, page_no, detection_type,
      CASE WHEN doc_id % 7 <> 3 THEN greatest(0, x1 - 5) END AS x1, CASE WHEN doc_id % 7 <> 3 THEN greatest(0, y1 - 5) END AS y1,
      CASE WHEN doc_id % 7 <> 3 THEN least(1000, x2 + 5) END AS x2, CASE WHEN doc_id % 7 <> 3 THEN least(800, y2 + 5) END AS y2
      FROM {ALL}) AS r"""


def numbered_regions(spark, sf):
    return O.number_regions(_text_boxes(spark, sf), PAGE, "event_id").select(
        *PAGE, "event_id", "region_id"
    )


NUMBERED_SQL = f"""
    SELECT doc_id, page_no, event_id, printf('auto-%04d', row_number() OVER
      (PARTITION BY doc_id, page_no ORDER BY event_id)) AS region_id FROM {TEXT_BOXES.sql()}"""

# --- pixels -----------------------------------------------------------------

# Small white images with a few boxes each.
SMALL = Derived(
    "events",
    (
        (
            "user_id AS doc_id", "cast(event_id % 5 AS bigint) AS page_no",
            "cast((event_id * 7) % 50 AS int) AS x1", "cast((event_id * 5) % 40 AS int) AS y1",
            "cast((event_id * 7) % 50 + 1 + event_id % 9 AS int) AS x2",
            "cast((event_id * 5) % 40 + 1 + event_id % 4 AS int) AS y2",
        ),
    ),
)


def _filled(spark, sf):
    boxes = SMALL.df(spark, sf).select(*PAGE, B.make_bbox("x1", "y1", "x2", "y2").alias("bbox"))
    pages = boxes.select(*PAGE, F.lit(64).alias("image_width"), F.lit(48).alias("image_height")).distinct()
    rects = O.redaction_rectangles(boxes, pages, PAGE, margin=1)
    images = pages.select(
        *PAGE,
        F.col("image_height").alias("height"),
        F.col("image_width").alias("width"),
        F.lit(3).alias("n_channels"),
        F.unhex(F.repeat(F.lit("FF"), 64 * 48 * 3)).alias("data"),
    )
    return fill_rectangles(images, rects, PAGE)


def filled_pixels(spark, sf):
    white = F.length(F.replace(F.hex("data"), F.lit("00"), F.lit("")))
    return _filled(spark, sf).select(
        *PAGE, (F.lit(64 * 48) - white / 6).cast("long").alias("black_pixels")
    )


FILLED_SQL = f"""
    SELECT doc_id, page_no, count(DISTINCT y * 64 + x) AS black_pixels
    FROM (SELECT *, unnest(range(greatest(0, x1 - 1), least(63, x2 + 1) + 1)) AS x
      FROM (SELECT *, unnest(range(greatest(0, y1 - 1), least(47, y2 + 1) + 1)) AS y FROM {SMALL.sql()}) AS r) AS p
    GROUP BY doc_id, page_no"""

# --- passes -----------------------------------------------------------------

PASSES = Derived(
    "events",
    (
        (
            "user_id AS doc_id", "cast(event_id % 11 AS bigint) AS page_no",
            "cast((event_id * 13) % 23 % 4 AS int) AS pass_no",
            "CASE WHEN event_type IN ('click', 'view') THEN 'face' ELSE 'phone' END AS detection_type",
            "cast((event_id % 4) * 50 AS int) AS x1", "cast((event_id % 2) * 40 AS int) AS y1",
            "cast((event_id % 4) * 50 + 30 AS int) AS x2", "cast((event_id % 2) * 40 + 30 AS int) AS y2",
            "cast((event_id * 31) % 100 AS double) / 100 AS confidence",
        ),
    ),
)


def _pass_tables(spark, sf):
    found = PASSES.df(spark, sf).select(
        *PAGE, "pass_no", "detection_type", B.make_bbox("x1", "y1", "x2", "y2").alias("bbox"), "confidence"
    )
    return found.select(*PAGE).distinct(), found


def sanitized_pages(spark, sf):
    pages, found = _pass_tables(spark, sf)
    return I.sanitize_pages(pages, found, PAGE).select(
        *PAGE,
        F.col("redaction_passes").cast("long").alias("redaction_passes"),
        "applied_count", "remaining_count", "passed",
    )


_KEY = "doc_id, page_no, detection_type, x1, y1, x2, y2"
LOOP = f"""
    d AS MATERIALIZED (SELECT * FROM {PASSES.sql()}),
    pages AS (SELECT DISTINCT doc_id, page_no FROM d),
    new1 AS (SELECT * FROM d WHERE pass_no = 1 AND ({_KEY}) NOT IN (SELECT ({_KEY}) FROM d WHERE pass_no = 0)),
    new2 AS (SELECT * FROM d WHERE pass_no = 2 AND ({_KEY}) NOT IN (SELECT ({_KEY}) FROM d WHERE pass_no IN (0, 1))),
    passes AS (SELECT p.doc_id, p.page_no,
      CASE WHEN a.n IS NULL THEN 1 WHEN b.n IS NULL THEN 2 ELSE 3 END AS redaction_passes,
      CASE WHEN a.n IS NULL THEN 0 WHEN b.n IS NULL THEN a.n ELSE a.n + b.n END AS added
      FROM pages p
      LEFT JOIN (SELECT doc_id, page_no, count(*) AS n FROM new1 GROUP BY ALL) AS a USING (doc_id, page_no)
      LEFT JOIN (SELECT doc_id, page_no, count(*) AS n FROM new2 GROUP BY ALL) AS b USING (doc_id, page_no)),
    outcome AS (SELECT p.doc_id, p.page_no, cast(redaction_passes AS bigint) AS redaction_passes,
      cast(added + count(*) FILTER (d.pass_no = 0) AS bigint) AS applied_count,
      count(*) FILTER (d.pass_no = p.redaction_passes) AS remaining_count,
      count(*) FILTER (d.pass_no = p.redaction_passes) = 0 AS passed
      FROM passes p JOIN d ON d.doc_id = p.doc_id AND d.page_no = p.page_no
      GROUP BY p.doc_id, p.page_no, redaction_passes, added)"""
SANITIZED_PAGES_SQL = f"WITH {LOOP} SELECT * FROM outcome"


def applied_boxes(spark, sf):
    pages, found = _pass_tables(spark, sf)
    outcomes = I.sanitize_pages(pages, found, PAGE)
    return I.applied_page_detections(found, outcomes, PAGE).select(
        *PAGE, "detection_type", *flat_box(),
        F.col("pass_no").cast("long").alias("pass_no"), "n", "confidence",
    )


APPLIED_SQL = f"""WITH {LOOP}
    SELECT {_KEY.replace("x1, y1, x2, y2", BOX_SQL)}, cast(pass_no AS bigint) AS pass_no, count(*) AS n,
      max(confidence) AS confidence
    FROM (SELECT * FROM d WHERE pass_no = 0
      UNION ALL SELECT new1.* FROM new1 JOIN passes USING (doc_id, page_no) WHERE redaction_passes > 1
      UNION ALL SELECT new2.* FROM new2 JOIN passes USING (doc_id, page_no) WHERE redaction_passes > 2) AS a
    GROUP BY {_KEY}, pass_no"""


def new_detections(spark, sf):
    """Reports of the first verification that name something not yet applied."""
    _, found = _pass_tables(spark, sf)
    identity = [*PAGE, "detection_type", "bbox"]
    first = first_reports(found, PAGE).filter("first_pass = 1").select(*identity)
    return (
        found.filter("pass_no = 1").join(first, identity, "left_semi")
        .select(*PAGE, "detection_type", *flat_box(), "confidence")
    )


def page_verification(spark, sf):
    """What the last pass of each page still reports."""
    pages, found = _pass_tables(spark, sf)
    last = I.sanitize_pages(pages, found, PAGE).select(*PAGE, F.col("redaction_passes").alias("pass_no"))
    return D.verification_report(pages, found.join(last, [*PAGE, "pass_no"], "left_semi"), PAGE)


VERIFIED_SQL = f"WITH {LOOP} SELECT doc_id, page_no, remaining_count, passed FROM outcome"


def _document_results(spark, sf):
    pages, found = _pass_tables(spark, sf)
    outcomes = I.sanitize_pages(pages, found, PAGE)
    # every tenth document has a twin whose pages are missing
    ids = pages.select(F.explode(F.when(F.col("doc_id") % 10 == 0, F.array("doc_id", -1 - F.col("doc_id"))).otherwise(F.array("doc_id"))).alias("doc_id"))
    documents = ids.distinct().select(
        "doc_id",
        (F.col("doc_id") % 6 != 1).alias("text_layer_empty"),
        F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("pdf").alias("source_format"),
    )
    # some pages have no verdict, some documents no check of their text layer
    known = F.col("passed") | (F.col("doc_id") % 4 == 0)
    verdicts = outcomes.withColumn("passed", F.when((F.col("doc_id") % 9 != 4) | (F.col("page_no") != 3), known))
    documents = documents.withColumn("text_layer_empty", F.when(F.col("doc_id") % 28 != 0, F.col("text_layer_empty")))
    return verdicts, I.document_results(verdicts, documents)


def document_results(spark, sf):
    _, documents = _document_results(spark, sf)
    return documents


_LAYER = "CASE WHEN {0} % 28 <> 0 THEN {0} % 6 <> 1 END"
_ROLLED = f"""{LOOP}, verdicts AS (SELECT * EXCLUDE (passed),
      CASE WHEN doc_id % 9 = 4 AND page_no = 3 THEN NULL ELSE passed OR doc_id % 4 = 0 END AS passed FROM outcome),
    rolled AS (
      SELECT doc_id, count(*) AS page_count, count_if(passed IS NOT TRUE)::bigint AS failed_page_count,
        sum(redaction_passes)::bigint AS redaction_passes, {_LAYER.format('doc_id')} AS text_layer_empty,
        CASE WHEN doc_id % 2 = 0 THEN 'docx' ELSE 'pdf' END AS source_format,
        doc_id % 28 <> 0 AND doc_id % 6 <> 1 AND count_if(passed IS NOT TRUE) = 0 AS passed
      FROM verdicts GROUP BY doc_id
      UNION ALL SELECT DISTINCT -1 - doc_id, 0, 0, 0, {_LAYER.format('(-1 - doc_id)')},
        CASE WHEN (-1 - doc_id) % 2 = 0 THEN 'docx' ELSE 'pdf' END, false
      FROM outcome WHERE doc_id % 10 = 0)"""


def published_documents(spark, sf):
    published, held = I.publishable(_document_results(spark, sf)[1])
    return published.select("doc_id", F.lit("published").alias("destination")).unionByName(
        held.select("doc_id", F.lit("held_back").alias("destination"))
    )


def failed_pages(spark, sf):
    verdicts, _ = _document_results(spark, sf)
    return I.failed_pages(verdicts)


def held_back_pages(spark, sf):
    return I.held_back_pages(*_document_results(spark, sf))


HELD_SQL = f"""WITH {_ROLLED}, held AS (SELECT * FROM rolled WHERE NOT passed)
    SELECT doc_id, page_no, CASE WHEN v.passed IS NULL THEN 'page_not_verified' ELSE 'detections_remain' END AS reason
    FROM verdicts v SEMI JOIN held USING (doc_id) WHERE v.passed IS NOT TRUE
    UNION ALL SELECT doc_id, NULL, 'no_pages' FROM held WHERE page_count = 0
    UNION ALL SELECT doc_id, NULL, 'text_layer_not_checked' FROM held WHERE text_layer_empty IS NULL
    UNION ALL SELECT doc_id, NULL, 'text_layer_left' FROM held WHERE NOT text_layer_empty"""


# --- geometry edits ---------------------------------------------------------


def moved_boxes(spark, sf):
    box = B.translate_bbox("b", "dx", "dy", "width", "height")
    return _pairs(spark, sf).withColumn("m", box).select("event_id", *flat_box("m"))


MOVED_SQL = f"""
    SELECT event_id, cast(x AS bigint) AS x1, cast(y AS bigint) AS y1,
      cast(x + bx2 - bx1 AS bigint) AS x2, cast(y + by2 - by1 AS bigint) AS y2
    FROM (SELECT *, least(greatest(floor(bx1 + dx + 0.5::double), 0), width - (bx2 - bx1)) AS x,
      least(greatest(floor(by1 + dy + 0.5::double), 0), height - (by2 - by1)) AS y FROM {P}) AS q"""

_HANDLE = "CASE event_id % 4 WHEN 0 THEN 'nw' WHEN 1 THEN 'ne' WHEN 2 THEN 'se' ELSE 'sw' END"


def resized_boxes(spark, sf):
    df = _pairs(spark, sf).withColumn("handle", F.expr(_HANDLE))
    box = B.resize_bbox(
        "b", "handle", F.col("ax2") + F.col("dx"), F.col("ay2") + F.col("dy"), "width", "height"
    )
    return df.withColumn("m", box).select("event_id", "handle", *flat_box("m"))


RESIZED_SQL = f"""
    SELECT event_id, handle,
      cast(CASE WHEN handle IN ('nw','sw') THEN least(greatest(px, 0), bx2 - 2) ELSE bx1 END AS bigint) AS x1,
      cast(CASE WHEN handle IN ('nw','ne') THEN least(greatest(py, 0), by2 - 2) ELSE by1 END AS bigint) AS y1,
      cast(CASE WHEN handle IN ('nw','sw') THEN bx2 ELSE least(greatest(px, bx1 + 2), width) END AS bigint) AS x2,
      cast(CASE WHEN handle IN ('nw','ne') THEN by2 ELSE least(greatest(py, by1 + 2), height) END AS bigint) AS y2
    FROM (SELECT *, {_HANDLE} AS handle,
      least(greatest(floor(ax2 + dx + 0.5::double), 0), width) AS px,
      least(greatest(floor(ay2 + dy + 0.5::double), 0), height) AS py FROM {P}) AS q"""


def dragged_boxes(spark, sf):
    """A drag in screen coordinates, scaled to the image."""

    def point(value, extent):
        return B.client_point_to_image(value, F.lit(3.0), F.lit(140.0), extent)

    xs, xe = point("ax1", "width"), point(F.col("bx2") * F.lit(2.0), "width")
    ys, ye = point("ay2", "height"), point(F.col("by1") * F.lit(3.0), "height")
    box = B.normalize_drag(xs, ys, xe, ye, "width", "height")
    return _pairs(spark, sf).withColumn("m", box).select(
        "event_id", *flat_box("m"), B.bbox_is_usable("m").alias("usable")
    )


def _point(value: str, extent: str) -> str:
    return f"least(greatest(({value} - 3.0::double) / 140.0::double * {extent}, 0.0), cast({extent} AS double))"


DRAGGED_SQL = f"""
    SELECT event_id, x1, y1, x2, y2, x2 - x1 >= 2 AND y2 - y1 >= 2 AS usable FROM (
      SELECT event_id, cast(floor(least(xs, xe)) AS bigint) AS x1, cast(floor(least(ys, ye)) AS bigint) AS y1,
        cast(ceil(greatest(xs, xe)) AS bigint) AS x2, cast(ceil(greatest(ys, ye)) AS bigint) AS y2
      FROM (SELECT event_id, {_point("ax1", "width")} AS xs, {_point("bx2 * 2.0::double", "width")} AS xe,
        {_point("ay2", "height")} AS ys, {_point("by1 * 3.0::double", "height")} AS ye FROM {P}) AS q) AS r"""

QUERIES = {
    "bbox_measures": (bbox_measures, MEASURES_SQL),
    "expanded_boxes": (expanded_boxes, EXPANDED_SQL),
    "overlaps": (overlaps, OVERLAPS_SQL),
    "rotated_boxes": (rotated_boxes, ROTATED_SQL),
    "grown_faces": (grown_faces, GROWN_SQL),
    "cleaned_signatures": (cleaned_signatures, CLEANED_SQL),
    "top_boxes": (top_boxes, TOP_SQL),
    "merged_faces": (merged_faces, f"SELECT * FROM {MERGED_FACES} AS f"),
    "merged_signatures": (merged_signatures, f"SELECT * FROM {MERGED_SIGNATURES} AS s"),
    "deduplicated_boxes": (deduplicated_boxes, DEDUPED),
    "image_detections": (image_detections, f"SELECT * FROM {ALL}"),
    "type_counts": (type_counts, TYPE_COUNTS_SQL),
    "redaction_rectangles": (redaction_rectangles, RECTANGLES_SQL),
    "numbered_regions": (numbered_regions, NUMBERED_SQL),
    "filled_pixels": (filled_pixels, FILLED_SQL),
    "sanitized_pages": (sanitized_pages, SANITIZED_PAGES_SQL),
    "applied_boxes": (applied_boxes, APPLIED_SQL),
    "new_detections": (
        new_detections,
        f"WITH {LOOP} SELECT doc_id, page_no, detection_type, {BOX_SQL}, confidence FROM new1",
    ),
    "page_verification": (page_verification, VERIFIED_SQL),
    "document_results": (document_results, f"WITH {_ROLLED} SELECT * FROM rolled"),
    "published_documents": (
        published_documents,
        f"WITH {_ROLLED} SELECT doc_id, CASE WHEN passed THEN 'published' ELSE 'held_back' END AS destination FROM rolled",
    ),
    "failed_pages": (
        failed_pages,
        f"WITH {_ROLLED} SELECT doc_id, page_no, remaining_count FROM verdicts WHERE passed IS NOT TRUE",
    ),
    "held_back_pages": (held_back_pages, HELD_SQL),
    "moved_boxes": (moved_boxes, MOVED_SQL),
    "resized_boxes": (resized_boxes, RESIZED_SQL),
    "dragged_boxes": (dragged_boxes, DRAGGED_SQL),
}
