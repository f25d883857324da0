"""Box geometry, merging, redaction rectangles, pixels and the pass loop."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import boxes as B
from veilspan.operators import boxes as O
from veilspan.operators.pixels import fill_rectangles
from veilspan.plans import image as I

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
PAGE = ["doc_id", "page_no"]
RAW = "doc_id int, page_no int, rotation int, idx long, x double, y double, w double, h double, score double, image_width int, image_height int"


def one(spark, expr, **columns):
    df = spark.range(1).select(*(c.alias(n) for n, c in columns.items())) if columns else spark.range(1)
    value = df.select(expr.alias("v")).first().v
    return tuple(value) if hasattr(value, "asDict") else value


def box(*values):
    return B.make_bbox(*(F.lit(v) for v in values))


def test_growth_and_rotation(spark):
    lit = F.lit
    assert one(spark, B.expand_face_bbox(lit(100), lit(100), lit(100), lit(100), lit(500), lit(500))) == (75, 70, 225, 230)
    for rotation, b in ((0, (100, 50, 200, 150)), (90, (150, 100, 250, 200)), (180, (200, 150, 300, 250)), (270, (50, 200, 150, 300))):
        assert one(spark, B.rotate_bbox_back(box(*b), lit(rotation), lit(400), lit(300))) == (100, 50, 200, 150)
    assert one(spark, B.rotate_bbox_back(box(1, 1, 2, 2), lit(45), lit(9), lit(9))) is None
    assert one(spark, B.expand_bbox(box(3, 2, 10, 10), lit(5), lit(12), lit(20))) == (0, 0, 12, 15)
    assert one(spark, B.expand_bbox(box(30, 2, 40, 10), lit(5), lit(12), lit(20))) is None
    assert one(spark, B.expand_bbox(box(3, 2, 10, 10), lit(-1), lit(12), lit(20))) is None
    assert one(spark, B.expand_signature_bbox(box(10, 10, 110, 60), lit(300), lit(300))) == (0, 0, 120, 70)
    assert one(spark, B.clean_raw_bbox(lit(-3.5), lit(1.2), lit(4.1), lit(2.0), lit(9), lit(9))) == (0, 1, 5, 2)
    assert one(spark, B.clean_raw_bbox(lit(-3.5), lit(1.2), lit(-1.0), lit(2.0), lit(9), lit(9))) is None


def test_edits(spark):
    lit = F.lit
    assert one(spark, B.translate_bbox(box(20, 20, 50, 40), lit(80), lit(-50), lit(100), lit(100))) == (70, 0, 100, 20)
    assert one(spark, B.resize_bbox(box(20, 20, 50, 50), lit("nw"), lit(48), lit(49), lit(100), lit(100))) == (48, 48, 50, 50)
    assert one(spark, B.resize_bbox(box(20, 20, 50, 50), lit("se"), lit(500), lit(0), lit(100), lit(100))) == (20, 20, 100, 22)
    assert one(spark, B.normalize_drag(lit(80.8), lit(60.2), lit(10.4), lit(20.7), lit(100), lit(100))) == (10, 20, 81, 61)
    assert one(spark, B.client_point_to_image(lit(60.0), lit(10.0), lit(100.0), lit(400))) == 200.0
    assert one(spark, B.client_point_to_image(lit(60.0), lit(10.0), lit(0.0), lit(400))) is None


def test_touching_boxes(spark):
    assert not one(spark, B.boxes_intersect(box(0, 0, 5, 5), box(5, 0, 9, 5)))
    for a, b, share in (((0, 0, 5, 5), (5, 0, 9, 5), 0.0), ((0, 0, 4, 4), (2, 0, 6, 4), 8 / 24)):
        assert one(spark, B.iou("a", "b"), a=box(*a), b=box(*b)) == pytest.approx(share)
    assert one(spark, B.enclosing_bbox(F.array(box(1, 5, 2, 6), box(0, 7, 1, 9)))) == (0, 5, 2, 9)


def test_strict_mode_fails(spark):
    value = B.require(B.bbox_is_valid(box(3, 0, 2, 1)), F.lit(1), "invalid box")
    with pytest.raises(Exception, match="invalid box"):
        one(spark, value)


def python_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def python_merge(boxes, threshold):
    out = []
    for conf, _, b in sorted(boxes, key=lambda x: (-x[0], x[1])):
        for i, (c, old) in enumerate(out):
            if python_iou(b, old) >= threshold:
                out[i] = (max(c, conf), (min(old[0], b[0]), min(old[1], b[1]), max(old[2], b[2]), max(old[3], b[3])))
                break
        else:
            out.append((conf, b))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.5])
def test_greedy_merge_random(spark, threshold):
    rng = random.Random(9)
    pages = {}
    for page in range(60):
        boxes = []
        for i in range(rng.choice([1, 3, 12, 40])):
            x, y = rng.randrange(60), rng.randrange(120)
            boxes.append((rng.choice([0.5, 0.6, 0.7, 0.9]), i, (x, y, x + rng.randint(5, 30), y + rng.randint(5, 30))))
        pages[page] = boxes
    rows = [(p, 1, c, i, b) for p, boxes in pages.items() for c, i, b in boxes]
    df = spark.createDataFrame(rows, f"doc_id int, page_no int, confidence double, idx long, bbox {BOX}")
    got = {p: [] for p in pages}
    for r in O.merge_boxes(df, PAGE, threshold, "face").collect():
        got[r.doc_id].append((r.confidence, tuple(r.bbox)))
    for page, boxes in pages.items():
        assert sorted(got[page]) == python_merge(boxes, threshold)


def test_face_found_twice(spark):
    # un-grown so that the result is easy to read: boxes of equal rotation, small margins cancel out
    df = spark.createDataFrame(
        [(1, 1, 0.88, 1, (105, 105, 205, 205)), (1, 1, 0.95, 0, (100, 100, 200, 200))],
        f"doc_id int, page_no int, confidence double, idx long, bbox {BOX}",
    )
    rows = O.merge_boxes(df, PAGE, 0.35, "face").collect()
    assert [(tuple(r.bbox), r.confidence) for r in rows] == [((100, 100, 205, 205), 0.95)]


def test_detector_tables(spark):
    raw = spark.createDataFrame(
        [
            (1, 1, 0, 0, 100.0, 100.0, 100.0, 100.0, 0.9, 500, 400),
            (1, 1, 90, 1, 10.0, 10.0, 20.0, 20.0, 0.44, 500, 400),
            (1, 1, 90, 2, 300.0, 400.0, 20.0, 20.0, 0.45, 500, 400),
        ],
        RAW,
    )
    faces = {tuple(r.bbox) for r in O.face_boxes(raw, PAGE).collect()}
    # rotated image is 400 x 500: grown (295,394,325,426) turned back
    assert faces == {(75, 70, 225, 230), (394, 75, 426, 105)}
    assert {tuple(r.bbox) for r in O.face_boxes(raw, PAGE, top_k=1).collect()} == faces
    signatures = {tuple(r.bbox) for r in O.signature_boxes(raw.filter("rotation = 0"), PAGE).collect()}
    assert signatures == {(90, 80, 210, 220)}


@pytest.mark.parametrize("k, salts", [(3, 2), (3, 64), (100, 4)])
def test_top_boxes(spark, k, salts):
    rng = random.Random(k)
    rows = [(p, 1, rng.choice([0, 90]), i, 0.0, 0.0, 1.0, 1.0, rng.choice([0.1, 0.5, 0.5, 0.9]), 9, 9) for p in range(5) for i in range(p * 20)]
    df = spark.createDataFrame(rows, RAW)
    want = set()
    for p in range(5):
        for rotation in (0, 90):
            group = sorted((-r[8], r[3]) for r in rows if r[0] == p and r[2] == rotation)
            want |= {(p, rotation, i) for _, i in group[:k]}
    got = O.top_boxes(df, PAGE, k, salts).select("doc_id", "rotation", "idx").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_page_detectors_together(spark):
    from tests.test_lines import line_rows, lines_df
    from veilspan.operators.lines import pages_from_lines

    pages, _ = pages_from_lines(lines_df(spark, line_rows("7", ["a@b.de", "Adres"])), PAGE)
    raw = spark.createDataFrame([("7", 1, 0, 0, 100.0, 100.0, 100.0, 100.0, 0.9, 500, 400)], RAW.replace("doc_id int", "doc_id string"))
    found = I.detect_pages(pages, PAGE, raw_faces=raw, raw_signatures=raw)
    assert sorted(r.detection_type for r in found.collect()) == ["address", "email", "face", "signature"]


def test_rectangles_and_pixels(spark):
    pages = spark.createDataFrame([(1, 1, 10, 8), (2, 1, 4, 4)], "doc_id int, page_no int, image_width int, image_height int")
    boxes = spark.createDataFrame(
        [(1, 1, "face", (2, 2, 4, 4)), (1, 1, "face", (2, 2, 4, 4)), (1, 1, "phone", (8, 6, 10, 8)), (1, 1, "email", (30, 1, 40, 2))],
        f"doc_id int, page_no int, detection_type string, bbox {BOX}",
    )
    rects = O.redaction_rectangles(boxes, pages, PAGE, margin=1)
    got = {r.detection_type: (r.valid, r.covered, r.rect and tuple(r.rect)) for r in rects.collect()}
    # the fill includes the right and lower edge and stops at the border
    assert got == {"face": (True, 25, (1, 1, 5, 5)), "phone": (True, 9, (7, 5, 10, 8)), "email": (False, None, None)}
    channels = F.when(F.col("doc_id") == 1, 3).otherwise(1)
    images = pages.select(
        *PAGE, F.col("image_height").alias("height"), F.col("image_width").alias("width"), channels.alias("n_channels"),
        F.unhex(F.repeat(F.lit("FF"), F.col("image_width") * F.col("image_height") * channels)).alias("data"),
    )
    held = {r.doc_id: (r.data, r.error) for r in fill_rectangles(images, rects, PAGE).collect()}
    # an image with a rectangle that cannot be placed is held back
    assert held[1] == (None, "a rectangle does not lie in the image") and held[2] == (b"\xff" * 48, None)
    elsewhere = spark.createDataFrame([(9, 1, "face", (0, 0, 2, 2))], f"doc_id int, page_no int, detection_type string, bbox {BOX}")
    unsized = O.redaction_rectangles(elsewhere, pages, PAGE).collect()
    assert [(r.doc_id, r.valid, r.rect) for r in unsized] == [(9, False, None)]
    rects = rects.filter("valid")
    filled = {r.doc_id: r.data for r in fill_rectangles(images, rects, PAGE).collect()}
    black = {
        (x, y) for y in range(8) for x in range(10) if filled[1][(y * 10 + x) * 3 : (y * 10 + x) * 3 + 3] == b"\0\0\0"
    }
    assert black == {(x, y) for x in range(1, 6) for y in range(1, 6)} | {(x, y) for x in (7, 8, 9) for y in (5, 6, 7)}
    assert filled[2] == b"\xff" * 48

    def flip(pixels, rectangles, margin):
        return pixels[:, ::-1]

    turned = {r.doc_id: r.data for r in fill_rectangles(images, rects, PAGE, 1, flip).collect()}
    assert turned[1] != filled[1] and turned[2] == filled[2]


def python_passes(passes, limit):
    """passes[k]: reports after pass k, passes[0] the original."""
    applied, known, done = list(passes.get(0, [])), set(passes.get(0, [])), 1
    while passes.get(done) and done < limit:
        new = [k for k in passes[done] if k not in known]
        if not new:
            break
        applied += new
        known |= set(new)
        done += 1
    return done, len(applied), len(passes.get(done, []))


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_pass_loop_random(spark, limit):
    rng = random.Random(limit)
    model, rows = {}, []
    for d in range(80):
        model[d] = {}
        for k in range(0, 6):
            found = [rng.choice("abcdefg"[: 3 + d % 5]) for _ in range(rng.choice([0, 1, 1, 3]))]
            if found:
                model[d][k] = found
            rows += [(d, 1, k, "face", (ord(c), 0, ord(c) + 1, 1), rng.random()) for c in found]
    found = spark.createDataFrame(rows, f"doc_id int, page_no int, pass_no int, detection_type string, bbox {BOX}, confidence double")
    pages = spark.createDataFrame([(d, 1) for d in model], "doc_id int, page_no int")
    outcomes = I.sanitize_pages(pages, found, PAGE, max_passes=limit)
    got = {r.doc_id: (r.redaction_passes, r.applied_count, r.remaining_count) for r in outcomes.collect()}
    assert got == {d: python_passes(p, limit) for d, p in model.items()}
    applied = I.applied_page_detections(found, outcomes, PAGE).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r.doc_id: r.n for r in applied.collect()} == {d: v[1] for d, v in got.items() if v[1]}


def test_document_rollup_and_publication(spark):
    pages = spark.createDataFrame(
        [("a", 1, 1, 0, True), ("a", 2, 2, 0, True), ("b", 1, 1, 0, True), ("b", 2, 3, 4, False), ("c", 1, 1, 0, True)],
        "doc_id string, page_no int, redaction_passes int, remaining_count int, passed boolean",
    )
    documents = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("none", True)], "doc_id string, text_layer_empty boolean")
    rolled = I.document_results(pages, documents)
    published, held = I.publishable(rolled)
    assert [r.doc_id for r in published.collect()] == ["a"]
    # a document without pages was not looked at, so it is held back
    assert sorted((r.doc_id, r.page_count) for r in held.collect()) == [("b", 2), ("c", 1), ("none", 0)]
    assert [tuple(r) for r in I.failed_pages(pages).collect()] == [("b", 2, 4)]
