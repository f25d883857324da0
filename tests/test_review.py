"""Plans, revisions, overrides, exports and sessions."""

import random

from pyspark.sql import functions as F

from veilspan.operators import review as R
from veilspan.operators.boxes import number_regions
from veilspan.plans.image import image_identity, plans_from_detections
from veilspan.plans.review import export_reviewed, export_sessions

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
PLAN = "plan_id string, revision int, source_sha256 string, image_width int, image_height int, redaction_margin int, max_redaction_passes int"
REGION = f"plan_id string, revision int, region_id string, bbox {BOX}, provenance string, action string, detection_type string, confidence double, geometry_modified boolean"
FOUND = f"plan_id string, pass_no int, detection_type string, bbox {BOX}, confidence double"


def plan(plan_id="p", revision=0, passes=3, margin=5):
    return (plan_id, revision, "0a" * 32, 100, 80, margin, passes)


def region(region_id="auto-0001", box=(10, 10, 30, 20), provenance="automatic", action="retain", kind="face", confidence=0.9, moved=False, plan_id="p", revision=0):
    return (plan_id, revision, region_id, box, provenance, action, kind, confidence, moved)


def changes(spark, decisions=(), moves=(), manual=()):
    return (
        spark.createDataFrame(list(decisions), "plan_id string, expected_revision int, region_id string, action string"),
        spark.createDataFrame(list(moves), f"plan_id string, expected_revision int, region_id string, bbox {BOX}"),
        spark.createDataFrame(list(manual), f"plan_id string, expected_revision int, request_no int, bbox {BOX}, detection_type string"),
    )


def test_revision(spark):
    plans = spark.createDataFrame([plan(), plan("q")], PLAN)
    regions = spark.createDataFrame(
        [region(), region("auto-0002", moved=True), region("auto-0003"), region("m", provenance="manual", kind=None, confidence=None), region(plan_id="q")],
        REGION,
    )
    new_plans, new_regions = R.revise_plans(
        plans, regions,
        *changes(
            spark,
            [("p", 0, "auto-0001", "remove")],
            [("p", 0, "auto-0001", (1, 1, 5, 5)), ("p", 0, "auto-0003", (10, 10, 30, 20)), ("p", 0, "m", (0, 0, 4, 4))],
            [("p", 0, 1, (2, 2, 9, 9), None), ("p", 0, 2, (2, 2, 9, 9), None)],
        ),
    )
    assert [(r.plan_id, r.revision) for r in new_plans.collect()] == [("p", 1)]
    rows = {r.region_id: r for r in new_regions.collect()}
    assert len(rows) == 6 and {r.revision for r in rows.values()} == {1}
    assert (rows["auto-0001"].action, tuple(rows["auto-0001"].bbox), rows["auto-0001"].geometry_modified) == ("remove", (1, 1, 5, 5), True)
    assert rows["auto-0002"].geometry_modified  # stays marked
    assert not rows["auto-0003"].geometry_modified  # same box again
    assert not rows["m"].geometry_modified and tuple(rows["m"].bbox) == (0, 0, 4, 4)
    added = [r for k, r in rows.items() if k.startswith("manual-")]
    assert len(added) == 2 and all(len(r.region_id) == 39 and r.confidence is None for r in added)


def test_refused_requests(spark):
    plans = spark.createDataFrame([plan("stale", 2), plan("twice"), plan("unknown"), plan("moved"), plan("fine")], PLAN)
    regions = spark.createDataFrame([region(plan_id=p, revision=r) for p, r in (("stale", 2), ("twice", 0), ("unknown", 0), ("moved", 0), ("fine", 0))], REGION)
    asked = changes(
        spark,
        [("stale", 1, "auto-0001", "remove"), ("twice", 0, "auto-0001", "remove"), ("twice", 0, "auto-0001", "retain"),
         ("unknown", 0, "nobody", "remove"), ("fine", 0, "auto-0001", "remove"), ("nowhere", 0, "auto-0001", "remove")],
        [("moved", 0, "nobody", (0, 0, 1, 1)), ("moved", 0, "nobody", (0, 0, 2, 2))],
    )
    got = {(r.plan_id, r.reason) for r in R.revision_violations(plans, regions, *asked).collect()}
    assert got == {
        ("stale", "stale_revision"), ("twice", "duplicate_decision"), ("unknown", "unknown_decision_region"),
        ("moved", "unknown_geometry_update_region"), ("moved", "duplicate_geometry_update"),
        ("nowhere", "unknown_plan"), ("nowhere", "unknown_decision_region"),
    }
    new_plans, _ = R.revise_plans(plans, regions, *asked)
    assert [r.plan_id for r in new_plans.collect()] == ["fine"]


def exports(spark, regions, found, passes=3):
    plans = spark.createDataFrame([plan(passes=passes)], PLAN)
    rows = export_reviewed(
        plans, spark.createDataFrame(regions, REGION), spark.createDataFrame(found, FOUND)
    ).collect()
    assert len(rows) == 1
    return rows[0]


def test_removed_place_found_again(spark):
    """It stays visible: no remediation, and the output needs a review."""
    r = exports(spark, [region(action="remove")], [("p", 1, "face", (32, 10, 40, 20), 0.9)])
    assert (r.status, r.redaction_passes, r.remediation_count, r.remaining_count) == ("review_required", 1, 0, 1)


def test_other_type_and_distant_place_are_remediated(spark):
    for found in (("p", 1, "phone", (32, 10, 40, 20), 0.9), ("p", 1, "face", (35, 10, 40, 20), 0.9)):
        r = exports(spark, [region(action="remove")], [found])
        assert (r.status, r.redaction_passes, r.remediation_count) == ("verified_with_human_overrides", 2, 1)


def test_new_place_is_remediated(spark):
    r = exports(spark, [region()], [("p", 1, "phone", (50, 50, 60, 60), 0.5)] * 2)
    assert (r.status, r.redaction_passes, r.remediation_count, r.applied_region_count) == ("passed", 2, 1, 1)
    r = exports(spark, [region()], [("p", 1, "phone", (50, 50, 60, 60), 0.5)], passes=1)
    assert (r.status, r.redaction_passes, r.remaining_count) == ("review_required", 1, 1)


def test_known_place_found_again(spark):
    r = exports(spark, [region()], [("p", 1, "face", (10, 10, 30, 20), 0.5)])
    assert (r.status, r.redaction_passes) == ("review_required", 1)
    # a manual region carries no confidence, so it is no known key
    manual = region("m", provenance="manual", confidence=None)
    r = exports(spark, [manual], [("p", 1, "face", (10, 10, 30, 20), 0.5)])
    assert (r.status, r.redaction_passes, r.manual_addition_count) == ("passed", 2, 1)


def test_removing_a_manual_region_is_no_override(spark):
    r = exports(spark, [region("m", provenance="manual", confidence=None, action="remove")], [("q", 1, "face", (0, 0, 1, 1), 0.5)])
    assert (r.status, r.automatic_removal_count) == ("passed", 0)
    r = exports(spark, [region(moved=True)], [("q", 1, "face", (0, 0, 1, 1), 0.5)])
    assert r.status == "verified_with_human_overrides"


def test_blocked_random(spark):
    """Tiles change nothing: the same pairs as comparing everything."""
    rng = random.Random(8)

    def box():
        x, y = rng.randrange(1900), rng.randrange(1900)
        return (x, y, x + rng.randint(1, 900), y + rng.randint(1, 90))

    plans = spark.createDataFrame([(f"p{i}", 0, "0a" * 32, 2000, 2000, 5, 3) for i in range(6)], PLAN)
    regions = [region(f"r{i}", box(), action=rng.choice(["remove", "retain"]), kind=rng.choice(["face", "phone"]), plan_id=f"p{i % 6}") for i in range(90)]
    found = [(f"p{rng.randrange(6)}", 1, rng.choice(["face", "phone"]), box(), 0.5) for _ in range(200)]
    got = R.blocked_by_removal(spark.createDataFrame(found, FOUND), spark.createDataFrame(regions, REGION), plans)
    want = set()
    for p, _, kind, b, _ in found:
        for q, _, _, r, _, action, k, _, _ in regions:
            scope = (max(0, r[0] - 5), max(0, r[1] - 5), min(2000, r[2] + 5), min(2000, r[3] + 5))
            meets = b[0] < scope[2] and scope[0] < b[2] and b[1] < scope[3] and scope[1] < b[3]
            if (p, kind, action) == (q, k, "remove") and meets:
                want.add((p, kind, b))
    assert {(r.plan_id, r.detection_type, tuple(r.bbox)) for r in got.collect()} == want


def test_rules(spark):
    plans = spark.createDataFrame([plan()], PLAN)
    regions = [
        region(" "), region("a", confidence=None), region("b", kind=None), region("c", provenance="manual"),
        region("d", provenance="manual", confidence=None, moved=True), region("e", (0, 0, 101, 5)), region("f", (5, 5, 5, 9)),
        region("g", confidence=1.5), region("ok"),
    ]
    got = {(r.region_id, r.rule) for r in R.region_violations(spark.createDataFrame(regions, REGION), plans).collect()}
    assert got == {
        (" ", "blank_region_id"), ("a", "automatic_without_type_or_confidence"), ("b", "automatic_without_type_or_confidence"),
        ("c", "manual_with_confidence"), ("d", "manual_geometry_modified"), ("e", "outside_image"), ("f", "invalid_box"),
        ("g", "confidence_out_of_range"),
    }


def test_sessions(spark):
    pages = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("u", 1)], "session_id string, page_number int")
    plans = spark.createDataFrame([("s", 1, 0), ("s", 2, 3), ("t", 1, 1)], "session_id string, page_number int, revision int")
    expected = spark.createDataFrame([("s", 1, 0), ("s", 2, 3), ("t", 1, 0), ("t", 2, 0), ("u", 1, 0)], "session_id string, page_number int, revision int")
    gate = R.export_gate(pages, plans, expected)
    assert {tuple(r) for r in gate.collect()} == {("t", 1, "stale_revision"), ("t", 2, "unknown_page"), ("u", 1, "not_analyzed")}
    facts = "session_id string, page_number int, plan_revision int, redaction_passes int, automatic_removal_count long, automatic_geometry_adjustment_count long, manual_addition_count long, applied_region_count long, remaining_count long, detectors_clear boolean, status string"
    results = spark.createDataFrame(
        [("s", 1, 0, 1, 0, 0, 1, 2, 0, True, "passed"), ("s", 2, 3, 2, 1, 0, 0, 4, 0, True, "verified_with_human_overrides"), ("t", 1, 1, 1, 0, 0, 0, 0, 0, True, "passed")],
        facts,
    )
    for empty, status in ((None, "verified_with_human_overrides"), (True, "verified_with_human_overrides"), (False, "review_required")):
        documents = spark.createDataFrame([("s", empty)], "session_id string, text_layer_empty boolean")
        rows = export_sessions(pages, plans, expected, results, documents).collect()
        assert [(r.session_id, r.status, r.plan_revision, r.redaction_passes, r.applied_region_count, r.passed) for r in rows] == [("s", status, 3, 3, 6, False)]


def test_session_states(spark):
    pages = spark.createDataFrame([(s, 1) for s in "abcd"], "session_id string, page_number int")
    log = spark.createDataFrame([("b", 1, 1, 0), ("c", 1, 1, 0), ("d", 1, 1, 0), ("d", 1, 9, 1)], "session_id string, page_number int, seq long, revision int")
    exported = spark.createDataFrame([("a", 3), ("c", 5), ("d", 5)], "session_id string, seq long")
    got = {r.session_id: r.state for r in R.session_states(pages, log, exported).collect()}
    assert got == {"a": "uploaded", "b": "analyzed", "c": "exported", "d": "analyzed"}
    assert {r.session_id: r.revision for r in R.current_plans(log).collect()}["d"] == 1


def test_analysis_gives_numbered_regions(spark):
    keys = ["doc_id", "page_no"]
    pages = image_identity(
        spark.createDataFrame([(1, 1, bytearray(b"x"), 100, 80)], "doc_id int, page_no int, content binary, image_width int, image_height int")
    )
    found = spark.createDataFrame([(1, 1, 4, (0, 0, 1, 1), "face", 0.5), (1, 1, 9, (0, 0, 2, 2), "phone", 1.0)], f"doc_id int, page_no int, seq long, bbox {BOX}, detection_type string, confidence double")
    plans, regions = plans_from_detections(pages, number_regions(found, keys, "seq"), keys)
    assert sorted((r.region_id, r.detection_type) for r in regions.collect()) == [("auto-0001", "face"), ("auto-0002", "phone")]
    assert R.plan_violations(plans).count() == 0 and R.region_violations(regions, plans).count() == 0
    changed = plans.select("plan_id", F.lit("00" * 32).alias("source_sha256"), "image_width", "image_height")
    assert R.source_mismatches(plans, plans.limit(0)).count() == 1
    assert R.source_mismatches(plans, plans).count() == 0 and R.source_mismatches(plans, changed).count() == 1


def test_labels(spark):
    df = spark.createDataFrame([("tckn", "automatic"), (None, "manual"), (None, "automatic")], "k string, p string")
    assert [r[0] for r in df.select(R.region_label("k", "p")).collect()] == ["Identity number", "Manual privacy region", "Detection"]
