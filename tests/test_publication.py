"""Unverified pages never pass, exports to the end, publication in one step."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_review import FOUND, PLAN, REGION, plan, region
from veilspan.operators import review as R
from veilspan.plans import image as I
from veilspan.plans import publish as P
from veilspan.plans import review as E
from workload.text import _sanitized, published_files

FACTS = "session_id string, page_number int, plan_revision int, redaction_passes int, automatic_removal_count long, automatic_geometry_adjustment_count long, manual_addition_count long, applied_region_count long, remaining_count long, detectors_clear boolean, status string"


def result(page, clear=True, status="passed", remaining=0, revision=0, session="s"):
    return (session, page, revision, 1, 0, 0, 0, 2, remaining, clear, status)


def test_status_of_unknown_verdicts(spark):
    cases = [(True, 0, 0), (None, 0, 0), (True, None, 0), (True, 0, None), (False, 1, 1), (True, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, clear boolean, removals long, moves long")
    got = [r[0] for r in df.orderBy("i").select(R.page_status("clear", "removals", "moves")).collect()]
    assert got == ["passed", "review_required", "review_required", "review_required", "review_required", "verified_with_human_overrides", "review_required"]


def test_pages_without_a_verdict_fail(spark):
    pages = spark.createDataFrame(
        [("a", 1, 1, 0, None), ("a", 2, 1, 0, True), ("b", 1, 1, 0, True), ("c", 1, 2, 3, False), ("c", 2, 1, 0, None), ("d", 1, 1, 0, True)],
        "doc_id string, page_no int, redaction_passes int, remaining_count int, passed boolean",
    )
    documents = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", None), ("e", False)], "doc_id string, text_layer_empty boolean")
    rolled = I.document_results(pages, documents)
    assert {r.doc_id: (r.failed_page_count, r.passed) for r in rolled.collect()} == {"a": (1, False), "b": (0, True), "c": (2, False), "d": (0, False), "e": (0, False)}
    assert {tuple(r)[:2] for r in I.failed_pages(pages).collect()} == {("a", 1), ("c", 1), ("c", 2)}
    held = {tuple(r) for r in I.held_back_pages(pages, rolled).collect()}
    assert held == {
        ("a", 1, "page_not_verified"), ("c", 1, "detections_remain"), ("c", 2, "page_not_verified"),
        ("d", None, "text_layer_not_checked"), ("e", None, "no_pages"), ("e", None, "text_layer_left"),
    }


@pytest.mark.parametrize(
    "page,status",
    [
        (result(2), "passed"),
        (result(2, status="verified_with_human_overrides"), "verified_with_human_overrides"),
        (result(2, clear=None), "review_required"),
        (result(2, clear=None, remaining=3), "review_required"),
        (result(2, status=None), "review_required"),
        (result(2, remaining=3), "review_required"),
        (result(2, remaining=None), "review_required"),
        (result(2, clear=False, status="review_required", remaining=1), "review_required"),
    ],
)
def test_documents_with_unknown_pages(spark, page, status):
    documents = spark.createDataFrame([("s", None)], "session_id string, text_layer_empty boolean")
    row = R.document_export(spark.createDataFrame([result(1), page], FACTS), documents).first()
    assert (row.page_count, row.status, row.passed, row.detectors_clear) == (2, status, status == "passed", status != "review_required")


def test_sessions_with_missing_results(spark):
    key = "session_id string, page_number int"
    rows = [("s", 1), ("s", 2), ("t", 1), ("u", 1), ("u", 2)]
    pages = spark.createDataFrame(rows, key)
    plans = spark.createDataFrame([(*r, 0) for r in rows], f"{key}, revision int")
    results = [result(1), result(1, session="t"), result(1, session="u"), result(2, session="u", revision=5), result(9, session="t")]
    documents = spark.createDataFrame([(s, None) for s in "stu"], "session_id string, text_layer_empty boolean")
    got = E.export_sessions(pages, plans, plans, spark.createDataFrame(results, FACTS), documents)
    # a page of s has no result, one of u only that of another revision, and page 9 is no page of t
    assert {(r.session_id, r.page_count, r.missing_page_count, r.status) for r in got.collect()} == {
        ("s", 2, 1, "review_required"), ("t", 1, 0, "passed"), ("u", 2, 1, "review_required"),
    }


def test_export_to_the_end(spark):
    """Regions, remediations and their rectangles; what stays visible is reported, not painted."""
    plans = spark.createDataFrame([plan(), plan("q"), plan("gone")], PLAN)
    regions = spark.createDataFrame([region(), region("auto-0002", (60, 60, 70, 70), action="remove"), region(plan_id="q")], REGION)
    again, new, later = (60, 60, 70, 70), (40, 40, 50, 50), (0, 70, 9, 80)
    found = spark.createDataFrame(
        [("p", 1, "face", again, 0.9), ("p", 1, "face", new, 0.4), ("p", 1, "face", new, 0.6), ("p", 2, "phone", later, 1.0), ("p", 3, "face", again, 0.9)], FOUND
    )
    exports = E.export_reviewed(plans, regions, found)
    done = E.remediated_detections(plans, regions, found, exports)
    assert {(r.plan_id, r.pass_no, tuple(r.bbox), r.confidence) for r in done.collect()} == {("p", 1, new, 0.6), ("p", 2, later, 1.0)}
    left = E.remaining_detections(found, exports).collect()
    assert [(r.plan_id, r.pass_no, tuple(r.bbox)) for r in left] == [("p", 3, again)]
    rects = {(r.plan_id, r.origin, tuple(r.rect)) for r in E.export_rectangles(plans, regions, found, exports).collect()}
    assert rects == {
        ("p", "plan", (5, 5, 35, 25)), ("q", "plan", (5, 5, 35, 25)), ("p", "remediation", (35, 35, 55, 55)), ("p", "remediation", (0, 65, 14, 80)),
    }
    pages = spark.createDataFrame([("p", "s", 4)], "plan_id string, session_id string, page_number int")
    rows = E.export_detections_by_page(plans, regions, found, exports, pages)
    assert sorted((r.session_id, r.page_number, r.outcome, r.pass_no) for r in rows.collect()) == [("s", 4, "remaining", 3), ("s", 4, "remediated", 1), ("s", 4, "remediated", 2)]


def test_changed_sources_are_not_exported(spark):
    plans = spark.createDataFrame([plan(), plan("q"), plan("r"), plan("gone")], PLAN)
    files = plans.filter("plan_id <> 'gone'").select("plan_id", "source_sha256", "image_width", "image_height")

    def other(plan_id):
        return files.withColumn("source_sha256", F.when(F.col("plan_id") == plan_id, F.repeat(F.lit("0b"), 32)).otherwise(F.col("source_sha256")))

    gate = E.source_gate(plans, other("q"), other("r"))
    assert {(r.plan_id, r.reason) for r in gate.collect()} == {("q", "source_changed"), ("r", "source_changed_during_export"), ("gone", "source_changed")}
    none = spark.createDataFrame([], FOUND)
    exported = E.export_reviewed(plans, spark.createDataFrame([region()], REGION), none, other("q"), other("r"))
    assert [r.plan_id for r in exported.collect()] == ["p"]


def documents(spark, text):
    return spark.createDataFrame([(1, text, True), (2, None, True), (3, "held", False), (4, "unknown", None)], "doc_id int, text string, passed boolean")


def test_publication(spark, tmp_path):
    target = str(tmp_path / "out")
    with pytest.raises(P.NotPublished):
        (tmp_path / "out").mkdir()
        P.read_published(spark, target)
    P.publish(documents(spark, "first"), target)
    P.publish(documents(spark, "second"), target)
    assert sorted((r.doc_id, r.text) for r in P.read_published(spark, target).collect()) == [(1, "second"), (2, None)]
    assert P.read_contents(spark, target).count() == 2 and P.changed_contents(spark, target).count() == 0


@pytest.mark.parametrize("broken", ["commit", "_contents"])
def test_failure_leaves_the_former_publication(spark, tmp_path, monkeypatch, broken):
    """The job ends after the rows are written, before the rename."""
    target = str(tmp_path / "out")
    first = P.publish(documents(spark, "first"), target)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(P, broken, killed)
        with pytest.raises(KeyboardInterrupt):
            P.publish(documents(spark, "second"), target)
    assert len(list((tmp_path / "out").glob("version-*"))) == 2
    assert P.current_version(spark, target) == first
    assert {r.text for r in P.read_published(spark, target).collect()} == {"first", None}
    P.publish(documents(spark, "third"), target)
    assert {r.text for r in P.read_published(spark, target).collect()} == {"third", None}


def test_changed_rows_are_found(spark, tmp_path):
    target = str(tmp_path / "out")
    version = P.publish(documents(spark, "first"), target)
    rows = spark.read.parquet(f"{target}/{version}/rows")
    rows.withColumn("text", F.when(F.col("doc_id") == 2, "").otherwise(F.col("text"))).write.parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("overwrite").parquet(f"{target}/{version}/rows")
    # an empty text in the place of a null
    assert [r.doc_id for r in P.changed_contents(spark, target).collect()] == [2]


@pytest.fixture
def tables(spark, tmp_path):
    """Customers and documents, each in a file of one part."""
    customers = [(k, f"Customer#{k}", k % 25) for k in range(200)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    texts = [(k, "tel 0532 123 45 67", "en", "a") for k in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_texts_of_many_looks_use_all_cores(spark, tables):
    rows = _sanitized(spark, tables).select("doc_id").rdd
    used = rows.mapPartitions(lambda part: [sum(r.doc_id.startswith("n") for r in part)]).collect()
    assert sum(used) == 40 and sum(n > 0 for n in used) > 1


def test_published_texts_are_not_shuffled(spark, tables):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as where no side is small
    try:
        done = published_files(spark, tables)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(done._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(name, before)
    shuffled = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert shuffled and not any("sanitized_text" in columns for columns in shuffled)
