"""Queries over review plans, revisions, exports and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions.boxes import make_bbox
from veilspan.operators import detections as D
from veilspan.operators import review as R
from veilspan.operators.boxes import number_regions
from veilspan.plans.image import plans_from_detections
from veilspan.plans.review import export_detections_by_page, export_reviewed, export_sessions
from veilspan.plans.review import export_rectangles as rectangles_of_exports
from veilspan.plans.review import source_gate as gate_of_sources
from veilspan.session import load_table
from workload.common import BOX_SQL, Derived, flat_box

# One plan per customer, one region per order.
PLANS = Derived(
    "customer",
    (
        (
            "concat('p', cast(c_custkey AS string)) AS plan_id",
            "cast(c_custkey % 3 AS int) AS revision",
            "c_custkey",
            "repeat('0a', 32) AS source_sha256",
            "cast(1000 AS int) AS image_width", "cast(800 AS int) AS image_height",
            "cast(5 AS int) AS redaction_margin",
            "cast(1 + c_custkey % 3 AS int) AS max_redaction_passes",
        ),
    ),
)
REGIONS = Derived(
    "orders",
    (
        (
            "o_orderkey", "o_custkey",
            "concat('p', cast(o_custkey AS string)) AS plan_id",
            "cast(o_custkey % 3 AS int) AS revision",
            "concat('r', cast(o_orderkey AS string)) AS region_id",
            "cast((o_orderkey * 7) % 900 AS int) AS x1", "cast((o_orderkey * 11) % 700 AS int) AS y1",
            "cast((o_orderkey * 7) % 900 + 30 + o_orderkey % 60 AS int) AS x2",
            "cast((o_orderkey * 11) % 700 + 20 + o_orderkey % 70 AS int) AS y2",
            "CASE WHEN o_orderkey % 4 = 3 THEN 'manual' ELSE 'automatic' END AS provenance",
            "CASE WHEN o_orderkey % 5 = 1 THEN 'remove' ELSE 'retain' END AS action",
            "CASE WHEN o_orderkey % 8 = 3 THEN cast(NULL AS string) WHEN o_orderkey % 2 = 0 THEN 'face'"
            " ELSE 'phone' END AS detection_type",
            "CASE WHEN o_orderkey % 4 = 3 THEN cast(NULL AS double)"
            " ELSE cast(o_orderkey % 100 AS double) / 100 END AS confidence",
            "o_orderkey % 4 <> 3 AND o_orderkey % 6 = 2 AS geometry_modified",
        ),
    ),
)
# Regions with faults, and plans with faults.
BAD_REGIONS = Derived(
    "orders",
    (
        (
            "concat('p', cast(o_custkey AS string)) AS plan_id", "cast(o_custkey % 3 AS int) AS revision",
            "o_orderkey AS k",
            "CASE WHEN o_orderkey % 19 = 0 THEN '  ' ELSE concat('r', cast(o_orderkey AS string)) END AS region_id",
            "cast(o_orderkey % 990 AS int) AS x1", "cast(o_orderkey % 700 - 3 AS int) AS y1",
            "cast(o_orderkey % 990 + o_orderkey % 30 AS int) AS x2", "cast(o_orderkey % 700 + 50 AS int) AS y2",
            "CASE WHEN o_orderkey % 23 = 1 THEN 'robot' WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'automatic' END AS provenance",
            "CASE WHEN o_orderkey % 29 = 2 THEN 'keep' ELSE 'retain' END AS action",
            "CASE WHEN o_orderkey % 31 = 3 THEN 'iban' WHEN o_orderkey % 5 = 0 THEN cast(NULL AS string) ELSE 'face' END AS detection_type",
            "CASE WHEN o_orderkey % 4 = 0 THEN cast(NULL AS double) ELSE cast(o_orderkey % 130 AS double) / 100 END AS confidence",
            "o_orderkey % 7 = 0 AS geometry_modified",
        ),
    ),
)
BAD_PLANS = Derived(
    "customer",
    (
        (
            "c_custkey",
            "CASE WHEN c_custkey % 50 = 9 THEN ' ' ELSE concat('p', cast(c_custkey AS string)) END AS plan_id",
            "cast(c_custkey % 20 - 1 AS int) AS revision",
            "CASE WHEN c_custkey % 9 = 4 THEN 'zz' WHEN c_custkey % 9 = 5 THEN repeat('0A', 32)"
            " ELSE repeat('0a', 32) END AS source_sha256",
            "cast(c_custkey % 40 AS int) AS image_width", "cast(800 AS int) AS image_height",
            "cast(c_custkey % 13 - 1 AS int) AS redaction_margin", "cast(c_custkey % 11 AS int) AS max_redaction_passes",
        ),
    ),
)


def _boxed(derived, spark, sf):
    return derived.df(spark, sf).withColumn("bbox", make_bbox("x1", "y1", "x2", "y2"))


def region_violations(spark, sf):
    return R.region_violations(_boxed(BAD_REGIONS, spark, sf), PLANS.df(spark, sf)).select(
        "plan_id", "region_id", "rule"
    )


_REGION_RULES = {
    "blank_region_id": "trim(region_id) = ''",
    "unknown_provenance": "provenance NOT IN ('automatic', 'manual')",
    "unknown_action": "action NOT IN ('retain', 'remove')",
    "unknown_type": "detection_type = 'iban'",
    "automatic_without_type_or_confidence": "provenance = 'automatic' AND (detection_type IS NULL OR confidence IS NULL)",
    "manual_with_confidence": "provenance = 'manual' AND confidence IS NOT NULL",
    "manual_geometry_modified": "provenance = 'manual' AND geometry_modified",
    "confidence_out_of_range": "confidence > 1 OR confidence < 0",
    "invalid_box": "x1 < 0 OR y1 < 0 OR x2 <= x1 OR y2 <= y1",
    "outside_image": "x1 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1 AND (x2 > 1000 OR y2 > 800)",
}
REGION_VIOLATIONS_SQL = " UNION ALL ".join(
    f"SELECT plan_id, region_id, '{name}' AS rule FROM {BAD_REGIONS.sql()} WHERE {rule}"
    for name, rule in _REGION_RULES.items()
)


def plan_violations(spark, sf):
    return R.plan_violations(BAD_PLANS.df(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


_PLAN_RULES = {
    "blank_plan_id": "trim(plan_id) = ''",
    "negative_revision": "revision < 0",
    "bad_fingerprint": "source_sha256 = 'zz'",
    "empty_image": "image_width <= 0",
    "negative_margin": "redaction_margin < 0",
    "no_pass_allowed": "max_redaction_passes < 1",
}
PLAN_VIOLATIONS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) AS n FROM {BAD_PLANS.sql()} WHERE {rule} HAVING count(*) > 0"
    for name, rule in _PLAN_RULES.items()
)


def source_mismatches(spark, sf):
    plans = PLANS.df(spark, sf)
    files = plans.select(
        "plan_id",
        F.when(F.col("c_custkey") % 7 == 1, F.repeat(F.lit("0b"), 32)).otherwise(F.col("source_sha256")).alias("source_sha256"),
        (F.col("image_width") + F.when(F.col("c_custkey") % 5 == 2, 1).otherwise(0)).alias("image_width"),
        "image_height",
    ).filter(F.col("c_custkey") % 11 != 3)  # some files are missing
    return R.source_mismatches(plans, files).select("plan_id")


# --- revisions --------------------------------------------------------------

_EXPECTED = "cast(o_custkey % 3 + CASE WHEN o_custkey % 10 = 7 THEN 1 ELSE 0 END AS int) AS expected_revision"
DECISIONS = Derived(
    "orders",
    (
        (
            "o_orderkey", "concat('p', cast(o_custkey AS string)) AS plan_id", _EXPECTED,
            "concat('r', cast(o_orderkey + CASE WHEN o_orderkey % 97 = 6 THEN 10000000 ELSE 0 END AS string)) AS region_id",
            "CASE WHEN o_orderkey % 201 = 0 THEN 'keep' WHEN o_orderkey % 2 = 0 THEN 'remove' ELSE 'retain' END AS action",
        ),
    ),
    "o_orderkey % 3 = 0",
)
REPEATED = Derived("orders", DECISIONS.steps, "o_orderkey % 51 = 0")
MOVES = Derived(
    "orders",
    (
        (
            "o_orderkey", "concat('p', cast(o_custkey AS string)) AS plan_id", _EXPECTED,
            "concat('r', cast(o_orderkey + CASE WHEN o_orderkey % 89 = 1 THEN 10000000 ELSE 0 END AS string)) AS region_id",
            "cast((o_orderkey * 7) % 900 + CASE WHEN o_orderkey % 8 = 1 THEN 3 ELSE 0 END AS int) AS x1",
            # some move in y only, some change their size only
            "cast((o_orderkey * 11) % 700 + CASE WHEN o_orderkey % 16 = 5 THEN 2 ELSE 0 END AS int) AS y1",
            "cast((o_orderkey * 7) % 900 + 30 + o_orderkey % 60 + CASE WHEN o_orderkey % 113 = 5 THEN 900 WHEN o_orderkey % 32 = 13 THEN 2 ELSE 0 END AS int) AS x2",
            "cast((o_orderkey * 11) % 700 + 20 + o_orderkey % 70 + CASE WHEN o_orderkey % 127 = 9 THEN -200 WHEN o_orderkey % 16 = 5 THEN 2 ELSE 0 END AS int) AS y2",
        ),
    ),
    "o_orderkey % 4 = 1",
)
MANUAL = Derived(
    "customer",
    (
        (
            "c_custkey", "concat('p', cast(c_custkey AS string)) AS plan_id",
            "cast(c_custkey % 3 AS int) AS expected_revision", "cast(1 AS int) AS request_no",
            "cast(10 AS int) AS x1", "cast(20 AS int) AS y1", "cast(CASE WHEN c_custkey % 34 = 0 THEN 10 WHEN c_custkey % 38 = 0 THEN 1001 ELSE 110 + c_custkey % 9 END AS int) AS x2", "cast(60 AS int) AS y2",
            "CASE WHEN c_custkey % 46 = 0 THEN 'iban' WHEN c_custkey % 4 = 0 THEN 'signature' ELSE cast(NULL AS string) END AS detection_type",
        ),
    ),
    "c_custkey % 2 = 0",
)
DECISIONS_SQL = f"(SELECT * FROM {DECISIONS.sql()} UNION ALL SELECT * FROM {REPEATED.sql()}) AS decisions"


def _changes(spark, sf):
    decisions = DECISIONS.df(spark, sf).unionByName(REPEATED.df(spark, sf))
    return decisions, _boxed(MOVES, spark, sf), _boxed(MANUAL, spark, sf)


def revision_violations(spark, sf):
    return R.revision_violations(
        PLANS.df(spark, sf), REGIONS.df(spark, sf), *_changes(spark, sf)
    ).select("plan_id", "region_id", "reason")


VIOLATIONS = f"""(
      SELECT DISTINCT q.plan_id, cast(NULL AS varchar) AS region_id,
        CASE WHEN p.plan_id IS NULL THEN 'unknown_plan' ELSE 'stale_revision' END AS reason
      FROM (SELECT plan_id, expected_revision FROM {DECISIONS_SQL} UNION SELECT plan_id, expected_revision FROM {MOVES.sql()}
        UNION SELECT plan_id, expected_revision FROM {MANUAL.sql()}) AS q
      LEFT JOIN {PLANS.sql()} AS p ON p.plan_id = q.plan_id
      WHERE p.plan_id IS NULL OR p.revision <> q.expected_revision
      UNION ALL SELECT plan_id, region_id, 'duplicate_decision' FROM {DECISIONS_SQL} GROUP BY plan_id, region_id HAVING count(*) > 1
      UNION ALL SELECT DISTINCT plan_id, region_id, 'unknown_decision_region' FROM {DECISIONS_SQL}
        WHERE (plan_id, region_id) NOT IN (SELECT (plan_id, region_id) FROM {REGIONS.sql()})
      UNION ALL SELECT DISTINCT plan_id, region_id, 'unknown_geometry_update_region' FROM {MOVES.sql()}
        WHERE (plan_id, region_id) NOT IN (SELECT (plan_id, region_id) FROM {REGIONS.sql()})
      UNION ALL SELECT DISTINCT plan_id, region_id, 'unknown_action' FROM {DECISIONS_SQL} WHERE action = 'keep'
      UNION ALL SELECT plan_id, region_id, 'outside_image' FROM {MOVES.sql()} WHERE x2 > 1000 AND y2 > y1
      UNION ALL SELECT plan_id, region_id, 'invalid_box' FROM {MOVES.sql()} WHERE y2 <= y1 OR y2 < 0
      UNION ALL SELECT plan_id, NULL, 'invalid_box' FROM {MANUAL.sql()} WHERE x2 <= x1
      UNION ALL SELECT plan_id, NULL, 'outside_image' FROM {MANUAL.sql()} WHERE x2 > 1000
      UNION ALL SELECT plan_id, NULL, 'unknown_type' FROM {MANUAL.sql()} WHERE detection_type = 'iban') AS violations""".replace(
    "AS s0 AS p", "AS p"
)


def _revised(spark, sf):
    return R.revise_plans(
        PLANS.df(spark, sf), _boxed(REGIONS, spark, sf).drop("x1", "y1", "x2", "y2"), *_changes(spark, sf)
    )


def revised_regions(spark, sf):
    return _revised(spark, sf)[1].select(
        "plan_id", F.col("revision").cast("long").alias("revision"), "region_id", *flat_box(),
        "provenance", "action", "detection_type", "confidence", "geometry_modified",
    )


ACCEPTED = f"""accepted AS MATERIALIZED (SELECT plan_id FROM (SELECT plan_id FROM {DECISIONS_SQL}
        UNION SELECT plan_id FROM {MOVES.sql()} UNION SELECT plan_id FROM {MANUAL.sql()}) AS q
      WHERE plan_id NOT IN (SELECT plan_id FROM {VIOLATIONS}))"""
REVISED_SQL = f"""
    WITH {ACCEPTED}, d AS (SELECT * FROM {DECISIONS_SQL}), m AS (SELECT * FROM {MOVES.sql()}),
    r AS (SELECT * FROM {REGIONS.sql()} WHERE plan_id IN (SELECT plan_id FROM accepted))
    SELECT r.plan_id, cast(r.revision + 1 AS bigint) AS revision, r.region_id,
      cast(coalesce(m.x1, r.x1) AS bigint) AS x1, cast(coalesce(m.y1, r.y1) AS bigint) AS y1,
      cast(coalesce(m.x2, r.x2) AS bigint) AS x2, cast(coalesce(m.y2, r.y2) AS bigint) AS y2,
      r.provenance, coalesce(d.action, r.action) AS action, r.detection_type, r.confidence,
      r.geometry_modified OR (r.provenance = 'automatic' AND m.x1 IS NOT NULL
        AND (m.x1 <> r.x1 OR m.y1 <> r.y1 OR m.x2 <> r.x2 OR m.y2 <> r.y2)) AS geometry_modified
    FROM r LEFT JOIN d ON d.plan_id = r.plan_id AND d.region_id = r.region_id
    LEFT JOIN m ON m.plan_id = r.plan_id AND m.region_id = r.region_id
    UNION ALL
    SELECT plan_id, cast(expected_revision + 1 AS bigint),
      concat('manual-', substr(sha256(concat_ws('|', plan_id, expected_revision, request_no)), 1, 32)), x1, y1, x2, y2,
      'manual', 'retain', detection_type, NULL, false
    FROM {MANUAL.sql()} WHERE plan_id IN (SELECT plan_id FROM accepted)"""


def revised_plans(spark, sf):
    return _revised(spark, sf)[0].select("plan_id", F.col("revision").cast("long").alias("revision"))


# --- counts and overrides ---------------------------------------------------


def plan_counts(spark, sf):
    return R.plan_counts(REGIONS.df(spark, sf)).drop("revision")


COUNTS = f"""(SELECT plan_id, count_if(action = 'retain')::bigint AS active_region_count,
      count_if(provenance = 'automatic' AND action = 'remove')::bigint AS automatic_removal_count,
      count_if(provenance = 'automatic' AND geometry_modified)::bigint AS automatic_geometry_adjustment_count,
      count_if(provenance = 'manual' AND action = 'retain')::bigint AS manual_addition_count
      FROM {REGIONS.sql()} GROUP BY plan_id) AS counts"""

# What the verifier reports, partly where regions are.
FOUND = Derived(
    "orders",
    (
        (
            "o_orderkey", "concat('p', cast(o_custkey AS string)) AS plan_id",
            "cast(1 + (o_orderkey * 5) % 17 % 3 AS int) AS pass_no",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'face' ELSE 'phone' END AS detection_type",
            "(o_orderkey * 7) % 900 + CASE WHEN o_orderkey % 3 = 0 THEN 25 ELSE 0 END AS a",
            "(o_orderkey * 11) % 700 AS b",
        ),
        (
            "o_orderkey", "plan_id", "pass_no", "detection_type",
            "cast(a AS int) AS x1", "cast(b AS int) AS y1",
            "cast(a + 30 + o_orderkey % 60 AS int) AS x2", "cast(b + 20 + o_orderkey % 70 AS int) AS y2",
            "cast(o_orderkey % 100 AS double) / 100 AS confidence",
        ),
    ),
)


def _found(spark, sf):
    return _boxed(FOUND, spark, sf).select("plan_id", "pass_no", "detection_type", "bbox", "confidence")


def blocked_detections(spark, sf):
    blocked = R.blocked_by_removal(_found(spark, sf), _boxed(REGIONS, spark, sf), PLANS.df(spark, sf))
    return blocked.select("plan_id", "detection_type", *flat_box())


BLOCKED = f"""(SELECT DISTINCT f.plan_id, f.detection_type, f.x1, f.y1, f.x2, f.y2
      FROM (SELECT * FROM {FOUND.sql()}) AS f JOIN (SELECT * FROM {REGIONS.sql()}) AS r
        ON r.plan_id = f.plan_id AND r.detection_type = f.detection_type
      WHERE r.provenance = 'automatic' AND r.action = 'remove'
        AND f.x1 < least(1000, r.x2 + 5) AND greatest(0, r.x1 - 5) < f.x2
        AND f.y1 < least(800, r.y2 + 5) AND greatest(0, r.y1 - 5) < f.y2) AS blocked"""


def _exports(spark, sf):
    return export_reviewed(PLANS.df(spark, sf), _boxed(REGIONS, spark, sf), _found(spark, sf))


def reviewed_exports(spark, sf):
    exported = _exports(spark, sf)
    return exported.select(
        "plan_id",
        *(F.col(c).cast("long").alias(c) for c in ("plan_revision", "redaction_passes", "remediation_count")),
        "remaining_count", "detectors_clear", "applied_region_count", "automatic_removal_count",
        "automatic_geometry_adjustment_count", "manual_addition_count", "status",
    )


_BOX = "x1, y1, x2, y2"
EXPORTS = f"""
    f AS MATERIALIZED (SELECT * FROM {FOUND.sql()}),
    known AS MATERIALIZED (SELECT plan_id, detection_type, {_BOX} FROM {REGIONS.sql()}
      WHERE action = 'retain' AND detection_type IS NOT NULL AND confidence IS NOT NULL
      UNION SELECT * FROM {BLOCKED}),
    fresh AS (SELECT plan_id, detection_type, {_BOX}, min(pass_no) AS p FROM f
      WHERE (plan_id, detection_type, {_BOX}) NOT IN (SELECT (plan_id, detection_type, {_BOX}) FROM known)
      GROUP BY plan_id, detection_type, {_BOX}),
    n AS (SELECT plan_id, count(*) FILTER (p = 1) AS n1, count(*) FILTER (p = 2) AS n2 FROM fresh GROUP BY plan_id),
    staged AS (SELECT pl.*, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2,
      CASE WHEN max_redaction_passes = 1 OR coalesce(n1, 0) = 0 THEN 1
        WHEN max_redaction_passes = 2 OR coalesce(n2, 0) = 0 THEN 2 ELSE 3 END AS passes
      FROM (SELECT * FROM {PLANS.sql()}) AS pl LEFT JOIN n ON n.plan_id = pl.plan_id),
    verified AS (SELECT s.plan_id, s.c_custkey, s.revision, s.passes,
      CASE s.passes WHEN 1 THEN 0 WHEN 2 THEN n1 ELSE n1 + n2 END AS remediation_count, count(f.plan_id) AS remaining_count
      FROM staged s LEFT JOIN f ON f.plan_id = s.plan_id AND f.pass_no = s.passes GROUP BY ALL),
    exports AS (SELECT v.plan_id, v.c_custkey, cast(v.revision AS bigint) AS plan_revision, cast(passes AS bigint) AS redaction_passes,
      cast(remediation_count AS bigint) AS remediation_count, remaining_count, remaining_count = 0 AS detectors_clear,
      coalesce(active_region_count, 0) AS applied_region_count, coalesce(automatic_removal_count, 0) AS automatic_removal_count,
      coalesce(automatic_geometry_adjustment_count, 0) AS automatic_geometry_adjustment_count,
      coalesce(manual_addition_count, 0) AS manual_addition_count,
      CASE WHEN remaining_count > 0 THEN 'review_required'
        WHEN coalesce(automatic_removal_count, 0) + coalesce(automatic_geometry_adjustment_count, 0) > 0
        THEN 'verified_with_human_overrides' ELSE 'passed' END AS status
      FROM verified v LEFT JOIN {COUNTS} ON counts.plan_id = v.plan_id)"""
EXPORTS_SQL = f"WITH {EXPORTS} SELECT * EXCLUDE (c_custkey) FROM exports"

# --- sessions ---------------------------------------------------------------

_SESSION = "concat('s', cast(c_custkey % 50 AS string)) AS session_id"
_PAGE = "cast((c_custkey - c_custkey % 50) / 50 + 1 AS int) AS page_number"
PAGES = Derived("customer", ((_SESSION, _PAGE, "c_custkey", "concat('p', cast(c_custkey AS string)) AS plan_id"),))
EXPECTED = Derived(
    "customer",
    ((
        _SESSION,
        "cast((c_custkey - c_custkey % 50) / 50 + 1 + CASE WHEN c_custkey % 410 = 2 THEN 1000 ELSE 0 END AS int) AS page_number",
        "cast(c_custkey % 3 + CASE WHEN c_custkey % 290 = 3 THEN 1 ELSE 0 END AS int) AS revision", "c_custkey",
    ),),
    "c_custkey % 370 <> 1",
)


def _gate_tables(spark, sf):
    pages = PAGES.df(spark, sf)
    plans = pages.filter("c_custkey % 310 <> 0").select(
        "session_id", "page_number", (F.col("c_custkey") % 3).cast("int").alias("revision")
    )
    expected = EXPECTED.df(spark, sf)
    expected = expected.unionByName(expected.filter("c_custkey % 430 = 7"))  # named twice
    return pages, plans, expected.drop("c_custkey")


def export_gate(spark, sf):
    return R.export_gate(*_gate_tables(spark, sf)).select(
        "session_id", F.col("page_number").cast("long").alias("page_number"), "reason"
    )


GATE = f"""(SELECT coalesce(h.session_id, w.session_id) AS session_id,
      cast(coalesce(h.page_number, w.page_number) AS bigint) AS page_number,
      CASE WHEN h.session_id IS NULL THEN 'unknown_page' WHEN w.session_id IS NULL THEN 'missing_page'
        WHEN w.n > 1 THEN 'duplicate_page' WHEN h.c_custkey % 310 = 0 THEN 'not_analyzed' WHEN h.c_custkey % 3 <> w.revision THEN 'stale_revision' END AS reason
      FROM (SELECT * FROM {PAGES.sql()}) AS h FULL JOIN (SELECT session_id, page_number, max(revision) AS revision, count(*) AS n
        FROM (SELECT * FROM {EXPECTED.sql()} UNION ALL SELECT * FROM {EXPECTED.sql()} WHERE c_custkey % 430 = 7) AS e
        GROUP BY session_id, page_number) AS w
        ON w.session_id = h.session_id AND w.page_number = h.page_number) AS gate"""


def _documents(pages):
    number = F.regexp_extract("session_id", r"\d+", 0).cast("int")
    return pages.select("session_id").distinct().select(
        "session_id",
        F.when(number % 3 == 0, F.lit(None)).otherwise(number % 3 == 1).cast("boolean").alias("text_layer_empty"),
    )


def _page_exports(spark, sf):
    """Results by page, some of them without a verdict."""
    pages = PAGES.df(spark, sf)
    joined = _exports(spark, sf).join(pages.select("plan_id", "session_id", "page_number", "c_custkey"), "plan_id")
    unknown = F.col("c_custkey") % 100 == 11
    return pages, joined.withColumns(
        {
            "detectors_clear": F.when(unknown, None).otherwise(F.col("detectors_clear")),
            "status": F.when(F.col("c_custkey") % 100 == 61, None).otherwise(F.col("status")),
        }
    )


def document_exports(spark, sf):
    pages, exports = _page_exports(spark, sf)
    return R.document_export(exports, _documents(pages)).withColumn(
        "plan_revision", F.col("plan_revision").cast("long")
    )


_SUMMED = (
    "redaction_passes", "automatic_removal_count", "automatic_geometry_adjustment_count",
    "manual_addition_count", "applied_region_count", "remaining_count",
)
DOCUMENTS = f"""
    rolled AS (SELECT concat('s', c_custkey % 50) AS session_id, c_custkey % 50 % 3 AS t, count(*) AS page_count,
      bool_and(detectors_clear AND c_custkey % 100 NOT IN (11, 61)) AS detectors_clear, bool_or(status = 'verified_with_human_overrides') AS o,
      max(plan_revision) AS plan_revision, {", ".join(f"sum({c})::bigint AS {c}" for c in _SUMMED)}
      FROM exports GROUP BY c_custkey % 50),
    documents AS (SELECT *, CASE WHEN NOT detectors_clear OR t = 2 THEN 'review_required'
        WHEN o THEN 'verified_with_human_overrides' ELSE 'passed' END AS status,
      CASE t WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS text_layer_empty FROM rolled)"""
DOCUMENTS_SQL = f"""WITH {EXPORTS}, {DOCUMENTS}
    SELECT * EXCLUDE (t, o), status = 'passed' AS passed FROM documents"""


def exported_sessions(spark, sf):
    """Some pages have no result, some the result of an older plan."""
    pages, exports = _page_exports(spark, sf)
    stale = F.col("plan_revision") + F.when(F.col("c_custkey") % 150 == 9, 1).otherwise(0)
    exports = exports.filter("c_custkey % 150 <> 7").withColumn("plan_revision", stale)
    gate_pages, plans, expected = _gate_tables(spark, sf)
    return export_sessions(gate_pages, plans, expected, exports, _documents(pages)).select(
        "session_id", "page_count", "missing_page_count", "status", "passed"
    )


_NOT_GATED = f"session_id NOT IN (SELECT session_id FROM {GATE} WHERE reason IS NOT NULL)"
EXPORTED_SQL = f"""WITH {EXPORTS}, pages AS (SELECT e.*, concat('s', c_custkey % 50) AS session_id,
      c_custkey % 150 IN (7, 9) AS missing, c_custkey % 100 IN (11, 61) AS unknown FROM exports e),
    rolled AS (SELECT session_id, count(*) AS page_count, count(*) FILTER (missing) AS missing_page_count,
      bool_and(detectors_clear AND NOT missing AND NOT unknown) AS clear,
      bool_or(status = 'verified_with_human_overrides' AND NOT missing AND NOT unknown) AS o, any_value(c_custkey % 50 % 3) AS t
      FROM pages WHERE {_NOT_GATED} GROUP BY session_id)
    SELECT session_id, page_count, missing_page_count, CASE WHEN NOT clear OR t = 2 THEN 'review_required'
      WHEN o THEN 'verified_with_human_overrides' ELSE 'passed' END AS status,
      clear AND t <> 2 AND NOT o AS passed FROM rolled"""


# --- exports to the end -----------------------------------------------------


def _sources(plans, changed):
    """The files of the plans; ``changed`` picks those with other bytes."""
    digest = F.when(changed, F.repeat(F.lit("0b"), 32)).otherwise(F.col("source_sha256"))
    return plans.select("plan_id", digest.alias("source_sha256"), "image_width", "image_height")


def _gated(spark, sf):
    plans = PLANS.df(spark, sf)
    key = F.col("c_custkey")
    return plans, _sources(plans, key % 7 == 1).filter("c_custkey % 11 <> 3"), _sources(plans, key % 13 == 2)


def source_gate(spark, sf):
    return gate_of_sources(*_gated(spark, sf)).select("plan_id", "reason")


_GATED = "CASE WHEN c_custkey % 7 = 1 OR c_custkey % 11 = 3 THEN 'source_changed' WHEN c_custkey % 13 = 2 THEN 'source_changed_during_export' END"


def gated_exports(spark, sf):
    plans, before, after = _gated(spark, sf)
    exported = export_reviewed(plans, _boxed(REGIONS, spark, sf), _found(spark, sf), before, after)
    return exported.select("plan_id", F.col("redaction_passes").cast("long").alias("redaction_passes"), "status")


def _export_tables(spark, sf):
    return PLANS.df(spark, sf), _boxed(REGIONS, spark, sf), _found(spark, sf), _exports(spark, sf)


def export_detections(spark, sf):
    """What each export remediated and what it left, by page."""
    rows = export_detections_by_page(*_export_tables(spark, sf), PAGES.df(spark, sf))
    return rows.select(
        "session_id", F.col("page_number").cast("long").alias("page_number"), "outcome",
        F.col("pass_no").cast("long").alias("pass_no"), "detection_type", *flat_box(), "confidence",
    )


_REMEDIATED = f"""SELECT f.plan_id, f.pass_no, f.detection_type, f.x1, f.y1, f.x2, f.y2, max(f.confidence) AS confidence
      FROM f JOIN fresh n ON n.plan_id = f.plan_id AND n.detection_type = f.detection_type AND n.p = f.pass_no
        AND n.x1 = f.x1 AND n.y1 = f.y1 AND n.x2 = f.x2 AND n.y2 = f.y2
      JOIN exports x ON x.plan_id = f.plan_id WHERE n.p < x.redaction_passes GROUP BY ALL"""
BY_PAGE_SQL = f"""WITH {EXPORTS}
    SELECT session_id, cast(page_number AS bigint) AS page_number, outcome, cast(pass_no AS bigint) AS pass_no,
      detection_type, {BOX_SQL}, confidence FROM (
      SELECT 'remediated' AS outcome, r.* FROM ({_REMEDIATED}) AS r
      UNION ALL SELECT 'remaining', f.plan_id, f.pass_no, f.detection_type, f.x1, f.y1, f.x2, f.y2, f.confidence
      FROM f JOIN exports x ON x.plan_id = f.plan_id AND x.redaction_passes = f.pass_no) AS d
    JOIN (SELECT * FROM {PAGES.sql()}) AS pg ON pg.plan_id = d.plan_id"""


def export_rectangles(spark, sf):
    rows = rectangles_of_exports(*_export_tables(spark, sf))
    return rows.select(
        "plan_id", "origin", "region_id", "detection_type",
        *(F.col(f"rect.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), "covered", "valid",
    )


RECTANGLES_SQL = f"""WITH {EXPORTS}, painted AS (
      SELECT plan_id, 'plan' AS origin, region_id, detection_type, x1, y1, x2, y2 FROM {REGIONS.sql()} WHERE action = 'retain'
      UNION ALL SELECT plan_id, 'remediation', NULL, detection_type, x1, y1, x2, y2 FROM ({_REMEDIATED}) AS r),
    grown AS (SELECT plan_id, origin, region_id, detection_type, cast(greatest(0, x1 - 5) AS bigint) AS x1,
      cast(greatest(0, y1 - 5) AS bigint) AS y1, cast(least(1000, x2 + 5) AS bigint) AS x2, cast(least(800, y2 + 5) AS bigint) AS y2 FROM painted)
    SELECT *, (least(999, x2) - x1 + 1) * (least(799, y2) - y1 + 1) AS covered, true AS valid FROM grown
    WHERE plan_id IN (SELECT plan_id FROM exports)"""


LOG = Derived(
    "events",
    ((
        "concat('s', cast(user_id AS string)) AS session_id", "cast(event_id % 3 + 1 AS int) AS page_number",
        "event_id AS seq", "cast(event_id % 7 AS int) AS revision", "event_type", "user_id",
    ),),
)


def current_plans(spark, sf):
    log = LOG.df(spark, sf).filter("event_type IN ('click', 'view')")
    return R.current_plans(log).select(
        "session_id", F.col("page_number").cast("long").alias("page_number"),
        F.col("revision").cast("long").alias("revision"), "seq",
    )


def session_states(spark, sf):
    log = LOG.df(spark, sf)
    plans = log.filter("event_type IN ('click', 'view') AND user_id % 4 <> 1")
    exports = log.filter("event_type = 'purchase' AND user_id % 4 <> 2")
    return R.session_states(log, plans, exports)


STATES_SQL = f"""
    SELECT session_id, count(DISTINCT page_number) AS page_count,
      CASE WHEN coalesce(max(seq) FILTER (event_type = 'purchase' AND user_id % 4 <> 2), -1)
          > max(seq) FILTER (event_type IN ('click', 'view') AND user_id % 4 <> 1) THEN 'exported'
        WHEN max(seq) FILTER (event_type IN ('click', 'view') AND user_id % 4 <> 1) IS NOT NULL THEN 'analyzed'
        ELSE 'uploaded' END AS state
    FROM {LOG.sql()} GROUP BY session_id"""


def remaining_sessions(spark, sf):
    log = LOG.df(spark, sf)
    deleted = log.filter("event_type = 'error' AND seq % 31 = 0").select("session_id")
    return R.delete_sessions(log, deleted).select("session_id", "seq")


def duplicate_lines(spark, sf):
    return D.duplicate_keys(load_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "n"
    )


def region_labels(spark, sf):
    return REGIONS.df(spark, sf).select(
        "region_id", R.region_label("detection_type", "provenance").alias("label")
    )


LABELS_SQL = f"""
    SELECT region_id, CASE detection_type WHEN 'face' THEN 'Face' WHEN 'phone' THEN 'Phone number'
      ELSE CASE provenance WHEN 'manual' THEN 'Manual privacy region' ELSE 'Detection' END END AS label FROM {REGIONS.sql()}"""


def status_labels(spark, sf):
    shown = _exports(spark, sf).select("plan_id", R.status_presentation("status").alias("s"))
    return shown.select("plan_id", "s.eyebrow", "s.title", "s.description", "s.tone", "s.download_label")


# The texts are fixed values of the operator; SQL gets them from there.
_STATUS_ROWS = ", ".join(
    "(" + ", ".join("'" + text.replace("'", "''") + "'" for text in (status, *shown)) + ")"
    for status, shown in R.STATUS_PRESENTATION.items()
)
STATUS_LABELS_SQL = f"""WITH {EXPORTS}
    SELECT plan_id, t.eyebrow, t.title, t.description, t.tone, t.download_label FROM exports JOIN
      (VALUES {_STATUS_ROWS}) AS t(status, eyebrow, title, description, tone, download_label) ON t.status = exports.status"""


def analyzed_plans(spark, sf):
    """Revision 0 of the plans of pages derived from orders."""
    found = _boxed(REGIONS, spark, sf).filter("provenance = 'automatic' AND detection_type IS NOT NULL").select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no"), "o_orderkey", "bbox", "detection_type", "confidence"
    )
    keys = ["doc_id", "page_no"]
    pages = PLANS.df(spark, sf).select(
        F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page_no"), "source_sha256", "image_width", "image_height"
    )
    plans, regions = plans_from_detections(pages, number_regions(found, keys, "o_orderkey"), keys)
    joined = plans.join(regions, ["plan_id", "revision"])
    return joined.select(
        "doc_id", "plan_id", F.col("revision").cast("long").alias("revision"), "region_id", *flat_box(),
        "detection_type", "confidence", "action", "provenance",
    )


ANALYZED_SQL = f"""
    SELECT o_custkey AS doc_id, substr(sha256(concat_ws('|', o_custkey, 1)), 1, 32) AS plan_id, 0::bigint AS revision,
      printf('auto-%04d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS region_id, {BOX_SQL},
      detection_type, confidence, 'retain' AS action, 'automatic' AS provenance
    FROM {REGIONS.sql()} WHERE provenance = 'automatic' AND detection_type IS NOT NULL"""

QUERIES = {
    "region_violations": (region_violations, REGION_VIOLATIONS_SQL),
    "plan_violations": (plan_violations, PLAN_VIOLATIONS_SQL),
    "source_mismatches": (
        source_mismatches,
        "SELECT concat('p', c_custkey) AS plan_id FROM customer WHERE c_custkey % 7 = 1 OR c_custkey % 5 = 2 OR c_custkey % 11 = 3",
    ),
    "revision_violations": (revision_violations, f"SELECT * FROM {VIOLATIONS}"),
    "revised_regions": (revised_regions, REVISED_SQL),
    "revised_plans": (
        revised_plans,
        f"WITH {ACCEPTED} SELECT plan_id, cast(revision + 1 AS bigint) AS revision FROM {PLANS.sql()}"
        " WHERE plan_id IN (SELECT plan_id FROM accepted)",
    ),
    "plan_counts": (plan_counts, f"SELECT * FROM {COUNTS}"),
    "blocked_detections": (
        blocked_detections, f"SELECT plan_id, detection_type, {BOX_SQL} FROM {BLOCKED}",
    ),
    "reviewed_exports": (reviewed_exports, EXPORTS_SQL),
    "export_gate": (export_gate, f"SELECT * FROM {GATE} WHERE reason IS NOT NULL"),
    "document_exports": (document_exports, DOCUMENTS_SQL),
    "exported_sessions": (
        exported_sessions,
        EXPORTED_SQL,
    ),
    "source_gate": (
        source_gate,
        f"SELECT plan_id, {_GATED} AS reason FROM {PLANS.sql()} WHERE {_GATED} IS NOT NULL",
    ),
    "gated_exports": (
        gated_exports,
        f"WITH {EXPORTS} SELECT plan_id, redaction_passes, status FROM exports WHERE {_GATED} IS NULL",
    ),
    "export_detections": (export_detections, BY_PAGE_SQL),
    "export_rectangles": (export_rectangles, RECTANGLES_SQL),
    "current_plans": (
        current_plans,
        f"SELECT session_id, cast(page_number AS bigint) AS page_number, cast(arg_max(revision, seq) AS bigint) AS revision,"
        f" max(seq) AS seq FROM {LOG.sql()} WHERE event_type IN ('click', 'view') GROUP BY session_id, page_number",
    ),
    "session_states": (session_states, STATES_SQL),
    "remaining_sessions": (
        remaining_sessions,
        f"SELECT session_id, seq FROM {LOG.sql()} WHERE session_id NOT IN"
        f" (SELECT session_id FROM {LOG.sql()} WHERE event_type = 'error' AND seq % 31 = 0)",
    ),
    "duplicate_lines": (
        duplicate_lines,
        "SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, count(*) AS n FROM lineitem"
        " GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    ),
    "region_labels": (region_labels, LABELS_SQL),
    "status_labels": (status_labels, STATUS_LABELS_SQL),
    "analyzed_plans": (analyzed_plans, ANALYZED_SQL),
}
