"""Queries over whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilspan.functions.text import (
    dedupe_detections,
    find_emails,
    find_phones,
    find_structured,
    find_tckn,
    is_valid_tckn,
    merge_spans,
    normalize_digits,
    redact_text,
)
from veilspan.operators import detections as D
from veilspan.operators.batch import batch_summary
from veilspan.plans.publish import changed_contents, publish, read_contents, read_published
from veilspan.plans.text import applied_detections, sanitize_texts
from veilspan.session import ensure_checkpoint_dir, load_table
from veilspan.streaming.text import sanitize_stream, write_stream
from workload.common import (
    CARDS,
    SPAN_RULES,
    TEXTS_SQL,
    Derived,
    cards,
    detections_sql,
    documents,
    raw_spans_sql,
    redacted_sql,
    texts,
    valid_tckn_sql,
)

TYPES_SQL = (
    "(VALUES ('tckn'), ('phone'), ('email'), ('person'), ('address'), ('face'),"
    " ('signature')) AS types(detection_type)"
)
SPAN_COLUMNS = 'doc_id, detection_type, "start", "end", confidence'


def _spans(df):
    return D.explode_rows(df, ["doc_id"], F.col("found")).select(
        "doc_id",
        "d.detection_type",
        F.col("d.start").cast("long").alias("start"),
        F.col("d.end").cast("long").alias("end"),
        "d.confidence",
    )


def source_counts(spark, sf):
    found = documents(spark, sf).withColumn("found", find_structured("text"))
    return D.count_array_by_type(found, ["source"], "found").select(
        "source", "detection_type", F.col("n").cast("long").alias("n")
    )


SOURCE_COUNTS_SQL = f"""
    SELECT s.source, types.detection_type, count(f.doc_id) AS n
    FROM (SELECT DISTINCT source FROM documents) AS s CROSS JOIN {TYPES_SQL}
    LEFT JOIN (SELECT d.source, x.doc_id, x.detection_type FROM {detections_sql("documents")} AS x
      JOIN documents AS d ON d.doc_id = x.doc_id) AS f
      ON f.source = s.source AND f.detection_type = types.detection_type
    GROUP BY s.source, types.detection_type"""


def corpus_counts(spark, sf):
    found = texts(spark, sf).withColumn("found", find_structured("text"))
    return D.count_by_type(_spans(found)).select("detection_type", "n")


CORPUS_COUNTS_SQL = f"""
    SELECT types.detection_type, count(f.doc_id) AS n FROM {TYPES_SQL}
    LEFT JOIN {detections_sql(TEXTS_SQL)} AS f ON f.detection_type = types.detection_type
    GROUP BY types.detection_type"""


def missing_categories(spark, sf):
    found = cards(spark, sf).withColumn("found", find_structured("text"))
    counts = D.count_by_type(_spans(found))
    return D.missing_types(counts, ["tckn", "phone", "email", "person", "face"]).select(
        "detection_type", "n"
    )


MISSING_SQL = f"""
    SELECT types.detection_type, count(f.doc_id) AS n FROM {TYPES_SQL}
    LEFT JOIN {detections_sql(CARDS.sql())} AS f ON f.detection_type = types.detection_type
    WHERE types.detection_type IN ('tckn', 'phone', 'email', 'person', 'face')
    GROUP BY types.detection_type HAVING count(f.doc_id) = 0"""


def tckn_spans(spark, sf):
    return _spans(texts(spark, sf).withColumn("found", find_tckn("text")))


def phone_spans(spark, sf):
    return _spans(texts(spark, sf).withColumn("found", find_phones("text")))


def email_spans(spark, sf):
    return _spans(texts(spark, sf).withColumn("found", find_emails("text")))


def structured_spans(spark, sf):
    return _spans(texts(spark, sf).withColumn("found", find_structured("text")))


def redacted_web_pages(spark, sf):
    pages = load_table(spark, sf, "pages", spread=True).select("page_id", "html")
    found = pages.withColumn("found", find_structured("html"))
    return found.select(
        "page_id",
        redact_text("html", "found").alias("html"),
        F.size("found").cast("long").alias("n"),
    )


def redacted_turns(spark, sf):
    """Each turn is followed by the card of the customer with its conversation's number."""
    turns = load_table(spark, sf, "conversations", spread=True)
    joined = turns.join(cards(spark, sf).withColumnRenamed("text", "card"), turns.conv_id == F.col("doc_id"))
    found = joined.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
        F.concat("text", F.lit(" "), "card").alias("text"),
    ).withColumn("found", find_structured("text"))
    return found.select(
        "turn_id",
        redact_text("text", "found").alias("text"),
        F.size("found").cast("long").alias("n"),
    )


WEB_PAGES = "(SELECT page_id AS doc_id, html AS text FROM pages) AS web"
TURNS = (
    "(SELECT c.conv_id * 1000 + c.turn AS doc_id, concat(c.text, ' ', k.text) AS text"
    f" FROM conversations AS c JOIN (SELECT * FROM {CARDS.sql()}) AS k ON c.conv_id = k.doc_id) AS turns"
)


def _redacted_count_sql(source: str, key: str, text: str) -> str:
    return f"""
    WITH src AS MATERIALIZED (SELECT * FROM {source}),
    hits AS MATERIALIZED (SELECT * FROM {detections_sql("src")} AS x),
    n AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id)
    SELECT r.doc_id AS {key}, r.text AS {text}, coalesce(n.n, 0) AS n
    FROM {redacted_sql("src", "hits")} AS r LEFT JOIN n ON n.doc_id = r.doc_id"""


def number_checks(spark, sf):
    df = cards(spark, sf)
    return df.select(
        "doc_id",
        normalize_digits("text").alias("digits"),
        is_valid_tckn("tckn").alias("valid"),
        is_valid_tckn("phone").alias("phone_valid"),
    )


NUMBER_CHECKS_SQL = f"""
    SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits,
      {valid_tckn_sql("tckn")} AS valid,
      coalesce({valid_tckn_sql("regexp_replace(phone, '[^0-9]', '', 'g')")
        .replace("cast(substr", "try_cast(substr")}, false) AS phone_valid
    FROM {CARDS.sql()}"""


def deduplicated_spans(spark, sf):
    """The same hits twice, the second time with a lower and a shifted score."""
    found = texts(spark, sf).withColumn("once", find_structured("text"))
    weaker = F.transform(
        "once",
        lambda d: F.struct(
            d["start"].alias("start"),
            d["end"].alias("end"),
            d["detection_type"].alias("detection_type"),
            (d["confidence"] / 2 + F.when(d["start"] % 2 == 0, 0.75).otherwise(0.0)).alias("confidence"),
        ),
    )
    return _spans(found.withColumn("found", dedupe_detections(F.concat("once", weaker))))


DEDUPED_SQL = f"""
    SELECT doc_id, detection_type, "start", "end",
      greatest(confidence, confidence / 2 + CASE WHEN "start" % 2 = 0 THEN 0.75 ELSE 0.0 END::double)
        AS confidence
    FROM {detections_sql(TEXTS_SQL)} AS d"""


def deduplicated_rows(spark, sf):
    """Typed spans taken from order lines, many of them equal."""
    return D.dedupe_text(_line_spans(spark, sf), ["doc_id"]).select(
        "doc_id", "detection_type", "start", "end", "confidence"
    )


def _line_spans(spark, sf):
    return load_table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS doc_id",
        "CASE WHEN l_returnflag = 'A' THEN 'phone' WHEN l_returnflag = 'N' THEN 'person'"
        " ELSE 'email' END AS detection_type",
        "(l_partkey * 13) % 30011 AS start",
        "(l_partkey * 13) % 30011 + cast(l_quantity AS bigint) AS end",
        "l_discount * 5 + 0.25D AS confidence",
    )


LINE_SPANS = (
    "(SELECT l_suppkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'phone' WHEN l_returnflag = 'N'"
    " THEN 'person' ELSE 'email' END AS detection_type, (l_partkey * 13) % 30011 AS \"start\","
    " (l_partkey * 13) % 30011 + cast(l_quantity AS bigint) AS \"end\","
    " l_discount * 5 + 0.25::double AS confidence FROM lineitem) AS spans"
)


def merged_span_rows(spark, sf):
    return D.merge_span_rows(_line_spans(spark, sf), ["doc_id"]).select(
        "doc_id", "merged_start", "merged_end"
    )


MERGED_ROWS_SQL = f"""
    WITH reach AS (SELECT doc_id, "start" AS s, "end" AS e, max("end") OVER (PARTITION BY doc_id
        ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
      FROM {LINE_SPANS}),
    isles AS (SELECT doc_id, s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER
      (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM reach)
    SELECT doc_id, min(s) AS merged_start, max(e) AS merged_end FROM isles GROUP BY doc_id, n"""


def merged_spans_in_row(spark, sf):
    found = texts(spark, sf).withColumn("found", find_structured("text"))
    return D.explode_rows(found, ["doc_id"], merge_spans("found")).select(
        "doc_id",
        F.col("d.start").cast("long").alias("merged_start"),
        F.col("d.end").cast("long").alias("merged_end"),
    )


MERGED_IN_ROW_SQL = MERGED_ROWS_SQL.replace(LINE_SPANS, f"{detections_sql(TEXTS_SQL)} AS spans")


def redacted_texts(spark, sf):
    found = texts(spark, sf).withColumn("found", find_structured("text"))
    return found.select("doc_id", redact_text("text", "found").alias("text"))


REDACTED_SQL = f"SELECT doc_id, text FROM {redacted_sql(TEXTS_SQL, detections_sql(TEXTS_SQL))} AS r"


# Texts that need several looks: a telephone number hides the end of an address, the
# address keeps a label away from a number, and that number keeps it from the next one.
LAYERED = Derived(
    "customer",
    (
        (
            "c_custkey", "concat('n', cast(c_custkey AS string)) AS doc_id",
            "concat('TC ', repeat('a', 30), cast(c_custkey % 10 AS string), '.b@mail.example.com', '53212345', lpad(cast(c_custkey % 100 AS string), 2, '0'),"
            " CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' 1 2 3 4 5 6 7 8 9 0 1' END,"
            " CASE WHEN c_custkey % 3 = 2 THEN ';9 8 7 6 5 4 3 2 1 0 0' ELSE '' END, ' end') AS text",
        ),
        ("doc_id", "text", "c_custkey"),
    ),
    "c_custkey % 5 = 1",
)
LOOKED_AT_SQL = (
    f"(SELECT doc_id, text FROM {TEXTS_SQL} UNION ALL SELECT doc_id, text FROM {LAYERED.sql()}) AS looked_at"
)


def _sanitized(spark, sf):
    # few texts, but each of them takes every look, so they are dealt to all cores as well
    layered = LAYERED.df(spark, sf, spread=True).select("doc_id", "text")
    return sanitize_texts(texts(spark, sf).unionByName(layered))


def sanitized_texts(spark, sf):
    return _sanitized(spark, sf).select(
        "doc_id",
        "sanitized_text",
        F.col("redaction_passes").cast("long").alias("redaction_passes"),
        F.aggregate(
            "detections", F.lit(0).cast("long"), lambda n, d: n + F.size(d)
        ).alias("applied_count"),
        F.size("remaining").cast("long").alias("remaining_count"),
        "status",
    )


def _passes_sql(select: str, source: str = TEXTS_SQL) -> str:
    """Three passes; ``t0..t3`` hold the texts and ``d0..d3`` the detections."""
    return f"""
    WITH t0 AS MATERIALIZED (SELECT doc_id, text FROM {source}),
    d0 AS MATERIALIZED (SELECT * FROM {detections_sql("t0")} AS x),
    t1 AS MATERIALIZED (SELECT * FROM {redacted_sql("t0", "d0")} AS x),
    d1 AS MATERIALIZED (SELECT * FROM {detections_sql("t1")} AS x),
    t2 AS MATERIALIZED (SELECT * FROM {redacted_sql("t1", "d1")} AS x),
    d2 AS MATERIALIZED (SELECT * FROM {detections_sql("t2")} AS x),
    t3 AS MATERIALIZED (SELECT * FROM {redacted_sql("t2", "d2")} AS x),
    d3 AS MATERIALIZED (SELECT * FROM {detections_sql("t3")} AS x),
    n AS (SELECT doc_id, p, count(*) AS c FROM (
      SELECT doc_id, 0 AS p FROM d0 UNION ALL SELECT doc_id, 1 FROM d1
      UNION ALL SELECT doc_id, 2 FROM d2 UNION ALL SELECT doc_id, 3 FROM d3) AS u GROUP BY doc_id, p),
    w AS (SELECT t3.doc_id, t3.text,
        coalesce(sum(CASE WHEN p < 3 THEN 1 END), 0)::bigint AS redaction_passes,
        coalesce(sum(CASE WHEN p < 3 THEN c END), 0)::bigint AS applied_count,
        coalesce(sum(CASE WHEN p = 3 THEN c END), 0)::bigint AS remaining_count
      FROM t3 LEFT JOIN n ON n.doc_id = t3.doc_id GROUP BY t3.doc_id, t3.text)
    {select}"""


SANITIZED_SQL = _passes_sql(
    "SELECT doc_id, text AS sanitized_text, redaction_passes, applied_count, remaining_count,"
    " CASE WHEN remaining_count = 0 THEN 'passed' ELSE 'review_required' END AS status FROM w",
    LOOKED_AT_SQL,
)


def published_files(spark, sf):
    """Texts that were published, read back with the digests of the list of contents."""
    target = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    done = _sanitized(spark, sf).select("doc_id", "sanitized_text", (F.col("status") == "passed").alias("passed"))
    publish(done, target)
    listed = read_contents(spark, target).select("doc_id", F.col("sha256").alias("_listed"))
    changed = changed_contents(spark, target).select("doc_id")
    # digests are joined, not the texts they are made of
    rows = read_published(spark, target).select("doc_id", F.sha2(F.col("sanitized_text").cast("binary"), 256).alias("sha256"))
    return rows.join(listed, "doc_id").join(changed, "doc_id", "left_anti").select("doc_id", "sha256")


PUBLISHED_SQL = _passes_sql("SELECT doc_id, sha256(text) AS sha256 FROM w WHERE remaining_count = 0", LOOKED_AT_SQL)


def streamed_texts(spark, sf):
    """The documents as a stream of files, redacted into the shared folder."""
    # a pattern, as a stream takes a single file by a pattern only; the table may be a file or a folder
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{sf}/documents[.]parquet")
    base = f"{ensure_checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"
    done = sanitize_stream(stream)
    query = write_stream(done, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    # a stream without rows writes no file to take the schema from
    return spark.read.schema(done.schema).parquet(f"{base}/out").select(
        "doc_id", "sanitized_text", F.col("redaction_passes").cast("long").alias("redaction_passes"), "status"
    )


def applied_by_pass(spark, sf):
    return (
        applied_detections(_sanitized(spark, sf), ["doc_id"])
        .groupBy("pass_no", "detection_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))
        .select(F.col("pass_no").cast("long").alias("pass_no"), "detection_type", "n", "chars")
    )


APPLIED_SQL = _passes_sql(
    'SELECT p::bigint AS pass_no, detection_type, count(*) AS n, sum("end" - "start")::bigint AS chars'
    " FROM (SELECT 1 AS p, * FROM d0 UNION ALL SELECT 2, * FROM d1 UNION ALL SELECT 3, * FROM d2)"
    " AS a GROUP BY p, detection_type",
    LOOKED_AT_SQL,
)


def text_verification(spark, sf):
    """What a second look finds in texts redacted without their phone numbers."""
    first = texts(spark, sf).withColumn(
        "kept", F.filter(find_structured("text"), lambda d: d["detection_type"] != "phone")
    )
    again = first.select("doc_id", redact_text("text", "kept").alias("text")).withColumn(
        "found", find_structured("text")
    )
    return D.verification_report(again, _spans(again), ["doc_id"])


_KEPT = f"(SELECT * FROM {detections_sql(TEXTS_SQL)} AS x WHERE detection_type <> 'phone')"
VERIFICATION_SQL = f"""
    WITH again AS MATERIALIZED (SELECT * FROM {redacted_sql(TEXTS_SQL, _KEPT)} AS x)
    SELECT again.doc_id, count(d.doc_id) AS remaining_count, count(d.doc_id) = 0 AS passed
    FROM again LEFT JOIN {detections_sql("again")} AS d ON d.doc_id = again.doc_id
    GROUP BY again.doc_id"""


def batch_outcome(spark, sf):
    """One-pass batch; texts of one source count as unreadable."""
    done = sanitize_texts(documents(spark, sf), max_passes=1, keep_text=False)
    results = done.withColumn(
        "error", F.when(F.col("source") == "src3", "not valid UTF-8")
    ).withColumn("status", F.when(F.col("error").isNull(), F.col("status")))
    return batch_summary(results).select(
        "processed", "passed", "review_required", "failed",
        F.col("exit_code").cast("long").alias("exit_code"),
    )


BATCH_SQL = f"""
    WITH t1 AS MATERIALIZED (SELECT * FROM {redacted_sql("documents", detections_sql("documents"))} AS x),
    r AS (SELECT DISTINCT doc_id FROM {detections_sql("t1")} AS x),
    s AS (SELECT d.doc_id, d.source = 'src3' AS failed, r.doc_id IS NOT NULL AS dirty
      FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id)
    SELECT count(*) AS processed, count_if(NOT failed AND NOT dirty)::bigint AS passed,
      count_if(NOT failed AND dirty)::bigint AS review_required, count_if(failed)::bigint AS failed,
      CASE WHEN count_if(failed OR dirty) > 0 THEN 1 ELSE 0 END::bigint AS exit_code FROM s"""


def _typed_sql(kind: str) -> str:
    return (
        f"SELECT {SPAN_COLUMNS} FROM {detections_sql(TEXTS_SQL)} AS d"
        f" WHERE detection_type = '{kind}'"
    )


QUERIES = {
    "source_counts": (source_counts, SOURCE_COUNTS_SQL),
    "corpus_counts": (corpus_counts, CORPUS_COUNTS_SQL),
    "missing_categories": (missing_categories, MISSING_SQL),
    "tckn_spans": (tckn_spans, _typed_sql("tckn")),
    "phone_spans": (phone_spans, _typed_sql("phone")),
    "email_spans": (email_spans, _typed_sql("email")),
    "structured_spans": (
        structured_spans,
        f"SELECT {SPAN_COLUMNS} FROM {detections_sql(TEXTS_SQL)} AS d",
    ),
    "redacted_web_pages": (redacted_web_pages, _redacted_count_sql(WEB_PAGES, "page_id", "html")),
    "redacted_turns": (redacted_turns, _redacted_count_sql(TURNS, "turn_id", "text")),
    "number_checks": (number_checks, NUMBER_CHECKS_SQL),
    "deduplicated_spans": (deduplicated_spans, DEDUPED_SQL),
    "deduplicated_rows": (
        deduplicated_rows,
        'SELECT doc_id, detection_type, "start", "end", max(confidence) AS confidence'
        f' FROM {LINE_SPANS} GROUP BY doc_id, detection_type, "start", "end"',
    ),
    "merged_span_rows": (merged_span_rows, MERGED_ROWS_SQL),
    "merged_spans_in_row": (merged_spans_in_row, MERGED_IN_ROW_SQL),
    "redacted_texts": (redacted_texts, REDACTED_SQL),
    "sanitized_texts": (sanitized_texts, SANITIZED_SQL),
    "streamed_texts": (
        streamed_texts,
        _passes_sql(
            "SELECT doc_id, text AS sanitized_text, redaction_passes,"
            " CASE WHEN remaining_count = 0 THEN 'passed' ELSE 'review_required' END AS status FROM w",
            "documents",
        ),
    ),
    "published_files": (published_files, PUBLISHED_SQL),
    "applied_by_pass": (applied_by_pass, APPLIED_SQL),
    "text_verification": (text_verification, VERIFICATION_SQL),
    "batch_outcome": (batch_outcome, BATCH_SQL),
}
