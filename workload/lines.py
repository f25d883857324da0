"""Queries over recognised lines with boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions.text import find_structured
from veilspan.operators import detections as D
from veilspan.operators import lines as L
from veilspan.operators import semantic as S
from veilspan.operators.scan import dense_position
from veilspan.session import load_table
from veilspan.sources.ocr_json import parse_ocr_results
from workload.common import (
    BOX_SQL,
    CARDS,
    Derived,
    cards,
    detections_sql,
    documents,
    flat_box,
    lines_of,
    lines_sql,
    page_rows,
)

PAGE = ["doc_id", "page_no"]
CARD_LINES = lines_sql(CARDS.sql())
DOC_LINES = lines_sql("documents")


def _flat(df, *columns):
    return df.select("doc_id", *columns, *flat_box(), "confidence")


# --- search index -----------------------------------------------------------


def line_offsets(spark, sf):
    return L.line_offsets(lines_of(documents(spark, sf)), PAGE).selectExpr(
        "doc_id", "cast(line_no AS bigint) AS line_no", "start", "end"
    )


LINE_OFFSETS_SQL = f"""
    SELECT doc_id, line_no, e - length(text) AS "start", e AS "end" FROM (
      SELECT doc_id, cast(line_no AS bigint) AS line_no, text, cast(sum(length(text) + 1) OVER
        (PARTITION BY doc_id ORDER BY line_no) - 1 AS bigint) AS e FROM {DOC_LINES}) AS o"""


def line_offsets_in_row(spark, sf):
    spans = page_rows(documents(spark, sf)).select(
        "doc_id", F.posexplode_outer(L.line_spans("items")).alias("line_no", "s")
    )
    return spans.filter(F.col("s").isNotNull()).selectExpr(
        "doc_id", "cast(line_no AS bigint) AS line_no",
        "cast(s.start AS bigint) AS start", "cast(s.end AS bigint) AS end",
    )


def page_texts(spark, sf):
    return page_rows(documents(spark, sf)).select("doc_id", L.page_text("items").alias("text"))


PAGE_TEXTS_SQL = f"""
    SELECT d.doc_id, coalesce(string_agg(l.text, chr(10) ORDER BY line_no), '') AS text
    FROM documents d LEFT JOIN {DOC_LINES} ON l.doc_id = d.doc_id GROUP BY d.doc_id""".replace(
    " AS lines", " AS l"
)


def gathered_pages(spark, sf):
    pages, _ = L.pages_from_lines(lines_of(documents(spark, sf)), PAGE)
    return pages.select(
        "doc_id",
        L.page_text("items").alias("text"),
        F.size("items").cast("long").alias("line_count"),
    )


GATHERED_SQL = f"""
    SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS line_count
    FROM {DOC_LINES} GROUP BY doc_id"""


def dense_lines(spark, sf):
    """Line numbers with holes, made dense again."""
    sparse = lines_of(documents(spark, sf)).withColumn("line_no", F.col("line_no") * 3000 + 7)
    return dense_position(sparse, PAGE, "line_no", "position", chunk=8192).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "position"
    )


# --- predicates -------------------------------------------------------------


def line_predicates(spark, sf):
    lines = lines_of(cards(spark, sf)).unionByName(
        lines_of(documents(spark, sf)).withColumn("doc_id", -F.col("doc_id") - 1)
    )
    return lines.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        L.runs_line_semantics("text").alias("second_look"),
        L.is_address_header("text").alias("header"),
        L.is_stop_header("text").alias("stop"),
    )


# --- fixed values -----------------------------------------------------------
# Headers of address blocks and of other fields, as in veilspan.functions.patterns.
# RE2 folds only ASCII here, so the dotted letters are spelled out.
HEADER = (
    r"(?i)^\s*(?:[iİı]kamet\s+adres[iİı]|ev\s+adres[iİı]|yerle[şŞ][iİı]m\s+yer[iİı](?:\s+adres[iİı])?"
    r"|tebl[iİı]gat\s+adres[iİı]|a[çÇ][ıIiİ]k\s+adres|adres)\s*[:\-]?"
)
STOP = (
    r"(?i)^\s*(?:telefon|tel\.?|gsm|cep|e-?posta|e-?ma[iİı]l|t\.?\s*c\.?|tc|tckn|[iİı]mza|tar[iİı]h"
    r"|ad[ıIiİ]?\s+soyad[ıIiİ]?)(?:[^\p{L}\p{N}_]|$)"
)
# A stop word that ends in a dot has its border there, whatever follows.
STOP_DOT = r"(?i)^\s*(?:tel|t\.?\s*c)\."
# ----------------------------------------------------------------------------
IS_STOP = f"((regexp_matches(text, '{STOP}') OR regexp_matches(text, '{STOP_DOT}')) AND NOT regexp_matches(text, '{HEADER}'))"

PREDICATES_SQL = f"""
    SELECT doc_id, cast(line_no AS bigint) AS line_no,
      trim(text, ' \t') <> '' AND length(trim(text, ' \t')) <= 120
        AND len(regexp_split_to_array(trim(text, ' \t'), '\\s+')) <= 12 AS second_look,
      regexp_matches(text, '{HEADER}') AS header, {IS_STOP} AS stop
    FROM (SELECT doc_id, line_no, text FROM {CARD_LINES}
      UNION ALL SELECT -doc_id - 1, line_no, text FROM {DOC_LINES}) AS all_lines"""


# --- mapping spans to boxes -------------------------------------------------


def mapped_spans(spark, sf):
    """Hits on the joined page text, mapped by the interval join of tables."""
    lines = lines_of(cards(spark, sf))
    hits = L.structured_in_lines(lines, PAGE)
    return _flat(
        L.join_spans_to_lines(hits, L.line_offsets(lines, PAGE), PAGE),
        "detection_type", "start", "end",
    )


def _offsets_sql(lines: str) -> str:
    return (
        "(SELECT *, e - length(text) AS s FROM (SELECT *, sum(length(text) + 1) OVER"
        f" (PARTITION BY doc_id ORDER BY line_no) - 1 AS e FROM {lines}) AS o0) AS o"
    )


def _page_text_sql(lines: str) -> str:
    return (
        "(SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text"
        f" FROM {lines} GROUP BY doc_id) AS page_text"
    )


MAPPED_SQL = f"""
    SELECT d.doc_id, d.detection_type, d."start", d."end",
      cast(min(x1) AS bigint) AS x1, cast(min(y1) AS bigint) AS y1,
      cast(max(x2) AS bigint) AS x2, cast(max(y2) AS bigint) AS y2,
      least(d.confidence, min(o.confidence)) AS confidence
    FROM {detections_sql(_page_text_sql(CARD_LINES))} AS d
    JOIN {_offsets_sql(CARD_LINES)} ON o.doc_id = d.doc_id AND d."start" < o.e AND o.s < d."end"
    GROUP BY d.doc_id, d.detection_type, d."start", d."end", d.confidence"""


def structured_in_lines(spark, sf):
    """Documents and cards searched stretch by stretch, pages never joined."""
    lines = lines_of(cards(spark, sf)).unionByName(
        lines_of(documents(spark, sf)).withColumn("doc_id", -F.col("doc_id") - 1)
    )
    return L.structured_in_lines(lines, PAGE).select(
        "doc_id", "detection_type", "start", "end", "confidence"
    )


IN_LINES_SQL = f"""
    SELECT doc_id, detection_type, "start", "end", confidence
    FROM {detections_sql(_page_text_sql(CARD_LINES))} AS a
    UNION ALL SELECT -doc_id - 1, detection_type, "start", "end", confidence
    FROM {detections_sql(_page_text_sql(DOC_LINES))} AS b"""


# Two pages of figures: nearly every line may belong to a number of the lines around it.
FIGURES = Derived(
    "lineitem",
    (
        (
            "l_orderkey % 2 AS doc_id", "l_orderkey * 8 + l_linenumber AS line_no", "l_partkey AS p", "l_suppkey AS s",
            "(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 7 AS m",
        ),
        (
            "doc_id", "line_no",
            "CASE m WHEN 0 THEN concat('5', lpad(cast(p % 100 AS string), 2, '0'))"
            " WHEN 1 THEN lpad(cast(p % 1000 AS string), 3, '0')"
            " WHEN 2 THEN concat(lpad(cast(s % 100 AS string), 2, '0'), ' ', lpad(cast(p % 100 AS string), 2, '0'))"
            " WHEN 3 THEN '-' WHEN 4 THEN concat(cast(s % 50 AS string), '.', cast(p % 90 + 10 AS string))"
            " WHEN 5 THEN cast(p % 10 AS string) ELSE concat('532 ', lpad(cast(s % 1000 AS string), 3, '0')) END AS text",
        ),
    ),
)


def figures_in_lines(spark, sf):
    """Hits of pages that are one run of figures, wherever the search before them ended."""
    box = F.struct(*(F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 1), ("y2", 1))))
    lines = FIGURES.df(spark, sf).select("doc_id", F.lit(1).alias("page_no"), "line_no", "text", box.alias("bbox"), F.lit(1.0).alias("confidence"))
    return L.structured_in_lines(lines, PAGE, chunk=1 << 15).select(
        "doc_id", "detection_type", "start", "end", "confidence"
    )


_FIGURE_PAGES = (
    "(SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no, text) AS text"
    f" FROM {FIGURES.sql()} GROUP BY doc_id) AS figures"
)
FIGURES_SQL = f'SELECT doc_id, detection_type, "start", "end", confidence FROM {detections_sql(_FIGURE_PAGES)} AS d'


def mapped_spans_in_row(spark, sf):
    pages = page_rows(cards(spark, sf)).withColumn("text", L.page_text("items"))
    found = pages.withColumn("found", find_structured("text"))
    boxes = D.explode_rows(found, ["doc_id"], L.map_spans_to_boxes("found", "items"))
    return _flat(boxes.select("doc_id", "d.*"), "detection_type")


# --- address blocks ---------------------------------------------------------


def address_blocks(spark, sf):
    pages = page_rows(cards(spark, sf))
    rows = D.explode_rows(pages, ["doc_id"], L.address_blocks("items"))
    return _flat(rows.select("doc_id", "d.*"))


def address_lines(spark, sf):
    """The same from a line table cut into short chunks with halos."""
    return _flat(L.address_lines(lines_of(cards(spark, sf)), PAGE))


def _address_sql(lines: str) -> str:
    return f"""(
      WITH marked AS (
        SELECT *, regexp_matches(text, '{HEADER}') AS head, {IS_STOP} AS stop,
          lag(y2) OVER w AS py2, lag(y2 - y1) OVER w AS ph FROM {lines}
        WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
      broken AS (SELECT *, NOT head AND (stop OR coalesce(y1 - py2 > 2.5 * greatest(ph, y2 - y1, 1), false))
        AS brk FROM marked),
      seg AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g
        FROM broken),
      pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1 AS p,
        sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS b FROM seg)
      SELECT doc_id, line_no, x1, y1, x2, y2, confidence FROM pos WHERE g > 0 AND p <= 5 AND b = 0)"""


ADDRESS_SQL = f"SELECT doc_id, {BOX_SQL}, confidence FROM {_address_sql(CARD_LINES)} AS a"

# --- all text detections of a page ------------------------------------------


def page_detections(spark, sf):
    pages = page_rows(cards(spark, sf))
    rows = D.explode_rows(pages, ["doc_id"], L.page_text_detections("items"))
    return _flat(rows.select("doc_id", "d.*"), "detection_type")


def page_detections_from_lines(spark, sf):
    return _flat(L.text_detections_in_lines(lines_of(cards(spark, sf)), PAGE), "detection_type")


def page_detections_in_pieces(spark, sf):
    return _flat(L.text_detections_in_lines(lines_of(cards(spark, sf)), PAGE, chunk=4), "detection_type")


def _page_detections_sql(extra: str = "") -> str:
    return f"""
    SELECT doc_id, detection_type, {BOX_SQL}, max(confidence) AS confidence FROM (
      SELECT doc_id, detection_type, x1, y1, x2, y2, confidence FROM ({MAPPED_SQL}) AS m
      UNION ALL SELECT doc_id, 'address', x1, y1, x2, y2, confidence FROM {_address_sql(CARD_LINES)} AS a
      {extra}) AS u GROUP BY doc_id, detection_type, x1, y1, x2, y2"""


# --- names from a phrase list -----------------------------------------------


# Names of customers have a number sign in them.
NAME_WORD = r"(?U)[\w#]+"


def _gazetteer(spark, sf):
    """Customer names as persons, nations as addresses, with varying scores."""
    people = load_table(spark, sf, "customer").selectExpr(
        "c_name AS phrase", "'Person' AS label", "cast(30 + c_custkey % 60 AS double) / 100 AS score"
    )
    places = load_table(spark, sf, "nation").selectExpr(
        "concat('Sokak ', cast(n_nationkey AS string), ' ', n_name) AS phrase", "'address' AS label",
        "cast(20 + n_nationkey AS double) / 50 AS score",
    )
    other = load_table(spark, sf, "supplier").selectExpr(
        "s_name AS phrase", "'company' AS label", "1.0D AS score"
    )
    return people.unionByName(places).unionByName(other)


GAZETTEER = """(SELECT c_name AS phrase, 'person' AS label, cast(30 + c_custkey % 60 AS double) / 100 AS score
      FROM customer
      UNION ALL SELECT concat('Sokak ', n_nationkey, ' ', n_name), 'address', cast(20 + n_nationkey AS double) / 50
      FROM nation UNION ALL SELECT s_name, 'company', 1.0 FROM supplier) AS g"""


def _entities(spark, sf):
    return S.gazetteer_entities(cards(spark, sf), ["doc_id"], _gazetteer(spark, sf), word=NAME_WORD)


def gazetteer_entities(spark, sf):
    return _entities(spark, sf).selectExpr(
        "doc_id", "label", "cast(start AS bigint) AS start", "cast(end AS bigint) AS end", "score"
    )


# The list is matched against runs of words rebuilt by position in the text.
_WORDS = f"""(SELECT doc_id, i, w, cast(sum(length(sep) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS bigint) AS e
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([^\\w#]*)([\\w#]+)', 1)) AS sep,
        unnest(regexp_extract_all(text, '([^\\w#]*)([\\w#]+)', 2)) AS w,
        unnest(range(len(regexp_extract_all(text, '[\\w#]+')))) AS i FROM {CARDS.sql()}) AS w0) AS w1"""
GRAMS = f"""(
      WITH w AS MATERIALIZED (SELECT * FROM {_WORDS}),
      seq AS (SELECT doc_id, w AS w1, e - length(w) AS s, e AS e1, lead(w) OVER o AS w2, lead(e) OVER o AS e2,
        lead(w, 2) OVER o AS w3, lead(e, 2) OVER o AS e3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, s, e1 AS e, w1 AS gram FROM seq
      UNION ALL SELECT doc_id, s, e2, concat(w1, ' ', w2) FROM seq WHERE w2 IS NOT NULL
      UNION ALL SELECT doc_id, s, e3, concat(w1, ' ', w2, ' ', w3) FROM seq WHERE w3 IS NOT NULL) AS grams"""
ENTITIES_SQL = (
    'SELECT doc_id, label, s AS "start", e AS "end", score'
    f" FROM {GRAMS} JOIN {GAZETTEER} ON g.phrase = grams.gram"
)


def accepted_entities(spark, sf):
    return S.filter_raw_predictions(_entities(spark, sf)).selectExpr(
        "doc_id", "label", "cast(start AS bigint) AS start", "cast(end AS bigint) AS end", "score"
    )


ACCEPTED_SQL = (
    f"SELECT * FROM ({ENTITIES_SQL}) AS x WHERE (label = 'person' AND score >= 0.35)"
    " OR (label = 'address' AND score >= 0.30)"
)


def pages_with_names(spark, sf):
    """Structured hits, address blocks, names in the page and names per line."""
    pages = page_rows(cards(spark, sf)).withColumn("text", L.page_text("items"))
    listed = _gazetteer(spark, sf)
    in_page = (
        S.gazetteer_entities(pages.select("doc_id", "text"), ["doc_id"], listed, word=NAME_WORD)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("label", "start", "end", "score")).alias("raw"))
    )
    lines = L.lines_from_pages(pages, PAGE)
    looked_at = lines.filter(L.runs_line_semantics("text"))
    per_line = S.filter_raw_predictions(
        S.gazetteer_entities(looked_at.select("doc_id", "line_no", "text"), ["doc_id", "line_no"], listed, word=NAME_WORD)
    ).join(lines.hint("merge"), ["doc_id", "line_no"])
    line_boxes = (
        per_line.groupBy("doc_id")
        .agg(
            F.collect_list(
                F.struct(
                    F.col("label").alias("detection_type"),
                    "bbox",
                    F.least("score", "confidence").alias("confidence"),
                )
            ).alias("line_boxes")
        )
    )
    joined = pages.join(in_page, "doc_id", "left").join(line_boxes, "doc_id", "left")
    found = L.page_text_detections("items", S.accept_entities("raw"), F.col("line_boxes"))
    return _flat(D.explode_rows(joined, ["doc_id"], found).select("doc_id", "d.*"), "detection_type")


def names_in_lines(spark, sf):
    """The same from a line table in chunks of four lines."""
    found = S.detections_with_names(lines_of(cards(spark, sf)), PAGE, _gazetteer(spark, sf), word=NAME_WORD, chunk=4)
    return _flat(found, "detection_type")


_PAGE_WORDS = _WORDS.replace(CARDS.sql(), _page_text_sql(CARD_LINES))
_PAGE_ENTITIES = ENTITIES_SQL.replace(_WORDS, _PAGE_WORDS)
NAMES_SQL = _page_detections_sql(
    f"""UNION ALL
      SELECT n.doc_id, n.label, min(x1), min(y1), max(x2), max(y2), least(n.score, min(o.confidence))
      FROM ({_PAGE_ENTITIES}) AS n JOIN {_offsets_sql(CARD_LINES)}
        ON o.doc_id = n.doc_id AND n."start" < o.e AND o.s < n."end"
      WHERE (label = 'person' AND score >= 0.35) OR (label = 'address' AND score >= 0.30)
      GROUP BY n.doc_id, n.label, n."start", n."end", n.score
      UNION ALL
      SELECT n.doc_id, n.label, x1, y1, x2, y2, least(n.score, o.confidence)
      FROM ({_PAGE_ENTITIES}) AS n JOIN {_offsets_sql(CARD_LINES)}
        ON o.doc_id = n.doc_id AND o.s <= n."start" AND n."end" <= o.e
      WHERE length(trim(text)) <= 120 AND ((label = 'person' AND score >= 0.35)
        OR (label = 'address' AND score >= 0.30))"""
)


# --- recognition results ----------------------------------------------------


def _ocr_json(spark, sf):
    """Results as JSON; every 10th is nested, some are broken in one way each."""
    items = page_rows(cards(spark, sf)).withColumn("n", F.size("items"))
    texts = F.transform("items", lambda i: F.concat(F.lit("  "), i["text"], F.lit(" ")))
    scores = F.transform("items", lambda i: i["confidence"])
    boxes = F.transform(
        "items", lambda i: F.array(*(i["bbox"][c] for c in ("x1", "y1", "x2", "y2")))
    )
    body = F.to_json(
        F.struct(
            F.concat(texts, F.array(F.lit("   "))).alias("rec_texts"),
            F.when(F.col("doc_id") % 11 == 3, scores)
            .otherwise(F.concat(scores, F.array(F.lit(0.5))))
            .alias("rec_scores"),
            F.concat(
                F.when(
                    F.col("doc_id") % 13 == 5,
                    F.transform(boxes, lambda b: F.slice(b, 1, 3)),
                ).otherwise(boxes),
                F.array(F.array(*(F.lit(v) for v in (0, 0, 1, 1)))),
            ).alias("rec_boxes"),
        )
    )
    json = (
        F.when(F.col("doc_id") % 17 == 2, F.lit("{broken"))
        .when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"res":'), body, F.lit("}")))
        .otherwise(body)
    )
    return items.select("doc_id", "page_no", json.alias("json"))


def recognised_lines(spark, sf):
    good, _ = parse_ocr_results(_ocr_json(spark, sf))
    return _flat(
        L.lines_from_pages(good, PAGE).withColumn("line_no", F.col("line_no").cast("long")),
        "line_no", "text",
    )


def refused_results(spark, sf):
    _, bad = parse_ocr_results(_ocr_json(spark, sf))
    return bad.select("doc_id", "error")


_BAD = (
    "CASE WHEN doc_id % 17 = 2 THEN 'not valid JSON' WHEN doc_id % 11 = 3 THEN 'arrays differ in length'"
    " WHEN doc_id % 13 = 5 THEN 'bad box shape' END"
)

QUERIES = {
    "line_offsets": (line_offsets, LINE_OFFSETS_SQL),
    "line_offsets_in_row": (line_offsets_in_row, LINE_OFFSETS_SQL),
    "page_texts": (page_texts, PAGE_TEXTS_SQL),
    "gathered_pages": (gathered_pages, GATHERED_SQL),
    "dense_lines": (
        dense_lines,
        "SELECT doc_id, cast(line_no * 3000 + 7 AS bigint) AS line_no,"
        f" cast(line_no AS bigint) AS position FROM {DOC_LINES}",
    ),
    "line_predicates": (line_predicates, PREDICATES_SQL),
    "structured_in_lines": (structured_in_lines, IN_LINES_SQL),
    "figures_in_lines": (figures_in_lines, FIGURES_SQL),
    "mapped_spans": (mapped_spans, MAPPED_SQL),
    "mapped_spans_in_row": (
        mapped_spans_in_row,
        f"SELECT doc_id, detection_type, x1, y1, x2, y2, confidence FROM ({MAPPED_SQL}) AS m",
    ),
    "address_blocks": (address_blocks, ADDRESS_SQL),
    "address_lines": (address_lines, ADDRESS_SQL),
    "page_detections": (page_detections, _page_detections_sql()),
    "page_detections_from_lines": (page_detections_from_lines, _page_detections_sql()),
    "page_detections_in_pieces": (page_detections_in_pieces, _page_detections_sql()),
    "gazetteer_entities": (gazetteer_entities, ENTITIES_SQL),
    "accepted_entities": (accepted_entities, ACCEPTED_SQL),
    "pages_with_names": (pages_with_names, NAMES_SQL),
    "names_in_lines": (names_in_lines, NAMES_SQL),
    "recognised_lines": (
        recognised_lines,
        f"SELECT doc_id, cast(line_no AS bigint) AS line_no, trim(text) AS text, {BOX_SQL}, confidence"
        f" FROM {CARD_LINES} WHERE ({_BAD}) IS NULL",
    ),
    "refused_results": (
        refused_results,
        f"SELECT doc_id, {_BAD} AS error FROM {CARDS.sql()} WHERE ({_BAD}) IS NOT NULL",
    ),
}
