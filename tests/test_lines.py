"""Lines, boxes of text hits, address blocks, recognition results, plug-ins."""

import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.text import find_structured
from veilspan.operators import lines as L
from veilspan.operators import semantic as S
from veilspan.operators.chunks import line_chunks, structured_in_chunks
from veilspan.operators.detections import explode_rows
from veilspan.sources.ocr_json import parse_ocr_results
from tests.test_text import NUMBER, python_rule

PAGE = ["doc_id", "page_no"]
SCHEMA = "doc_id string, page_no int, line_no int, text string, bbox struct<x1:int,y1:int,x2:int,y2:int>, confidence double"


def line_rows(doc, texts, gaps=None):
    rows, y = [], 10
    for i, text in enumerate(texts):
        y += (gaps or {}).get(i, 0)
        rows.append((doc, 1, i, text, (5, y, 5 + 8 * len(text), y + 20), 0.5 + (i % 50) / 100))
        y += 25
    return rows


def lines_df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_header_and_following_lines(spark):
    rows = line_rows("a", ["Ad Soyad", "Adres:", "Sokak 1", "Kat 2", "İstanbul", "Telefon 1", "later"])
    rows += line_rows("b", ["İstanbul adresindeki ofis"])
    rows += line_rows("c", ["IKAMET ADRESİ", "1", "2", "3", "4", "5", "6"])
    rows += line_rows("d", ["açık adres - x", "near", "far", "next"], {2: 80})
    pages, large = L.pages_from_lines(lines_df(spark, rows), PAGE)
    assert large.count() == 0
    got = explode_rows(pages, ["doc_id"], L.address_blocks("items")).groupBy("doc_id").count()
    assert dict(map(tuple, got.collect())) == {"a": 4, "c": 6, "d": 2}


def python_blocks(rows):
    header, stop = python_rule(P.ADDRESS_HEADER), python_rule(P.STOP_HEADER)
    out, left, above = [], 0, None
    for row in rows:
        _, _, n, text, (_, y1, _, y2), _ = row
        if header.match(text):
            out.append(n)
            left, above = 5, row
            continue
        if not left:
            continue
        far = y1 - above[4][3] > 2.5 * max(above[4][3] - above[4][1], y2 - y1, 1)
        if stop.match(text) or far:
            left = 0
            continue
        out.append(n)
        left, above = left - 1, row
    return out


@pytest.mark.parametrize("chunk", [6, 4096])
def test_blocks_match_state_machine(spark, chunk):
    rng = random.Random(2)
    kinds = ["Adres", "ev adresi:", "tel. 1", "Tarih", "T.C. x", "x", "y y", "adı soyadı", "adrese", "telefonu"]
    pages = {}
    for d in range(40):
        texts = [rng.choice(kinds[:2] + kinds[2:] + ["z"] * 8) for _ in range(rng.randint(1, 30))]
        gaps = {i: rng.choice([0, 0, 0, 51, 49]) for i in range(len(texts))}
        pages[f"d{d}"] = line_rows(f"d{d}", texts, gaps)
    df = lines_df(spark, [r for rows in pages.values() for r in rows])
    want = {(d, n) for d, rows in pages.items() for n in python_blocks(rows)}
    got = L.address_lines(df, PAGE, chunk=chunk).select("doc_id", "line_no").collect()
    assert set(map(tuple, got)) == want
    in_row = explode_rows(L.pages_from_lines(df, PAGE)[0], ["doc_id"], L.address_blocks("items"))
    boxes = {(r.doc_id, r.d.bbox.y1) for r in in_row.collect()}
    assert boxes == {(d, pages[d][n][4][1]) for d, n in want}


def test_span_to_boxes(spark):
    rows = line_rows("a", ["Kimlik No", NUMBER]) + line_rows("b", ["0532 123", "45 67 x", "y"])
    pages, _ = L.pages_from_lines(lines_df(spark, rows), PAGE)
    found = pages.withColumn("text", L.page_text("items")).withColumn("f", find_structured("text"))
    boxes = explode_rows(found, ["doc_id"], L.map_spans_to_boxes("f", "items")).collect()
    got = {r.doc_id: (r.d.detection_type, tuple(r.d.bbox), r.d.confidence) for r in boxes}
    # only the line of the number, though the label stands on another one
    assert got["a"] == ("tckn", rows[1][4], 0.51)
    assert got["b"] == ("phone", (5, 10, 69, 55), 0.5)


def test_many_lines_and_hits_in_one_page(spark):
    """More lines than one block; the join of tables is the model."""
    rng = random.Random(6)
    rows = line_rows("a", [rng.choice(["0532 123", "45 67 x", "y", "a@b.de", NUMBER]) for _ in range(700)])
    df = lines_df(spark, rows)
    pages, _ = L.pages_from_lines(df, PAGE)
    found = pages.withColumn("text", L.page_text("items")).withColumn("f", find_structured("text"))
    boxes = explode_rows(found, PAGE, L.map_spans_to_boxes("f", "items")).select(*PAGE, "d.*")
    joined = L.join_spans_to_lines(L.structured_in_lines(df, PAGE), L.line_offsets(df, PAGE), PAGE)
    columns = ["detection_type", "bbox", "confidence"]
    got = sorted(map(tuple, boxes.select(*columns).collect()))
    assert got == sorted(map(tuple, joined.select(*columns).collect())) and len(got) > 300


@pytest.mark.parametrize("chunk, block", [(20, 1), (4096, 7), (4096, 128)])
def test_lines_equal_joined_page(spark, chunk, block, monkeypatch):
    """Searching stretches gives the hits of the joined text, labels included."""
    monkeypatch.setattr(L, "_BLOCK_LINES", block)
    rng = random.Random(4)
    kinds = [
        "0532", "123 45", "67", "0532 123", "45 67 x", "TC", "Kimlik No:", "12345678901", NUMBER, NUMBER[:5],
        NUMBER[5:], "---", "(", "a", "bb a@b.de", "+90", "word " * 6, "1",
    ]
    rows = []
    for d in range(60):
        rows += line_rows(f"d{d}", [rng.choice(kinds).strip() for _ in range(rng.randint(1, 40))])
    rows += line_rows("labels", ["TC"] + ["."] * 18 + ["12345678901"] + ["."] * 3 + ["TC"])
    df = lines_df(spark, rows)
    joined, _ = L.pages_from_lines(df, PAGE)
    whole = explode_rows(joined.withColumn("text", L.page_text("items")), PAGE, find_structured("text"))
    want = sorted(tuple(r) for r in whole.select("doc_id", "d.detection_type", "d.start", "d.end", "d.confidence").collect())
    got = L.structured_in_lines(df, PAGE, chunk).select("doc_id", "detection_type", "start", "end", "confidence")
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100


def test_pages_in_chunks_of_one_line(spark):
    rows = line_rows("a", ["Adres", "0532 123", "45 67 x", "a@b.de"]) + line_rows("b", ["c@d.de"])
    df = lines_df(spark, rows)
    every = L.text_detections_in_lines(df, PAGE)
    split = L.text_detections_in_lines(df, PAGE, chunk=1)
    assert L.pages_from_lines(df, PAGE, max_lines=1)[0].count() == 1
    columns = [*PAGE, "detection_type", "bbox", "confidence"]
    assert sorted(every.select(*columns).collect()) == sorted(split.select(*columns).collect())
    assert every.count() == 7


def test_interval_join_spans_buckets(spark):
    lines = L.line_offsets(lines_df(spark, line_rows("a", ["abc", "defg", "hi"])), PAGE)
    spans = spark.createDataFrame(
        [("a", 1, "phone", 1, 10, 0.9), ("a", 1, "email", 3, 4, 1.0), ("a", 1, "tckn", 40, 50, 1.0)],
        "doc_id string, page_no int, detection_type string, start long, end long, confidence double",
    )
    for bucket in (1, 2, 100):
        got = L.join_spans_to_lines(spans, lines, PAGE, bucket).collect()
        # a span over nothing but a line end touches no line
        assert [(r.detection_type, tuple(r.bbox), r.confidence) for r in got] == [("phone", (5, 10, 37, 80), 0.5)]


def test_second_look_predicate(spark):
    texts = ["  ", "Ada Lovelace", "x" * 121, " ".join("w" * 13), " ".join("w" * 12), " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(L.runs_line_semantics("t")).collect()] == [False, True, False, False, True, False]


def test_recognition_results(spark):
    good = {"rec_texts": [" a ", " "], "rec_scores": [0.5, 1], "rec_boxes": [[0, 0, 2.9, 2], [1]]}
    cases = {
        "good": good,
        "nested": {"res": good},
        "empty": {},
        "lengths": {**good, "rec_scores": [0.5]},
        "shape": {**good, "rec_boxes": [[0, 0, 1], [1]]},
        "box": {**good, "rec_boxes": [[3, 0, 2, 2], [1]]},
        "score": {**good, "rec_scores": [1.5, 1]},
    }
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [("json", "{oops")]
    ok, bad = parse_ocr_results(spark.createDataFrame(rows, "doc_id string, json string"))
    items = {r.doc_id: [(i.text, tuple(i.bbox), i.confidence) for i in r["items"]] for r in ok.collect()}
    assert items == {"good": [("a", (0, 0, 2, 2), 0.5)], "nested": [("a", (0, 0, 2, 2), 0.5)], "empty": []}
    assert {r.doc_id: r.error for r in bad.collect()} == {
        "lengths": "arrays differ in length", "shape": "bad box shape", "box": "invalid box",
        "score": "invalid confidence", "json": "not valid JSON",
    }


def test_thresholds(spark):
    raw = [("person", 0, 3, 0.35), ("Person", 4, 5, 0.34), ("address", 6, 9, 0.3), ("iban", 0, 1, 1.0), ("person", 5, 5, 0.9), ("address", 1, 2, None)]
    df = spark.createDataFrame([(raw,)], "raw array<struct<label:string,start:int,end:int,score:double>>")
    got = df.select(S.accept_entities("raw").alias("d")).first().d
    assert [tuple(d) for d in got] == [(0, 3, "person", 0.35), (1, 2, "address", 1.0), (6, 9, "address", 0.3)]
    with pytest.raises(ValueError):
        S.accept_entities("raw", person=1.2)


def test_plugin_model_and_line_fallback(spark):
    """A model that misses a name inside a page but finds it on a line of its own."""

    def load():
        def predict(text):
            return [{"label": "person", "start": 0, "end": len(text), "score": 0.9}] if text == "Ada Demir" else []

        return predict

    recognize = S.recognizer_udf(load)
    rows = line_rows("a", ["Ada Demir", "some other line", ""])[:2]
    pages, _ = L.pages_from_lines(lines_df(spark, rows), PAGE)
    texts = pages.withColumn("text", L.page_text("items"))
    whole = texts.withColumn("raw", recognize("text"))
    assert whole.select(F.size("raw")).first()[0] == 0
    lines = L.lines_from_pages(pages, PAGE).withColumn("raw", recognize("text"))
    per_line = lines.groupBy(*PAGE).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", S.accept_entities("raw").alias("d")))), lambda x: x["d"]
        ).alias("by_line")
    )
    joined = pages.join(per_line, PAGE)
    boxes = joined.select(
        F.explode(L.page_text_detections("items", line_semantic=S.line_entities_to_boxes("items", "by_line"))).alias("d")
    ).collect()
    assert [(b.d.detection_type, tuple(b.d.bbox), b.d.confidence) for b in boxes] == [("person", rows[0][4], 0.5)]


def test_gazetteer(spark):
    texts = spark.createDataFrame([(1, "Ada  Demir, Ada"), (2, " ")], "id int, text string")
    listed = spark.createDataFrame([("Ada Demir", "person", 0.9), ("Ada", "person", 0.2)], "phrase string, label string, score double")
    got = S.gazetteer_entities(texts, ["id"], listed).select("start", "end", "score").collect()
    assert sorted(map(tuple, got)) == [(0, 3, 0.2), (0, 10, 0.9), (12, 15, 0.2)]
    with pytest.raises(Exception, match="more than 1 words"):
        S.gazetteer_entities(texts, ["id"], listed, max_words=1).collect()


def test_gazetteer_moves_only_runs_that_may_match(spark):
    texts = spark.range(400).selectExpr("id", "concat('one two three four five ', if(id % 2 = 0, 'Ada Demir', 'Bob'), ' six') AS text")
    listed = spark.createDataFrame([("Ada Demir", "person", 0.9), ("six", "person", 0.5)], "phrase string, label string, score double")
    runs = S.word_grams(texts, ["id"], listed, "phrase", 3)
    # of up to 21 runs a text, those that start with Ada (3) or with the last word (1)
    assert runs.count() == 200 * (3 + 1) + 200 * 1
    assert S.word_grams(texts, ["id"], listed.limit(0), "phrase", 3).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.gazetteer_entities(texts, ["id"], listed, salts=16)
        assert found.count() == 200 + 400
        # the phrase of half the texts is joined in several tasks
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spread = found.filter("start = 24 AND score = 0.9").groupBy(F.spark_partition_id()).count()
        assert spread.count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plugin_batches_skip_blank_texts():
    def load():
        return lambda text: [{"label": "person", "start": 0, "end": 1, "score": 1.0}]

    batches = S.recognizer_udf(load).func(iter([pd.Series(["x", " ", None])]))
    assert [len(v) for v in next(batches)] == [1, 0, 0]


def joined_hits(spark, rows):
    """Hits of the joined page text, one row a page."""
    texts = {}
    for doc, page, n, text, *_ in sorted(rows, key=lambda r: (r[0], r[2])):
        texts.setdefault((doc, page), []).append(text or "")
    df = spark.createDataFrame([(*k, "\n".join(t)) for k, t in texts.items()], "doc_id string, page_no int, text string")
    whole = explode_rows(df, PAGE, find_structured("text")).select("doc_id", "d.*")
    return sorted(tuple(r) for r in whole.select("doc_id", "detection_type", "start", "end", "confidence").collect())


@pytest.mark.parametrize("chunk", [1, 3, 10, 4096])
def test_runs_of_numbers_over_chunks(spark, chunk):
    """Pages where a hit may begin almost anywhere, so each depends on those before it.

    Lines of separators, empty lines, null texts and holes in the numbering included.
    """
    rng = random.Random(8)
    kinds = ["12.50 7", "0532", "123", "45", "67", "5", "-", ".", "", "  . ", "(", ")", "+90", "0090 ", "(212)", "1", "22 3", NUMBER, NUMBER[:6], NUMBER[6:], " 34", "555 1", "x", "TC"]
    rows = []
    for d in range(90):
        few = rng.sample(kinds, rng.randint(2, 9)) if d % 3 else ["5321234567", "532 123", "45 67", "-"][: rng.randint(2, 4)]
        page = line_rows(f"d{d}", [rng.choice(few) for _ in range(rng.randint(1, 60))])
        rows += [(a, b, n * (1 + d % 4) + d % 2, t if t or d % 5 else None, *rest) for a, b, n, t, *rest in page]
    want = joined_hits(spark, rows)
    got = L.structured_in_lines(lines_df(spark, rows), PAGE, chunk).select("doc_id", "detection_type", "start", "end", "confidence")
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 300


def test_number_over_many_lines_of_separators(spark):
    rows = line_rows("a", ["0532", *["-"] * 50, "123", *["."] * 9, "45", "67", "x"] * 2)
    for chunk in (1, 4, 4096):
        got = L.structured_in_lines(lines_df(spark, rows), PAGE, chunk).select("doc_id", "detection_type", "start", "end", "confidence")
        assert sorted(map(tuple, got.collect())) == joined_hits(spark, rows)
    assert len(joined_hits(spark, rows)) == 2


def test_a_page_of_numbers_is_spread(spark):
    """A page that is one run of numbers: no task sees more than a few chunks of it."""
    lines = spark.range(60_000).selectExpr(
        "'a' AS doc_id", "1 AS page_no", "id AS line_no", "CASE id % 4 WHEN 0 THEN '532' WHEN 1 THEN '242' WHEN 2 THEN '35' ELSE '67' END AS text",
        "named_struct('x1', 0, 'y1', int(id), 'x2', 9, 'y2', int(id) + 1) AS bbox", "1.0D AS confidence",
    )
    chunks = line_chunks(lines, PAGE, 1024)
    assert chunks.agg(F.max(F.length("body"))).first()[0] < 1024 * 8
    spread = chunks.repartition(8, *PAGE, "_chunk").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 20
    found = structured_in_chunks(chunks, PAGE).collect()
    text = "\n".join(("532", "242", "35", "67")[i % 4] for i in range(60_000))
    want = [(m.start(), m.end()) for m in re.finditer(r"(?<!\d)0?\(?[2345]\d{2}\)?[\s.\-]*\d{3}[\s.\-]*\d{2}[\s.\-]*\d{2}(?!\d)", text)]
    assert sorted((r.start, r.end) for r in found if r.detection_type == "phone") == want and len(want) > 10_000


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_names_over_chunks(spark, chunk):
    """Phrases over line ends, over lines without words and over chunks; holes in the numbering."""
    rng = random.Random(5)
    rows = []
    for d in range(25):
        page = line_rows(f"d{d}", [rng.choice(["Ada", "Ada Demir", "Demir", "x", "--", "", "Demir Ada x", "Ada, Demir;"]) for _ in range(rng.randint(1, 14))])
        rows += [(a, b, n * 3 + d % 2, *rest) for a, b, n, *rest in page]
    listed = spark.createDataFrame([("Ada Demir", "Person", 0.9), ("Demir Ada x", "address", 0.4), ("Ada", "person", 0.2), ("x", "person", None)], "phrase string, label string, score double")
    texts = {}
    for doc, page, n, text, *_ in sorted(rows, key=lambda r: (r[0], r[2])):
        texts.setdefault((doc, page), []).append(text)
    whole = spark.createDataFrame([(*k, "\n".join(t)) for k, t in texts.items()], "doc_id string, page_no int, text string")
    want = S.filter_raw_predictions(S.gazetteer_entities(whole, PAGE, listed)).select("doc_id", "label", "start", "end", F.coalesce("score", F.lit(1.0))).collect()
    got = S.names_in_chunks(line_chunks(lines_df(spark, rows), PAGE, chunk), PAGE, listed).select("doc_id", "detection_type", "start", "end", "confidence").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 40


def test_joins_of_texts_made_of_small_files_broadcast_nothing(spark, tmp_path):
    """A few bytes a file row become whole pages; the estimates know the files only."""
    spark.range(50).write.parquet(str(tmp_path / "t"))
    made = spark.read.parquet(str(tmp_path / "t")).selectExpr("id AS doc_id", "concat('Ada Demir ', id, '\n', repeat('0532 123 45 67 x\n', 20)) AS text")
    box = F.expr("named_struct('x1', 0, 'y1', 0, 'x2', 1, 'y2', 1)")
    lines = made.select("doc_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"), box.alias("bbox"), F.lit(1.0).alias("confidence"))
    listed = made.selectExpr("'Ada Demir' AS phrase", "'person' AS label", "0.9D AS score").distinct()
    for found in (S.gazetteer_entities(made, ["doc_id"], listed), S.detections_with_names(lines, PAGE, listed, chunk=4)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_chunks_are_searched_in_as_many_tasks_as_the_session_asks_for(spark):
    """Few bytes and much work: adaptive execution would draw all chunks together."""
    rows = [(d, 1, n, "0532 123 45 67", (0, 0, 1, 1), 1.0) for d in range(8) for n in range(40)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, text string, bbox struct<x1:int,y1:int,x2:int,y2:int>, confidence double")
    used = line_chunks(lines, PAGE, 4).rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(used) == 80 and sum(n > 0 for n in used) == int(spark.conf.get("spark.sql.shuffle.partitions"))
