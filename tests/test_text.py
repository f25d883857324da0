"""Recognizers, spans, redaction and the pass loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.text import (
    dedupe_detections,
    find_structured,
    has_tckn_context,
    is_valid_tckn,
    match_spans,
    merge_spans,
    normalize_digits,
    redact_text,
    strip,
)
from veilspan.operators.detections import missing_types, count_by_type
from veilspan.plans.text import applied_detections, sanitize_texts

PHONES = [
    "0532 123 45 67", "05321234567", "532 123 45 67", "5321234567", "+90 532 123 45 67",
    "+905321234567", "0090 532 123 45 67", "0212 123 45 67", "02121234567", "+90 212 123 45 67",
    "+90 (212) 123 45 67", "(216) 123 45 67", "0216-123-45-67",
]
NOT_PHONES = ["12345", "123456789", "9999999999", "111 222 33 44", "1234 5678 9012"]
EMAILS = ["a@b.co", "first.last@mail.example.com", "a_b-c+d@x-y.org", "A@B.CO"]
NOT_EMAILS = ["example.com", "@example.com", "name@", "name@example", "name example.com"]


def valid_number(first9: str) -> str:
    d = [int(c) for c in first9]
    tenth = (sum(d[0::2]) * 7 - sum(d[1::2])) % 10
    return first9 + str(tenth) + str((sum(d) + tenth) % 10)


NUMBER = valid_number("100000001")


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", find_structured("text").alias("d")).orderBy("id").collect()
    return [[(d.detection_type, d.start, d.end, d.confidence) for d in row.d] for row in rows]


def test_phone_and_email_forms(spark):
    assert [[d[:3] for d in f] for f in found(spark, PHONES)] == [
        [("phone", 0, len(t))] for t in PHONES
    ]
    assert found(spark, NOT_PHONES) == [[]] * len(NOT_PHONES)
    assert [[d[:3] for d in f] for f in found(spark, EMAILS)] == [
        [("email", 0, len(t))] for t in EMAILS
    ]
    assert found(spark, NOT_EMAILS) == [[]] * len(NOT_EMAILS)


def test_identity_numbers(spark):
    spaced = f"{NUMBER[:3]} {NUMBER[3:6]} {NUMBER[6:9]} {NUMBER[9:]}"
    texts = [NUMBER, spaced, spaced.replace(" ", "."), "12345678901", "T.C. Kimlik No: 12345678901", "", None]
    tckn = [[d for d in f if d[0] == "tckn"] for f in found(spark, texts)]
    assert tckn[0] == [("tckn", 0, 11, 1.0)]
    assert tckn[1] == tckn[2] == [("tckn", 0, 14, 1.0)]
    assert tckn[3] == tckn[5] == tckn[6] == []
    assert tckn[4] == [("tckn", 16, 27, 0.95)]


def test_checksum(spark):
    arabic = "".join(chr(0x660 + int(c)) for c in NUMBER)
    values = [NUMBER, "0" + NUMBER[1:], NUMBER[:10], NUMBER[:10] + str((int(NUMBER[10]) + 1) % 10), arabic, None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string").orderBy("id")
    rows = df.select(is_valid_tckn("v").alias("ok"), normalize_digits("v").alias("n")).collect()
    assert [r.ok for r in rows] == [True, False, False, False, True, False]
    assert rows[4].n == arabic


def test_context_is_a_slice(spark):
    text = "TC " + "x" * 37 + "12345678901"
    # cutting a word open at the edge makes a word border there
    rows = [(text, 40, 51), ("z" + text, 41, 52), (text.replace("x1", "xx1"), 41, 52)]
    df = spark.createDataFrame(rows, "t string, s int, e int")
    assert [r[0] for r in df.select(has_tckn_context("t", "s", "e")).collect()] == [True, True, False]


def python_rule(pattern: str) -> re.Pattern:
    """The same expression for Python, which is Unicode-aware by itself."""
    flags = re.IGNORECASE if pattern.startswith("(?iuU)") else 0
    return re.compile(re.sub(r"^\(\?\w+\)", "", pattern).replace(P.WORD_EDGE, r"\b"), flags)


@pytest.mark.parametrize("pattern", [P.TCKN_CANDIDATE, P.PHONE, P.EMAIL])
def test_spans_match_python(spark, pattern):
    rng = random.Random(7)
    alphabet = ["0", "1", "2", "5", "9", "٣", " ", ".", "-", "\n", "\x1d", " ", "(", ")", "+90", "a", "İ", "ı", "😀", "@", "x.co", "b@c.de", "0532 123 45 67"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {
        r.id: [(s.start, s.end, s.match) for s in r.s]
        for r in df.select("id", match_spans("text", pattern).alias("s")).collect()
    }
    rule = python_rule(pattern)
    for i, text in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m.group()) for m in rule.finditer(text)], repr(text)


def test_word_borders_match_python(spark):
    """Combining marks and odd numbers next to a label, as Python sees them."""
    rng = random.Random(13)
    parts = ["TC", "T.C.", "T C", "tckn", "Kimlik No", "KİMLİK NUMARASI", "kimlik numarası:", "\u0301", "²", "Ⅷ", "_", "é", ".", " ", "x", "‿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    stops = ["tel.", "tel", "T.C.", "TCKN", "imza", "İMZA", "Tarih", "ad soyad", "ADI SOYADI", "e-posta"]
    lines = [rng.choice([" ", ""]) + rng.choice(stops) + rng.choice(parts + [""]) for _ in range(1000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + lines)], "id int, t string")
    got = {r.id: (r.c, r.s) for r in df.select("id", F.col("t").rlike(P.TCKN_CONTEXT).alias("c"), F.col("t").rlike(P.STOP_HEADER).alias("s")).collect()}
    context, stop = python_rule(P.TCKN_CONTEXT), python_rule(P.STOP_HEADER)
    for i, t in enumerate(texts + lines):
        assert got[i] == (bool(context.search(t)), bool(stop.match(t))), repr(t)


def test_many_matches_in_one_text(spark):
    """More matches than one fold block holds."""
    text = " ".join(f"u{i}@x.de" for i in range(1500))
    df = spark.createDataFrame([(text,)], "text string").withColumn("d", find_structured("text"))
    row = df.select("d", redact_text("text", "d").alias("r"), merge_spans("d").alias("m")).first()
    assert [(d.start, d.end) for d in row.d] == [m.span() for m in re.finditer(r"\S+", text)]
    assert len(row.m) == 1500
    assert row.r == " ".join(["[REDACTED]"] * 1500)


def python_merge(spans):
    merged = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def test_merge_and_redact_random(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = "".join(rng.choice("abcd😀é ") for _ in range(rng.randint(1, 40)))
        spans = []
        for _ in range(rng.choice([0, 1, 3, 8])):
            s = rng.randrange(len(text))
            spans.append((s, rng.randint(s + 1, len(text)), "phone", 1.0))
        rows.append((i, text, spans))
    rows.append((400, "abc", [(0, 2, "phone", 1.0), (0, 1, "email", 1.0)]))
    df = spark.createDataFrame(
        rows, "id int, text string, d array<struct<start:int,end:int,detection_type:string,confidence:double>>"
    )
    got = df.select("id", merge_spans("d").alias("m"), redact_text("text", "d").alias("r")).collect()
    for row in got:
        _, text, spans = rows[row.id]
        merged = python_merge([s[:2] for s in spans])
        assert [[m.start, m.end] for m in row.m] == merged
        for s, e in reversed(merged):
            text = text[:s] + "[REDACTED]" + text[e:]
        assert row.r == text


def test_dedupe_keeps_best(spark):
    d = [(5, 6, "email", 0.1), (1, 2, "phone", 0.2), (5, 6, "email", 0.9), (5, 6, "phone", 0.3)]
    df = spark.createDataFrame([(d,)], "d array<struct<start:int,end:int,detection_type:string,confidence:double>>")
    got = [tuple(x) for x in df.select(dedupe_detections("d").alias("d")).first().d]
    assert got == [(1, 2, "phone", 0.2), (5, 6, "email", 0.9), (5, 6, "phone", 0.3)]


def test_strip_is_unicode_aware(spark):
    df = spark.createDataFrame([(" \x1f a b \n",)], "t string")
    assert df.select(strip("t")).first()[0] == "a b"


def python_loop(text, passes):
    """A small model of the whole loop."""
    rules = {k: python_rule(p) for k, p in (("tckn", P.TCKN_CANDIDATE), ("phone", P.PHONE), ("email", P.EMAIL))}
    context = python_rule(P.TCKN_CONTEXT)

    def look(t):
        hits = []
        for kind, rule in rules.items():
            for m in rule.finditer(t):
                if kind == "tckn":
                    digits = "".join(c for c in m.group() if c.isdigit())
                    ok = digits[0] != "0" and valid_number(digits[:9]) == digits
                    if not ok and not context.search(t[max(0, m.start() - 40) : m.end() + 40]):
                        continue
                hits.append((m.start(), m.end(), kind))
        return sorted(hits)

    applied = []
    for _ in range(passes):
        hits = look(text)
        if not hits:
            break
        applied.append(hits)
        for s, e in reversed(python_merge([h[:2] for h in hits])):
            text = text[:s] + "[REDACTED]" + text[e:]
    return text, applied, look(text)


def test_sanitize_matches_model(spark):
    rng = random.Random(11)
    parts = ["TC ", "Kimlik No ", "12345678901 ", NUMBER + " ", "0532 123 45 67 ", "someone.with.long.name@mail.example.com ", "lorem ipsum ", "\n", "x" * 20 + " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(250)]
    # the label comes into range only once the address between is shorter
    texts.append("TC " + "a" * 40 + "@mail.example.com 12345678901")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    for passes in (1, 3):
        rows = sanitize_texts(df, max_passes=passes).collect()
        second = 0
        for row in rows:
            text, applied, remaining = python_loop(texts[row.id], passes)
            assert row.sanitized_text == text
            assert row.redaction_passes == len(applied)
            assert [[(d.start, d.end, d.detection_type) for d in p] for p in row.detections] == applied
            assert [(d.start, d.end, d.detection_type) for d in row.remaining] == remaining
            assert row.status == ("review_required" if remaining else "passed")
            second += len(applied) > 1
        assert passes == 1 or second


def test_sanitize_with_plugin_and_filters(spark):
    df = spark.createDataFrame([(1, "Ada wrote to a@b.de"), (2, "nothing")], "id int, text string")

    def names(text):
        at = F.instr(text, "Ada")
        hit = F.array(
            F.struct(
                (at - 1).alias("start"), (at + 2).alias("end"),
                F.lit("person").alias("detection_type"), F.lit(0.8).alias("confidence"),
            )
        )
        return F.when(at > 0, hit)

    done = sanitize_texts(df, semantic=names)
    assert done.filter("id = 1").first().sanitized_text == "[REDACTED] wrote to [REDACTED]"
    assert done.filter("status = 'passed' AND redaction_passes = 0").count() == 1
    kinds = applied_detections(done, ["id"]).select("detection_type", "pass_no").collect()
    assert sorted(map(tuple, kinds)) == [("email", 1), ("person", 1)]
    with pytest.raises(ValueError):
        sanitize_texts(df, max_passes=0)


def test_counts_include_zeros(spark):
    rows = spark.createDataFrame([], "detection_type string")
    counts = count_by_type(rows)
    assert counts.count() == 7
    assert missing_types(counts, ["face", "email"]).count() == 2


def test_no_text_in_outputs(spark):
    df = spark.createDataFrame([(1, "a@b.de")], "id int, text string")
    done = sanitize_texts(df, keep_text=False)
    assert "a@b.de" not in str(done.collect())
