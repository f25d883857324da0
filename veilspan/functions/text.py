"""Column functions over whole texts: spans, recognizers, redaction.

Arguments are column names or SQL expressions.  The ``_sql`` forms return
expression text, to be used inside a larger expression.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.arrays import fresh_name, let, let_sql, running_sql
from veilspan.schemas import REDACTION_TOKEN, SPAN, TEXT_DETECTIONS


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def no_detections() -> Column:
    return F.array().cast(TEXT_DETECTIONS)


# --- trimming and digits ----------------------------------------------------


def strip(value: Column | str) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.regexp_replace(_col(value), rf"(?U)^{P.SPACE}+|{P.SPACE}+$", "")


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII counterpart."""
    found = [
        (chr(code), str(unicodedata.decimal(chr(code))))
        for code in range(128, sys.maxunicode + 1)
        if unicodedata.decimal(chr(code), None) is not None
    ]
    return "".join(f for f, _ in found), "".join(t for _, t in found)


def normalize_digits(value: Column | str) -> Column:
    """Drop everything that is not a decimal digit (of any script)."""
    return F.regexp_replace(_col(value), r"(?U)\D", "")


def is_valid_tckn_sql(value: str) -> str:
    source, target = _decimal_digits()
    digits = f"regexp_replace({value}, r'(?U)\\D', '')"

    def check(raw: str) -> str:
        plain = (
            f"CASE WHEN {raw} RLIKE r'[^\\x00-\\x7f]'"
            f" THEN translate({raw}, '{source}', '{target}') ELSE {raw} END"
        )

        def rule(n: str) -> str:
            d = [f"cast(substring({n}, {i}, 1) AS int)" for i in range(1, 12)]
            odd, even = " + ".join(d[0:9:2]), " + ".join(d[1:8:2])
            return (
                f"coalesce(length({n}) = 11 AND {d[0]} <> 0"
                f" AND {d[9]} = pmod(({odd}) * 7 - ({even}), 10)"
                f" AND {d[10]} = pmod({odd} + {even} + {d[9]}, 10), false)"
            )

        return let_sql(plain, rule)

    return let_sql(digits, check)


def is_valid_tckn(value: str) -> Column:
    """Checksum test for an 11-digit identity number, separators ignored."""
    return F.expr(is_valid_tckn_sql(value))


def has_tckn_context_sql(text: str, start: str, end: str, radius: int) -> str:
    left = f"greatest(0, {start} - {radius})"
    return (
        f"substring({text}, {left} + 1, {end} + {radius} - {left})"
        f" RLIKE r'{P.TCKN_CONTEXT}'"
    )


def has_tckn_context(
    text: str, start: str, end: str, radius: int = P.TCKN_CONTEXT_RADIUS
) -> Column:
    """True when an identity-number label lies near ``[start, end)``."""
    return F.expr(has_tckn_context_sql(text, start, end, radius))


# --- span extraction --------------------------------------------------------


def match_spans_sql(text: str, pattern: str) -> str:
    def locate(matches: str) -> str:
        def place(gaps: str) -> str:
            lengths = f"transform({matches}, (m, i) -> length({gaps}[i]) + length(m))"
            return let_sql(
                running_sql(lengths, "0", lambda a, b: f"{a} + {b}"),
                lambda before: f"transform({matches}, (m, i) -> named_struct("
                f"'start', {before}[i] + length({gaps}[i]),"
                f" 'end', {before}[i] + length({gaps}[i]) + length(m), 'match', m))",
            )

        return (
            f"CASE WHEN size({matches}) > 0 THEN {let_sql(f'split({text}, {quoted}, -1)', place)}"
            " ELSE cast(array() AS array<struct<start:int,end:int,match:string>>) END"
        )

    quoted = f"r'{pattern}'"
    return let_sql(f"regexp_extract_all({text}, {quoted}, 0)", locate)


def match_spans(text: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start,end,match>>``.

    Offsets are half-open and count code points.  The matches and the pieces
    between them alternate, so their lengths add up to the offsets.
    ``pattern`` must not match the empty string.
    """
    return F.expr(match_spans_sql(text, pattern))


_NONE = f"cast(array() AS {TEXT_DETECTIONS})"


def _guarded(condition: str, detections: str) -> str:
    return f"CASE WHEN {condition} THEN {detections} ELSE {_NONE} END"


def _typed(spans: str, kind: str) -> str:
    return (
        f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end,"
        f" 'detection_type', '{kind}', 'confidence', 1.0D))"
    )


def find_tckn_sql(text: str) -> str:
    s = fresh_name()
    confidence = (
        f"CASE WHEN {is_valid_tckn_sql(f'{s}.match')} THEN 1.0D"
        f" WHEN {has_tckn_context_sql(text, f'{s}.start', f'{s}.end', P.TCKN_CONTEXT_RADIUS)}"
        " THEN 0.95D END"
    )
    scored = (
        f"filter(transform({match_spans_sql(text, P.TCKN_CANDIDATE)}, {s} -> named_struct("
        f"'start', {s}.start, 'end', {s}.end, 'detection_type', 'tckn',"
        f" 'confidence', {confidence})), d -> d.confidence IS NOT NULL)"
    )
    return _guarded(f"{text} RLIKE r'{P.TCKN_GUARD}'", scored)


def find_phones_sql(text: str) -> str:
    return _guarded(
        f"{text} RLIKE r'{P.PHONE_GUARD}'", _typed(match_spans_sql(text, P.PHONE), "phone")
    )


def find_emails_sql(text: str) -> str:
    return _guarded(
        f"contains({text}, '@')", _typed(match_spans_sql(text, P.EMAIL), "email")
    )


def find_structured_sql(text: str) -> str:
    return let_sql(
        text,
        lambda t: f"array_sort(concat({find_tckn_sql(t)}, {find_phones_sql(t)}, {find_emails_sql(t)}))",
    )


def find_tckn(text: str) -> Column:
    """Identity numbers: checksum-valid (1.0) or labelled (0.95)."""
    return F.expr(let_sql(text, find_tckn_sql))


def find_phones(text: str) -> Column:
    return F.expr(let_sql(text, find_phones_sql))


def find_emails(text: str) -> Column:
    return F.expr(let_sql(text, find_emails_sql))


def find_structured(text: str) -> Column:
    """All structured detections ordered by (start, end, type).

    Within one type matches never overlap, so no duplicates can arise here.
    """
    return F.expr(find_structured_sql(text))


def dedupe_detections(detections: Column | str) -> Column:
    """One detection per (type, start, end) with the highest confidence."""

    def survivors(ordered: Column) -> Column:
        def first(d: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)
            same = (
                (before["start"] == d["start"])
                & (before["end"] == d["end"])
                & (before["detection_type"] == d["detection_type"])
            )
            return (i == 0) | ~same

        return F.filter(ordered, first)

    # best score first among equals, then compared with the neighbour only
    ranked = F.array_sort(
        F.transform(
            _col(detections),
            lambda d: F.struct(
                d["start"].alias("start"),
                d["end"].alias("end"),
                d["detection_type"].alias("detection_type"),
                (-d["confidence"]).alias("confidence"),
            ),
        )
    )
    return F.transform(
        let(ranked, survivors),
        lambda d: F.struct(
            d["start"].alias("start"),
            d["end"].alias("end"),
            d["detection_type"].alias("detection_type"),
            (-d["confidence"]).alias("confidence"),
        ),
    )


def find_pii(text: str, semantic: Column | None = None) -> Column:
    """Structured detections, joined with plug-in detections where given."""
    structured = find_structured(text)
    if semantic is None:
        return structured
    return dedupe_detections(
        F.concat(structured, F.coalesce(semantic, no_detections()))
    )


# --- redaction --------------------------------------------------------------


def merge_spans_sql(detections: str) -> str:
    ordered = (
        f"array_sort(transform({detections}, d -> named_struct('start', d.start, 'end', d.end)))"
    )

    def islands(spans: str) -> str:
        ends = f"transform({spans}, s -> s.end)"

        def build(before: str) -> str:
            heads = (
                f"filter(sequence(0, size({spans}) - 1),"
                f" i -> {spans}[i].start > {before}[i])"
            )
            return let_sql(
                heads,
                lambda h: f"transform({h}, (first, k) -> named_struct("
                f"'start', {spans}[first].start,"
                f" 'end', coalesce(get({before}, get({h}, k + 1)), array_max({ends}))))",
            )

        runs = let_sql(running_sql(ends, "-1", lambda a, b: f"greatest({a}, {b})"), build)
        return f"CASE WHEN size({spans}) > 0 THEN {runs} ELSE cast(array() AS array<{SPAN}>) END"

    return let_sql(ordered, islands)


def merge_spans(detections: str) -> Column:
    """Physical spans: overlapping or touching detections become one."""
    return F.expr(merge_spans_sql(detections))


def redact_text_sql(text: str, detections: str) -> str:
    def cut(spans: str) -> str:
        begin = f"CASE WHEN i = 0 THEN 0 ELSE {spans}[i - 1].end END"
        pieces = (
            f"transform({spans}, (s, i) -> substring({text}, {begin} + 1, s.start - {begin}))"
        )
        tail = f"substring({text}, element_at({spans}, -1).end + 1)"
        return (
            f"CASE WHEN size({spans}) > 0 THEN"
            f" array_join(concat({pieces}, array({tail})), '{REDACTION_TOKEN}')"
            f" ELSE {text} END"
        )

    return let_sql(merge_spans_sql(detections), cut)


def redact_text(text: str, detections: str) -> Column:
    """Replace every merged span by the redaction token."""
    return F.expr(redact_text_sql(text, detections))
