"""Derived inputs and SQL building blocks shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import load_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Derived:
    """Select steps on top of a table, run by Spark and printed as SQL."""

    table: str
    steps: tuple[tuple[str, ...], ...]
    where: str | None = None

    def df(self, spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
        result = load_table(spark, sf, self.table, spread)
        for step in self.steps:
            result = result.selectExpr(*step)
        return result if self.where is None else result.filter(self.where)

    def sql(self) -> str:
        query = self.table
        for i, step in enumerate(self.steps):
            query = f"(SELECT {', '.join(step)} FROM {query}) AS s{i}"
        return query if self.where is None else f"(SELECT * FROM {query} WHERE {self.where}) AS w"


# Contact cards: a name, an identity number (every third with a wrong checksum,
# every fifth labelled), a phone number, an e-mail address and an address block.
CARDS = Derived(
    "customer",
    (
        (
            "c_custkey AS doc_id",
            "c_name AS name",
            "c_nationkey AS nation",
            "cast(100000000 + (c_custkey * 7919) % 899999999 AS string) AS f9",
        ),
        (
            "doc_id", "name", "nation", "f9",
            "cast(substr(f9,1,1) AS int) + cast(substr(f9,3,1) AS int) + cast(substr(f9,5,1) AS int)"
            " + cast(substr(f9,7,1) AS int) + cast(substr(f9,9,1) AS int) AS odd",
            "cast(substr(f9,2,1) AS int) + cast(substr(f9,4,1) AS int)"
            " + cast(substr(f9,6,1) AS int) + cast(substr(f9,8,1) AS int) AS even",
        ),
        (
            "doc_id", "name", "nation", "f9", "odd + even AS s9",
            "((odd * 7 - even) % 10 + 10) % 10 AS d10",
        ),
        (
            "doc_id", "name", "nation",
            "concat(f9, cast(d10 AS string), cast((s9 + d10 + CASE WHEN doc_id % 3 = 0"
            " THEN 1 ELSE 0 END) % 10 AS string)) AS tckn",
            "concat(lpad(cast((doc_id * 37) % 1000 AS string), 3, '0'), ' ',"
            " lpad(cast((doc_id * 11) % 100 AS string), 2, '0'), ' ',"
            " lpad(cast((doc_id * 7) % 100 AS string), 2, '0')) AS tail",
        ),
        (
            "doc_id", "name", "nation", "tckn",
            "CASE WHEN doc_id % 12 = 7 THEN concat(substr(tckn,1,5), chr(10), substr(tckn,6,6))"
            " WHEN doc_id % 4 = 1 THEN concat(substr(tckn,1,3),' ',substr(tckn,4,3),' ',"
            "substr(tckn,7,3),' ',substr(tckn,10,2))"
            " WHEN doc_id % 4 = 2 THEN concat(substr(tckn,1,3),'.',substr(tckn,4,3),'.',"
            "substr(tckn,7,3),'-',substr(tckn,10,2)) ELSE tckn END AS shown",
            "CASE WHEN doc_id % 4 = 0 THEN concat('+90 532 ', tail)"
            " WHEN doc_id % 4 = 1 THEN concat('0(212) ', tail)"
            " WHEN doc_id % 4 = 2 THEN concat('0542', replace(tail, ' ', ''))"
            " ELSE concat('216-', replace(tail, ' ', '-')) END AS phone",
        ),
        (
            "doc_id", "name", "nation", "tckn", "phone",
            "concat(name, chr(10),"
            " CASE WHEN doc_id % 5 = 0 THEN 'T.C. Kimlik No: ' ELSE 'Ref ' END, shown, chr(10),"
            " CASE WHEN doc_id % 2 = 0 THEN 'Telefon: ' ELSE 'tel ' END, phone, chr(10),"
            " 'E-posta: c', cast(doc_id AS string), '.x@mail', cast(nation AS string), '.example.com', chr(10),"
            " CASE WHEN doc_id % 7 = 0 THEN '   ' ELSE 'ok' END, chr(10),"
            " CASE WHEN doc_id % 9 = 0 THEN 'no block here' WHEN doc_id % 4 = 3 THEN 'Ev adresi'"
            " ELSE 'Adres:' END, chr(10),"
            " 'Sokak ', cast(doc_id % 97 AS string), chr(10), 'NATION_', cast(nation AS string), chr(10),"
            " CASE WHEN doc_id % 3 = 1 THEN 'Tarih: 2024' ELSE 'Kat 3' END, chr(10),"
            " 'Not 1', chr(10), 'Not 2', chr(10), 'Not 3', chr(10), 'Not 4') AS text",
        ),
    ),
)

DOCUMENTS = Derived("documents", (("doc_id", "text", "lang", "source"),))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return CARDS.df(spark, sf, spread=True)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "documents", spread=True).select(
        "doc_id", "text", "lang", "source"
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cards and documents under one string key."""
    a = cards(spark, sf).select(F.concat(F.lit("c"), "doc_id").alias("doc_id"), "text")
    b = documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    return a.unionByName(b)


TEXTS_SQL = (
    f"(SELECT concat('c', doc_id) AS doc_id, text FROM {CARDS.sql()}"
    " UNION ALL SELECT concat('d', doc_id) AS doc_id, text FROM documents) AS texts"
)


# --- lines ------------------------------------------------------------------

LINE_BOX = {
    "x1": "20 + doc_id % 7",
    "y1": "40 * line_no + CASE WHEN doc_id % 6 = 0 AND line_no >= 6 THEN 200 ELSE 0 END",
    "w": "8 * length(text)",
    "h": "24",
    "confidence": "cast(50 + (doc_id + line_no) % 50 AS double) / 100",
}


def lines_of(df: DataFrame) -> DataFrame:
    """Line table of a ``doc_id, text`` table; blank lines are left out."""
    kept = F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")
    return (
        df.select("doc_id", F.posexplode(kept).alias("line_no", "text"))
        .selectExpr("doc_id", "line_no", "text", *(f"{e} AS {n}" for n, e in LINE_BOX.items()))
        .selectExpr(
            "doc_id", "1 AS page_no", "line_no", "text",
            "named_struct('x1', cast(x1 AS int), 'y1', cast(y1 AS int),"
            " 'x2', cast(x1 + w AS int), 'y2', cast(y1 + h AS int)) AS bbox",
            "confidence",
        )
    )


def lines_sql(source: str) -> str:
    """The same line table: doc_id, line_no, text, x1, y1, x2, y2, confidence."""
    return (
        "(SELECT doc_id, line_no, text, x1, y1, x1 + w AS x2, y1 + h AS y2, confidence FROM"
        f" (SELECT doc_id, line_no, text, {', '.join(f'{e} AS {n}' for n, e in LINE_BOX.items())}"
        " FROM (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no"
        " FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '')"
        f" AS ls FROM {source}) AS l0) AS l1) AS l2) AS lines"
    )


def page_rows(df: DataFrame) -> DataFrame:
    """Page rows of a ``doc_id, text`` table, built inside each row."""
    kept = F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")

    def item(text, i):
        doc = F.col("doc_id")
        x1 = (20 + doc % 7).cast("int")
        y1 = (40 * i + F.when((doc % 6 == 0) & (i >= 6), 200).otherwise(0)).cast("int")
        return F.struct(
            text.alias("text"),
            F.struct(
                x1.alias("x1"), y1.alias("y1"),
                (x1 + 8 * F.length(text)).alias("x2"), (y1 + 24).alias("y2"),
            ).alias("bbox"),
            ((50 + (doc + i) % 50).cast("double") / 100).alias("confidence"),
        )

    return df.select(
        "doc_id", F.lit(1).alias("page_no"), F.transform(kept, item).alias("items")
    )


def flat_box(box: str = "bbox") -> list:
    return [F.col(f"{box}.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]


BOX_SQL = ", ".join(f"cast({c} AS bigint) AS {c}" for c in ("x1", "y1", "x2", "y2"))


# --- spans in SQL -----------------------------------------------------------
# The checking engine has no look-around.  Every character that may stand next
# to a match is doubled first, so that neighbouring matches do not compete for
# it; matches are then put between two marks, and lengths give the offsets.

_MAIL = r"A-Za-z0-9._%+\-"
_SEP = r"(?:\s\s|\.\.|--)"
SPAN_RULES = {
    # type: (outside character, pattern with doubled outside characters)
    "email": (
        rf"[^{_MAIL}]",
        rf"[{_MAIL}]+@@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}",
    ),
    "tckn": (r"\D", rf"\d(?:{_SEP}?\d){{10}}"),
    "phone": (
        r"\D",
        rf"(?:(?:\+\+90|0090){_SEP}*)?0?(?:\(\()?[2345]\d{{2}}(?:\)\))?{_SEP}*\d{{3}}"
        rf"{_SEP}*\d{{2}}{_SEP}*\d{{2}}",
    ),
}


def raw_spans_sql(source: str, kind: str, key: str = "doc_id", text: str = "text") -> str:
    """``key, start, end, match`` of one pattern, as a bracketed query."""
    out, pattern = SPAN_RULES[kind]

    def single(s: str) -> str:
        return f"regexp_replace({s}, '({out}){out}', '\\1', 'g')"

    return f"""(
      WITH marked AS (
        SELECT {key} AS k, string_split(regexp_replace(
            regexp_replace({text}, '({out})', '\\1\\1', 'g'),
            '(^|{out})({pattern})($|{out})',
            concat('\\1', chr(1), '\\2', chr(2), '\\3'), 'g'), chr(1)) AS parts
        FROM {source}),
      pieces AS (
        SELECT k, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM marked),
      cut AS (
        SELECT k, i,
          CASE WHEN i = 1 THEN '' ELSE {single("split_part(part, chr(2), 1)")} END AS match,
          CASE WHEN i = 1 THEN {single("part")} ELSE {single("split_part(part, chr(2), 2)")} END AS rest
        FROM pieces),
      placed AS (
        SELECT k, i, match, sum(length(match) + length(rest)) OVER (PARTITION BY k ORDER BY i)
          - length(match) - length(rest) AS start FROM cut)
      SELECT k AS {key}, cast(start AS bigint) AS "start",
        cast(start + length(match) AS bigint) AS "end", match
      FROM placed WHERE i > 1)"""


def valid_tckn_sql(digits: str) -> str:
    d = [f"cast(substr({digits},{i},1) AS int)" for i in range(1, 12)]
    odd, even = "+".join(d[0:9:2]), "+".join(d[1:8:2])
    return (
        f"(length({digits}) = 11 AND substr({digits},1,1) <> '0'"
        f" AND {d[9]} = ((({odd}) * 7 - ({even})) % 10 + 10) % 10"
        f" AND {d[10]} = ({odd} + {even} + {d[9]}) % 10)"
    )


CONTEXT_SQL = (
    r"(?i)(?:\bT\.?\s*C\.?\b|\bTC\b|\bTCKN\b|\bT\.?\s*C\.?\s*Kimlik\b"
    r"|\bKimlik\s*(?:No|Numarası|Numarasi)\b|\bKimlik\s*(?:No|Numarası|Numarasi)\s*[:.]?)"
)


def detections_sql(source: str, key: str = "doc_id", text: str = "text") -> str:
    """``key, detection_type, start, end, confidence`` of all structured hits."""
    return f"""(
      SELECT {key}, 'email' AS detection_type, "start", "end", 1.0::double AS confidence
      FROM {raw_spans_sql(source, "email", key, text)} AS e
      UNION ALL
      SELECT {key}, 'phone', "start", "end", 1.0::double
      FROM {raw_spans_sql(source, "phone", key, text)} AS p
      UNION ALL
      SELECT {key}, 'tckn', "start", "end", CASE WHEN ok THEN 1.0 ELSE 0.95 END::double FROM (
        SELECT r.{key}, r."start", r."end",
          {valid_tckn_sql("regexp_replace(match, '[^0-9]', '', 'g')")} AS ok,
          regexp_matches(substr(t.{text}, cast(greatest(0, r."start" - 40) + 1 AS bigint),
            cast(r."end" + 40 - greatest(0, r."start" - 40) AS bigint)), '{CONTEXT_SQL}') AS labelled
        FROM {raw_spans_sql(source, "tckn", key, text)} AS r
        JOIN {source} ON r.{key} = {source.rsplit(" AS ", 1)[-1]}.{key}
      ) AS scored WHERE ok OR labelled)""".replace(
        f"t.{text}", f"{source.rsplit(' AS ', 1)[-1]}.{text}"
    )


def redacted_sql(source: str, detections: str, key: str = "doc_id", text: str = "text") -> str:
    """``key, text`` after replacing the merged spans of ``detections``."""
    name = source.rsplit(" AS ", 1)[-1]
    return f"""(
      WITH spans AS (SELECT DISTINCT {key} AS k, "start" AS s, "end" AS e FROM {detections} AS d),
      reach AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans),
      isles AS (SELECT k, s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END)
        OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM reach),
      merged AS (SELECT k, n, min(s) AS s, max(e) AS e FROM isles GROUP BY k, n),
      chained AS (SELECT k, s, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS p FROM merged),
      built AS (SELECT c.k, string_agg(concat(substr({name}.{text}, cast(p + 1 AS bigint),
          cast(s - p AS bigint)), '[REDACTED]'), '' ORDER BY s) AS head, max(e) AS last
        FROM chained c JOIN {source} ON {name}.{key} = c.k GROUP BY c.k)
      SELECT {name}.{key}, CASE WHEN b.k IS NULL THEN {name}.{text}
        ELSE concat(b.head, substr({name}.{text}, cast(b.last + 1 AS bigint))) END AS {text}
      FROM {source} LEFT JOIN built b ON b.k = {name}.{key})"""
