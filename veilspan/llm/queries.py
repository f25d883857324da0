"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clustered, with_inertia
from .decontaminate import contamination
from .html_extract import extracted
from .importance import resampled
from .line_dedup import without_common_lines
from .minhash import near_duplicates
from .mixing import mixed
from .pii import pseudonymised
from .quality_classifier import quality
from .quality_rules import BOILERPLATE, CLOSED, FRAGMENT_WORDS, LEAST_WORDS, MOST_LOST, MOST_REPEATED, MOST_SYMBOLS, NAVIGATION, SEPARATED, SEPARATED_WORDS, SYMBOLS
from .quality_rules import judged as quality_judged
from .suffix_dedup import without_repeats
from .toxicity import toxicity
from .url_filter import UrlLists, judged


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    done = without_common_lines(docs, min_docs=10, min_length=1)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (SELECT doc_id, text, pos, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
common AS (SELECT key FROM (SELECT DISTINCT doc_id, text, key FROM k) WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id, k.text
"""


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf, "labels"), threshold=0.7)


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf, "benchmark"), window=10)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, s, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.r, dw.size, dw.s, iw.item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + size)) AS p FROM m) GROUP BY r),
k AS (SELECT r, count(*) AS n, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT DISTINCT r, item_id::VARCHAR AS v FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(k.n, 0) AS n_items,
       sha256(coalesce(k.v, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return quality_judged(docs).drop("cleaned")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLAIN_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SYMBOLS_IN = "(length({0}) - length(translate({0}, " + _quoted(SYMBOLS) + ", '')))"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, {_PLAIN_WORDS.format('t')} AS w FROM d),
g AS (SELECT r, s, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS s FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 5)) AS p FROM g JOIN twice USING (r, g)) GROUP BY r),
l AS (SELECT r, line, trim(line, {_BLANKS}) AS x FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT r, line, x, len({_PLAIN_WORDS.format('x')}) AS n FROM l),
f AS (SELECT r, line, x, 100 * {_SYMBOLS_IN.format('x')} > {MOST_SYMBOLS} * length(x) OR regexp_matches(x, {_quoted(NAVIGATION)})
    OR (n <= {SEPARATED_WORDS} AND regexp_matches(x, {_quoted(SEPARATED)})) OR regexp_matches(x, {_quoted(BOILERPLATE)})
    OR (n < {FRAGMENT_WORDS} AND NOT regexp_matches(x, {_quoted(CLOSED)})) AS fails FROM j),
k AS (SELECT r, count(*) FILTER (x <> '') - count(DISTINCT line) FILTER (x <> '') AS n_dup_lines, sum(length(x)) AS whole,
    coalesce(sum(length(x)) FILTER (x <> '' AND fails), 0) AS failing FROM f GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, list_sum([length(x) FOR x IN w])::BIGINT AS word_chars, {_SYMBOLS_IN.format('t')} AS n_symbols,
    n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, failing, whole
  FROM d JOIN w USING (r) JOIN k USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * failing <= {MOST_LOST} * whole AS kept FROM b
"""


def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = near_duplicates(docs, words=5, percent=85)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept)


_SPACED = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACED.format('text')}, []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
t AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN t USING (doc_id)
"""


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    done = without_repeats(docs, length=400).withColumnRenamed("id", "doc_id")
    # a removed run may end inside a character; only the digest is of the exact bytes
    return done.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixed(docs, weights=(5, 2, 1), most=3).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")



def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return pseudonymised(docs, key="corpus release key 1")


#: Verdict, host and beginning of the path of each rule.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCKED_HOSTS = (
    "adult-x.example.com",
    "ads-track.example.com",
    "casino-win.example.net",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
)


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    lists = UrlLists.share(spark, URL_RULES, BLOCKED_HOSTS)
    pages = _table(spark, sf, "pages").select("page_id", "url")
    return judged(pages, lists).withColumnRenamed("id", "page_id")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_HOST_ROWS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)

OP5_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, host, path) AS (VALUES {_RULE_ROWS}), hosts(host) AS (VALUES {_HOST_ROWS}),
m AS (SELECT p.r, x.verdict, x.host || x.path AS rule,
    row_number() OVER (PARTITION BY p.r ORDER BY length(x.host || x.path) DESC, length(x.host) DESC) AS k
  FROM p JOIN rules x ON (p.host = x.host OR ends_with(p.host, '.' || x.host)) AND starts_with(p.path, x.path))
SELECT page_id, host, path, m.rule AS rule,
  coalesce(m.verdict, CASE WHEN EXISTS (SELECT 1 FROM hosts h WHERE p.host = h.host OR ends_with(p.host, '.' || h.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.r = m.r AND m.k = 1
"""


def op10_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(_table(spark, sf, "pages").select("page_id", "url", "html"))


def op11_importance(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    drawn = resampled(docs, _table(spark, sf, "benchmark"), percent=10, least_words=20, seed=2024, least=1, most=1, buckets=10_000)
    return drawn.withColumnRenamed("id", "doc_id").drop("n_words")


_BYTES_OF = "[('0x' || substr(hex(encode({0})), 2 * k + 1, 2))::BIGINT FOR k IN range(strlen({0}))]"

#: The CRC of a word is made from the table of its polynomial, byte by byte.
OP11_SQL = f"""
WITH polynomial AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS x FROM d),
tw AS (SELECT unnest({_WORDS.format('text')}) AS x FROM benchmark WHERE text IS NOT NULL),
x AS MATERIALIZED (SELECT x, xor(list_reduce({_BYTES_OF.format('x')},
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT x FROM dw UNION SELECT x FROM tw), polynomial),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN x USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN x USING (x) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN x USING (x) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
k AS (SELECT *, n_features >= 20 AS enough FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place FROM k)
SELECT doc_id, n_features, weight, score,
  CASE WHEN enough AND place <= 10 * (SELECT count(*) FROM k WHERE enough) // 100 THEN place END AS rank FROM o
"""


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    assigned, centroids = clustered(_table(spark, sf, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)
    return with_inertia(assigned, centroids).withColumnRenamed("id", "vec_id")


def _op12_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """One table of distances and one of centroids a round."""
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
    (SELECT v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM e) ORDER BY h, v LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, min(ROW(d, c)) AS best FROM
    (SELECT r, c, list_sum([(e.v[i] - c{n}.v[i]) * (e.v[i] - c{n}.v[i]) FOR i IN range(1, {dims + 1})])::BIGINT AS d FROM e, c{n}) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN
    (SELECT c, list(x ORDER BY i) AS v FROM
      (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM
        (SELECT a{n}.best[2] AS c, unnest(range({dims})) AS i, unnest(v) AS x FROM e JOIN a{n} USING (r)) GROUP BY c, i) GROUP BY c) m USING (c))"""
            )
    last = f"a{rounds}"
    return f"""
WITH {', '.join(steps)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance,
  (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM {last} JOIN e USING (r) JOIN c{rounds} ON c{rounds}.c = best[2]
"""


OP12_SQL = _op12_sql(40, 5, 64, 256, 2)


def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return quality(docs, _table(spark, sf, "labels"), threshold=0.3)


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_toxicity": (op2_toxicity, None),
    "op3_decontaminate": (op3_decontaminate, OP3_SQL),
    "op4_pii": (op4_pii, None),
    "op5_url_filter": (op5_url_filter, OP5_SQL),
    "op6_quality_rules": (op6_quality_rules, OP6_SQL),
    "op7_minhash": (op7_minhash, OP7_SQL),
    "op8_suffix_dedup": (op8_suffix_dedup, None),
    "op9_mixing": (op9_mixing, None),
    "op10_html_extract": (op10_html_extract, None),
    "op11_importance": (op11_importance, OP11_SQL),
    "op12_centroids": (op12_centroids, OP12_SQL),
    "op13_quality": (op13_quality, None),
}
