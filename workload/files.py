"""Queries over file lists, file contents, uploads and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import paths as P
from veilspan.operators import manifest as M
from veilspan.operators.batch import number_files, output_collisions
from veilspan.operators.tree import audit_summary, audit_tree
from veilspan.session import load_table
from veilspan.sources import files as S
from workload.common import Derived

# --- file names -------------------------------------------------------------

FILES = Derived(
    "part",
    ((
        "p_partkey",
        "concat('/data/', CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b/c' END, '/',"
        " CASE WHEN p_partkey % 41 = 0 THEN '.hidden' WHEN p_partkey % 43 = 0 THEN 'noext'"
        " ELSE concat('File.', cast(p_partkey % 700 AS string), CASE p_partkey % 9 WHEN 0 THEN '.png'"
        " WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.pdf' WHEN 4 THEN '.doc' WHEN 5 THEN '.docx'"
        " WHEN 6 THEN '.txt' WHEN 7 THEN '.csv' ELSE '.Txt' END) END) AS path",
        "cast(p_size AS bigint) AS length",
    ),),
)
# name without directory, and its lower-cased extension
NAMED = f"""(SELECT *, CASE WHEN p_partkey % 41 = 0 OR p_partkey % 43 = 0 THEN '' ELSE
      ['.png', '.jpg', '.jpeg', '.pdf', '.doc', '.docx', '.txt', '.csv', '.txt'][p_partkey % 9 + 1] END AS ext,
    CASE WHEN p_partkey % 41 = 0 THEN '.hidden' WHEN p_partkey % 43 = 0 THEN 'noext'
      ELSE concat('File.', p_partkey % 700) END AS stem FROM {FILES.sql()}) AS named"""
ROUTE = """CASE WHEN ext IN ('.png', '.jpg', '.jpeg') THEN 'image' WHEN ext = '.pdf' THEN 'pdf'
      WHEN ext IN ('.doc', '.docx') THEN 'word' WHEN ext = '.txt' THEN 'text' END"""
OUTPUT = "concat('/out/', stem, '_REDACTED', CASE WHEN ext IN ('.doc', '.docx') THEN '.pdf' ELSE ext END)"


def supported_files(spark, sf):
    return S.list_supported(FILES.df(spark, sf)).select("path", "length")


def routed_files(spark, sf):
    return S.route_files(FILES.df(spark, sf)).select("p_partkey", "route", "error")


def output_paths(spark, sf):
    path = F.col("path")
    directory = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return FILES.df(spark, sf).select(
        "p_partkey",
        P.output_path(path, F.lit("/out")).alias("output_path"),
        P.default_output_directory(path, F.lit(True)).alias("file_directory"),
        P.default_output_directory(directory, F.lit(False)).alias("tree_directory"),
    )


OUTPUT_PATHS_SQL = f"""
    SELECT p_partkey, {OUTPUT} AS output_path,
      CASE WHEN p_partkey % 3 = 0 THEN '/data/a' ELSE '/data/b/c' END AS file_directory,
      CASE WHEN p_partkey % 3 = 0 THEN '/data/a_REDACTED' ELSE '/data/b/c_REDACTED' END AS tree_directory
    FROM {NAMED}"""


def colliding_outputs(spark, sf):
    files = FILES.df(spark, sf).filter(P.is_supported("path"))
    return output_collisions(files.withColumn("output_path", P.output_path("path", F.lit("/out"))))


COLLISIONS_SQL = f"""SELECT {OUTPUT} AS output_path, count(*) AS n FROM {NAMED} WHERE ext NOT IN ('', '.csv')
    GROUP BY 1 HAVING count(*) > 1"""


def numbered_files(spark, sf):
    """Documents as files, numbered in path order."""
    files = load_table(spark, sf, "documents").select(
        F.concat(F.lit("/docs/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path")
    )
    return number_files(files).select("path", F.col("position").cast("long").alias("position"), "total")


NUMBERED_SQL = """
    SELECT path, row_number() OVER (ORDER BY path) AS position, count(*) OVER () AS total
    FROM (SELECT concat('/docs/', source, '/', lpad(cast(doc_id AS varchar), 9, '0'), '.txt') AS path FROM documents) AS d"""


PATHS = Derived(
    "part",
    ((
        "p_partkey",
        "concat(CASE p_partkey % 8 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN './' WHEN 3 THEN 'x//'"
        " WHEN 4 THEN 'x\\\\' WHEN 5 THEN ' ' ELSE '' END, CASE WHEN p_partkey % 16 = 13 THEN ' ' ELSE"
        " concat('a/', replace(p_name, ' ', '/'), CASE WHEN p_partkey % 5 = 0 THEN '/ş..bin' ELSE '/f.bin' END) END) AS path",
    ),),
)
PATHS_SQL = PATHS.sql().replace("x\\\\", "x\\")


def path_checks(spark, sf):
    return PATHS.df(spark, sf).select(
        "p_partkey",
        P.is_safe_relative_path("path").alias("safe"),
        P.is_ascii("path").alias("ascii"),
        M.normalized_path("path").alias("normalized"),
    )


CHECKS_SQL = f"""
    SELECT p_partkey, p_partkey % 8 NOT IN (0, 1, 4) AND p_partkey % 16 <> 13 AS safe, p_partkey % 5 <> 0 OR p_partkey % 16 = 13 AS ascii,
      list_aggregate(list_filter(string_split(trim(path), '/'), lambda p: p <> '' AND p <> '.'), 'string_agg', '/') AS normalized
    FROM {PATHS_SQL}""".replace("list_aggregate(", "coalesce(list_aggregate(").replace("'/') AS normalized", "'/'), '') AS normalized")


def fingerprints(spark, sf):
    return load_table(spark, sf, "documents", spread=True).select(
        "doc_id", P.fingerprint(F.encode("text", "UTF-8")).alias("source_sha256")
    )


# --- contents ---------------------------------------------------------------


def decoded_texts(spark, sf):
    """Documents as raw bytes: with marks, other line ends, and invalid bytes."""
    docs = load_table(spark, sf, "documents", spread=True)
    k = F.col("doc_id")
    text = F.when(k % 4 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.when(k % 4 == 2, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    )
    content = F.concat(
        F.when(k % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))),
        F.encode(text, "UTF-8"),
        F.when(k % 10 == 7, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit(""))),
    )
    name = F.when(k % 13 == 4, F.lit(".md")).otherwise(F.lit(".txt"))
    files = docs.select(
        F.concat(F.lit("/in/"), k.cast("string"), name).alias("path"), content.alias("content"), "doc_id"
    )
    read = S.read_texts(files)
    return read.select(
        "doc_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "output_path", "error"
    )


DECODED_SQL = """
    SELECT doc_id, CASE WHEN error IS NULL THEN text END AS text,
      concat('/in/', doc_id, '_REDACTED', CASE WHEN doc_id % 13 = 4 THEN '.md' ELSE '.txt' END) AS output_path, error
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 13 = 4 THEN 'expected a .txt file'
      WHEN doc_id % 10 = 7 THEN 'not valid UTF-8' END AS error FROM documents) AS d"""

_W, _H = "((p_partkey * 97) % 9000)", "((p_partkey * 31) % 9000)"


def checked_uploads(spark, sf):
    """PNG headers, JPEG and PDF starts, some declared as something else."""
    parts = load_table(spark, sf, "part").selectExpr("p_partkey", f"{_W} AS w", f"{_H} AS h")
    k = F.col("p_partkey")
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"),
        F.lpad(F.hex("w"), 8, "0"),
        F.lpad(F.hex("h"), 8, "0"),
        F.when(k % 11 == 0, F.repeat(F.lit("00"), 40)).otherwise(F.lit("")),
    )
    content = (
        F.when(k % 17 == 0, F.lit(""))
        .when(k % 4 == 0, F.lit("FFD8FFE000104A46"))
        .when(k % 4 == 1, F.lit("255044462D312E37"))
        .otherwise(png)
    )
    declared = (
        F.when(k % 13 == 0, "text/plain")
        .when(k % 4 == 0, F.when(k % 8 == 0, "image/jpeg").otherwise("image/png"))
        .when(k % 4 == 1, "application/pdf")
        .otherwise(F.when(k % 7 == 0, "image/jpeg").otherwise("image/png"))
    )
    uploads = parts.select(
        "p_partkey",
        F.unhex(content).alias("content"),
        declared.alias("media_type"),
        F.when((k % 4 == 0) & (k % 3 != 0), F.col("w")).alias("image_width"),
        F.when((k % 4 == 0) & (k % 3 != 0), F.col("h")).alias("image_height"),
    )
    return S.validate_uploads(uploads, max_bytes=60).select("p_partkey", "accepted", "reject_reason")


UPLOADS_SQL = f"""
    SELECT p_partkey, reject_reason IS NULL AS accepted, reject_reason FROM (SELECT p_partkey,
      CASE WHEN k % 13 = 0 THEN 'unsupported_media_type' WHEN k % 17 = 0 THEN 'empty'
        WHEN k % 4 NOT IN (0, 1) AND k % 11 = 0 THEN 'too_large'
        WHEN k % 4 = 0 AND (k % 3 = 0 OR w = 0 OR h = 0) THEN 'not_an_image'
        WHEN k % 4 NOT IN (0, 1) AND (w = 0 OR h = 0) THEN 'not_an_image'
        WHEN k % 4 <> 1 AND w * h > 50000000 THEN 'too_many_pixels'
        WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'format_mismatch'
        WHEN k % 4 NOT IN (0, 1) AND k % 7 = 0 THEN 'format_mismatch' END AS reject_reason
      FROM (SELECT p_partkey, p_partkey AS k, {_W} AS w, {_H} AS h FROM part) AS p) AS q"""


# A supplier's order lines in many short documents, or in few long ones.
_PDF = "l_suppkey * 1000 + l_partkey % (CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE 60 END)"


def checked_pdfs(spark, sf):
    """PDFs of suppliers' order lines, one page per part; customers have none."""
    pages = load_table(spark, sf, "lineitem").selectExpr(
        f"{_PDF} AS doc_id", "cast(l_partkey AS bigint) AS page_no",
        "l_quantity * 40 AS width_pt", "l_tax * 10000 + 500 AS height_pt",
    )
    empty = load_table(spark, sf, "customer").selectExpr(
        "-1 - c_custkey AS doc_id", "cast(NULL AS bigint) AS page_no",
        "cast(NULL AS double) AS width_pt", "cast(NULL AS double) AS height_pt",
    )
    return S.validate_pdf_pages(pages.unionByName(empty)).select(
        "doc_id", "page_count", "oversized_page", "reject_reason"
    )


PDFS_SQL = f"""
    SELECT doc_id, page_count, oversized_page, CASE WHEN page_count < 1 THEN 'no_pages' WHEN page_count > 100 THEN 'too_many_pages'
      WHEN oversized_page IS NOT NULL THEN 'too_many_pixels' END AS reject_reason
    FROM (SELECT {_PDF} AS doc_id, count(*) AS page_count, min(CASE WHEN ceil(l_quantity * 40 * (300 / 72.0::double))
          * ceil((l_tax * 10000 + 500) * (300 / 72.0::double)) > 50000000 THEN l_partkey END) AS oversized_page
        FROM lineitem GROUP BY ALL
      UNION ALL SELECT -1 - c_custkey, 0, NULL FROM customer) AS p"""


# --- manifests --------------------------------------------------------------

# Each part is a manifest of two models with one source and two files each.


def _manifests(spark, sf):
    parts = load_table(spark, sf, "part", spread=True)
    k = F.col("p_partkey")

    def text(condition, bad, good):
        return F.when(condition, F.lit(bad)).otherwise(good)

    def file(n):
        return F.struct(
            text(k % 12 == n, "../f.bin", F.concat(F.lit("f"), F.when(k % 19 == 1, F.lit("0")).otherwise(F.lit(str(n))), F.lit(".bin"))).alias("path"),
            (k % 15 * (n + 1)).cast("long").alias("size"),
            text(k % 21 == n, "abc", F.sha2(F.concat(k.cast("string"), F.lit(str(n))), 256)).alias("sha256"),
        )

    def model(n):
        target = F.when(
            (k % 9 == 2) & F.lit(n == 1), F.concat(F.lit("m/0/"), k.cast("string"))
        ).otherwise(F.lit(f"m/{n}"))
        source = F.struct(
            text(k % 14 == n, "no-slash", F.concat(F.lit("org/"), F.translate("p_name", " ", "-"))).alias("repo_id"),
            text(k % 16 == n, "main", F.repeat(F.lit("0A"), 20)).alias("revision"),
            F.array(file(0), file(1)).alias("files"),
        )
        return F.struct(
            F.when(k % 22 == 3, F.lit("same")).otherwise(F.lit(f"id{n}")).alias("id"),
            text(k % 18 == n, "  ", F.col("p_name")).alias("name"),
            F.col("p_brand").alias("provider"),
            F.lit("MIT").alias("license"),
            F.when(k % 25 == 4, F.lit("m/both")).otherwise(target).alias("target_directory"),
            F.when(k % 27 == n + 1, F.slice(F.array(source), 1, 0)).otherwise(F.array(source)).alias("sources"),
        )

    body = F.to_json(
        F.struct(
            F.when(k % 10 == 6, 2).otherwise(1).alias("schema_version"),
            F.array(model(0), model(1)).alias("models"),
        )
    )
    return parts.select("p_partkey", text(k % 30 == 8, "[1, 2", body).alias("json"))


def manifest_violations(spark, sf):
    parsed = M.parse_manifests(_manifests(spark, sf))
    return M.manifest_violations(parsed, "p_partkey").select("p_partkey", "field", "rule")


def _manifest_sql() -> str:
    sound = "k % 30 <> 8"
    rows = [
        ("k % 30 = 8", "'manifest'", "not_an_object"),
        ("k % 30 = 8 OR k % 10 = 6", "'schema_version'", "unsupported_version"),
        ("k % 30 = 8", "'models'", "empty_list"),
        (f"{sound} AND k % 22 = 3", "'same'", "duplicate_model_id"),
        (f"{sound} AND k % 25 = 4", "'m/both'", "duplicate_target"),
        (f"{sound} AND k % 25 <> 4 AND k % 9 = 2", "concat('m/0/', k)", "overlapping_target"),
    ]
    for n in (0, 1):
        full = f"{sound} AND k % 27 <> {n + 1}"
        rows += [
            (f"{sound} AND k % 18 = {n}", f"'models[{n}].name'", "blank"),
            (f"{sound} AND k % 27 = {n + 1}", f"'models[{n}].sources'", "empty_list"),
            (f"{full} AND k % 14 = {n}", f"'models[{n}].sources[0].repo_id'", "bad_repository"),
            (f"{full} AND k % 16 = {n}", f"'models[{n}].sources[0].revision'", "bad_revision"),
            (f"{full} AND k % 19 = 1 AND k % 12 NOT IN (0, 1)", "'f0.bin'", "duplicate_file"),
        ]
        for i in (0, 1):
            at = f"models[{n}].sources[0].files[{i}]"
            rows += [
                (f"{full} AND k % 12 = {i}", f"'{at}.path'", "unsafe_path"),
                (f"{full} AND k % 15 = 0", f"'{at}.size'", "bad_size"),
                (f"{full} AND k % 21 = {i}", f"'{at}.sha256'", "bad_digest"),
            ]
    return " UNION ALL ".join(
        f"SELECT k AS p_partkey, {field} AS field, '{rule}' AS rule FROM (SELECT p_partkey AS k FROM part) AS p WHERE {where}"
        for where, field, rule in rows
    )


def target_overlaps(spark, sf):
    """Directories named after customers' nations and segments, nested in places."""
    models = load_table(spark, sf, "customer").selectExpr(
        "c_custkey % 20 AS tree", "concat('m', cast(c_custkey AS string)) AS model_id",
        "CASE WHEN c_custkey % 7 = 0 THEN cast(c_nationkey AS string) WHEN c_custkey % 7 = 1 THEN"
        " concat(cast(c_nationkey AS string), '/', c_mktsegment) ELSE concat(cast(c_nationkey AS string), '/',"
        " c_mktsegment, '/', cast(c_custkey AS string)) END AS target_directory",
    )
    return M.overlapping_models(models, "tree").select("tree", "inner_model", "outer_model")


_TARGETS = """(SELECT c_custkey % 20 AS tree, concat('m', c_custkey) AS model_id, CASE WHEN c_custkey % 7 = 0
      THEN cast(c_nationkey AS varchar) WHEN c_custkey % 7 = 1 THEN concat(c_nationkey, '/', c_mktsegment)
      ELSE concat(c_nationkey, '/', c_mktsegment, '/', c_custkey) END AS target FROM customer)"""
OVERLAPS_SQL = f"""SELECT a.tree, a.model_id AS inner_model, b.model_id AS outer_model FROM {_TARGETS} AS a
    JOIN {_TARGETS} AS b ON a.tree = b.tree AND starts_with(a.target, concat(b.target, '/'))"""


def _inspected(spark, sf):
    parts = load_table(spark, sf, "part").selectExpr(
        "concat('m', cast(p_partkey % 50 AS string)) AS model_id", "concat('f', cast(p_partkey AS string)) AS path",
        "cast(p_size AS bigint) AS size", "sha2(p_name, 256) AS sha256", "p_partkey AS k",
    )
    present = parts.filter("k % 211 <> 5").selectExpr(
        "model_id", "path", "k % 199 <> 3 AS is_file", "size + CASE WHEN k % 151 = 2 THEN 1 ELSE 0 END AS size",
        "CASE WHEN k % 173 = 1 THEN 'x' ELSE upper(sha256) END AS sha256",
    )
    return M.inspect_files(parts.drop("k"), present)


def file_problems(spark, sf):
    return _inspected(spark, sf).filter(F.col("problem").isNotNull()).select("model_id", "path", "problem")


_PROBLEM = """CASE WHEN p_partkey % 211 = 5 THEN 'missing' WHEN p_partkey % 199 = 3 THEN 'not_a_file'
      WHEN p_partkey % 151 = 2 THEN 'size_mismatch' WHEN p_partkey % 173 = 1 THEN 'sha256_mismatch' END"""


def _states(spark, sf):
    directories = load_table(spark, sf, "part").selectExpr(
        "concat('m', cast(p_partkey % 50 AS string)) AS model_id", "p_partkey % 50 <> 7 AS is_directory"
    ).distinct().filter("model_id <> 'm9'")
    return M.model_states(_inspected(spark, sf), directories)


def model_states(spark, sf):
    return _states(spark, sf)


STATES = f"""(SELECT concat('m', p_partkey % 50) AS model_id, count(*) AS file_count,
      CASE WHEN p_partkey % 50 IN (7, 9) THEN 1 ELSE count({_PROBLEM}) END AS problem_count, sum(p_size)::bigint AS expected_bytes,
      CASE WHEN p_partkey % 50 = 9 THEN 'missing' WHEN p_partkey % 50 = 7 OR count({_PROBLEM}) > 0 THEN 'invalid' ELSE 'valid' END AS state
      FROM part GROUP BY p_partkey % 50) AS states"""


def required_bytes(spark, sf):
    return M.required_bytes(_states(spark, sf))


# --- published trees --------------------------------------------------------

TREE = Derived(
    "part",
    ((
        "p_partkey",
        "concat(CASE p_partkey % 10 WHEN 0 THEN 'src/' WHEN 1 THEN 'Private/x/' WHEN 2 THEN 'docs/evidence/Kanit/'"
        " WHEN 3 THEN 'build/private/' WHEN 4 THEN 'evidence/tmp/' WHEN 5 THEN '.venv-3/' WHEN 6 THEN 'models/' ELSE '' END,"
        " 'p', cast(p_partkey AS string), CASE p_partkey % 7 WHEN 0 THEN '.ONNX' WHEN 1 THEN '.pem' WHEN 2 THEN '.py' ELSE '.md' END) AS path",
    ),),
)


def tree_problems(spark, sf):
    return audit_tree(TREE.df(spark, sf))


TREE_ROWS = f"""(SELECT DISTINCT 'sensitive_directory' AS kind, ['Private', 'docs/evidence', 'evidence'][list_position([1, 2, 4], p_partkey % 10)] AS path
      FROM part WHERE p_partkey % 10 IN (1, 2, 4)
      UNION ALL SELECT 'forbidden_file', path FROM {TREE.sql()} WHERE p_partkey % 10 NOT IN (1, 2, 3, 4, 5) AND p_partkey % 7 IN (0, 1)) AS tree"""


def tree_summary(spark, sf):
    summary = audit_summary(audit_tree(TREE.df(spark, sf)))
    return summary.withColumn("exit_code", F.col("exit_code").cast("long"))


QUERIES = {
    "supported_files": (
        supported_files, f"SELECT path, length FROM {NAMED} WHERE ext NOT IN ('', '.csv')",
    ),
    "routed_files": (
        routed_files,
        f"SELECT p_partkey, {ROUTE} AS route, CASE WHEN ({ROUTE}) IS NULL THEN concat('unsupported file type: ', ext) END AS error FROM {NAMED}",
    ),
    "output_paths": (output_paths, OUTPUT_PATHS_SQL),
    "colliding_outputs": (colliding_outputs, COLLISIONS_SQL),
    "numbered_files": (numbered_files, NUMBERED_SQL),
    "path_checks": (path_checks, CHECKS_SQL),
    "fingerprints": (fingerprints, "SELECT doc_id, sha256(text) AS source_sha256 FROM documents"),
    "decoded_texts": (decoded_texts, DECODED_SQL),
    "checked_uploads": (checked_uploads, UPLOADS_SQL),
    "checked_pdfs": (checked_pdfs, PDFS_SQL),
    "manifest_violations": (manifest_violations, _manifest_sql()),
    "target_overlaps": (target_overlaps, OVERLAPS_SQL),
    "file_problems": (
        file_problems,
        f"SELECT concat('m', p_partkey % 50) AS model_id, concat('f', p_partkey) AS path, {_PROBLEM} AS problem"
        f" FROM part WHERE ({_PROBLEM}) IS NOT NULL",
    ),
    "model_states": (model_states, f"SELECT * FROM {STATES}"),
    "required_bytes": (
        required_bytes,
        "SELECT sum(expected_bytes)::bigint AS total_bytes, coalesce(sum(expected_bytes) FILTER (state <> 'valid'), 0)::bigint"
        f" AS required_bytes FROM {STATES}",
    ),
    "tree_problems": (tree_problems, f"SELECT * FROM {TREE_ROWS}"),
    "tree_summary": (
        tree_summary,
        "SELECT count_if(kind = 'sensitive_directory')::bigint AS sensitive_directories, count_if(kind = 'forbidden_file')::bigint"
        f" AS forbidden_files, 1::bigint AS exit_code FROM {TREE_ROWS}",
    ),
}
