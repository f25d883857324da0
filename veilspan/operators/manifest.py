"""Model manifest: flattening, rule checks, and comparison with an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import paths as P
from veilspan.functions.arrays import let
from veilspan.functions.text import strip
from veilspan.operators.detections import add_once, explode_rows
from veilspan.schemas import MANIFEST_JSON

# --- fixed values -----------------------------------------------------------
MANIFEST_VERSION = 1
# ----------------------------------------------------------------------------


def parse_manifests(df: DataFrame, json: str = "json") -> DataFrame:
    """Add ``manifest``; null where the text is not a JSON object of its shape."""
    schema = T.StructType([*MANIFEST_JSON.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(json, schema, {"columnNameOfCorruptRecord": "_bad"})
    whole = add_once(df, _parsed=parsed)
    usable = F.when(F.col("_parsed._bad").isNull(), F.col("_parsed"))
    return add_once(whole, manifest=usable).drop("_parsed")


def normalized_path(path: Column | str) -> Column:
    """Path without empty and ``.`` parts."""
    value = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(strip(value), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")


def manifest_models(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.posexplode("manifest.models").alias("model_no", "m")).select(
        key,
        "model_no",
        strip("m.id").alias("model_id"),
        strip("m.name").alias("name"),
        strip("m.provider").alias("provider"),
        strip("m.license").alias("license"),
        normalized_path("m.target_directory").alias("target_directory"),
    )


def manifest_files(parsed: DataFrame, key: str) -> DataFrame:
    """One row per expected file."""
    models = parsed.select(key, F.posexplode("manifest.models").alias("model_no", "m"))
    sources = models.select(
        key,
        "model_no",
        strip("m.id").alias("model_id"),
        normalized_path("m.target_directory").alias("target_directory"),
        F.posexplode("m.sources").alias("source_no", "s"),
    )
    return sources.select(
        key,
        "model_no",
        "model_id",
        "target_directory",
        "source_no",
        strip("s.repo_id").alias("repo_id"),
        F.lower(strip("s.revision")).alias("revision"),
        F.posexplode("s.files").alias("file_no", "f"),
    ).select(
        key,
        "model_no",
        "model_id",
        "target_directory",
        "source_no",
        "repo_id",
        "revision",
        "file_no",
        normalized_path("f.path").alias("path"),
        F.col("f.path").alias("raw_path"),
        F.col("f.size").alias("size"),
        F.lower(strip("f.sha256")).alias("sha256"),
    )


def _blank(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def _fails(value: Column, pattern: str) -> Column:
    return ~F.coalesce(F.lower(strip(value)).rlike(pattern), F.lit(False))


def _empty(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0)) <= 0


_RULES = "array<struct<field:string,rule:string>>"


def _repeated(values: Column) -> Column:
    """Each value that an array holds more than once; nulls are not compared."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.array_distinct(let(known, lambda row: F.filter(row, lambda v, i: (i > 0) & (F.get(row, i - 1) == v))))


def _inner(targets: Column) -> Column:
    """The directories of an array that lie inside another one of it.

    In the order of their names, a directory is followed by all that lie in it; the
    mark after each name stands before every letter, so none comes in between.
    """
    ended = F.array_sort(F.array_distinct(F.transform(F.filter(targets, lambda t: t.isNotNull()), lambda t: F.replace(F.concat(t, F.lit("/")), F.lit("/"), F.lit("\x01")))))
    # the outermost directory that is open: it changes when a name no longer begins with it
    first = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("inside"))
    walked = F.aggregate(
        ended,
        first,
        lambda s, t: F.when(F.coalesce(t.startswith(s["open"]), F.lit(False)), F.struct(s["open"].alias("open"), F.concat(s["inside"], F.array(t)).alias("inside"))).otherwise(
            F.struct(t.alias("open"), s["inside"].alias("inside"))
        ),
    )["inside"]
    return F.transform(walked, lambda t: F.replace(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("\x01"), F.lit("/")))


def manifest_violations(parsed: DataFrame, key: str) -> DataFrame:
    """All broken rules as ``(key, field, rule)``, one row each.

    Every rule is an array in the manifest's row, so a manifest is read and parsed once.
    """

    def rule(condition: Column, field: Column, name: str) -> Column:
        return F.when(condition, F.struct(field.alias("field"), F.lit(name).alias("rule")))

    def found(*rules: Column) -> Column:
        return F.array_compact(F.array(*rules))

    def each(items: Column, rules) -> Column:
        """The rules of every item of an array that may be null."""
        return F.coalesce(F.flatten(F.transform(items, rules)), F.array().cast(_RULES))

    def named(values: Column, name: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("field"), F.lit(name).alias("rule")))

    def within(at: Column, name: str) -> Column:
        return F.concat(at, F.lit(name))

    def numbered(at: Column, name: str, i: Column) -> Column:
        return F.concat(at, F.lit(f"{name}["), i.cast("string"), F.lit("]"))

    def file_rules(at: Column):
        return lambda f, k: let(
            numbered(at, ".files", k),
            lambda here: found(
                rule(~P.is_safe_relative_path(f["path"]), within(here, ".path"), "unsafe_path"),
                rule(~F.coalesce(f["size"] > 0, F.lit(False)), within(here, ".size"), "bad_size"),
                rule(_fails(f["sha256"], P.SHA256), within(here, ".sha256"), "bad_digest"),
            ),
        )

    def source_rules(at: Column):
        return lambda s, j: let(
            numbered(at, ".sources", j),
            lambda here: F.concat(
                found(
                    rule(~F.coalesce(strip(s["repo_id"]).rlike(P.REPOSITORY), F.lit(False)), within(here, ".repo_id"), "bad_repository"),
                    rule(_fails(s["revision"], P.REVISION), within(here, ".revision"), "bad_revision"),
                    rule(_empty(s["files"]), within(here, ".files"), "empty_list"),
                ),
                each(s["files"], file_rules(here)),
            ),
        )

    def model_rules(m: Column, i: Column) -> Column:
        paths = F.flatten(F.transform(F.filter(m["sources"], lambda s: s["files"].isNotNull()), lambda s: F.transform(s["files"], lambda f: normalized_path(f["path"]))))
        return let(
            numbered(F.lit(""), "models", i),
            lambda here: F.concat(
                found(
                    *(rule(_blank(m[name]), within(here, f".{name}"), "blank") for name in ("id", "name", "provider", "license")),
                    rule(~P.is_safe_relative_path(m["target_directory"]), within(here, ".target_directory"), "unsafe_path"),
                    rule(_empty(m["sources"]), within(here, ".sources"), "empty_list"),
                ),
                each(m["sources"], source_rules(here)),
                F.coalesce(named(_repeated(paths), "duplicate_file"), F.array().cast(_RULES)),
            ),
        )

    models = F.col("manifest.models")
    root = found(
        rule(F.col("manifest").isNull(), F.lit("manifest"), "not_an_object"),
        rule(~F.col("manifest.schema_version").eqNullSafe(F.lit(MANIFEST_VERSION)), F.lit("schema_version"), "unsupported_version"),
        rule(_empty(models), F.lit("models"), "empty_list"),
    )
    targets = F.transform(models, lambda m: normalized_path(m["target_directory"]))
    rules = F.concat(
        root,
        F.when(
            models.isNotNull(),
            F.concat(
                each(models, model_rules),
                named(_repeated(F.transform(models, lambda m: strip(m["id"]))), "duplicate_model_id"),
                named(_repeated(targets), "duplicate_target"),
                named(_inner(targets), "overlapping_target"),
            ),
        ).otherwise(F.array().cast(_RULES)),
    )
    return explode_rows(parsed, [key], rules).select(key, "d.field", "d.rule")


def target_overlaps(models: DataFrame, key: str) -> DataFrame:
    """Target directories that lie inside another one, a row each.

    ``outer_target`` is the nearest one around; ``inner_models`` and ``outer_models`` say
    how many models have either directory.  Each directory lists its ancestors and meets
    them by equality, so no pair of models is ever formed.
    """
    targets = models.groupBy(key, "target_directory").agg(F.count_distinct("model_id").alias("models"))
    parts = F.split("target_directory", "/")
    ancestors = targets.filter(F.size(parts) > 1).select(
        key,
        F.col("target_directory").alias("inner_target"),
        F.col("models").alias("inner_models"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path")),
            )
        ).alias("a"),
    ).select(key, "inner_target", "inner_models", "a.depth", F.col("a.path").alias("outer_target"))
    outer = targets.select(key, F.col("target_directory").alias("outer_target"), F.col("models").alias("outer_models"))
    nearest = F.max(F.struct("depth", "outer_target", "outer_models")).alias("o")
    return ancestors.join(outer, [key, "outer_target"]).groupBy(key, "inner_target").agg(
        F.first("inner_models").alias("inner_models"), nearest
    ).select(key, "inner_target", "o.outer_target", "inner_models", "o.outer_models")


def overlapping_models(models: DataFrame, key: str) -> DataFrame:
    """All pairs of models whose directories lie one inside the other.

    Each directory lists its ancestors, however far around, and meets them by equality,
    so only pairs that are in the result are formed.  They are as many as the models
    inside a directory times those that have it.
    """
    targets = models.select(key, "model_id", "target_directory").distinct()
    parts = F.split("target_directory", "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    inner = targets.filter(F.size(parts) > 1).select(
        key,
        F.col("model_id").alias("inner_model"),
        F.explode(F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("outer_target"),
    )
    outer = targets.select(key, F.col("model_id").alias("outer_model"), F.col("target_directory").alias("outer_target"))
    return inner.join(outer, [key, "outer_target"]).select(key, "inner_model", "outer_model")


def inspect_files(
    files: DataFrame, inventory: DataFrame, verify_hashes: bool = True
) -> DataFrame:
    """First problem of every expected file, null where it is in order.

    ``inventory``: ``model_id, path, is_file, size, sha256`` of what exists.
    """
    found = inventory.select(
        "model_id",
        "path",
        "is_file",
        F.col("size").alias("_size"),
        F.lower("sha256").alias("_sha256"),
    )
    problem = (
        F.when(F.col("is_file").isNull(), "missing")
        .when(~F.col("is_file"), "not_a_file")
        .when(F.col("_size") != F.col("size"), "size_mismatch")
    )
    if verify_hashes:
        problem = problem.when(
            ~F.col("_sha256").eqNullSafe(F.col("sha256")), "sha256_mismatch"
        )
    return files.join(found, ["model_id", "path"], "left").select(
        "model_id", "path", "size", problem.alias("problem")
    )


def model_states(inspected: DataFrame, directories: DataFrame) -> DataFrame:
    """valid, missing or invalid per model, with problem and byte counts.

    ``directories``: ``model_id, is_directory`` of the targets that exist.
    """
    rolled = inspected.groupBy("model_id").agg(
        F.count("*").alias("file_count"),
        F.count("problem").alias("_file_problems"),
        F.sum("size").alias("expected_bytes"),
    )
    state = (
        F.when(F.col("is_directory").isNull(), "missing")
        .when(~F.col("is_directory") | (F.col("_file_problems") > 0), "invalid")
        .otherwise("valid")
    )
    # without a usable directory there is one problem, the directory itself
    problems = F.when(
        F.coalesce("is_directory", F.lit(False)), F.col("_file_problems")
    ).otherwise(F.lit(1))
    return rolled.join(
        directories.select("model_id", "is_directory"), "model_id", "left"
    ).select(
        "model_id",
        "file_count",
        problems.cast("long").alias("problem_count"),
        "expected_bytes",
        state.alias("state"),
    )


def required_bytes(states: DataFrame) -> DataFrame:
    """Total size, and the size of the models that must be fetched again."""
    return states.agg(
        F.sum("expected_bytes").alias("total_bytes"),
        F.coalesce(
            F.sum(F.when(F.col("state") != "valid", F.col("expected_bytes"))), F.lit(0)
        ).alias("required_bytes"),
    )


def require_valid(states: DataFrame) -> DataFrame:
    """Fail the job when any model is not valid; otherwise pass rows through."""
    return states.withColumn(
        "state",
        F.when(F.col("state") == "valid", F.col("state")).otherwise(
            F.raise_error(F.concat(F.lit("model not usable: "), F.col("model_id")))
        ),
    )
