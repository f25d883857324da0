"""Real files: listing, reading, images, uploads, manifests, trees, batches."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from veilspan.functions import paths as P
from veilspan.operators import batch, manifest as M
from veilspan.operators.tree import audit_summary, audit_tree
from veilspan.plans.batch import sanitize_directory, supported_files
from veilspan.plans.text import sanitize_texts
from veilspan.sources import files as S
from workload.files import _manifests


def png(width, height, pixel=b"\xff\xff\xff"):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + pixel * width for _ in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    root = tmp_path / "in"
    (root / "b.TXT").write_bytes("mail a@b.de\r\nTel 0532 123 45 67\rend".encode())
    (root / "a.txt").write_bytes(b"\xef\xbb\xbfclean")
    (root / "sub" / "a.txt").write_bytes(b"bad \xff byte")
    (root / "pic.png").write_bytes(png(3, 2))
    (root / "broken.png").write_bytes(b"no picture")
    (root / "skip.csv").write_bytes(b"1,2")
    return root


def names(df):
    return [r.path.rsplit("/in/", 1)[1] for r in df.collect()]


def test_listing(spark, tree):
    flat = S.list_supported(S.read_files(spark, str(tree)))
    assert names(flat) == ["a.txt", "b.TXT", "broken.png", "pic.png"]
    deep = S.list_supported(S.read_files(spark, str(tree), recursive=True))
    assert names(deep) == ["a.txt", "b.TXT", "broken.png", "pic.png", "sub/a.txt"]
    assert names(S.list_supported(S.read_files(spark, str(tree / "a.txt")))) == ["a.txt"]
    # listing reads no bytes
    assert "content" not in flat._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    with pytest.raises(Exception):
        S.read_files(spark, str(tree / "missing")).collect()


def test_text_batch(spark, tree, tmp_path):
    files = S.route_files(S.read_files(spark, str(tree), recursive=True))
    texts = S.read_texts(files.filter("route = 'text'").drop("error"))
    usable = texts.filter(F.col("error").isNull())
    done = sanitize_texts(usable.select("path", "output_path", "text"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert rows["a.txt"].sanitized_text == "clean" and rows["a.txt"].redaction_passes == 0
    assert rows["b.TXT"].sanitized_text == "mail [REDACTED]\nTel [REDACTED]\nend"
    assert rows["b.TXT"].output_path.endswith("/in/b_REDACTED.txt")
    failed = texts.filter(F.col("error").isNotNull()).select("path", "error")
    assert [r.error for r in failed.collect()] == ["not valid UTF-8"]
    results = done.select("path", "status", F.lit(None).cast("string").alias("error")).unionByName(
        failed.withColumn("status", F.lit(None).cast("string"))
    )
    summary = batch.batch_summary(results).first()
    assert (summary.processed, summary.passed, summary.failed, summary.exit_code) == (3, 2, 1, 1)
    S.write_sanitized(done, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("status = 'passed'").count() == 2
    with pytest.raises(Exception):
        S.write_sanitized(done, str(tmp_path / "out"))


def test_directory(spark, tree, tmp_path):
    (tree / "sub" / "b.txt").write_text("same name, other folder")
    out = str(tmp_path / "done")
    summary = sanitize_directory(spark, str(tree), out, recursive=True).first()
    # a.txt twice and b.txt twice: no output may overwrite another; pictures need recognised pages
    pictures = len(list(tree.rglob("*.png")))
    assert pictures and tuple(summary) == (4 + pictures, 0, 0, 4 + pictures, 1)
    flat = str(tmp_path / "flat")
    pictures = len(list(tree.glob("*.png")))
    assert tuple(sanitize_directory(spark, str(tree), flat).first()) == (2 + pictures, 2, 0, pictures, 1)
    rows = spark.read.parquet(flat).filter("status != 'failed'").collect()
    assert {r.sanitized_text for r in rows} == {"clean", "mail [REDACTED]\nTel [REDACTED]\nend"}
    routes = supported_files(spark, str(tree)).select("route").distinct().collect()
    assert sorted(r.route for r in routes) == ["image", "text"]


def test_same_input_and_output(spark):
    df = spark.createDataFrame([("/d/a_REDACTED.txt", bytearray(b"x"))], "path string, content binary")
    row = S.read_texts(df.withColumn("path", F.lit("/d/a.txt")), "/d").first()
    assert row.error is None
    clash = df.withColumn("path", F.lit("/d/x_REDACTED.txt"))
    assert S.read_texts(clash, "/d").first().output_path == "/d/x_REDACTED_REDACTED.txt"


def test_images(spark, tree):
    images = S.read_images(spark, str(tree / "*.png"))
    got = {r.image.origin.rsplit("/", 1)[1]: (r.valid, r.image.width, r.image.height) for r in images.collect()}
    assert got["pic.png"] == (True, 3, 2)
    assert not got["broken.png"][0]


def test_uploads(spark):
    ok = png(3, 2)
    rows = [
        ("ok", "image/png", ok, None, None), ("type", "image/gif", ok, None, None), ("empty", "image/png", b"", None, None),
        ("mismatch", "image/jpeg", ok, None, None), ("text", "image/png", b"hello", None, None),
        ("big", "image/png", png(4, 4), None, None), ("long", "image/png", ok + b"\0" * 200, None, None),
        ("pdf", "application/pdf", b"%PDF-1.7", None, None), ("jpeg", "image/jpeg", b"\xff\xd8\xff\xe0", 3, 2),
        ("notpdf", "application/pdf", b"PDF", None, None),
    ]
    df = spark.createDataFrame([(a, b, bytearray(c), d, e) for a, b, c, d, e in rows], "k string, media_type string, content binary, image_width int, image_height int")
    got = {r.k: r.reject_reason for r in S.validate_uploads(df, max_bytes=150, max_pixels=12).collect()}
    assert got == {
        "ok": None, "type": "unsupported_media_type", "empty": "empty", "mismatch": "format_mismatch", "text": "not_an_image",
        "big": "too_many_pixels", "long": "too_large", "pdf": None, "jpeg": None, "notpdf": "format_mismatch",
    }


def test_page_geometry(spark):
    df = spark.createDataFrame([(792.0,)], "pt double")
    # the order of multiplication matters at exact borders
    assert df.select(P.rendered_pixels("pt")).first()[0] == 3301


def test_names(spark):
    cases = ["/x/a.tar.GZ", "/x/.hidden", "/x/none", "/x/a.docx", "/x/a.", "/x/B.Doc"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    rows = df.select(P.suffix("p").alias("s"), P.stem("p").alias("m"), P.output_path("p", F.lit("/o")).alias("o")).collect()
    assert [r.s for r in rows] == [".gz", "", "", ".docx", "", ".doc"]
    assert [r.o for r in rows] == ["/o/a.tar_REDACTED.gz", "/o/.hidden_REDACTED", "/o/none_REDACTED", "/o/a_REDACTED.pdf", "/o/a._REDACTED", "/o/B_REDACTED.pdf"]
    clash = spark.createDataFrame([("/x/a.doc",), ("/y/a.docx",), ("/y/a.pdf",), ("/y/b.pdf",)], "path string")
    out = batch.output_collisions(clash.withColumn("output_path", P.output_path("path", F.lit("/o"))))
    assert [tuple(r) for r in out.collect()] == [("/o/a_REDACTED.pdf", 3)]


def test_numbering(spark):
    df = spark.range(500).select(F.format_string("/f/%05d", (F.col("id") * 7919) % 500).alias("path")).repartition(7)
    rows = batch.number_files(df).orderBy("position").collect()
    assert [r.path for r in rows] == [f"/f/{i:05d}" for i in range(500)]
    assert [r.position for r in rows] == list(range(1, 501)) and {r.total for r in rows} == {500}


def payload(**changes):
    file = {"path": "a/b.bin", "size": 5, "sha256": "ab" * 32, **changes.get("file", {})}
    source = {"repo_id": "org/name", "revision": "0a" * 20, "files": [file], **changes.get("source", {})}
    model = {"id": "m", "name": "n", "provider": "p", "license": "l", "target_directory": "t", "sources": [source], **changes.get("model", {})}
    return {"schema_version": 1, "models": [model], **changes.get("root", {})}


MANIFESTS = {
    "ok": (payload(), set()),
    "upper": (payload(file={"sha256": "AB" * 32}, source={"revision": "0A" * 20}), set()),
    "dots": (payload(file={"path": "./a//b.bin"}), set()),
    "version": (payload(root={"schema_version": 2}), {"unsupported_version"}),
    "none": (payload(root={"models": []}), {"empty_list"}),
    "up": (payload(file={"path": "../b"}), {"unsafe_path"}),
    "root": (payload(file={"path": "/b"}), {"unsafe_path"}),
    "windows": (payload(file={"path": "a\\b"}), {"unsafe_path"}),
    "size": (payload(file={"size": 0}), {"bad_size"}),
    "digest": (payload(file={"sha256": "xy"}), {"bad_digest"}),
    "revision": (payload(source={"revision": "main"}), {"bad_revision"}),
    "repo": (payload(source={"repo_id": "one"}), {"bad_repository"}),
    "blank": (payload(model={"license": " "}), {"blank"}),
    "twice": (payload(source={"files": [{"path": "a", "size": 1, "sha256": "ab" * 32}] * 2}), {"duplicate_file"}),
    "overlap": (payload(root={"models": [payload()["models"][0], {**payload()["models"][0], "id": "k", "target_directory": "t/u"}]}), {"overlapping_target"}),
    "beside": (payload(root={"models": [payload()["models"][0], {**payload()["models"][0], "id": "k", "target_directory": "tu"}]}), set()),
    "same": (payload(root={"models": [payload()["models"][0]] * 2}), {"duplicate_model_id", "duplicate_target"}),
}


def test_manifest_rules(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in MANIFESTS.items()] + [("text", "nonsense")]
    parsed = M.parse_manifests(spark.createDataFrame(rows, "k string, json string"))
    got = {}
    for r in M.manifest_violations(parsed, "k").collect():
        got.setdefault(r.k, set()).add(r.rule)
    assert got.pop("text") == {"not_an_object", "unsupported_version", "empty_list"}
    assert got == {k: rules for k, (_, rules) in MANIFESTS.items() if rules}
    files = M.manifest_files(parsed.filter("k = 'dots'"), "k").first()
    assert (files.path, files.size, files.model_id) == ("a/b.bin", 5, "m")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_manifests_are_read_and_parsed_once(spark, tmp_path):
    rows = [(k, json.dumps(v)) for k, (v, _) in MANIFESTS.items()]
    spark.createDataFrame(rows, "k string, json string").write.parquet(str(tmp_path / "m"))
    found = M.manifest_violations(M.parse_manifests(spark.read.parquet(str(tmp_path / "m"))), "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert scans(found) == 1 and plan.count("from_json") == 1 and "Exchange" not in plan


def test_many_models_in_one_folder(spark):
    """As many rows as inner directories, however many models share them."""
    rows = [("k", f"a{i}", "m") for i in range(1000)] + [("k", f"b{i}", f"m/x{i % 10}") for i in range(1000)]
    rows += [("k", "c", "m/x1/y"), ("k", "d", "mx"), ("other", "e", "m/x2"), ("k", "f", "m/x1")]
    got = M.target_overlaps(spark.createDataFrame(rows, "k string, model_id string, target_directory string"), "k").collect()
    want = {("k", f"m/x{i}", 101 if i == 1 else 100, "m", 1000) for i in range(10)} | {("k", "m/x1/y", 1, "m/x1", 101)}
    assert {(r.k, r.inner_target, r.inner_models, r.outer_target, r.outer_models) for r in got} == want and len(got) == 11
    models = [{**payload()["models"][0], "id": f"m{i}", "target_directory": f"t/{i}" if i else "./t/"} for i in range(300)]
    parsed = M.parse_manifests(spark.createDataFrame([("k", json.dumps(payload(root={"models": models})))], "k string, json string"))
    fields = [r.field for r in M.manifest_violations(parsed, "k").collect() if r.rule == "overlapping_target"]
    assert sorted(fields) == sorted(f"t/{i}" for i in range(1, 300))


def test_inventory(spark):
    files = spark.createDataFrame(
        [("a", "1", 5, "aa"), ("a", "2", 5, "bb"), ("b", "1", 7, "cc"), ("c", "1", 9, "dd"), ("d", "1", 1, "ee")],
        "model_id string, path string, size long, sha256 string",
    )
    inventory = spark.createDataFrame(
        [("a", "1", True, 5, "aa"), ("a", "2", True, 6, "zz"), ("b", "1", True, 7, "zz"), ("c", "1", True, 9, "DD")],
        "model_id string, path string, is_file boolean, size long, sha256 string",
    )
    there = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "model_id string, is_directory boolean")
    inspected = M.inspect_files(files, inventory)
    problems = {(r.model_id, r.path): r.problem for r in inspected.collect()}
    assert problems[("a", "2")] == "size_mismatch" and problems[("b", "1")] == "sha256_mismatch" and problems[("d", "1")] == "missing"
    states = M.model_states(inspected, there)
    assert {r.model_id: r.state for r in states.collect()} == {"a": "invalid", "b": "invalid", "c": "valid", "d": "missing"}
    assert tuple(M.required_bytes(states).first()) == (27, 18)
    relaxed = M.model_states(M.inspect_files(files, inventory, verify_hashes=False), there)
    assert {r.model_id for r in relaxed.filter("state = 'valid'").collect()} == {"b", "c"}
    with pytest.raises(Exception, match="model not usable"):
        M.require_valid(states).collect()


def test_tree_audit(spark):
    paths = [
        "README.md", "models/README.md", "models/x.ONNX", "src/private/deep/k.pem", "src/Private/other.md", "build/private/k.pem",
        "private/build/k.pem", ".venv-3/a.key", "certs/a.key", "docs/kanit/x.md",
    ]
    problems = audit_tree(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {tuple(r) for r in problems.collect()} == {
        ("forbidden_file", "models/x.ONNX"), ("forbidden_file", "certs/a.key"), ("sensitive_directory", "src/private"),
        ("sensitive_directory", "src/Private"), ("sensitive_directory", "private"), ("sensitive_directory", "docs/kanit"),
    }
    assert tuple(audit_summary(problems).first()) == (4, 2, 1)


def test_manifests_of_a_small_file_use_all_cores(spark, tmp_path):
    rows = [(k, f"a {k}", "Brand#1", 1) for k in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    used = _manifests(spark, str(tmp_path)).rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(used) == 200 and sum(n > 0 for n in used) > 1


def test_every_pair_of_models_that_overlap(spark):
    rows = [("k", "a", "m"), ("k", "a2", "m"), ("k", "b", "m/x"), ("k", "c", "m/x/y"), ("k", "d", "mx"), ("j", "e", "m/x"), ("k", "f", "m/x"), ("k", "b", "m/x")]
    got = M.overlapping_models(spark.createDataFrame(rows, "k string, model_id string, target_directory string"), "k").collect()
    want = [("k", i, o) for i in ("b", "c", "f") for o in ("a", "a2")] + [("k", "c", "b"), ("k", "c", "f")]
    assert sorted(map(tuple, got)) == sorted(want)
