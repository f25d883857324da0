"""The pipeline's stages against plain versions, and as a whole."""

import brute
import pytest
from pyspark.sql import functions as F
from test_operators import toxic_table

import __spark_entry__
import corpus_pipeline as pipeline
from veilspan.llm.toxicity import toxicity

ITEM = " ".join(f"leak{i}" for i in range(14))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = toxic_table()
    docs = [(i, t + "\nshared by many" * (i % 20 == 1)) for i, t in docs]
    long = next(t for i, t in docs if i % 6 and len(t.split()) > 150)
    docs += [(2000, long), (2001, long + " more"), (2002, None), (2003, ""), (2004, f"word1 word2 {ITEM} word3"), (2005, " ".join(ITEM.split()[:9]))]
    rows = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.select("doc_id", "text").collect()
        before = [tuple(r) for r in before]
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "mixing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "toxicity":
            judged = toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            assert set(after) == {r.doc_id for r in judged.filter("predicted = 0").collect()}
            assert len(after) < len(before) - 100 and {2002, 2003} < set(after)
        elif name == "line_dedup":
            want = {i: digest for i, _, _, digest in brute.line_dedup(before, pipeline.LINE_DOCUMENTS)}
            assert {i: brute.sha(t or "") for i, t in after.items()} == want
            assert any(t != after[i] for i, t in before)
        elif name == "near_dedup":
            want = {i for i, _, _, kept in brute.near_duplicates(before, pipeline.NEAR_PERCENT) if kept}
            assert set(after) == want and len(want) < len(before)
        elif name == "decontamination":
            rows = brute.contamination(before, [(1, ITEM), (2, None)], pipeline.WINDOW_WORDS)
            assert set(after) == {r[0] for r in rows if not r[5]} and 2004 not in after and 2005 in after
        else:
            got = {r.doc_id: (r.size, r.taken) for r in docs.collect()}
            assert {i: n for i, (n, _) in got.items()} == {i: len((t or "").split()) for i, t in before}
            assert all(taken <= 3 * n for n, taken in got.values()) and sum(t for _, t in got.values()) > 0


def test_run(spark, folder):
    rows = pipeline.run(spark, folder)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(rows.columns)
    assert 500 < rows.count() < 800
    assert rows.agg(F.max(F.col("taken") - 3 * F.col("size"))).first()[0] <= 0


#: Names that the operators use inside, or return.
CLASHING = ("_copy", "_id", "_row", "_n_lines", "_n_dropped", "id", "row", "component", "score", "votes", "entries", "looked", "keep", "n_words", "n_hit", "hit_id", "size", "key")


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_clashing_names(spark, folder, name, stage):
    """Columns of any names are carried along, and the rows are those without them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHING})
    key = lambda r: (r.doc_id, r.taken if name == "mixing" else r.text)
    got = stage(spark, wide, folder)
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, stage(spark, docs, folder).collect()), key=repr)
    if name != "mixing":
        assert got.columns == wide.columns
        assert got.filter(" OR ".join(f"`{c}` <> concat('{c} ', doc_id)" for c in CLASHING)).count() == 0


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_an_empty_table(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    got = stage(spark, docs, folder)
    assert got.count() == 0 and (name == "mixing" or got.schema == docs.schema)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_odd_rows(spark, folder, name, stage):
    """Repeated rows, rows without an id, null, empty and long texts, null sources."""
    toxic = next(t for i, t in toxic_table()[0] if i % 6 == 0)
    rows = [(1, None), (1, None), (2, ""), (None, None), (None, "plain words here"), (3, "three of a kind"), (3, "three of a kind"), (4, "word " * 200_000)]
    rows += [(5, f"start {ITEM} end"), (5, f"start {ITEM} end"), (None, ITEM), (6, toxic), (6, toxic), (7, " \n\t\n"), (8, "three of a kind")]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, docs, folder)
    ids = sorted(((r.doc_id,) for r in got.collect()), key=repr)
    gone = {"near_dedup": [8], "decontamination": [5, 5, None]}.get(name, [])
    left = sorted(((i,) for i, _ in rows), key=repr)
    for i in gone:
        left.remove((i,))
    assert ids == left


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
