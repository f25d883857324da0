"""The text plan on a stream of files."""

from pyspark.sql import functions as F

from veilspan.plans.text import sanitize_texts
from veilspan.streaming.text import sanitize_stream, windowed_counts, write_stream
from workload.text import streamed_texts

SCHEMA = "id int, ts timestamp, text string"


def batches(spark, path):
    rows = [(1, "2024-01-01 00:10:00", "a@b.de"), (2, "2024-01-01 00:20:00", "0532 123 45 67 c@d.de"), (3, "2024-01-01 02:00:00", "clean")]
    first = spark.createDataFrame([(i, t, x) for i, t, x in rows], "id int, ts string, text string")
    typed = first.withColumn("ts", F.to_timestamp("ts"))
    typed.write.mode("append").parquet(path)
    return typed


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    table = batches(spark, source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    out = str(tmp_path / "out")
    query = write_stream(sanitize_stream(stream), out, str(tmp_path / "state"))
    query.awaitTermination()
    columns = ["id", "sanitized_text", "redaction_passes", "status"]
    want = sorted(sanitize_texts(table).select(*columns).collect())
    assert sorted(spark.read.parquet(out).select(*columns).collect()) == want
    # a restart takes only what is new
    spark.createDataFrame([(9, "e@f.de")], "id int, text string").withColumn("ts", F.current_timestamp()).select(
        "id", "ts", "text"
    ).write.mode("append").parquet(source)
    write_stream(sanitize_stream(stream), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_window_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    batches(spark, source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    found = sanitize_stream(stream).withColumn("hits", F.flatten("detections"))
    counts = windowed_counts(found, detections="hits")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.detection_type, r.n) for r in spark.table("counts").collect()}
    assert got == {("email", 2), ("phone", 1)}


def test_streamed_tables_of_one_file_of_many_and_of_none(spark, tmp_path):
    rows = [(1, "a@b.de"), (2, "clean"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    table.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    columns = ["doc_id", "sanitized_text", "redaction_passes", "status"]
    want = sorted(map(tuple, sanitize_texts(table).select(*columns).collect()))
    assert sorted(map(tuple, streamed_texts(spark, str(tmp_path / "many")).select(*columns).collect())) == want
    assert sorted(map(tuple, streamed_texts(spark, str(tmp_path / "one")).select(*columns).collect())) == want
    assert streamed_texts(spark, str(tmp_path / "none")).count() == 0
