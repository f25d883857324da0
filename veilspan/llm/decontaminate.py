"""Passages of benchmark items in training documents, found by winnowing.

Method: of every ``window - gram + 1`` consecutive word grams of a text the one
with the least hash is a fingerprint, so two texts that share ``window`` words in a
row share a fingerprint.  Fingerprints of documents and items are joined; around
each joint fingerprint the windows that hold it are compared by a 128-bit hash of
all their words, which extends the hit to exactly the shared words.  An item of
fewer words than a window is one window of its own; its fingerprint is its only
gram, looked for at every word.

A bit filter of the items' fingerprints, of bounded size, lets a document's scan
drop most fingerprints at once.  It only spares work: what passes is joined, and a
filter too full to help changes no result.

Rows: rows of equal id and text get equal results.  Null texts, documents or items,
have no words.  Items without an id mark words but are not listed.  An empty
benchmark marks nothing.  Other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .frames import filter_bits, may_hold, row_key, small_batches, stored

WINDOW, GRAM = 10, 5
_HASHES = "fp long, size int, start int, one array<long>, two array<long>"
_FIRST, _SECOND, _SHORT = 11, 12, 13


def _fingerprints(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    grams = hashing.window_hashes(words, gram, _SHORT)
    at = hashing.winnowed(grams, window - gram + 1)
    return at, grams[at]


def _item_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint (``fp``) and for each window (``one``, ``two``)."""
    names = ["item", "fp", "one", "two", "size"]
    for batch in batches:
        data, starts = hashing.buffers(batch.column(1))
        for a, b in hashing.groups(starts):
            words, at = hashing.document_words(data, starts[a : b + 1], hashing.alphanumeric)
            for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                n = int(y - x)
                if not n:
                    continue
                size = min(n, window)
                fp = np.unique(_fingerprints(words[x:y], window, gram)[1] if n >= window else hashing.window_hashes(words[x:y], n, _SHORT))
                one, two = (hashing.window_hashes(words[x:y], size, s) for s in (_FIRST, _SECOND))
                total = len(fp) + len(one)
                item = batch.column(0).slice(a + i, 1).take(pa.array(np.zeros(total, np.int64)))
                blank, other = pa.nulls(len(one), pa.int64()), pa.nulls(len(fp), pa.int64())
                columns = [item, pa.concat_arrays([pa.array(fp.view(np.int64)), blank])]
                columns += [pa.concat_arrays([other, pa.array(v.view(np.int64))]) for v in (one, two)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(total, size, np.int32))], names)


def _document_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int, short: list[int], bits) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each fingerprint that an item may have, with the
    hashes of the windows around it."""
    table = bits.value
    def around(own: np.ndarray, size: int, first: np.ndarray, last: np.ndarray) -> list[list[np.ndarray]]:
        """Both hashes of the windows from ``first`` to ``last``, for each fingerprint."""
        hashes = [hashing.window_hashes(own, size, s).view(np.int64) for s in (_FIRST, _SECOND)]
        return [[h[x:y] for x, y in zip(first, last + 1, strict=True)] for h in hashes]

    names = ["id", "row", "n_words", "fp", "size", "start", "one", "two"]
    for batch in batches:
        data, starts = hashing.buffers(batch.column(2))
        counts: list[np.ndarray] = []
        at: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        first_windows: list[np.ndarray] = []
        hashes: list[list[np.ndarray]] = [[], []]
        for a, b in hashing.groups(starts):
            words, begins = hashing.document_words(data, starts[a : b + 1], hashing.alphanumeric)
            counts.append(np.diff(begins))
            for i, (x, y) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                own = words[x:y]
                found = []
                if len(own) >= window:
                    found.append((window, *_fingerprints(own, window, gram)))
                for size in short:
                    fp = hashing.window_hashes(own, size, _SHORT)
                    found.append((size, np.arange(len(fp)), fp))
                for size, place, fp in found:
                    kept = may_hold(table, fp)
                    if not kept.any():
                        continue
                    place, fp = place[kept], fp[kept]
                    first, last = (np.maximum(0, place + gram - window), np.minimum(place, len(own) - window)) if size == window else (place, place)
                    at.append(np.full(len(fp), a + i))
                    fps.append(fp.view(np.int64))
                    sizes.append(np.full(len(fp), size, np.int32))
                    first_windows.append(first.astype(np.int32))
                    for into, pieces in zip(hashes, around(own, size, first, last), strict=True):
                        into.extend(pieces)
        n = batch.num_rows
        total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        blanks = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), *blanks], names)
        if at:
            places = pa.array(np.concatenate(at))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes[0]])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(h))) for h in hashes]
            flat = [pa.array(np.concatenate(v)) for v in (fps, sizes, first_windows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.nulls(len(places), pa.int64()), *flat, *lists], names)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """``id``, ``row``, ``n_words``, ``n_hit``, ``spans`` (start and length in words) and ``items`` of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    item = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    made = stored(item.mapInArrow(lambda b: _item_rows(b, window, gram), "item string, fp long, one long, two long, size int"))
    fps = stored(made.filter("fp IS NOT NULL").select("fp", "size").distinct())
    windows = stored(made.filter("fp IS NULL").select("one", "two", "size", "item").distinct())
    short = sorted(r[0] for r in fps.filter(F.col("size") < window).select("size").distinct().collect())
    bits = spark.sparkContext.broadcast(filter_bits(fps, "fp"))

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    scanned = stored(source.mapInArrow(lambda b: _document_rows(b, window, gram, short, bits), f"id {kind}, row long, n_words long, {_HASHES}"))

    joint = scanned.filter("fp IS NOT NULL").join(fps, ["fp", "size"], "left_semi")
    around = joint.select("id", "row", "size", "start", F.posexplode(F.arrays_zip("one", "two")).alias("i", "w"))
    around = around.select("id", "row", "size", (F.col("start") + F.col("i")).alias("start"), F.col("w.one").alias("one"), F.col("w.two").alias("two"))
    hits = stored(around.join(windows.select("one", "two", "size").distinct(), ["one", "two", "size"], "left_semi").distinct())

    state = "named_struct('n', 0L, 'to', 0)"
    step = "(s, x) -> named_struct('n', s.n + greatest(0, x.start + x.size - greatest(s.to, x.start)), 'to', greatest(s.to, x.start + x.size))"
    spans = hits.groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))
    spans = spans.withColumn("n_hit", F.expr(f"aggregate(spans, {state}, {step}).n"))
    found = hits.select("id", "row", "one", "two", "size").distinct().join(windows, ["one", "two", "size"]).select("id", "row", "item").distinct()
    found = found.groupBy("id", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = found.select(F.col("id").alias("f_id"), F.col("row").alias("f_row"), "items")
    marks = spans.join(named, (F.col("row") == F.col("f_row")) & F.col("id").eqNullSafe(F.col("f_id")), "left")
    marks = marks.select(F.col("id").alias("m_id"), F.col("row").alias("m_row"), "n_hit", "spans", "items")
    texts = scanned.filter("fp IS NULL").select("id", "row", "n_words")
    joined = texts.join(marks, (F.col("row") == F.col("m_row")) & F.col("id").eqNullSafe(F.col("m_id")), "left")
    none = F.array().cast("array<string>")
    return joined.select("id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", none).alias("items"))
