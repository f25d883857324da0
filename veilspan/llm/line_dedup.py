"""Removal of lines that many documents share.

Method: every document gives one row for each different line key it has, with the
line's hash and its positions.  The rows are range-partitioned by hash, document
and text, so one very common line is dealt over as many tasks as its rows need.
Sorted tasks stream over their rows and see the occurrences of a line one after
the other; only the line at either end of a task may go on in another task, and
these are settled by a sum of at most two counts from each task.  What comes back
is a compressed bitmap of the lines each document keeps, never text.

Rows: rows of equal id and equal text count as one document; rows of equal id and
different texts count as different ones.  A null or empty text is one empty line,
which has no key and stays.  An empty table gives an empty result.  Other columns
are not read and may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import row_key, shuffle_width, small_batches, stored

_LINES = "id string, row long, line binary, positions binary"
_SEEN = "id string, row long, line binary, positions binary, kind int, docs long"
_LOST, _OPEN, _EDGE = 0, 1, 2


def _line_rows(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, rows, texts = (batch.column(i) for i in range(3))
        at, lines, places = [], [], []
        for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            if not text:
                continue
            found: dict[bytes, list[int]] = {}
            for n, line in enumerate(text.lower().split(b"\n")):
                key = line.strip()  # ASCII white space, as the text is bytes
                if key and (min_length <= 1 or len(key.decode()) >= min_length):
                    found.setdefault(digest(key), []).append(n)
            at.extend([i] * len(found))
            lines.extend(found)
            places.extend(np.array(p, "<i4").tobytes() for p in found.values())
        at = pa.array(at, pa.int64())
        columns = [ids.take(at), rows.take(at), pa.array(lines, pa.binary()), pa.array(places, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "row", "line", "positions"])


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of lines in ``min_docs`` documents, from rows sorted by line and document.

    Holds back at most ``min_docs - 1`` documents' rows of the line being read.
    """
    names = ["id", "row", "line", "positions", "kind", "docs"]

    def made(rows: pa.RecordBatch | pa.Table, kind: int, docs: int = 0) -> pa.RecordBatch:
        n = rows.num_rows
        columns = [rows.column(i) for i in range(4)] + [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, docs, np.int64))]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    def edge(line: bytes, docs: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([line], pa.binary()), pa.nulls(1, pa.binary()), pa.array([_EDGE], pa.int32()), pa.array([docs], pa.int64())], names
        )

    line, docs, document, held, first = None, 0, None, [], True

    def closed(at_edge: bool) -> Iterator[pa.RecordBatch]:
        """The line being read has ended here; at an edge another task may go on with it."""
        if line is None or not at_edge:
            return
        if docs < min_docs:
            yield from (made(rows, _OPEN) for rows in held)
        yield edge(line, docs)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.frombuffer(batch.column(2).buffers()[2], "V16")[batch.column(2).offset :][:n].view("<u8").reshape(n, 2)
        rows = batch.column(1).to_numpy(zero_copy_only=False)
        ids = batch.column(0)
        same_id = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, n - 1)), False) if n > 1 else pa.array([], pa.bool_())
        both_null = pc.and_(pc.is_null(ids.slice(1)), pc.is_null(ids.slice(0, n - 1))) if n > 1 else pa.array([], pa.bool_())
        new_line = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        same = np.concatenate([[False], np.asarray(pc.or_(same_id, both_null)) & (rows[1:] == rows[:-1])]) & ~new_line
        starts = np.flatnonzero(new_line)
        ends = np.append(starts[1:], n)
        counts = np.add.reduceat((~same).astype(np.int64), starts)
        whole = np.zeros(n, bool)
        for k in sorted({0, len(starts) - 1}):  # lines that may have begun before or may go on
            key, piece = keys[starts[k]].tobytes(), batch.slice(starts[k], ends[k] - starts[k])
            if key != line:
                if k:
                    lost = counts[1:k] >= min_docs
                    whole[starts[1] : ends[k - 1]] = np.repeat(lost, (ends - starts)[1:k])
                    if whole.any():
                        yield made(batch.filter(pa.array(whole)), _LOST)
                yield from closed(first)
                first = line is None
                line, docs, document, held = key, 0, None, []
            start = (ids[starts[k]].as_py(), int(rows[starts[k]]))
            docs += int(counts[k]) - (start == document)
            document = (ids[ends[k] - 1].as_py(), int(rows[ends[k] - 1]))
            if docs >= min_docs:
                yield from (made(x, _LOST) for x in held)
                held = []
                yield made(piece, _LOST)
            else:
                held.append(piece)
    yield from closed(True)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """``id``, ``row`` and ``keep`` of the documents that lose lines.

    ``id`` is the document's id as text, ``row`` the key of its id and text, and
    ``keep`` a compressed bitmap (see ``unpacked``) of its lines: a line goes if its
    key, stripped of ASCII white space and with A-Z in lower case, has at least
    ``min_length`` code points and is found in at least ``min_docs`` documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("string").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    lines = source.mapInArrow(lambda batches: _line_rows(batches, min_length), _LINES)
    dealt = lines.repartitionByRange(shuffle_width(spark), "line", "id", "row").sortWithinPartitions("line", "id", "row")
    seen = stored(dealt.mapInArrow(lambda batches: _stream(batches, min_docs), _SEEN))
    common = seen.filter(F.col("kind") == _EDGE).groupBy("line").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs).select("line")
    open_rows = seen.filter(F.col("kind") == _OPEN).join(common, "line", "left_semi")
    lost = seen.filter(F.col("kind") == _LOST).select("id", "row", "positions").union(open_rows.select("id", "row", "positions"))
    gathered = lost.groupBy("id", "row").agg(F.collect_list("positions").alias("positions"))
    return gathered.mapInArrow(_packed, "id string, row long, keep binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for pieces in batch.column(2).to_pylist():
            places = np.frombuffer(b"".join(pieces), "<i4")
            keep = np.ones(int(places.max()) + 1, np.uint8)
            keep[places] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes() + (len(keep) % 8).to_bytes(1, "little"), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["id", "row", "keep"])


def unpacked(keep: bytes) -> np.ndarray:
    """The lines a bitmap keeps, up to the last one it drops; later lines all stay."""
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    return bits[: len(bits) - (-raw[-1]) % 8].astype(bool)


def _applied(batches: Iterator[pa.RecordBatch], text_at: int, keep_at: int, schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keeps = batch.column(text_at).cast(pa.binary()), batch.column(keep_at).to_pylist()
        kept, lines, dropped = texts.to_pylist(), [], []
        for i, keep in enumerate(keeps):
            text = kept[i] or b""
            lines.append(text.count(b"\n") + 1)
            if keep is None:
                dropped.append(0)
                continue
            flags = unpacked(keep)
            parts = text.split(b"\n")
            dropped.append(int((~flags).sum()))
            kept[i] = b"\n".join([p for p, f in zip(parts, flags, strict=False) if f] + parts[len(flags) :])
        columns = batch.columns
        columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
        columns[keep_at] = pa.array(lines, pa.int64())
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped, pa.int64())], [*names[:keep_at], "n_lines", "n_dropped"])


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """``docs`` with the kept lines as text, and ``_n_lines`` and ``_n_dropped`` beside its columns.

    A null text stays null.  A document all of whose lines go has an empty text.
    """
    maps = line_bitmaps(docs, id_col, text_col, min_docs, min_length)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    inner = [f"c{names.index(c)}" for c in (id_col, text_col)]
    keyed = plain.withColumns({"_id": F.col(inner[0]).cast("string"), "_row": row_key(*inner)})
    maps = maps.withColumnRenamed("row", "_map_row").hint("shuffle_hash")
    joined = keyed.join(maps, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("_map_row")), "left")
    joined = joined.select(*plain.columns, "keep")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    text_at, keep_at = names.index(text_col), len(names)
    done = joined.mapInArrow(lambda batches: _applied(batches, text_at, keep_at, None), f"{kinds}, n_lines long, n_dropped long")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))
