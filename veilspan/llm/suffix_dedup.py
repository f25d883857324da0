"""Removal of byte strings that occur anywhere else in the corpus.

A byte goes if some string of ``length`` bytes that covers it also starts at another
place, in the same text or another one.

Method: a sparse suffix array.  Suffixes are sorted at anchors only: of all grams of
``length - GRID + 1`` bytes in ``GRID`` places in a row, the one with the least hash
is an anchor, so every string of ``length`` bytes has an anchor in it, and equal
strings have it at the same offset.  Suffixes are range-partitioned by their leading
bytes, for which sampled splitters are drawn; a hot beginning is dealt over several
ranges by its places.  Each bucket is sorted on its own and compares neighbours, and
the ends of the buckets are compared across their boundaries.

Suffixes that begin alike at an anchor still differ in how far they agree on either
side.  Every string has one anchor that decides on it, so the strings of an anchor are
an interval of offsets.  If all that the strings of an interval span occurs again, all of them do; if what they
have in common does not, none does; else the interval is split, down to single strings.
Where strings of an interval are still open, places that share their common part take
part in the next step though they are settled, one for each different surrounding.
Each test is one more sort of suffixes by their leading bytes, of a given length.  No
group of suffixes is held in memory; leading bytes move as 128-bit digests, which bring
equal strings together.

A text moves only if a bit filter of bounded size says that it may have what is looked
for; a join decides, so a filter too full to help changes no result.

Texts are read as UTF-8 bytes.

Rows: rows of equal id and equal text count as one document and get equal results.  A
null text is empty.  An empty table gives an empty result.  Other columns are not read
and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .frames import bit_filter, row_key, shuffle_width, small_batches, stored

LENGTH = 400
#: Offsets between a string and its anchor, and the offsets that are tested together.
GRID, CELL = 256, 16
_PIECE = 1 << 18

_PLACE = "key binary, row long, at long, low int, high int, other binary"
_UNIT = "shared binary, whole binary, row long, at long, low int, high int"
_SEEN, _OPEN, _EDGE = 0, 1, 2


def anchors(data: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of one text, and the hashes of their grams."""
    count = len(data) - gram + 1
    if count < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes, at = [], [], 0
    while True:
        end = min(at + _PIECE + width - 1, count)
        own = data[at : end + gram - 1]
        up, down = hashing._powers(len(own) + 1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=total[1:])
        values = hashing.mix((total[gram:] - total[:-gram]) * down[: end - at])
        kept = hashing.winnowed(values, width)
        places.append(kept + at)
        hashes.append(values[kept])
        if end == count:
            break
        at = end - width + 1
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return places, hashes[first]


def _scanned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of each text."""
    gram = length - GRID + 1
    for batch in batches:
        data, starts = hashing.buffers(batch.column(1))
        owner, keys, places = [], [], []
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if b - a >= length:
                at, hashed = anchors(data[a:b], gram, GRID)
                owner.append(np.full(len(at), i))
                keys.append(hashed)
                places.append(at)
        if owner:
            owner = np.concatenate(owner)
            keys = np.concatenate(keys).astype("<u8")
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), key, pa.array(np.concatenate(places))], ["row", "key", "at"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted bucket whose key another place has, and what its ends leave open."""
    names = ["key", "row", "at", "low", "high", "other", "kind"]
    held = first = last = None  # the last row so far, and whether the one before it has its key

    def made(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, kind, np.int32))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        key = batch.column(0)
        n = batch.num_rows
        width = len(key[0].as_py())
        keys = np.frombuffer(key.buffers()[2], np.uint8)[np.frombuffer(key.buffers()[1], np.int32)[key.offset] :][: n * width].reshape(n, width)
        places = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1)
        same_key = (keys[1:] == keys[:-1]).all(1)
        again = np.concatenate([[False], same_key & (places[1:] == places[:-1]).all(1)])  # one place twice
        if again.any():
            batch = batch.filter(pa.array(~again))
            keys, n = keys[~again], batch.num_rows
            same_key = (keys[1:] == keys[:-1]).all(1)
        before = np.concatenate([[bool(last)], same_key])
        after = np.append(same_key, False)
        if first is None:
            first = keys[0].tobytes()
            lead = True
        repeated = before | after
        repeated[-1] = False  # it is judged with what follows
        if lead and n > 1:
            if not repeated[0]:
                yield made(batch.slice(0, 1), _OPEN)
            lead = False
        if repeated.any():
            yield made(batch.filter(pa.array(repeated)), _SEEN)
        held, last = batch.slice(n - 1, 1), before[-1]
    if held is not None:
        yield made(held, _SEEN if last else _OPEN)
        ends = {first, held.column(0)[0].as_py()}
        for end in ends:
            blank = [pa.nulls(1, c.type) for c in held.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), *blank, pa.array([_EDGE], pa.int32())], names)


def repeated_keys(suffixes: DataFrame) -> DataFrame:
    """The rows of ``suffixes`` whose key is also that of another place.

    A bucket hands on the keys at its two ends; a key that ends a bucket and is alone
    there is repeated if it ends another one too.
    """
    order = ("key", "row", "at")
    dealt = suffixes.repartitionByRange(shuffle_width(suffixes.sparkSession), *order).sortWithinPartitions(*order)
    seen = stored(dealt.mapInArrow(_neighbours, f"{_PLACE}, kind int"))
    # a bucket of one key hands it on once
    ends = seen.filter(F.col("kind") == _EDGE).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return seen.filter(F.col("kind") == _SEEN).drop("kind").union(seen.filter(F.col("kind") == _OPEN).drop("kind").join(ends, "key", "left_semi"))


def _nearest(places: list[int], hashes: list[int], strict: bool) -> list[int | None]:
    """For each anchor the nearest one before it of a lesser hash, or an equal one."""
    found, open_anchors = [], []
    for at, value in zip(places, hashes, strict=True):
        while open_anchors and (open_anchors[-1][1] > value or (strict and open_anchors[-1][1] == value)):
            open_anchors.pop()
        found.append(open_anchors[-1][0] if open_anchors else None)
        open_anchors.append((at, value))
    return found


def _digest(text: bytes, begin: int, end: int, seed: int) -> bytes | None:
    return xxhash.xxh3_128_digest(text[begin:end], seed=seed) if 0 <= begin < end <= len(text) else None


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shared", "whole", "row", "at", "low", "high"])


def _units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The offsets of the strings that each repeated anchor decides on.

    An anchor decides on the strings in which it has the first of the least hashes.
    """
    gram = length - GRID + 1
    for batch in batches:
        rows, texts, lists = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        out = []
        for row, text, repeated in zip(rows, texts, lists, strict=True):
            n = len(text)
            places, hashes = (x.tolist() for x in anchors(np.frombuffer(text, np.uint8), gram, GRID))
            known = set(repeated)
            before = _nearest(places, hashes, False)
            after = [None if x is None else -x for x in _nearest([-x for x in reversed(places)], hashes[::-1], True)[::-1]]
            for i, at in enumerate(places):
                if at not in known:
                    continue
                high = min(GRID - 1, at, GRID - 1 if before[i] is None else at - before[i] - 1)
                low = max(0, at + length - n, 0 if after[i] is None else at + GRID - after[i])
                if low <= high:
                    low, high = low // CELL * CELL, high // CELL * CELL + CELL - 1
                    whole = _digest(text, at - high, at - low + length, low * GRID + high)
                    out.append((hashes[i].to_bytes(8, "little"), whole, row, at, low, high))
        yield _unit_batch(out)


def _split(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """The intervals of ``step`` offsets of each unit, with what their strings share and
    what they span; for single strings that is the same."""
    for batch in batches:
        rows, texts, lists = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        out = []
        for row, text, units in zip(rows, texts, lists, strict=True):
            for unit in units:
                at = unit["at"]
                for low in range(unit["low"], unit["high"] + 1, step):
                    high = low + step - 1
                    shared = _digest(text, at - low, at - high + length, 2 * low)
                    if shared is not None:
                        whole = shared if step == 1 else _digest(text, at - high, at - low + length, 2 * low + 1)
                        out.append((shared, whole, row, at, low, high))
        yield _unit_batch(out)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the strings of its settled intervals."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    for batch in batches:
        texts, lists = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        kept, removed, spans = [], [], []
        for text, found in zip(texts, lists, strict=True):
            at = np.array([(x["at"], x["low"], x["high"]) for x in found], np.int64)
            begin, end = at[:, 0] - at[:, 2], at[:, 0] - at[:, 1] + length
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            fresh = np.concatenate([[True], begin[1:] > end[:-1]])
            begin, end = begin[fresh], end[np.append(fresh[1:], True)]
            parts, last = [], 0
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                parts.append(text[last:a])
                last = b
            parts.append(text[last:])
            kept.append(b"".join(parts))
            removed.append(int((end - begin).sum()))
            spans.append(len(begin))
        counts = [pa.array(x, pa.int64()) for x in ([len(text) for text in texts], removed, spans)]
        shas = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(kept, pa.binary()), shas], names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left) and
    ``kept_sha256`` of each document."""
    if length <= GRID:
        raise ValueError(f"strings of {length} bytes are too short for {GRID} offsets")
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    scanned = stored(source.select("row", "text").mapInArrow(lambda b: _scanned(b, length), "row long, key binary, at long"))

    def meeting(bodies: DataFrame, lists: DataFrame) -> DataFrame:
        """The texts that ``lists`` has rows for, with them."""
        possible = bit_filter(lists.select("row"))
        return bodies.filter(possible("row")).join(lists.hint("shuffle_hash"), "row")

    def repeated(units: DataFrame, by: str, other: str) -> DataFrame:
        keyed = units.filter(F.col(by).isNotNull()).select(F.col(by).alias("key"), "row", "at", "low", "high", F.col(other).alias("other"))
        return repeated_keys(keyed).select(F.col("key").alias(by), F.col("other").alias(other), "row", "at", "low", "high")

    suffixes = scanned.select("key", "row", "at", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(None).cast("binary").alias("other"))
    places = stored(repeated_keys(suffixes).groupBy("row").agg(F.collect_set("at").alias("wanted")))
    texts = stored(meeting(source, places).select("row", "text", "wanted", "id"))
    bodies = texts.select("row", "text")
    units = stored(texts.drop("id").mapInArrow(lambda b: _units(b, length), _UNIT))
    settled = []
    for step in (CELL, 1):
        done = stored(repeated(units, "whole", "shared"))
        settled.append(done)
        left = stored(units.join(done.select("row", "at", "low"), ["row", "at", "low"], "left_anti"))
        needed = stored(left.select("shared").distinct())
        beside = done.join(needed, "shared", "left_semi").groupBy("whole").agg(F.min(F.struct("row", "at", "low", "high")).alias("x")).select("x.*")
        lists = left.select("row", "at", "low", "high").union(beside).groupBy("row").agg(F.collect_set(F.struct("at", "low", "high")).alias("units"))
        parts = meeting(bodies, stored(lists)).mapInArrow(lambda b, s=step: _split(b, length, s), _UNIT)
        units = stored(repeated(parts, "shared", "whole"))
    settled.append(units)

    found = settled[0].select("row", "at", "low", "high")
    for more in settled[1:]:
        found = found.union(more.select("row", "at", "low", "high"))
    gone = stored(found.groupBy("row").agg(F.collect_set(F.struct("at", "low", "high")).alias("found")))
    cut = meeting(texts.select("id", "row", "text"), gone).select("id", "text", "found")
    cut = cut.mapInArrow(lambda b: _cut(b, length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    # most whole texts are told by the filter and do not move
    touched, rows = bit_filter(gone.select("row")), gone.select("row").hint("shuffle_hash")
    whole = source.filter(~touched("row")).union(source.filter(touched("row")).join(rows, "row", "left_anti").select(source.columns))
    kept, zero = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    whole = whole.select("id", F.octet_length(kept).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), kept.alias("kept"), F.sha2(kept, 256).alias("kept_sha256"))
    return cut.union(whole)
