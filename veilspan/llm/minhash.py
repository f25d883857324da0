"""Near-duplicate documents by b-bit MinHash.

Method: a document's set of word shingles is hashed; documents of equal sets form
one class, and only classes go on.  Of every class the minima of a family of hash
functions are taken; rows of minima make band keys, and of each minimum only the
low bits are kept, packed into a signature.  Classes that meet in a band bucket
become candidates with the least class of that bucket; the number of equal
low-bit fields, corrected for chance matches, estimates their similarity and drops
accidental meetings.  Differing fields obey the triangle inequality, so a class close
to the bucket's least class has its near copies linked to it as well; the classes that
the least class rejects are compared, in blocks, with each other and with those
between.  What remains connected is a neighbourhood.  All pairs of a
neighbourhood are looked at in blocks of bounded size: the bit counts drop most
pairs, the full sets decide on the others, and only a spanning forest of the
confirmed links leaves a task.  Connected components of these links are the groups.

A link is missed only if its two sets agree in no band, which for the default
30 bands of 5 minima has a probability of 7e-6 at a similarity of 0.80 and 2e-8 at
0.85, or if the bit counts stray by more than five standard deviations.

Rows: rows that share an id belong together; rows without an id stand alone.  A
null text, or one without words, has an empty set and no links.  Texts of fewer
words than a shingle have one shingle, the whole sequence.  An empty table gives
an empty result.  Other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .frames import components, shuffle_width, small_batches, stored

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 30, 5
FIELD_BITS = 4
_MINIMA = BANDS * BAND_ROWS
_FIELDS = 64 // FIELD_BITS
_LONGS = -(-_MINIMA // _FIELDS)
_CHANCE = 2.0**-FIELD_BITS
_ONES = int("1" * _FIELDS, 16)

#: A neighbourhood holds classes whose estimated similarity to a bucket's least
#: class is at least this; below, a meeting in a bucket is an accident.
NEIGHBOUR = 0.45
#: How many standard deviations an estimate may lie below the threshold.
DEVIATIONS = 5.0
#: Size of a block of a neighbourhood, in classes and in shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 400_000
#: Size of a block of a bucket, of which only signatures are compared.
BUCKET_CLASSES = 4096

_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**31, (2, _MINIMA), dtype=np.uint32)
_FACTORS = np.stack([_FACTORS[0] * np.uint32(2) + np.uint32(1), _FACTORS[1] * np.uint32(2)])

_SKETCH = "id long, n_shingles long, shingles binary, bands array<long>, fields array<long>"


def shingle_sets(texts: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, by groups of texts."""
    data, starts = hashing.buffers(texts)
    for a, b in hashing.groups(starts):
        found, at = hashing.document_words(data, starts[a : b + 1], hashing.spaced)
        whole = hashing.window_hashes(found, words)
        sets = []
        for x, y in zip(at[:-1], at[1:], strict=True):
            if y - x >= words:
                sets.append(np.unique(whole[x : y - words + 1]))
            else:
                sets.append(hashing.window_hashes(found[x:y], int(y - x)) if y > x else whole[:0])
        yield sets


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sets in shingle_sets(batch.column(1), words):
            sizes = np.array([len(s) for s in sets])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            n = len(sets)
            minima = np.zeros((_MINIMA, n), np.uint32)
            full = np.flatnonzero(sizes)
            if len(full):
                values = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                work = np.empty_like(values)
                for k in range(_MINIMA):
                    np.bitwise_xor(values, _FACTORS[1, k], out=work)
                    np.multiply(work, _FACTORS[0, k], out=work)
                    minima[k, full] = np.minimum.reduceat(work, starts)
            keys = np.zeros((n, BANDS), np.uint64)
            fields = np.zeros((n, _LONGS), np.uint64)
            for k in range(_MINIMA):
                band = k // BAND_ROWS
                keys[:, band] = hashing.mix(keys[:, band] * np.uint64(31) + minima[k] + np.uint64((band + 1) << 33))
                low = minima[k] & np.uint32((1 << FIELD_BITS) - 1)
                fields[:, k // _FIELDS] |= low.astype(np.uint64) << np.uint64(FIELD_BITS * (k % _FIELDS))
            columns = [batch.column(0).slice(at, n), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(keys), _lists(fields)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "shingles", "bands", "fields"])
            at += n


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.view(np.int64).ravel()))


def differing(a: str, b: str) -> Column:
    """How many fields of two packed signatures differ."""
    total = F.lit(0)
    for i in range(_LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(_ones_signed())))
    return total


def _ones_signed() -> int:
    return _ONES - (1 << 64) if _ONES >= 1 << 63 else _ONES


def _differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(_ONES)).sum(1, dtype=np.int64)


def _least_estimate(percent: int) -> int:
    """The most fields that may differ in a pair that is worth a look at its sets."""
    same = _CHANCE + (1 - _CHANCE) * percent / 100
    return int(np.ceil(_MINIMA * (1 - same) + DEVIATIONS * np.sqrt(_MINIMA * same * (1 - same))))


def _reach(percent: int) -> int:
    """The most fields in which a class may differ from the least class of its bucket to
    be linked with it: by the estimate, and never fewer than in a pair worth a look."""
    return max(int(_MINIMA * (1 - _CHANCE - (1 - _CHANCE) * NEIGHBOUR)), _least_estimate(percent))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Full sets of the rows whose set is that of their class."""
    names = ["label", "node", "block", "blocks", "fields", "hashes"]
    for batch in batches:
        at = 0
        for sets in shingle_sets(batch.column(0), words):
            part = batch.slice(at, len(sets))
            wanted = part.column(6).to_pylist()
            keep = pa.array([len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == w for s, w in zip(sets, wanted, strict=True)], pa.bool_())
            hashes = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(1, 6)], hashes], names).filter(keep)
            at += len(sets)


def _linked(batches: Iterator[pa.RecordBatch], percent: int, forest: Callable = None) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between the two blocks of each run of rows."""
    forest = forest or _forest
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if key is not None and tuple(keys[a]) != key:
                yield from forest(held, key, percent)
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from forest(held, key, percent)


def _forest(held: list[pa.RecordBatch], key: tuple, percent: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    nodes = table.column("node").to_numpy()
    if len(nodes) < 2:
        return
    block = table.column("block").to_numpy()
    fields = np.array(table.column("fields").to_pylist(), np.int64).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    crossing = key[1] != key[2]
    limit = _least_estimate(percent)
    left, right = [], []
    for i in range(len(nodes) - 1):
        j = np.arange(i + 1, len(nodes))
        near = _differing(fields[i], fields[i + 1 :]) <= limit
        near &= 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
        if crossing:
            near &= block[j] != block[i]
        found = j[near]
        left.append(np.full(len(found), i))
        right.append(found)
    left, right = np.concatenate(left), np.concatenate(right)
    common = _intersections(sets, left, right)
    linked = 100 * common >= percent * (sizes[left] + sizes[right] - common)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = []
    for i, j in zip(left[linked].tolist(), right[linked].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            pairs.append((nodes[i], nodes[j]))
    if pairs:
        pairs = np.array(pairs, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _near_forest(held: list[pa.RecordBatch], key: tuple, percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of a bucket that are worth a look, by their bit
    counts; pairs without a rejected class are left out."""
    table = pa.Table.from_batches(held).combine_chunks()
    nodes = table.column("node").to_numpy()
    if len(nodes) < 2:
        return
    block = table.column("block").to_numpy()
    far = table.column("far").to_numpy()
    fields = table.column("fields").combine_chunks().flatten().to_numpy().reshape(-1, _LONGS).view(np.uint64)
    crossing, limit = key[1] != key[2], _least_estimate(percent)
    tree, left, right = np.arange(len(nodes)), [], []
    for i in range(len(nodes) - 1):
        near = _differing(fields[i], fields[i + 1 :]) <= limit
        near &= tree[i + 1 :] != tree[i]
        if not far[i]:
            near &= far[i + 1 :]
        if crossing:
            near &= block[i + 1 :] != block[i]
        found = np.flatnonzero(near) + i + 1
        if len(found):
            trees, first = np.unique(tree[found], return_index=True)
            left.extend([nodes[i]] * len(trees))
            right.extend(nodes[found[first]])
            tree[np.isin(tree, trees)] = tree[i]
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets, on the full sets."""
    if len(left) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    used = np.unique(np.concatenate([left, right]))
    place = {int(x): n for n, x in enumerate(used)}
    rows = np.repeat(np.arange(len(used)), [len(sets[x]) for x in used])
    values, column, count = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
    total = np.zeros((len(used), len(used)), np.float32)
    shared = np.flatnonzero(count > 1)  # a shingle of one set is in no intersection
    order = np.full(len(values), -1)
    order[shared] = np.arange(len(shared))
    column = order[column]
    rows, column = rows[column >= 0], column[column >= 0]
    step = max(1, 4_000_000 // len(used))
    for a in range(0, len(shared), step):
        part = (column >= a) & (column < a + step)
        here = np.zeros((len(used), min(step, len(shared) - a)), np.float32)
        here[rows[part], column[part] - a] = 1
        total += here @ here.T
    return total[[place[int(x)] for x in left], [place[int(x)] for x in right]].astype(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Id, set size, digest of the set, band keys and packed signature of each row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda batches: _sketches(batches, words), _SKETCH)


def _dealt(rows: DataFrame, group: str, *values: str) -> DataFrame:
    """The rows of each pair of blocks of a group side by side, as ``_linked`` reads them."""
    partner = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner"))
    pairs = partner.select(group, F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "node", "block", *values)
    return pairs.repartition(shuffle_width(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = 85) -> DataFrame:
    """``id``, ``n_shingles`` and ``component`` of each row.

    Two documents are linked if ``100 * intersection >= percent * union`` of their
    sets of ``words``-word shingles; ``component`` is the least id a row can reach
    over links, itself included.
    """
    rows = stored(sketches(docs, id_col, text_col, words))
    known = rows.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    least = known.groupBy("shingles").agg(F.min(F.struct("id", "n_shingles", "bands", "fields")).alias("x"))
    classes = stored(least.select("shingles", F.col("x.id").alias("node"), "x.n_shingles", "x.bands", "x.fields"))

    buckets = classes.select("node", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    meetings = buckets.join(hubs, "key").filter("node != hub").select("node", "hub").distinct()
    signature = classes.select("node", "fields")
    other = classes.select(F.col("node").alias("hub"), F.col("fields").alias("hub_fields"))
    reach = _reach(percent)
    met = stored(meetings.join(signature, "node").join(other, "hub").select("node", "hub", differing("fields", "hub_fields").alias("differ")))
    near = met.filter(F.col("differ") <= reach).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # near copies of any class that is closer are linked with the hub themselves
    loose = met.filter(F.col("differ") > reach - _least_estimate(percent)).select("node", "hub", (F.col("differ") > reach).alias("far"))
    left = stored(buckets.join(hubs, "key").join(loose, ["node", "hub"]).select("key", "node", "far"))
    open_keys = left.groupBy("key").agg(F.count("*").alias("n"), F.max("far").alias("any_far")).filter("n > 1 AND any_far")
    rest = left.join(open_keys.select("key", F.ceil(F.col("n") / BUCKET_CLASSES).cast("int").alias("blocks")), "key").join(signature, "node")
    rest = _dealt(rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "key", "far", "fields")
    near = near.union(rest.mapInArrow(lambda batches: _linked(batches, percent, _near_forest), "a long, b long"))
    labels = stored(components(near))

    members = stored(classes.select("shingles", "node", "n_shingles", "fields").join(labels, "node"))
    weights = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("w") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    dealt = members.join(weights.select("label", blocks.alias("blocks")), "label")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    sets = texts.join(dealt, "node").select("text", "label", "node", "block", "blocks", "fields", "shingles")
    sets = sets.mapInArrow(lambda batches: _sets(batches, words), "label long, node long, block int, blocks int, fields array<long>, hashes binary")
    links = _dealt(sets, "label", "fields", "hashes").mapInArrow(lambda batches: _linked(batches, percent), "a long, b long")
    found = components(links)

    named = classes.select("shingles", "node").join(found, "node", "left").select("shingles", F.coalesce("label", "node").alias("component"))
    return rows.select("id", "n_shingles", "shingles").join(named, "shingles", "left").select("id", "n_shingles", F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id")).alias("component"))
