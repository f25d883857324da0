"""Plain versions of the operators' contracts, on lists of rows in memory."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK = r"[^\x20\x09-\x0D]+"


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def line_dedup(docs, least=10):
    split = [(i, t, (t or "").split("\n")) for i, t in docs]
    key = lambda line: lowered(line.strip("\x20\t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t, lines in split:
        for line in lines:
            seen[key(line)].add((i, t))
    drop = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for i, _, lines in split:
        kept = [line for line in lines if key(line) not in drop]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def repeats(docs, length=400):
    """Rows of equal id and text count once, as the operator defines it."""
    texts = {(i, t): (t or "").encode() for i, t in docs}
    starts = defaultdict(list)
    for k, t in texts.items():
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]].append((k, p))
    gone = {k: bytearray(len(t)) for k, t in texts.items()}
    for places in starts.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + length] = b"\1" * length
    out = []
    for i, t in docs:
        flags, data = gone[i, t], texts[i, t]
        spans = len(re.findall(rb"\x01+", bytes(flags)))
        out.append((i, len(data), sum(flags), spans, sha(bytes(b for b, f in zip(data, flags, strict=True) if not f))))
    return sorted(out, key=repr)


def contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    found = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            found[tuple(w[s : s + n])].add(item)
    sizes = {len(k) for k in found}
    out = []
    for i, t in docs:
        w = words(t)
        hit, held = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in found:
                    hit.update(range(s, s + n))
                    held |= found[k]
        names = sorted(str(x) for x in held if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return sorted(out, key=repr)


def shingles(text, n=5):
    w = re.findall(BLANK, lowered(text or ""))
    return {tuple(w[s : s + n]) for s in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(docs, percent=85):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def quality(docs):
    """The measures and ``base_failed``."""
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(BLANK, t)
        windows = [tuple(w[s : s + 5]) for s in range(len(w) - 4)]
        times = Counter(windows)
        covered = {p for s, k in enumerate(windows) if times[k] > 1 for p in range(s, s + 5)}
        lines = [x for x in t.split("\n") if re.search(BLANK, x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed))
    return sorted(out, key=repr)


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by sharing what is above a cap again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_names, left = dict.fromkeys(names, 0.0), [s for s in names if sizes[s]], float(sum(sizes.values()))
    while open_names:
        total = sum(weight[s] for s in open_names)
        over = [s for s in open_names if left * weight[s] / total > most * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_names})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_names.remove(s)
    return target


def spark_hash(*values) -> int:
    """What Spark's 64-bit hash gives for ``(value, bytes)`` pairs, bytes being 4 or 8."""
    seed = 42
    for value, size in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i" if size == 4 else "<q", value), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def permuted(x: int, size: int, s: int, epoch: int) -> int:
    for r in range(24):
        mirror = (spark_hash((103, 4), (s, 4), (epoch, 4), (r, 4)) % size - x) % size
        if spark_hash((104, 4), (s, 4), (epoch, 4), (r, 4), (max(x, mirror), 8)) & 1:
            x = mirror
    return x


def mix(docs, block_words, shard_slots, most=3):
    """Words taken of each ``(id, source, size)``: slots drawn shard by shard, in order."""
    sizes: Counter = Counter()
    for _, s, n in docs:
        sizes[s] += n
    target = targets(sizes, most=most)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    blocks = [-(-sizes[s] // block_words) for s in names]
    want = [target[s] * b / sizes[s] if sizes[s] else 0.0 for s, b in zip(names, blocks, strict=True)]
    left, shard, counts = math.ceil(round(sum(want), 6)), 0, [0] * len(names)
    times: Counter = Counter()
    while left > 0:
        width = min(left, shard_slots)
        due = [w / sum(want) * width for w in want]
        certain = [math.floor(d + 1e-6) for d in due]
        parts = [max(math.floor((d - c) * (1 << 32)), 0) for d, c in zip(due, certain, strict=True)]
        lucky = [0] * len(names)
        for r in range(1, round(sum(parts) / (1 << 32)) + 1):
            u = spark_hash((102, 4), (shard, 8), (r, 8)) % sum(parts)
            low = 0
            for s, part in enumerate(parts):
                if low <= u < low + part:
                    lucky[s] += 1
                low += part
        for s, b in enumerate(blocks):
            for j in range(counts[s], counts[s] + certain[s] + lucky[s]):
                if b and j < most * b:
                    times[s, permuted(j % b, b, s, j // b)] += 1
            counts[s] += certain[s] + lucky[s]
        left, shard = left - width, shard + 1
    taken: Counter = Counter()
    for s, name in enumerate(names):
        at = 0
        for i, _, n in sorted((d for d in docs if d[1] == name), key=lambda d: spark_hash((101, 4), (d[0], 8))):
            for place in range(at, at + n):
                taken[i] += times[s, place // block_words]
            at += n
    return {i: taken[i] for i, _, _ in docs}
