"""Vectorised words and rolling hashes of UTF-8 texts, for use inside Arrow tasks.

Everything works on the byte buffer of an Arrow string column.  Words are hashed
by a polynomial over their bytes (arithmetic modulo 2**64) and mixed, so that no
Python object is made per word.  Bytes are visited in segments of bounded size
that end between two words; only arrays of one entry per word span a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 16
#: Texts are handed on in groups of about this many bytes.
GROUP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse for ``i < n``, modulo 2**64."""
    size = max(2 * SEGMENT_BYTES, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[size] = tuple(both)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spaced(data: np.ndarray) -> np.ndarray:
    """Bytes of words that are parted by ASCII white space."""
    return (data != 32) & ((data - np.uint8(9)) > 4)


def alphanumeric(data: np.ndarray) -> np.ndarray:
    """Bytes of words of ASCII letters, digits and anything beyond ASCII."""
    return ((data | np.uint8(32)) - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data > 127)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return data + (data - np.uint8(65) < 26).view(np.uint8) * np.uint8(32)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), starts


def groups(starts: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of values of about ``limit`` bytes; a larger value is alone."""
    n, at = len(starts) - 1, 0
    while at < n:
        end = int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def document_words(data: np.ndarray, starts: np.ndarray, inside_word) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, and where the words of each text begin.

    ``starts`` has the first byte of every text and the end of the last one;
    ``inside_word`` tells which bytes belong to words.  Texts touch in the buffer,
    but no word reaches over two of them.
    """
    hashes, firsts = [], []
    at, stop = int(starts[0]), int(starts[-1])
    borders = np.unique(starts)
    while at < stop:
        end = min(at + SEGMENT_BYTES, stop)
        inside = inside_word(data[at:end])
        if end < stop:  # end between two words, also if one is longer than a segment
            while inside[-1] and end < stop:
                parting = np.flatnonzero(~inside)
                border = borders[np.searchsorted(borders, end, side="right") - 1]
                cut = max(int(parting[-1]) + 1 + at if len(parting) else at, int(border))
                if cut > at:
                    end = cut
                    break
                end = min(end + SEGMENT_BYTES, stop)
                inside = inside_word(data[at:end])
            inside = inside[: end - at]
        cuts = borders[(borders > at) & (borders < end)] - at
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(first):
            up, down = _powers(end - at + 1)
            total = np.zeros(end - at + 1, np.uint64)
            np.cumsum((lowered(data[at:end]).astype(np.uint64) + np.uint64(1)) * up[: end - at], out=total[1:])
            hashes.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
            firsts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), starts)


def window_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of every window of ``length`` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((_BASE * (2 * seed + 1)) & _MASK)
    total = words[:n] * step
    for i in range(1, length):
        total += words[i : i + n]
        total *= step
    return mix(total ^ np.uint64((seed * 0xA0761D6478BD642F + length) & _MASK))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[width - have : width - have + n])


def winnowed(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some window of ``width`` values.

    With fewer values, that of all of them.  Equal values are all kept, so the
    choice depends on the content of a window alone.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(width, n)
    low = sliding_minimum(values, width)
    # a value is kept if some window that holds it has it as its least value:
    # the greatest of these minima equals it
    padded = np.concatenate([np.zeros(width - 1, low.dtype), low, np.zeros(width - 1, low.dtype)])
    return np.flatnonzero(_sliding_maximum(padded, width) == values)


def _sliding_maximum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    high, have = values, 1
    while have * 2 <= width:
        high = np.maximum(high[:-have], high[have:])
        have *= 2
    return np.maximum(high[:n], high[width - have : width - have + n])
