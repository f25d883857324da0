"""Verdicts on urls from lists of hosts, paths and whole urls.

Method: the entries of the lists are hashed to 64 bits and kept as one sorted array
of hashes, with the entries themselves behind it, in files that Spark hands to every
executor.  A task maps the files into memory, so only the pages that a search touches
are read, looks up the keys of a whole batch of urls by binary search at once, and
compares every hash it finds with the stored entry, so a collision decides nothing.
Lists of any length are cut into files of ``FILE_ENTRIES`` entries, which are all
searched.

A rule is a host and the beginning of a path.  It fits its host and the hosts below
it, if the path begins with the rule's; the longest rule that fits decides, and among
rules of one length that of the longer host.  Where no rule fits, a url is blocked if
its host, or a host above it, is on the block list.

Rows: a null url, or one without ``://``, has an empty host and path, fits no rule and
is on no list.  Repeated rows get equal verdicts.  An empty table or list is allowed.
Other columns are not read and may have any names.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import small_batches
from .urls import url_host, url_path

FILE_ENTRIES = 2_000_000
#: Parts host and path of a key.
_BAR = "\0"


class DigestFile:
    """A sorted array of 64-bit hashes with their entries, mapped from a file.

    Layout: the number of entries, their hashes in order, the ends of the entries, one
    byte each for the verdict, and the entries as UTF-8.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self._map, "<i8", 1)[0])
        self.hashes = np.frombuffer(self._map, "<u8", n, 8)
        self._ends = np.frombuffer(self._map, "<i8", n, 8 + 8 * n)
        self._verdicts = np.frombuffer(self._map, "u1", n, 8 + 16 * n)
        self._text = 8 + 17 * n

    @staticmethod
    def write(path: str, entries: list[tuple[str, int]]) -> None:
        coded = sorted((xxhash.xxh64_intdigest(key.encode()), key.encode(), verdict) for key, verdict in entries)
        with open(path, "wb") as file:
            file.write(np.array([len(coded)], "<i8").tobytes())
            file.write(np.array([h for h, _, _ in coded], "<u8").tobytes())
            file.write(np.cumsum([len(k) for _, k, _ in coded]).astype("<i8").tobytes())
            file.write(np.array([v for _, _, v in coded], "u1").tobytes())
            file.writelines(k for _, k, _ in coded)

    def find(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The verdict of each key, or -1 where it is not an entry."""
        verdicts = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        open_keys = np.flatnonzero(at < len(self.hashes))
        while len(open_keys):  # equal hashes stand side by side
            open_keys = open_keys[self.hashes[at[open_keys]] == hashes[open_keys]]
            for i in open_keys.tolist():
                place = int(at[i])
                begin = int(self._ends[place - 1]) if place else 0
                if self._map[self._text + begin : self._text + int(self._ends[place])] == keys[i]:
                    verdicts[i] = self._verdicts[place]
            at[open_keys] += 1
            open_keys = open_keys[(verdicts[open_keys] < 0) & (at[open_keys] < len(self.hashes))]
        return verdicts


@dataclass(frozen=True)
class UrlLists:
    """Names of the digest files, and the lengths of the paths of the rules."""

    files: tuple[str, ...]
    path_lengths: tuple[int, ...]

    @staticmethod
    def share(spark: SparkSession, rules: Iterable[tuple[str, str, str]], blocked_hosts: Iterable[str]) -> UrlLists:
        """Write the digest files and hand them to the executors."""
        lengths = set()

        def entries() -> Iterator[tuple[str, int]]:
            for verdict, host, path in rules:
                lengths.add(len(path))
                yield f"r{host}{_BAR}{path}", int(verdict == "block")
            for host in blocked_hosts:
                yield f"h{host}", 1

        names, part = [], []

        def flush() -> None:
            names.append(f"urls-{uuid.uuid4().hex}.idx")
            path = os.path.join(tempfile.gettempdir(), names[-1])
            DigestFile.write(path, part)
            spark.sparkContext.addFile(path)
            part.clear()

        for entry in entries():
            part.append(entry)
            if len(part) == FILE_ENTRIES:
                flush()
        if part:
            flush()
        return UrlLists(tuple(names), tuple(sorted(lengths)))


def _hosts(host: str) -> list[str]:
    """A host and the hosts above it, from the longest."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def _judged(batches: Iterator[pa.RecordBatch], lists: UrlLists) -> Iterator[pa.RecordBatch]:
    files = [DigestFile(SparkFiles.get(name)) for name in lists.files]
    for batch in batches:
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        keys, owner, lengths, labels = [], [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for above in _hosts(host):
                keys.append(f"h{above}".encode())
                owner.append(i)
                lengths.append(-1)
                labels.append((len(above), ""))
                for n in lists.path_lengths:
                    if n <= len(path):
                        keys.append(f"r{above}{_BAR}{path[:n]}".encode())
                        owner.append(i)
                        lengths.append(len(above) + n)
                        labels.append((len(above), above + path[:n]))
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        found = np.full(len(keys), -1, np.int64)
        for file in files:
            found = np.maximum(found, file.find(keys, hashes))
        best: dict[int, tuple] = {}
        listed = set()
        for k in np.flatnonzero(found >= 0).tolist():
            if lengths[k] < 0:
                listed.add(owner[k])
            else:
                best[owner[k]] = max(best.get(owner[k], (-1,)), (lengths[k], labels[k][0], labels[k][1], int(found[k])))
        rule = [best[i][2] if i in best else None for i in range(len(hosts))]
        verdict = ["block" if (best[i][3] if i in best else i in listed) else "allow" for i in range(len(hosts))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])


def judged(pages: DataFrame, lists: UrlLists, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` and ``verdict`` of each row."""
    small_batches(pages.sparkSession, 5000)
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    source = pages.select(F.col(id_col).alias("id"), F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"))
    return source.mapInArrow(lambda batches: _judged(batches, lists), f"id {kind}, host string, path string, rule string, verdict string")
