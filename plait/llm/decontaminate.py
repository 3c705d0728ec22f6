"""Benchmark decontamination by greedy string tiling.

A document and an item that share a seed (``SEED`` consecutive tokens; all of them for a
shorter item) are tiled: the longest common run of unmarked tokens, found by comparing
running Karp-Rabin hashes at lengths halved towards it and verified token by token, is
marked on both sides, again and again, down to the seed's length.  An item whose marked
share reaches ``COVERAGE`` is contained in the document, in whatever order its parts
stand.

The benchmark is the stated query set.  Its size is checked: it goes to the workers in
blocks of at most about ``BLOCK_BYTES``, each of which sees all documents.

Tokens are runs of word characters, lower-cased.  Null and empty texts and items share
nothing.  A repeated document gives its rows again; a repeated item (equal id and text)
counts once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 5
COVERAGE = 0.6
BLOCK_BYTES = 32 << 20
_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Running:
    """Karp-Rabin hashes of every window of a token sequence, by differences of one running sum (modulo 2^64)."""

    def __init__(self, ids: np.ndarray) -> None:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(_BASE, len(ids)), dtype=np.uint64)])
        self.undo = _powers(_INVERSE, len(ids) + 1)

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.undo[:n]


def _free(blocked: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` hold no blocked token."""
    sums = np.concatenate([[0], np.cumsum(blocked)])
    return sums[size:] == sums[: len(sums) - size]


def _common(a: Running, b: Running, x: np.ndarray, y: np.ndarray, used_x: np.ndarray, used_y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in x of windows free on both sides that occur in y, and the first such start in y; hashes are verified."""
    at_x, at_y = np.flatnonzero(_free(used_x, size)), np.flatnonzero(_free(used_y, size))
    hx, hy = a.windows(size)[at_x], b.windows(size)[at_y]
    values, first = np.unique(hy, return_index=True)
    if not len(values):
        return at_x[:0], at_y[:0]
    place = np.minimum(np.searchsorted(values, hx), len(values) - 1)
    same = values[place] == hx
    at_x, at_y = at_x[same], at_y[first[place[same]]]
    true = np.array([(x[i : i + size] == y[j : j + size]).all() for i, j in zip(at_x, at_y, strict=True)], bool)
    return at_x[true], at_y[true]


def tile(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in x, start in y, length) of the greedy tiling; ids below zero match nothing."""
    a, b = Running(x), Running(y)
    used_x, used_y, out = x < 0, y < 0, []
    low, high = least, min(len(x), len(y))
    while True:
        # longest common free run: common at a length means common at all smaller ones
        small, large = low - 1, high
        while small < large:
            half = (small + large + 1) // 2
            if len(_common(a, b, x, y, used_x, used_y, half)[0]):
                small = half
            else:
                large = half - 1
        if small < low:
            return out
        high = small
        for i, j in zip(*_common(a, b, x, y, used_x, used_y, high), strict=True):
            if not used_x[i : i + high].any() and not used_y[j : j + high].any():
                out.append((int(i), int(j), high))
                used_x[i : i + high] = used_y[j : j + high] = True


class Items:
    """A block of the benchmark, ready to search for."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        for item, text in rows:
            if words := tokens(text):
                self.ids.append(item)
                self.texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, x in enumerate(self.texts):
            size = min(SEED, len(x))
            seeds.setdefault(size, []).append((Running(x).windows(size), k))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, found in seeds.items():
            keys = np.concatenate([h for h, _ in found])
            owner = np.concatenate([np.full(len(h), k) for h, k in found])
            order = np.argsort(keys, kind="stable")
            self.seeds[size] = keys[order], owner[order]

    def contained(self, text: str | None, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item id, covered share, covered tokens, tiles) of the items that ``text`` contains."""
        words = tokens(text)
        get = self.vocabulary.get
        y = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hits: dict[int, list[np.ndarray]] = {}
        for size, (keys, owner) in self.seeds.items():
            at = np.flatnonzero(_free(y < 0, size)) if len(y) >= size else y[:0]
            if not len(at):
                continue
            h = Running(y).windows(size)[at]
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            for p, a, z in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for k in set(owner[a:z].tolist()):
                    hits.setdefault(k, []).append(np.arange(p, p + size))
        out = []
        for k, found in sorted(hits.items()):
            x = self.texts[k]
            near = np.unique(np.concatenate(found))
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            part = np.insert(y[near], gaps, -1)  # no match reaches beyond the seeds it consists of
            tiles = tile(x, part, min(SEED, len(x)))
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(x):
                out.append((self.ids[k], covered / len(x), covered, len(tiles)))
        return out


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[Items]:
    """The benchmark in blocks of a checked size; one block comes to the driver at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        out.append(Items(sorted({(r["i"], r["t"]) for r in part.toLocalIterator()}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))))
    return out


FOUND = "item_id long, coverage double, n_covered long, n_tiles long"


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item it contains: ``key`` and FOUND."""
    slim = docs.select(key, F.col(text).alias("_text"))
    kind = {"long": F.lit(0).cast("long"), "double": F.lit(0.0)}
    schema = slim.select(key, *(kind[x.split()[1]].alias(x.split()[0]) for x in FOUND.split(", "))).schema
    out = None
    for items in blocks(benchmark):

        def batches(it, items=items):
            for b in it:
                rows, at = [], []
                for k, t in enumerate(b.column(1)):
                    for r in items.contained(t.as_py(), coverage):
                        rows.append(r)
                        at.append(k)
                cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

        found = slim.mapInArrow(batches, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows that contain no item, columns unchanged."""
    for items in blocks(benchmark):

        def batches(it, items=items):
            for b in it:
                clean = [not items.contained(t.as_py(), coverage) for t in b.column(b.schema.get_field_index(text))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(batches, docs.schema)
    return docs
