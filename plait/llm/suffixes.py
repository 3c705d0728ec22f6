"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Two places repeat each other if the ``depth`` bytes from them are equal.  Sorting every
suffix would shuffle many times the text, so the first digit of the sort is an anchor:
every window of ``depth`` bytes holds a 32-byte gram of smallest hash (the leftmost if tied), which
depends on the window's bytes only, so equal windows share it at the same offset.

1.  ``anchors``: each run of windows with one anchor becomes a row: the gram's hash, a hash
    of the run's whole bytes, and its place.  Within a batch of rows all but the first place of equal runs are
    settled already, so a hot passage leaves one row a batch.
2.  ``settle``: rows of one gram meet.  A run equal to an earlier run repeats as a whole.
    Runs that share the gram but are not equal are open.
3.  ``contexts`` and ``radix_repeats``: the bytes of the open runs meet by gram; their
    suffixes are ordered by most-significant-digit passes of 8 bytes down to ``depth``,
    suffixes alone in their group leave at once, and the groups left after the last pass
    are exactly the repeated windows.  The windows of a gram with over ``OPEN_RUNS`` open runs
    are dealt by a 128-bit hash of their own instead, and the earliest found by a pre-aggregated minimum.
4.  ``remove``: the spans of a document meet its text.

Null texts count as empty, shorter texts than ``depth`` lose nothing.  Null ids come
after all others.  Rows of equal id are separate documents, ordered by the SHA-256 of the text; rows equal in
both do not remove each other and give equal results.  Other columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.common import materialize, salted_left_join

DEPTH = 100
GRAM = 32
#: Bytes looked at together; a longer text is taken in pieces.
PIECE_BYTES = 1 << 18
#: A gram with more open runs than this is dealt by window.
OPEN_RUNS = 4096
#: Suffixes sorted together, as far as grams allow.
SORTED = 1 << 19
_NO_ID = (1 << 63) - 1
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_BYTES = np.random.default_rng(576).integers(1, 1 << 63, 256).astype(np.uint64)
_PLACE = np.uint64((1 << 22) - 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[k]
    return h ^ (h >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, the first as the most significant; ``data`` has 7 bytes more than places."""
    w = data.astype(np.uint64)
    for size in (1, 2, 4):
        w = w[:-size] << np.uint64(8 * size) | w[size:]
    return w


class _Polynomial:
    """Hashes of byte ranges modulo 2^64 from one running sum."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTES, base: int = 0) -> None:
        n = len(data)
        powers = np.full(n + 1, _K[base], np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.undo = np.full(n + 1, np.uint64(pow(int(_K[base]), -1, 1 << 64)), np.uint64)
        self.undo[0] = 1
        self.undo = np.cumprod(self.undo, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.undo[start]


def _anchor_runs(data: np.ndarray, stops: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (``stops``: where each ends): text, first window, windows, anchor's place in the first window, gram hash, run hash."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(depth + GRAM + 8, np.uint8)])
    w = _words(wide)
    h = np.zeros(n + depth, np.uint64)
    for k, at in enumerate(range(0, GRAM, 8)):
        h = _mixed(h, k) + w[at : at + n + depth] * _K[k]
    h = _mixed(h, 1)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the smallest hash, then the leftmost
    width, span = depth - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.concatenate([[0], stops[:-1]])
    text = np.repeat(np.arange(len(stops)), stops - starts)
    at = np.flatnonzero(np.arange(n) + depth <= stops[text])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor, text = (least[at] & _PLACE).astype(np.int64), text[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    first, last = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    place, count = anchor[new] - first, last - first + 1
    whole = _Polynomial(data).ranges(first, last + depth)
    whole = _mixed(whole, 2) + (place * 128 + count).astype(np.uint64) * _K[3]
    return text[new], first - starts[text[new]], count, place, h[anchor[new]], whole


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _batch_anchors(column: pa.Array, depth: int) -> tuple[np.ndarray, ...]:
    """_anchor_runs of all rows of a batch, a piece at a time: row, first window, windows, place, gram, run."""
    data, offsets = _texts(column)
    out = []
    row = 0
    while row < len(column):
        stop = row + 1
        while stop < len(column) and offsets[stop + 1] - offsets[row] <= PIECE_BYTES:
            stop += 1
        a, z = int(offsets[row]), int(offsets[stop])
        if z - a <= PIECE_BYTES:
            found = _anchor_runs(data[a:z], offsets[row + 1 : stop + 1] - a, depth)
            out.append((found[0] + row, *found[1:]))
        else:  # one long text: pieces that overlap so that each window is in one of them
            for k in range(a, z, PIECE_BYTES):
                part = data[k : min(k + PIECE_BYTES + depth - 1, z)]
                found = _anchor_runs(part, np.array([len(part)]), depth)
                out.append((found[0] + row, found[1] + (k - a), *found[2:]))
        row = stop
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else _anchor_runs(data[:0], np.zeros(0, np.int64), depth)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id (nulls last), tie (a number of the text among the different ones of its id) and the text's bytes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), whole.cast("binary").alias("data"))
    known = rows.select("id", F.sha2("data", 256).alias("digest"))
    repeated = known.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("id")
    if repeated.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("tie"), "data")
    number = F.row_number().over(Window.partitionBy("id").orderBy("digest")).cast("long")
    ties = materialize(known.join(repeated, "id", "left_semi").distinct().select("id", "digest", number.alias("tie")), "ties")
    if ties.filter(F.col("tie") >= 1 << 24).limit(1).count():
        raise ValueError("one id has over 2^24 different texts")
    return rows.withColumn("digest", F.sha2("data", 256)).join(ties, ["id", "digest"], "left").select("id", F.coalesce("tie", F.lit(0)).alias("tie"), "data")


# place: tie, first window and number of windows in one long that orders places within an id; below zero: settled
def _place(tie: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return tie << 39 | first << 7 | count


def anchors(keyed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, run, id, place of every run of windows; of equal runs in a batch all but the first come as settled (place complemented, gram spread)."""

    def batches(it):
        for b in it:
            row, first, count, _, gram, run = _batch_anchors(b.column(2), depth)
            ids, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            place, ids = _place(ties[row], first, count), ids[row]
            order = np.lexsort((place, ids, run, gram))
            place, ids, run, gram = place[order], ids[order], run[order].view(np.int64), gram[order].view(np.int64)
            again = np.zeros(len(ids), bool)
            again[1:] = (gram[1:] == gram[:-1]) & (run[1:] == run[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(ids))))
            same = again & (ids == ids[head]) & (place == place[head])  # a repeated row's own place
            gram = np.where(again, _mixed(ids.view(np.uint64) + place.view(np.uint64), 0).view(np.int64), gram)
            place = np.where(again, ~place, place)
            keep = ~same
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (gram, run, ids, place)], names=["gram", "run", "id", "place"])

    return keyed.mapInArrow(batches, "gram long, run long, id long, place long")


def settle(runs: DataFrame, open_runs: int = OPEN_RUNS) -> DataFrame:
    """id, place, gram, kind: 0 a run that repeats as a whole, 1 an open run, 2 an open run of a gram with many."""
    dealt = runs.repartition("gram").sortWithinPartitions("gram", "run", "id", "place")

    def judged(c: list[np.ndarray]) -> pa.RecordBatch:
        gram, run, ids, place = c
        done = place < 0
        spans = [(ids[done], ~place[done], np.zeros(int(done.sum()), np.int64), np.zeros(int(done.sum()), np.int32))]
        gram, run, ids, place = (x[~done] for x in c)
        if len(gram):
            n = np.arange(len(gram))
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new_run = new_gram | np.concatenate([[True], run[1:] != run[:-1]])
            head = np.maximum.accumulate(np.where(new_run, n, 0))
            repeat = ~new_run & ~((ids == ids[head]) & (place == place[head]))
            of_gram = np.cumsum(new_gram) - 1
            different = np.bincount(of_gram, new_run)[of_gram]
            still = new_run & (different > 1)
            spans.append((ids[repeat], place[repeat], np.zeros(int(repeat.sum()), np.int64), np.zeros(int(repeat.sum()), np.int32)))
            spans.append((ids[still], place[still], gram[still], np.where(different[still] > open_runs, 2, 1).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*spans, strict=True)], names=["id", "place", "gram", "kind"])

    def batches(it):
        held: list[np.ndarray] | None = None
        for b in it:
            c = [x.to_numpy() for x in b.columns]
            if held is not None:
                c = [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)]
            ends = np.flatnonzero(c[0][1:] != c[0][:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last gram may go on
            if cut:
                yield judged([x[:cut] for x in c])
            held = [x[cut:] for x in c]
        if held is not None:
            yield judged(held)

    return dealt.mapInArrow(batches, "id long, place long, gram long, kind int")


def packed(keyed: DataFrame) -> DataFrame:
    """id, tie and the text compressed, for a shuffle."""

    def batches(it):
        z = zstandard.ZstdCompressor(level=1)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(x.as_py()) for x in b.column(2)], pa.binary())], names=["id", "tie", "packed"])

    return keyed.mapInArrow(batches, "id long, tie long, packed binary")


def _with_texts(keyed: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Texts beside the list of their places; one row a document, equal rows once."""
    lists = places.groupBy("id", F.shiftright("place", 39).alias("tie")).agg(F.collect_list(F.struct(*(c for c in places.columns if c != "id"))).alias("places"))
    texts = packed(keyed)
    return texts.join(lists, ["id", "tie"], how)


def contexts(keyed: DataFrame, opened: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The bytes of each open run: gram, id, place, data."""

    def batches(it):
        z = zstandard.ZstdDecompressor()
        for b in it:
            grams, ids, places, parts = [], [], [], []
            for k in range(b.num_rows):
                text = z.decompress(b.column(2)[k].as_py())
                for p in b.column(3)[k].as_py():
                    first, count = p["place"] >> 7 & 0xFFFFFFFF, p["place"] & 127
                    grams.append(p["gram"])
                    places.append(p["place"])
                    parts.append(text[first : first + count - 1 + depth])
                ids += [b.column(0)[k].as_py()] * (len(grams) - len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(parts, pa.binary())], names=["gram", "id", "place", "data"])

    return _with_texts(keyed, opened, "inner").mapInArrow(batches, "gram long, id long, place long, data binary")


def equal_groups(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes ``at`` (places in ``words``), within ``group``, down to ``depth`` bytes.

    Gives the places that are left, ordered, and a number a group of equal windows of two members or more.
    """
    for k in range(0, depth, 8):
        digit = words[at + min(k, depth - 8)]
        order = np.lexsort((at, digit, group))
        at, digit, group = at[order], digit[order], group[order]
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])])
        number = np.cumsum(new) - 1
        left = np.bincount(number)[number] > 1
        at, group = at[left], number[left]
        if not len(at):
            break
    return at, group


def radix_repeats(opened: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, place (of one or more windows) of the windows in open runs that occur earlier in another one."""
    dealt = opened.repartition("gram").sortWithinPartitions("gram", "id", "place")

    def judged(gram: np.ndarray, ids: np.ndarray, place: np.ndarray, column: pa.Array) -> pa.RecordBatch:
        data, offsets = _texts(column)
        base = int(offsets[0])
        data, offsets = data[base : int(offsets[-1])], offsets - base
        first, count = place >> 7 & 0xFFFFFFFF, place & 127
        words = _words(np.concatenate([data, np.zeros(8, np.uint8)]))
        row = np.repeat(np.arange(len(gram)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[row] + step
        number = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))[row]
        left, group = equal_groups(words, at, number, depth)
        if len(left):
            # suffixes are laid out by id and place within a gram, so the first of a group is the earliest
            left_row = np.searchsorted(offsets, left, side="right") - 1
            head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(left)), 0))
            where = _place(place[left_row] >> 39, first[left_row] + left - offsets[left_row], np.ones(len(left), np.int64))
            later = (ids[left_row] != ids[left_row][head]) | (where != where[head])
            left_ids, where = ids[left_row][later], where[later]
        else:
            left_ids = where = np.zeros(0, np.int64)
        return _joined(left_ids, where)

    def batches(it):
        held: list[pa.RecordBatch] = []
        for b in it:
            gram = b.column(0).to_numpy()
            ends = np.flatnonzero(gram[1:] != gram[:-1])
            if held and sum(h.num_rows for h in held) * 64 > SORTED and b.num_rows:
                last = held[-1].column(0)[-1].as_py()
                cut = 0 if gram[0] != last else int(ends[0]) + 1 if len(ends) else None
                if cut is not None:
                    yield judge([*held, b.slice(0, cut)])
                    held, b = [], b.slice(cut)
            if b.num_rows:
                held.append(b)
        if held:
            yield judge(held)

    def judge(held):
        t = pa.Table.from_batches(held).combine_chunks()
        c = [x.chunk(0) if x.num_chunks else x.combine_chunks() for x in t.columns]
        return judged(c[0].to_numpy(), c[1].to_numpy(), c[2].to_numpy(), c[3])

    return dealt.mapInArrow(batches, "id long, place long")


def _joined(ids: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Windows that follow each other in a document as one place of up to 127 windows."""
    order = np.lexsort((place, ids))
    ids, place = ids[order], place[order]
    if len(ids):
        step = np.concatenate([[True], (ids[1:] != ids[:-1]) | (place[1:] >> 7 != (place[:-1] >> 7) + 1)])
        run = np.cumsum(step) - 1
        inside = np.arange(len(ids)) - np.flatnonzero(step)[run]
        new = step | (inside % 127 == 0)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([heads, [len(ids)]]))
        ids, place = ids[heads], place[heads] - (place[heads] & 127) + sizes
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place)], names=["id", "place"])


def hashed_repeats(opened: DataFrame, depth: int = DEPTH) -> DataFrame:
    """As radix_repeats for grams with very many open runs: each window is dealt by a 128-bit hash of its bytes."""

    def batches(it):
        other = np.random.default_rng(901).integers(1, 1 << 63, 256).astype(np.uint64)
        for b in it:
            for k in range(b.num_rows):
                data = np.frombuffer(b.column(3)[k].as_py(), np.uint8)
                place = b.column(2)[k].as_py()
                n = place & 127
                start = np.arange(n)
                pair = [_mixed(p.ranges(start, start + depth), 2).view(np.int64) for p in (_Polynomial(data), _Polynomial(data, other, 2))]
                where = place - n + 1 + (start << 7)
                yield pa.RecordBatch.from_arrays([*(pa.array(p) for p in pair), pa.array([b.column(1)[k].as_py()] * n, pa.int64()), pa.array(where.astype(np.int64))], names=["a", "b", "id", "place"])

    windows = opened.mapInArrow(batches, "a long, b long, id long, place long")
    windows = windows.withColumn("key", F.struct("a", "b")).drop("a", "b")
    least = windows.groupBy("key").agg(F.min(F.struct("id", "place")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return salted_left_join(windows, least, "key", "place").filter("least is not null and (id <> least.id or place <> least.place)").select("id", "place")


def repeated_places(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, open_runs: int = OPEN_RUNS) -> DataFrame:
    """id (null ids as the largest long), place of all repeated windows but the earliest of each."""
    if not GRAM + 8 <= depth <= GRAM + 126:
        raise ValueError("depth must be from 40 to 158 bytes")
    keyed = _keyed(docs, key, text)
    known = materialize(settle(anchors(keyed, depth), open_runs), "settled")
    few = contexts(keyed, known.filter("kind = 1").select("id", "place", "gram"), depth)
    out = known.filter("kind = 0").select("id", "place").unionByName(radix_repeats(few, depth))
    if known.filter("kind = 2").limit(1).count():
        many = contexts(keyed, known.filter("kind = 2").select("id", "place", "gram"), depth)
        out = out.unionByName(hashed_repeats(many, depth))
    return out


def merged(places: list[int], depth: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for p in sorted(x & (1 << 39) - 1 for x in places):
        a, n = p >> 7, p & 127
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - 1 + depth))
        else:
            out.append((a, a + n - 1 + depth))
    return out


def _cut(keyed: DataFrame, places: DataFrame, depth: int, finish, schema: str, names: list[str]) -> DataFrame:
    def batches(it):
        z = zstandard.ZstdDecompressor()
        for b in it:
            rows = []
            for k in range(b.num_rows):
                text = z.decompress(b.column(2)[k].as_py())
                found = b.column(3)[k].as_py() or []
                rows.append((b.column(0)[k].as_py(), *finish(text, merged([p["place"] for p in found], depth))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=names)

    return _with_texts(keyed, places, "left").mapInArrow(batches, schema)


def removal_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, open_runs: int = OPEN_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left of every document."""

    def finish(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
        left, at = hashlib.sha256(), 0
        for a, z in spans:
            left.update(data[at:a])
            at = z
        left.update(data[at:])
        return len(data), sum(z - a for a, z in spans), len(spans), left.hexdigest()

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = _cut(_keyed(docs, key, text), repeated_places(docs, key, text, depth, open_runs), depth, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", names)
    return found.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), *names[1:])


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``key`` and the text that is left, with the removed spans (start, stop) in bytes; a character cut in two gives U+FFFD."""

    def finish(data: bytes, spans: list[tuple[int, int]]) -> tuple[str, list]:
        parts, at = [], 0
        for a, z in spans:
            parts.append(data[at:a])
            at = z
        return b"".join([*parts, data[at:]]).decode("utf-8", "replace"), [{"start": a, "stop": z} for a, z in spans]

    found = _cut(_keyed(docs, key, text), repeated_places(docs, key, text, depth), depth, finish, "id long, text string, spans array<struct<start:long,stop:long>>", ["id", "text", "spans"])
    return found.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(key), F.col("text").alias(text), "spans")
