"""Near-duplicate passages by compact windows.

Tokens are hashes of shingles of ``SHINGLE`` words.  For each of ``HASHES`` hash
functions the Cartesian tree of a text's token hashes, cut where a node spans fewer than
``least`` tokens, gives its compact windows (l, c, r): every passage of at least ``least``
tokens between l and r that holds c has c's hash as its min-hash.  Windows of equal
min-hash meet, and links among them are found without comparing all of them with each other:

1.  ``meetings``: each window is paired with the first one of its min-hash, up to FEW windows all with
    each other (a frequent min-hash is dealt over salted parts, whose first windows meet in turn).
2.  ``verified_links``: of the window pairs of two texts those are kept that no other one holds as
    a whole on both sides (an interval join on the pair); the words of both windows are compared:
    stretches of ``least`` tokens or more whose token sets have a Jaccard similarity of
    ``similarity`` or more are links.
3.  ``unsettled``: of min-hashes with more windows than step 1 compares, those are taken up whose
    texts are still in several classes.
4.  ``contexts`` and ``context_links``: the tokens around each such centre meet by min-hash.  Equal
    contexts are one; of the others the counts of shared tokens (a product of 0/1 matrices) tell
    all pairs that can hold two similar stretches of ``least`` tokens; those of different classes are compared,
    the one with most partners first, and give the links of a spanning forest.

So no two classes that meet at a min-hash go uncompared, and ``class_id`` is that of all links, found
with rows in proportion to the windows.  ``passages`` are the stretches that were verified on the way.

Rows of equal texts are one node: a text is known by its 64-bit hash, and its smallest id
stands for it.  Null texts count as empty and texts under ``WORDS`` words are in no
class.  Null ids come after all others in the smallest id and return as they are.  A long text is looked
at in one piece; ties (equal hashes in a text) each have a window of their own.  Other columns are not returned.

Shingles that many texts share come last in every order, so that a passage is met by what else it
holds.  A stretch with so few others that a similar one need not share any of them is also met by its
frequent shingles; where a similar one must share some, but the min-hashes alone would miss it
too often, each of the others is a key of its own.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.common import materialize, runs, salted_left_join
from plait.llm.simhash import components

SHINGLE = 5
#: Words of the shortest passage, and the similarity of two passages.
WORDS = 50
SIMILARITY = 0.8
HASHES = 4
#: Shares of shared tokens at which stretches are looked for, looser than what may stand.
LEVELS = (0.5, 0.75)
#: A shingle that more than SHARED of each SAMPLE texts share is frequent.
SHARED = 8
SAMPLE = 20_000
#: Shingles, and rows, that are counted together before their candidates are known.
CHUNK_TOKENS = 1 << 22
CHUNK_ROWS = 8000
#: Counters of each row of the sketch that the candidates come from, as a power of two.
SKETCH_BITS = 22
#: Share of frequent shingles in the shortest passage from which on each other one is a key.
HEAVY = 0.5
#: Texts that one copy of a text is verified against.
LEADS = 64
#: Parts over which the windows of a frequent min-hash are dealt.
PARTS = 16
#: Contexts of one min-hash that are compared in one task; more are dealt over blocks of two buckets of as many.
CROWD = 4096
#: Contexts whose shared tokens are counted at a time.
TILE = 256
#: Rows of a min-hash that ``meetings`` compares all with each other.
FEW = 3
#: Texts remembered to skip their repetitions.
CACHED_TEXTS = 1 << 20
#: Different links whose classes are found by one task; more take the rounds of ``components``.
LINKS_AT_ONCE = 1 << 21
_NO_ID = (1 << 63) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_ARM = (1 << 17) - 1
#: Hashes are compared without their last bits, which hold the place while minima are looked for.
_PLACE = np.uint64((1 << 20) - 1)
#: Tokens looked at together; a longer text goes through the tree itself.
PIECE_TOKENS = 1 << 15


def split_words(text: str | bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z as a-z."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return data.lower().split()


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
#: Bytes of a text looked at together, and powers of one factor and of its inverse modulo 2^64.
PIECE_BYTES = 1 << 20


def _powers(factor: int) -> np.ndarray:
    out = np.full(PIECE_BYTES + 1, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(int(_MIX[3])), _powers(pow(int(_MIX[3]), -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each of ``split_words``, from one running sum over the bytes."""
    out, at = [], 0
    while at < len(data):
        part = np.frombuffer(data, np.uint8, min(PIECE_BYTES, len(data) - at), at)
        space = _SPACE[part]
        if at + len(part) < len(data):  # the last word goes to the next piece; a word longer than one is cut
            cut = int(np.flatnonzero(space)[-1]) + 1 if space.any() else len(part)
            part, space = part[:cut], space[:cut]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        start, stop = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        out.append((sums[stop] - sums[start]) * _DOWN[start] ^ (stop - start).astype(np.uint64))
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: bytes | str | list[bytes]) -> np.ndarray:
    """One hash a shingle of a text's words; none for fewer words than a shingle has."""
    return _of_words(word_hashes(b" ".join(words) if isinstance(words, list) else words.encode("utf-8", "surrogatepass") if isinstance(words, str) else words))


def _of_words(ids: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a sequence of words' hashes."""
    n = len(ids) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    ids = (ids ^ (ids >> np.uint64(32))) * _MIX[1]
    ids ^= ids >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ ids[k : k + n]) * _MIX[k % 4]
        h ^= h >> np.uint64(29)
    return h


def shingles_together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of many texts laid end to end, and where each one's stop."""
    if len(texts) == 1 or sum(map(len, texts)) + len(texts) > PIECE_BYTES:
        each = [shingle_hashes(t) for t in texts]
        return np.concatenate(each), np.cumsum([len(t) for t in each])
    whole = b" ".join(texts)
    part = np.frombuffer(whole, np.uint8)
    space = _SPACE[part]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, stop = edges[::2], edges[1::2]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
    ids = (sums[stop] - sums[start]) * _DOWN[start] ^ (stop - start).astype(np.uint64)
    last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))  # words up to the end of each text
    n_words = np.diff(np.concatenate([[0], last]))
    h = _of_words(ids)
    own = np.arange(len(h)) + SHINGLE <= np.repeat(last, n_words)[: len(h)]  # of one text only
    return h[own], np.cumsum(np.maximum(n_words - SHINGLE + 1, 0))


def in_groups(texts, size: int = 1 << 17):
    """Lists of (place, text) of at most ``size`` bytes together, or of one text."""
    group, held = [], 0
    for k, t in texts:
        if group and held + len(t) + 1 > size:
            yield group
            group, held = [], 0
        group.append((k, t))
        held += len(t) + 1
    if group:
        yield group


def each_shingles(texts):
    """(place, ``shingle_hashes``) of (place, text)."""
    for group in in_groups(texts):
        tokens, stops = shingles_together([t for _, t in group])
        begin = 0
        for (k, _), stop in zip(group, stops.tolist(), strict=True):
            yield k, tokens[begin:stop]
            begin = stop


def narrow(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token, on which texts are compared."""
    return (tokens >> np.uint64(32)).astype(np.uint32)


def min_hashes(tokens: np.ndarray, function: int) -> np.ndarray:
    h = (tokens + _MIX[0] * np.arange(function + 1, function + 2, dtype=np.uint64)) * _MIX[1]
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(29))


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r), both ends included, of the Cartesian tree's nodes of ``least`` tokens or more; equal minima of a node make one window."""
    out, todo = [], [(0, len(hashes) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 < least:
            continue
        part = hashes[lo : hi + 1]
        c = int(part.argmin())
        out.append((lo, lo + c, hi))
        rest = part[c + 1 :]
        if len(rest) and rest.min() == part[c]:
            ties = [c, *(np.flatnonzero(rest == part[c]) + c + 1).tolist()]
            edges = [-1, *ties, len(part)]
            todo += [(lo + a + 1, lo + z - 1) for a, z in zip(edges, edges[1:], strict=False) if z - a - 1 >= least]
        else:
            todo += [(lo, lo + c - 1), (lo + c + 1, hi)]
    return out


def tree_nodes(hashes: np.ndarray, stops: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The same nodes for many texts laid end to end, all at once: text, l, c, r (places from the text's start).

    A node of ``least`` tokens or more is the minimum of some stretch of just that length, and its span ends
    before the nearest smaller hash on either side, which is found by doubling steps over range minima.  Of equal
    minima each but the first has a node of its own, from the one before on.
    """
    n = len(hashes)
    starts = np.concatenate([[0], stops[:-1]])
    text = np.repeat(np.arange(len(stops)), stops - starts)
    h = hashes & ~_PLACE
    levels = [h]  # levels[k][i]: minimum of the 2^k hashes from i on
    while 2 ** len(levels) <= int((stops - starts).max(initial=1)):
        half, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[: len(last) - half], last[half:]))
    at = np.flatnonzero(np.arange(n) + least <= stops[text])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    placed = h | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= least:
        placed = np.minimum(placed[: len(placed) - span], placed[span:])
        span *= 2
    if span < least:
        placed = np.minimum(placed[: len(placed) - (least - span)], placed[least - span :])
    c = np.unique((placed[at] & _PLACE).astype(np.int64))
    own, first, stop = h[c], starts[text[c]], stops[text[c]]
    lo, hi = c.copy(), c + 1
    for k in range(len(levels) - 1, -1, -1):
        level, step = levels[k], 1 << k
        down = lo - step
        ok = down >= first
        ok[ok] = level[down[ok]] > own[ok]
        lo = np.where(ok, down, lo)
        ok = hi + step <= stop
        ok[ok] = level[hi[ok]] >= own[ok]
        hi = np.where(ok, hi + step, hi)
    return text[c], lo - first, c - first, hi - 1 - first


def _packed(function: int, lo: np.ndarray, c: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash function, centre and arms in one long (arms beyond 2^17 tokens are cut short)."""
    return np.int64(function << 60) | c << 34 | np.minimum(c - lo, _ARM) << 17 | np.minimum(hi - c, _ARM)


def _ends(loc: int) -> tuple[int, int, int]:
    c = loc >> 34 & (1 << 26) - 1
    return c - (loc >> 17 & _ARM), c, c + (loc & _ARM)


def _slots(tokens: np.ndarray) -> list[np.ndarray]:
    """The counter of each token in each row of the sketch: other bits of its hash for each."""
    return [(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), (tokens * _MIX[1] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def crowded(some: DataFrame, limit: float) -> np.ndarray:
    """Which counters of a sketch of two rows are over ``limit`` when the shingles of all rows are added; a shingle that more texts have lies in such a one in both rows.

    Each task adds up its rows and gives its counters once, whatever they hold.
    """
    block = 1 << SKETCH_BITS - 6
    kinds = {k * block: t for k, t in ((1, np.uint8), (2, np.uint16), (4, np.uint32), (8, np.int64))}

    def add(it):
        counts = [np.zeros(1 << SKETCH_BITS, np.int64) for _ in range(2)]
        seen: set[int] = set()
        held, size = [], 0
        for b in it:
            if len(seen) > CACHED_TEXTS:  # repeated rows are added again then, which makes the counters no smaller
                seen.clear()
            fresh = _unseen(b.column(0), seen)
            for group in in_groups(_bytes(b.column(1), fresh)):
                held.append(shingles_together([t for _, t in group])[0])
                size += len(held[-1])
                if size > CHUNK_TOKENS:
                    _add_up(counts, held)
                    held, size = [], 0
        _add_up(counts, held)
        pack = zstandard.ZstdCompressor(level=1)
        for row, c in enumerate(counts):
            for k in range(64):
                part = c[k * block : (k + 1) * block]
                kind = next(t for t in kinds.values() if part.max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([row << 6 | k], pa.int32()), pa.array([pack.compress(part.astype(kind).tobytes())], pa.binary())], names=["block", "packed"])

    def total(it):
        unpack = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = unpack.decompress(packed)
                sums[k] = sums.get(k, 0) + np.frombuffer(data, kinds[len(data)]).astype(np.int64)
        packed = [np.packbits(c > limit).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["block", "over"])

    found = some.mapInArrow(add, "block int, packed binary").repartition("block").mapInArrow(total, "block int, over binary").toArrow()
    out = np.zeros((2, 1 << SKETCH_BITS), bool)
    for k, over in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        at = (k & 63) * block
        out[k >> 6, at : at + block] = np.unpackbits(np.frombuffer(over, np.uint8)).astype(bool)
    return out


def _add_up(counts: list[np.ndarray], held: list[np.ndarray]) -> None:
    if held:
        for c, at in zip(counts, _slots(np.concatenate(held)), strict=True):
            c += np.bincount(at, minlength=len(c))


def _unseen(texts: pa.Array, seen: set[int]) -> list[int]:
    """Places of the text hashes that are new."""
    out = []
    for k, th in enumerate(texts.to_pylist()):
        if th not in seen:
            seen.add(th)
            out.append(k)
    return out


def _bytes(column: pa.Array, places: list[int]):
    """(place, UTF-8) of some of a column's texts."""
    data = column.cast(pa.large_binary())
    return ((k, data[k].as_py()) for k in places)


def frequent_shingles(keyed: DataFrame, n_rows: int, copied: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that more different texts have than SHARED of each SAMPLE rows, or than SHARED of fewer rows; counted on all rows.

    Candidates are the shingles whose counters in a sketch of all rows are over the limit, which all that are over it have; these
    are counted on a second pass.  ``copied`` has the hashes of the texts of several rows.
    """
    limit = SHARED * max(1.0, n_rows / SAMPLE)
    some = keyed.select("text", "data")
    # a task of few rows gives as many counters as any, so small partitions are read together
    over = crowded(some.coalesce(max(1, n_rows // CHUNK_ROWS)), limit)
    several = np.zeros(1 << 20, bool)
    several[copied.select(F.pmod("text", F.lit(1 << 20)).alias("h")).distinct().toArrow().column(0).to_numpy()] = True
    sent = keyed.sparkSession.sparkContext.broadcast((np.packbits(over, axis=1), several))
    names = ["slot", "text", "tokens", "n"]

    def rows(text: int | None, tokens: np.ndarray, n: np.ndarray | None) -> list[tuple]:
        """Sorted tokens by slot."""
        slot = (tokens >> np.uint64(58)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(tokens)] if len(tokens) else [0]
        return [(int(slot[a]), text, tokens[a:z].tobytes(), None if n is None else n[a:z].tobytes()) for a, z in zip(edges, edges[1:], strict=False)]

    def made(out: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    def hits(it):
        packed, several = sent.value
        first, second = np.unpackbits(packed, axis=1).astype(bool)
        seen: set[int] = set()
        held, size = [], 0
        for b in it:
            if len(seen) > CACHED_TEXTS:
                seen.clear()
            ids = b.column(0).to_numpy(zero_copy_only=False)
            again = several[ids % (1 << 20)]  # perhaps of several rows: named, so that it counts once
            single = np.flatnonzero(~again).tolist()
            out: list[tuple] = []
            for places in (single, [k for k in _unseen(b.column(0), seen) if again[k]]):
                for group in in_groups(_bytes(b.column(1), places)):
                    tokens, stops = shingles_together([t for _, t in group])
                    at = np.flatnonzero(first[_slots(tokens)[0]])
                    at = at[second[_slots(tokens[at])[1]]]
                    tokens, text = tokens[at], np.searchsorted(stops, at, "right")
                    order = np.lexsort((tokens, text))
                    tokens, text = tokens[order], text[order]
                    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])])[: len(tokens)]
                    tokens, text = tokens[new], text[new]
                    if places is single:
                        held.append(tokens)
                        size += len(tokens)
                        continue
                    for t, part in zip(*_cut(text, tokens), strict=True):
                        out += rows(int(ids[group[t][0]]), part, None)
            if out:
                yield made(out)
            if size > CHUNK_TOKENS:
                yield made(rows(None, *np.unique(np.concatenate(held), return_counts=True)))
                held, size = [], 0
        if size:
            yield made(rows(None, *np.unique(np.concatenate(held), return_counts=True)))

    def count(it):
        def over(held):
            tokens, n = (np.concatenate(c) for c in zip(*held, strict=True))
            tokens, place = np.unique(tokens, return_inverse=True)
            return tokens, np.bincount(place, n).astype(np.int64)

        own, last, held, size = None, None, [], 0
        for b in it:
            for slot, text, tokens, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if slot != own:
                    if held:
                        yield known(*over(held))
                    own, last, held, size = slot, None, [], 0
                if text is not None and text == last:  # another row of the text
                    continue
                last = text
                found = np.frombuffer(tokens, np.uint64)
                held.append((found, np.frombuffer(n, np.int64) if n is not None else np.ones(len(found), np.int64)))
                size += len(found)
                if size > CHUNK_TOKENS:
                    held = [over(held)]
                    size = 0
        if held:
            yield known(*over(held))

    def known(tokens, n):
        return pa.RecordBatch.from_arrays([pa.array(tokens[n > limit].view(np.int64))], names=["token"])

    met = some.mapInArrow(hits, "slot int, text long, tokens binary, n binary").repartition("slot").sortWithinPartitions("slot", "text")
    return np.sort(met.mapInArrow(count, "token long").toArrow().column(0).to_numpy().view(np.uint64))


def _cut(text: np.ndarray, tokens: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The texts and the tokens of each."""
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    return text[heads].tolist(), np.split(tokens, heads[1:]) if len(text) else []


def _member(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


#: side: the part plus 1 (0 for the usual min-hashes) in 8 bits, above them 4 bits each of the NEXT tokens on either side of the centre.
WINDOW = "key long, side int, text long, loc long"
NEXT = 2


def windows(keyed: DataFrame, least: int, similarity: float = SIMILARITY, hashes: int = HASHES, frequent: np.ndarray | None = None) -> DataFrame:
    """WINDOW rows of (text hash, text).

    Frequent shingles come after all others in each order, so a window's centre is one of the others if the window has any.
    Two similar sets of ``least`` tokens differ by ``spare`` at most.  Where ``least`` tokens have no more others than that,
    the windows of the plain order that have a frequent centre are added; they are dealt over parts by text, the others are of
    none.  Where they have more, but HEAVY or more are frequent, the others are keys of their own.
    """
    known = keyed.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if frequent is None else frequent)
    spare = least - int(np.ceil(2 * least * similarity / (1 + similarity)))
    reach = int(least / similarity)

    def nodes(h: np.ndarray, stops: np.ndarray):
        if len(h) <= int(_PLACE):
            return tree_nodes(h, stops, least)
        lo, c, hi = np.array(compact_windows(h & ~_PLACE, least)).reshape(-1, 3).T
        return np.zeros(len(c), np.int64), lo, c, hi

    def found(part: list[tuple[int, np.ndarray]]):
        """Keys, whether they are frequent, the tokens beside, texts and packed windows of some texts' tokens."""
        whole, ids = np.concatenate([t for _, t in part]), np.array([k for k, _ in part])
        stops = np.cumsum([len(t) for _, t in part])
        starts = np.concatenate([[0], stops[:-1]])
        hot = _member(whole, known.value)
        beside = np.zeros(len(whole), np.int32)
        for k, step in enumerate((*range(-NEXT, 0), *range(1, NEXT + 1))):  # of tokens beyond the text's end: 0
            at = np.arange(len(whole)) + step
            there = (at >= np.repeat(starts, stops - starts)) & (at < np.repeat(stops, stops - starts))
            beside[there] |= ((whole[at[there]] >> np.uint64(60)).astype(np.int32) << 4 * k)
        total = np.concatenate([[0], np.cumsum(hot)])
        plenty = np.zeros(len(whole), np.int64)  # frequent tokens of the stretch from each place on, 0 if it leaves its text
        plenty[: max(0, len(whole) - least + 1)] = total[least:] - total[:-least] if len(whole) >= least else 0
        for z in stops.tolist():
            plenty[max(0, z - least + 1) : z] = 0
        full = np.concatenate([[0], np.cumsum(plenty >= least - spare)])  # full[i + 1] - full[j]: such stretches that start in j to i
        heavy = full[stops] > full[starts]
        some = (plenty >= HEAVY * least) & (plenty < least - spare)
        if some.any():
            edge = np.zeros(len(whole) + least + 1, np.int64)
            np.add.at(edge, np.flatnonzero(some), 1)
            np.add.at(edge, np.flatnonzero(some) + least, -1)
            c = np.flatnonzero((np.cumsum(edge)[: len(whole)] > 0) & ~hot)
            text = np.searchsorted(stops, c, "right")
            first, last = starts[text], stops[text] - 1
            lo, hi = np.maximum(first, c - reach), np.minimum(last, c + reach)
            yield min_hashes(whole[c], hashes), np.zeros(len(c), bool), beside[c], ids[text], _packed(hashes, lo - first, c - first, hi - first)
        for f in range(hashes):
            h = min_hashes(whole, f)
            text, lo, c, hi = nodes(h >> np.uint64(1) | hot.astype(np.uint64) << np.uint64(63), stops)
            own = ~hot[starts[text] + c]
            sets = [(text[own], lo[own], c[own], hi[own])]
            if heavy.any():
                chosen = [t for (_, t), y in zip(part, heavy, strict=True) if y]
                which = np.flatnonzero(heavy)
                text, lo, c, hi = nodes(min_hashes(np.concatenate(chosen), f), np.cumsum([len(t) for t in chosen]))
                text = which[text]
                s = starts[text]
                own = hot[s + c] & (full[s + hi - least + 2] > full[s + lo])
                sets.append((text[own], lo[own], c[own], hi[own]))
            for k, (text, lo, c, hi) in enumerate(sets):
                key = h[starts[text] + c]
                outer = _outermost(key, text, lo, hi)
                yield key[outer], np.full(len(outer), k == 1), beside[(starts[text] + c)[outer]], ids[text[outer]], _packed(f, lo, c, hi)[outer]

    def batches(it):
        seen: set[int] = set()
        for b in it:
            if len(seen) > CACHED_TEXTS:  # repeated rows meet later then
                seen.clear()
            part: list[tuple[int, np.ndarray]] = []
            size = 0
            texts = b.column(0)
            for k, tokens in chain(each_shingles(_bytes(b.column(1), _unseen(texts, seen))), [(None, None)]):
                if tokens is not None and len(tokens) < least:
                    continue
                fresh = len(tokens) if tokens is not None else 0
                if part and (tokens is None or size + fresh > PIECE_TOKENS):
                    for key, hot, beside, text, loc in found(part):
                        own = np.where(hot, _bucket(text, PARTS) + 1, 0).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), beside << 8 | own, text, loc)], names=["key", "side", "text", "loc"])
                    part, size = [], 0
                if tokens is not None:
                    part.append((texts[k].as_py(), tokens))
                    size += fresh

    return keyed.mapInArrow(batches, WINDOW)


def _bucket(text: np.ndarray, buckets: int) -> np.ndarray:
    return ((text.view(np.uint64) * _MIX[0]) >> np.uint64(40)).astype(np.int64) % buckets


def _outermost(key: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places of the windows that no other window of the same key and text holds as a whole."""
    order = np.lexsort((-hi, lo, text, key))
    key, text, hi = key[order], text[order], hi[order]
    run = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(run << 32 | hi) if len(key) else run
    inner = np.zeros(len(key), bool)
    inner[1:] = (run[1:] == run[:-1]) & (hi[1:] <= reach[:-1] & (1 << 32) - 1)
    return order[~inner]


#: kind: 0 a window of a min-hash that has more than ``meetings`` compares, 1 a pair of windows, 2 the first window of a part of a frequent
#: min-hash, 3 a pair whose tokens beside the centre differ.
MEETING = "kind int, key long, a long, loc_a long, b long, loc_b long"


def meetings(rows: DataFrame) -> DataFrame:
    """MEETING rows: each window with the first one of its min-hash, FEW windows all with each other, and the windows that this leaves uncompared with others."""
    rows = rows.select("key", F.col("side").bitwiseAND(255).alias("part"), "text", "loc", F.shiftright("side", 8).alias("beside"))
    together = rows.repartition("key", "part").sortWithinPartitions("key", "part", "text", "loc")
    names = ["kind", "key", "a", "loc_a", "b", "loc_b"]

    def meet(key, part, text, loc, beside):
        """Whole runs of rows with equal key and part."""
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        again = np.concatenate([[False], ~new[1:] & (text[1:] == text[:-1]) & (loc[1:] == loc[:-1])])
        key, part, text, loc, beside, new = (x[~again] for x in (key, part, text, loc, beside, new))
        n = len(key)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        head, size, at = np.repeat(heads, sizes), np.repeat(sizes, sizes), np.arange(n)
        foreign = np.flatnonzero(text != text[head])  # rows of another text than the first
        some = np.unique(head[foreign], return_index=True)
        other = np.full(n, -1)
        other[some[0]] = foreign[some[1]]  # the first of them in each run
        before = np.concatenate([[0], at[:-1]])
        links = [(head[foreign], foreign)]
        chain = foreign[(size[foreign] <= FEW) & (before[foreign] != head[foreign]) & (text[before[foreign]] != text[foreign])]
        links.append((before[chain], chain))
        own = at[(text == text[head]) & (at != head) & (other[head] >= 0)]  # further places of the first text
        links.append((own, other[head[own]]))
        hot = part > 0
        crowd = at[hot | ((other[head] >= 0) & (size > FEW))]
        zero = np.zeros(len(crowd), np.int64)
        kind = np.where(hot[crowd] & (crowd == head[crowd]), 2, 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, key[crowd], text[crowd], loc[crowd], zero, zero)], names=names)
        x, y = (np.concatenate(c) for c in zip(*links, strict=True))
        kind = np.where(_run_on(beside[x], beside[y]), 1, 3).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, key[x], text[x], loc[x], text[y], loc[y])], names=names)

    def batches(it):
        for columns in whole_runs(it, 2):
            yield from meet(*columns)

    return together.mapInArrow(batches, MEETING)


def _run_on(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether of the tokens beside two centres NEXT or more are the same, one after the other."""
    same = [(x >> 4 * k & 15) == (y >> 4 * k & 15) for k in range(2 * NEXT)]
    sides = []
    for order in (same[:NEXT][::-1], same[NEXT:]):  # outwards
        run = np.zeros(len(x), np.int64)
        still = np.ones(len(x), bool)
        for s in order:
            still = still & s
            run += still
        sides.append(run)
    return sides[0] + sides[1] >= NEXT


def whole_runs(it, keys: int):
    """The numeric columns of batches sorted by their first ``keys`` columns, cut where a run of equal keys ends."""
    held: list[list[np.ndarray]] = []
    for b in it:
        c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        if not len(c[0]):
            continue
        change = np.zeros(len(c[0]) - 1, bool)
        for k in range(keys):
            change |= c[k][1:] != c[k][:-1]
        ends = np.flatnonzero(change)
        if held and any(held[-1][k][-1] != c[k][0] for k in range(keys)):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if len(ends):
            cut = int(ends[-1]) + 1
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in c], strict=True)]
            held, c = [], [x[cut:] for x in c]
        held.append(c)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def met_pairs(met: DataFrame) -> DataFrame:
    """a, loc_a, b, loc_b with a < b, and near (the tokens beside agree), of the pairs that ``meetings`` found; the first windows of the parts of a frequent min-hash meet the least of them."""
    leads = met.filter("kind = 2").select("key", F.struct("a", "loc_a").alias("w"))
    least = leads.groupBy("key").agg(F.min("w").alias("least"), F.collect_set("w").alias("all"))  # a row a part
    across = least.select("least", F.explode("all").alias("w")).filter("least.a <> w.a").select("least.*", F.col("w.a").alias("b"), F.col("w.loc_a").alias("loc_b"), F.lit(True).alias("near"))
    return _ordered(met.filter("kind in (1, 3)").select("a", "loc_a", "b", "loc_b", (F.col("kind") == 1).alias("near")).unionByName(across))


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("loc_a", "loc_b"), ("b", "a"), ("loc_b", "loc_a"))), "near")


def widest_pairs(pairs: DataFrame) -> DataFrame:
    """Of each two texts' window pairs, those that no other one holds as a whole on both sides.

    Texts that meet by one hash function only, and by tokens that have other neighbours in each, are no candidates: one
    of four functions alone meets in 1 of 39 similar passages at 0.8, and of their shared tokens 1 of 400 stands so alone.
    """
    lists = pairs.groupBy("a", "b").agg(F.collect_set(F.struct("loc_a", "loc_b")).alias("places"), F.max("near").alias("near"))
    lists = lists.filter("near or size(array_distinct(transform(places, p -> shiftright(p.loc_a, 60)))) > 1").drop("near")

    def batches(it):
        for b in it:
            out: list[tuple[int, int, int, int]] = []
            for k in range(b.num_rows):
                kept: list[tuple[tuple[int, int, int], tuple[int, int, int]]] = []
                places = [(p["loc_a"], p["loc_b"]) for p in b.column(2)[k].as_py()]
                sized = sorted(((_ends(x), _ends(y), x, y) for x, y in places), key=lambda p: (p[0][0] - p[0][2] + p[1][0] - p[1][2], p[2], p[3]))
                for ea, eb, x, y in sized:
                    if any(ka[0] <= ea[0] and ea[2] <= ka[2] and kb[0] <= eb[0] and eb[2] <= kb[2] for ka, kb in kept):
                        continue
                    kept.append((ea, eb))
                    out.append((b.column(0)[k].as_py(), x, b.column(1)[k].as_py(), y))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["a", "loc_a", "b", "loc_b"])

    return lists.mapInArrow(batches, "a long, loc_a long, b long, loc_b long")


def stretches(shared: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """Stretches (start, stop) of ``least`` tokens or more in which shared tokens prevail.

    They are the maximal-scoring stretches where a shared token counts for and an unshared one against, balanced
    at each of LEVELS and at the share of shared tokens that two equally long sides have at ``similarity``, and
    the runs of shared tokens; what is too loose is left to the test of similarity.
    """
    if not shared.any():
        return []
    edges = (np.flatnonzero(np.diff(shared)) + 1).tolist()
    runs = [(a, z) for a, z in zip([0, *edges], [*edges, len(shared)], strict=True) if shared[a]]
    out = {(a, z) for a, z in runs if z - a >= least}
    if len(runs) > 1:
        for share in (*LEVELS, 2 * similarity / (1 + similarity)):
            out.update((a, z) for a, z in _maximal(runs, share) if z - a >= least)
    return sorted(out)


def _maximal(runs: list[tuple[int, int]], share: float) -> list[tuple[int, int]]:
    """Disjoint maximal-scoring stretches of runs of shared tokens; each keeps the running sum before it and at its end."""
    found: list[tuple[int, int, float, float]] = []
    total, last = 0.0, runs[0][0]
    for a, z in runs:
        total -= share * (a - last)
        item = (a, z, total, total := total + (1 - share) * (z - a))
        last = z
        while True:
            k = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < item[2]), None)
            if k is None or found[k][3] >= item[3]:
                break
            item = (found[k][0], item[1], found[k][2], item[3])
            del found[k:]
        found.append(item)
    return [(a, z) for a, z, _, _ in found]


def compare(words_a: list[bytes], words_b: list[bytes], least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of two windows, in tokens: starts, stops and the Jaccard similarity of the token sets."""
    return compare_tokens(shingle_hashes(words_a), shingle_hashes(words_b), least, similarity)


def _codes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' tokens as numbers from 0 on, equal where the tokens are."""
    both = np.concatenate([x, y])
    order = np.argsort(both)
    ordered = both[order]
    number = np.empty(len(both), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return number[: len(x)], number[len(x) :]


def _within(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For codes under ``n``: whether y has each of x."""
    has = np.zeros(n, bool)
    has[y] = True
    return has[x]


def _distinct(before: np.ndarray, least: int, of: np.ndarray | None = None) -> np.ndarray:
    """Numbers of distinct tokens (those marked in ``of``) in each stretch of ``least`` tokens."""
    n = len(before)
    at = np.arange(n) if of is None else np.flatnonzero(of)
    edge = np.bincount(np.maximum(before[at], at - least) + 1, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return np.cumsum(edge)[: n - least + 1]


def _promising(shared: np.ndarray, before: np.ndarray, least: int, similarity: float) -> bool:
    """Whether some stretch of ``least`` tokens shares as much as part of a longer similar one must.

    Of T tokens (1 - similarity) T may be unshared; the first and the last ``least`` of them both hold these only if all lie
    in the 2 least - T between, so one has 2 (1 - similarity) / (2 - similarity) least of them at most.
    """
    return bool((_distinct(before, least, shared) >= (1 - 2 * (1 - similarity) / (2 - similarity)) * _distinct(before, least) - 1).any())


def _hopeless(ordered: np.ndarray, y: np.ndarray, least: int, similarity: float) -> bool:
    """Whether y is not ``_promising`` against sorted tokens; a quick test that gives up on repeated tokens."""
    if len(y) < least:
        return True
    hit = ordered[np.minimum(np.searchsorted(ordered, y), len(ordered) - 1)] == y
    total = np.concatenate([[0], np.cumsum(hit)])
    if (total[least:] - total[:-least]).max() >= (1 - 2 * (1 - similarity) / (2 - similarity)) * least - 1:
        return False
    alike = np.sort(y)
    return not (alike[1:] == alike[:-1]).any()


def compare_tokens(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """As ``compare``.  What the maximal stretches leave is searched whole if they give nothing."""
    if len(x) < least or len(y) < least:
        return []
    x, y = _codes(x, y)
    n = int(max(x.max(), y.max())) + 1
    shared = _within(x, y, n)
    if not _promising(shared, _before(x), least, similarity) or not _promising(_within(y, x, n), _before(y), least, similarity):
        return []
    out = []
    for a0, a1 in stretches(shared, least, similarity):
        p = np.zeros(n, bool)
        p[x[a0:a1]] = True
        n_p = int(p.sum())
        for b0, b1 in stretches(p[y], least, similarity):
            q = np.zeros(n, bool)
            q[y[b0:b1]] = True
            both = int((p & q).sum())
            jaccard = both / (n_p + int(q.sum()) - both)
            if jaccard >= similarity:
                out.append((a0, a1, b0, b1, jaccard))
    return out or _searched(x, y, n, least, similarity)


def _edges(x: np.ndarray, y: np.ndarray, n: int, shared: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and stops of the runs of x that y has in the same order, as far as neighbouring tokens tell."""
    step = np.isin(x[:-1] * n + x[1:], y[:-1] * n + y[1:]) & shared[1:] & shared[:-1]
    starts = shared & ~np.concatenate([[False], step])
    stops = shared & ~np.concatenate([step, [False]])
    return np.flatnonzero(starts).tolist(), (np.flatnonzero(stops) + 1).tolist()


def _dense(x: np.ndarray, y: np.ndarray, n_codes: int, least: int, similarity: float, most: float | None = None) -> list[tuple[int, int, int, int]]:
    """(start, stop, distinct tokens, distinct tokens that y has) of the stretches of x of ``least`` tokens to twice as many, from run edge to run edge or of just ``least``, of whose distinct tokens y has ``similarity`` or more; none of over ``most`` distinct tokens.

    A longer stretch is made of such ones, and no less is shared in one of them than in the whole.
    """
    n = len(x)
    shared, before = _within(x, y, n_codes), _before(x)
    starts, stops = _edges(x, y, n_codes, shared)
    begin, end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begin[starts], end[stops] = True, True
    some = np.unique(np.array([*starts, *(max(0, z - least) for z in stops), *([n - least] if starts else [])], np.int64))
    some = some[some + least <= n]
    out = []
    for k in range(0, len(some), TILE):
        i = some[k : k + TILE, None]
        at = i + np.arange(2 * least)[None, :]
        inside = at < n
        at = np.minimum(at, n - 1)
        new = (before[at] < i) & inside
        seen, both = np.cumsum(new, 1)[:, least - 1 :], np.cumsum(new & shared[at], 1)[:, least - 1 :]
        fits = inside[:, least - 1 :] & end[at[:, least - 1 :] + 1] & begin[i]
        fits[:, 0] = True
        fits &= both >= similarity * seen
        if most is not None:
            fits &= seen <= most
        r, c = np.nonzero(fits)
        out += zip(i[r, 0].tolist(), (i[r, 0] + c + least).tolist(), seen[r, c].tolist(), both[r, c].tolist(), strict=True)
    return out


def _before(x: np.ndarray) -> np.ndarray:
    """The place of the same token before each place, -1 if none."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _searched(x: np.ndarray, y: np.ndarray, n: int, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages between all run edges of both sides, the longest first, those of x apart from each other."""
    out: list[tuple[int, int, int, int, float]] = []
    for a0, a1, n_p, _ in sorted(_dense(x, y, n, least, similarity), key=lambda s: (s[0] - s[1], s[0])):
        if any(a0 < o[1] and o[0] < a1 for o in out):
            continue
        met = [(b0, b1, c / (n_p + n_q - c)) for b0, b1, n_q, c in _dense(y, x[a0:a1], n, least, similarity, n_p / similarity) if c >= similarity * (n_p + n_q - c)]
        taken: list[tuple[int, int]] = []
        for b0, b1, j in sorted(met, key=lambda s: (s[0] - s[1], -s[2], s[0])):
            if all(b1 <= a or z <= b0 for a, z in taken):
                taken.append((b0, b1))
                out.append((a0, a1, b0, b1, j))
    return out


def verified_links(keyed: DataFrame, firsts: DataFrame, pairs: DataFrame, least: int, similarity: float) -> DataFrame:
    """a, b (text hashes), a0, a1, b0, b1 (words) and the similarity of the pairs that stand."""
    # text a comes once for about LEADS texts b, with the stretch that its windows span; each b comes with its window
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADS).alias("copies"))
    dealt = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    none = F.lit(None).cast("long")
    lo, hi = (F.expr(x) for x in ("min((shiftright(loc_a, 34) & 67108863) - (shiftright(loc_a, 17) & 131071))", "max((shiftright(loc_a, 34) & 67108863) + (loc_a & 131071))"))
    spans = dealt.groupBy("a", "copy").agg(lo.alias("lo"), hi.alias("hi"))
    sides = [
        spans.select(F.col("a").alias("text"), F.struct("a", "copy", none.alias("loc_a"), none.alias("b"), none.alias("loc_b"), "lo", "hi").alias("of")),
        dealt.select(F.col("b").alias("text"), F.struct("a", "copy", "loc_a", "b", "loc_b", none.alias("lo"), none.alias("hi")).alias("of")),
    ]
    wanted = sides[0].unionByName(sides[1]).groupBy("text").agg(F.collect_list("of").alias("of"))
    wanted = wanted.join(firsts, "text").select("id", "text", "of")
    met = packed_texts(keyed).join(wanted, ["id", "text"])

    shape = "a long, copy int, b long, loc_a long, loc_b long, start long, tokens binary"
    names = ["a", "copy", "b", "loc_a", "loc_b", "start", "tokens"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def regions(it):
        unpack = zstandard.ZstdDecompressor()
        seen: set[int] = set()
        for b in it:
            out, size = [], 0
            fresh = _unseen(b.column(1), seen)  # no repeated row
            for k, tokens in each_shingles((k, unpack.decompress(b.column(2)[k].as_py())) for k in fresh):
                tokens = narrow(tokens)
                for p in b.column(3)[k].as_py():
                    lo, hi = (p["lo"], p["hi"]) if p["b"] is None else _ends(p["loc_b"])[::2]
                    out.append((p["a"], p["copy"], p["b"], p["loc_a"], p["loc_b"], lo, tokens[lo : hi + 1].tobytes()))
                    size += len(out[-1][-1])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
            cols = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    together = met.mapInArrow(regions, shape).repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first())

    def verify(it):
        tokens, first, ordered = np.zeros(0, np.uint32), 0, np.zeros(1, np.uint32)
        for batch in it:
            out = []
            places = zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True)
            for k, (a, b, loc_a, _, start) in enumerate(places):
                found = np.frombuffer(batch.column(6)[k].as_py(), np.uint32)
                if b is None:
                    tokens, first, ordered = found, start, np.sort(found)
                    continue
                if _hopeless(ordered, found, least, similarity):
                    continue
                la, _, ha = _ends(loc_a)
                for a0, a1, b0, b1, j in compare_tokens(tokens[la - first : ha + 1 - first], found, least, similarity):
                    out.append((a, b, la + a0, la + a1 - 1 + SHINGLE, start + b0, start + b1 - 1 + SHINGLE, j))
            cols = zip(*out, strict=True) if out else [[]] * 7
            types = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "a0", "a1", "b0", "b1", "similarity"])

    return together.mapInArrow(verify, LINK)


def unsettled(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """key, text, loc, root, n (windows of the key) of the min-hashes whose windows are of several classes."""
    roots = components(links.select("a", "b"), LINKS_AT_ONCE).withColumnRenamed("node", "text")
    rows = crowd.join(roots, "text", "left").select("key", "text", "loc", F.coalesce("root", "text").alias("root"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    return salted_left_join(rows, mixed.select("key", "n"), "key", "text").filter("n is not null")


#: centre: the place of the min-hash in ``tokens`` (32 bits each), start: the place of the first token in the text.
CONTEXT = "key long, block long, text long, root long, start long, centre int, tokens binary"


def packed_texts(keyed: DataFrame) -> DataFrame:
    """id, text hash and the text compressed, for a shuffle."""

    def pack(it):
        z = zstandard.ZstdCompressor(level=1)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(x.as_py()) for x in b.column(2)], pa.binary())], names=["id", "text", "packed"])

    return keyed.select("id", "text", F.col("data").cast("binary")).mapInArrow(pack, "id long, text long, packed binary")


def contexts(keyed: DataFrame, firsts: DataFrame, rows: DataFrame, least: int, similarity: float, crowd: int = CROWD) -> DataFrame:
    """CONTEXT of each of ``unsettled``'s rows: the tokens that a similar stretch of ``least`` tokens with the centre may hold.

    A key of over ``crowd`` rows is dealt over blocks of two buckets of texts; every two buckets meet in one block.
    """
    reach = int(least / similarity)
    wanted = rows.groupBy("text").agg(F.collect_list(F.struct("key", "loc", "root", "n")).alias("of")).join(firsts, "text")
    met = packed_texts(keyed).join(wanted, ["id", "text"]).select("text", "packed", "of")
    names = ["key", "block", "text", "root", "start", "centre", "tokens"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]

    def batches(it):
        unpack = zstandard.ZstdDecompressor()
        seen: set[int] = set()
        for b in it:
            out = []
            fresh = _unseen(b.column(0), seen)  # no repeated row
            for k, tokens in each_shingles((k, unpack.decompress(b.column(1)[k].as_py())) for k in fresh):
                text, tokens = b.column(0)[k].as_py(), narrow(tokens)
                for p in b.column(2)[k].as_py():
                    lo, c, hi = _ends(p["loc"])
                    lo, hi = max(lo, c - reach), min(hi, c + reach)
                    row = (text, p["root"], lo, c - lo, tokens[lo : hi + 1].tobytes())
                    buckets = -(-p["n"] // crowd)
                    own = int(_bucket(np.array([text]), buckets)[0])
                    blocks = [min(own, o) * buckets + max(own, o) for o in range(buckets) if o != own] if buckets > 1 else [0]
                    out += [(p["key"], block, *row) for block in blocks]
                if len(out) > 1 << 15:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return met.mapInArrow(batches, CONTEXT)


def _fewest(tokens: np.ndarray, centre: int, least: int) -> int:
    """The fewest distinct tokens that a stretch of ``least`` tokens with the centre has."""
    if len(set(tokens.tolist())) == len(tokens):
        return least
    before = _before(tokens)
    return min(int((before[i : i + least] < i).sum()) for i in range(max(0, centre - least + 1), min(centre, len(tokens) - least) + 1))


def _tagged(side: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([t.astype(np.int64) << 32 | k for k, t in enumerate(side)]))


def _own_counts(some: list[np.ndarray]) -> np.ndarray:
    """Numbers of distinct tokens that each two contexts share, by a product of a 0/1 matrix over the tokens of two or more."""
    code = _tagged(some)
    token = code >> 32
    new = np.concatenate([[True], token[1:] != token[:-1]])
    number = np.cumsum(new) - 1
    several = np.bincount(number) > 1
    keep, place = several[number], np.cumsum(several) - 1
    matrix = np.zeros((len(some), int(several.sum())), np.float32)
    matrix[(code & 0xFFFFFFFF)[keep], place[number[keep]]] = 1
    return matrix @ matrix.T


def _shared_counts(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The same for contexts of two lists."""
    sides = [_tagged(side) for side in (some, others)]
    tokens = np.intersect1d(*(np.unique(s >> 32) for s in sides), assume_unique=True)
    out = []
    for code, side in zip(sides, (some, others), strict=True):
        matrix = np.zeros((len(side), len(tokens)), np.float32)
        if len(tokens):
            place = np.minimum(np.searchsorted(tokens, code >> 32), len(tokens) - 1)
            known = tokens[place] == code >> 32
            matrix[(code & 0xFFFFFFFF)[known], place[known]] = 1
        out.append(matrix)
    return out[0] @ out[1].T


def context_links(text: np.ndarray, root: np.ndarray, centre: np.ndarray, tokens: list[bytes], least: int, similarity: float) -> list[tuple[int, int, tuple]]:
    """Two rows and the passage that they share, for a spanning forest of the links between rows of different ``root``."""
    _, group = np.unique(root, return_inverse=True)
    parent = list(range(int(group.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[tuple[int, bytes], int] = {}
    arrays = [np.frombuffer(t, np.uint32) for t in tokens]
    out: list[tuple[int, int, tuple]] = []
    own: list[int] = []
    for k, alike in enumerate(zip(centre.tolist(), tokens, strict=True)):
        head = first.setdefault(alike, k)
        if head == k:
            own.append(k)
        elif (a := find(int(group[head]))) != (b := find(int(group[k]))):
            parent[b] = a
            n = len(arrays[k])
            out.append((head, k, (0, n, 0, n, 1.0)))
    # the rows of the largest class are compared with the others only
    kept = group[np.array(own)]
    others = np.flatnonzero(kept != np.bincount(kept).argmax())
    fewest = np.array([_fewest(arrays[k], int(centre[k]), least) for k in own])
    near = np.zeros((len(others), len(own)), bool)
    few = _own_counts([arrays[k] for k in own]) if len(own) <= TILE else None
    for i in range(0, len(others), TILE):
        for j in range(0, len(own), TILE):
            rows, columns = others[i : i + TILE], np.arange(j, min(j + TILE, len(own)))
            # similar sets share this part of both; two tokens may have the same 32 bits
            enough = similarity / (1 + similarity) * (fewest[rows][:, None] + fewest[columns][None, :]) - 1
            counts = few[rows] if few is not None else _shared_counts([arrays[own[k]] for k in rows], [arrays[own[k]] for k in columns])
            near[i : i + TILE, j : j + TILE] = counts >= enough
    near &= kept[others][:, None] != kept[None, :]
    partners = near.sum(1)
    for hub in np.argsort(-partners, kind="stable").tolist():
        if not partners[hub]:
            break
        x = own[others[hub]]
        ordered = np.sort(arrays[x])
        for k in np.flatnonzero(near[hub]).tolist():
            y = own[k]
            a, b = find(int(group[x])), find(int(group[y]))
            if a != b and not _hopeless(ordered, arrays[y], least, similarity) and (found := compare_tokens(arrays[x], arrays[y], least, similarity)):
                parent[b] = a
                out += [(x, y, f) for f in found]
        near[:, others[hub]] = False  # these pairs have been looked at
    return out


LINK = "a long, b long, a0 long, a1 long, b0 long, b1 long, similarity double"


def near_contexts(met: DataFrame, least: int, similarity: float) -> DataFrame:
    """LINK rows between rows of one key and different roots."""
    together = met.repartition("key", "block").sortWithinPartitions("key", "block", "text", "start", "centre")
    names = ["a", "b", "a0", "a1", "b0", "b1", "similarity"]
    kinds = [pa.int64()] * 6 + [pa.float64()]

    def batches(it):
        out = []
        for _, _, text, root, start, centre, tokens in runs(it, 2):
            text, root, start, centre = (c.to_numpy(zero_copy_only=False) for c in (text, root, start, centre))
            if len(text) < 2 or (root == root[0]).all():
                continue
            for x, y, (a0, a1, b0, b1, j) in context_links(text, root, centre, tokens.to_pylist(), least, similarity):
                a, b = int(start[x]), int(start[y])
                out.append((int(text[x]), int(text[y]), a + a0, a + a1 - 1 + SHINGLE, b + b0, b + b1 - 1 + SHINGLE, j))
            if len(out) > 1 << 15:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        cols = zip(*out, strict=True) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return together.mapInArrow(batches, LINK)


def all_links(keyed: DataFrame, firsts: DataFrame, frequent: np.ndarray, least: int, similarity: float) -> DataFrame:
    """Verified links whose classes are those of all links among windows of equal min-hash."""
    met = materialize(meetings(windows(keyed.select("text", "data"), least, similarity, frequent=frequent)), "met")
    pairs = widest_pairs(met_pairs(met))
    links = materialize(verified_links(keyed, firsts, pairs, least, similarity), "links")
    crowd = met.filter("kind <> 1").select("key", F.col("a").alias("text"), F.col("loc_a").alias("loc"))
    rows = materialize(unsettled(crowd, links), "unsettled")
    return links.unionByName(materialize(near_contexts(contexts(keyed, firsts, rows, least, similarity), least, similarity), "links"))


def near_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document that shares a passage: ``key``, class_id (smallest key of its class), n_copies (rows of equal text) and passages (verified stretches, start:stop in words, merged)."""
    least = words - SHINGLE + 1
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(whole).alias("text"), whole.alias("data"))
    members = materialize(keyed.select("id", "text"), "members")
    firsts = materialize(members.groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies")), "firsts")
    size = F.regexp_count("data", F.lit(r"[^ \t\n\x0B\f\r]+"))
    copied = keyed.join(firsts.filter("n_copies > 1").select("id", "text"), ["id", "text"], "left_semi").select("text", size.alias("n_words")).filter(F.col("n_words") >= words).distinct()
    frequent = frequent_shingles(keyed, members.count(), firsts.filter("n_copies > 1").select("text"))
    links = all_links(keyed, firsts.select("text", "id"), frequent, least, similarity)
    roots = components(links.select("a", "b"), LINKS_AT_ONCE)
    sides = [links.select(F.col(s).alias("text"), F.struct(F.col(f"{s}0").alias("start"), F.col(f"{s}1").alias("stop")).alias("span")) for s in "ab"]
    spans = sides[0].unionByName(sides[1]).groupBy("text").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    found = firsts.join(spans, "text", "left").join(roots.withColumnRenamed("node", "text"), "text", "left").join(copied, "text", "left").withColumn("root", F.coalesce("root", "text"))
    found = found.filter("spans is not null or n_words is not null")
    classes = found.groupBy("root").agg(F.min("id").alias("class_id"))
    named = salted_left_join(found, classes, "root", "text")
    passages = F.when(F.col("n_words").isNotNull(), F.concat_ws(":", F.lit("0"), F.col("n_words").cast("string"))).otherwise(_merged("spans"))
    named = named.select("text", "class_id", "n_copies", passages.alias("passages"))
    joined = salted_left_join(members.select("id", "text"), named, "text", "id").filter("passages is not null")
    given = [F.when(F.col(c) != _NO_ID, F.col(c)).alias(n) for c, n in (("id", key), ("class_id", "class_id"))]
    return joined.select(*given, "n_copies", "passages")


def _merged(spans: str):
    """Sorted spans as text, those that touch as one."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["stop"]), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(F.col(spans), F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)
    return F.array_join(F.transform(merged, lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
