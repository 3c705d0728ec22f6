"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected components.

Fingerprints within ``radius`` bits agree wholly on all but ``radius`` of ``BLOCKS``
blocks of bits, so every choice of agreeing blocks is a shard key: linked fingerprints
meet in at least one shard.  A shard's distinct fingerprints form a BK-tree (children
keyed by their Hamming distance to the parent; a search follows only the edges within
the radius), built in the task that owns the shard instead of being broadcast, because
the fingerprints of a corpus have no size bound.  A shard gives the links of a spanning
forest, never all pairs.  A shard of more than ``SHARD_ROWS`` fingerprints is dealt
again by the same rule over its remaining bits, which loses nothing.

Null texts count as empty; a text without words has fingerprint zero and is linked like
any other.  Equal rows share a fingerprint; a null id is kept, and counts for nothing in
the smallest id.  Other columns are not returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.common import free_name, materialize, runs, salted_left_join

SEED = 42
SHINGLE = 3
RADIUS = 2
BLOCKS = 4
SHARD_ROWS = 512
#: Shingles hashed at a time.
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64; shingles repeat as often as they occur."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(stops), PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + PIECE], stops[k : k + PIECE])], np.uint64)  # noqa: B905
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(stops), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", column: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Replace ``text`` by the signed 64-bit fingerprint ``column``."""
    keep = [c for c in docs.columns if c not in (text, column)]
    slim = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep, F.lit(0).cast("long").alias(column)).schema

    def batches(it):
        for b in it:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.columns[-1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=schema.names)

    return slim.mapInArrow(batches, schema)


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        at = self.root
        while (d := (at ^ value).bit_count()) in self.children[at]:
            at = self.children[at][d]
        if d:
            self.children[at][d] = value
            self.children[value] = {}

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for k, child in self.children[at].items():
                if abs(k - d) <= radius:
                    todo.append(child)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` among distinct ``values``: (value, smaller value) pairs."""
    tree, parent, out = BKTree(), {}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in sorted(values):
        parent[v] = v
        for near in tree.within(v, radius):
            if (a := find(v)) != (b := find(near)):
                parent[max(a, b)] = min(a, b)
                out.append((v, near))
        tree.add(v)
    return out


def _shard_keys(bits: range, radius: int, blocks: int) -> list[int]:
    """Masks of the bits on which two values within ``radius`` over ``bits`` may be asked to agree: one of them always holds."""
    cuts = [bits.start + len(bits) * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, column: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all links within ``radius``."""
    masks = [_signed(m) for m in _shard_keys(range(64), radius, radius + 2)]
    one = F.col(column)
    keyed = prints.select(one.alias("v"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), one.bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)))).alias("s")).select("s.i", "s.key", "v")
    sizes = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["i", "key"])
    usual = met.filter(F.col("n") <= SHARD_ROWS).select("i", "key", F.lit(0).alias("j"), F.lit(0).cast("long").alias("sub"), "v")
    # a large shard's members agree on its mask, so they differ, by radius at most, on the others
    again = []
    for i, m in enumerate(masks):
        rest = [b for b in range(64) if not m >> b & 1]
        cuts = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
        subs = [_signed(sum(1 << b for b in rest[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)]
        again.append(F.when(F.col("i") == i, F.array(*(F.struct(F.lit(j + 1).alias("j"), F.col("v").bitwiseAND(F.lit(s).cast("long")).alias("sub")) for j, s in enumerate(subs)))))
    large = met.filter(F.col("n") > SHARD_ROWS).select("i", "key", "v", F.explode(F.coalesce(*again)).alias("s")).select("i", "key", "s.j", "s.sub", "v")
    dealt = usual.unionByName(large)

    def link(it):
        pairs: list[tuple[int, int]] = []
        for columns in runs(it, 4):
            if len(columns[0]) > 1:
                pairs += shard_links([x & 0xFFFFFFFFFFFFFFFF for x in columns[4].to_pylist()], radius)
            if len(pairs) > PIECE:
                yield _links(pairs)
                pairs = []
        yield _links(pairs)

    together = dealt.repartition("i", "key", "j", "sub").sortWithinPartitions("i", "key", "j", "sub")
    return together.mapInArrow(link, "a long, b long").distinct()


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates the large-star and small-star steps; every round is written to the shared
    folder, so lineage stays short, and only counts come to the driver.  Up to ``at_once`` different
    links are joined by one task instead, as each round costs the driver many plans and stages.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    if edges.count() <= at_once:

        def join(it):
            read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it]
            if read:
                node, root = roots_of(*(np.concatenate(x) for x in zip(*read, strict=True)))
                for k in range(0, len(node), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array(node[k : k + PIECE]), pa.array(root[k : k + PIECE])], names=["node", "root"])

        return materialize(edges.coalesce(1).mapInArrow(join, "node long, root long"), "roots")
    state = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "links")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if (row["n"], row["h"], row["x"]) == state:
            break
        state = (row["n"], row["h"], row["x"])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the smallest node that each reaches."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(node))
    x, y = place[: len(a)], place[len(a) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return node, node[root]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return _spread(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _spread(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _spread(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Join each edge with its u's minimum; a hub's edges are dealt over many tasks."""
    return salted_left_join(edges, least, "u", "v")


def fingerprint_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, more: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``more``, fp (signed), root (a fingerprint that names the component) and component_id, the smallest key whose fingerprint is reachable by links within ``radius``."""
    prints = materialize(with_fingerprints(docs.select(key, *more, text), text), "prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "firsts")
    roots = components(near_links(firsts.select("fp"), radius=radius))
    mapped = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = mapped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = salted_left_join(mapped.select("fp", "root"), ids, "root", "fp").select("fp", "root", "component_id")
    return salted_left_join(prints, by_print, "fp", key)


def hex16(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return fingerprint_components(docs).select("doc_id", hex16().alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest ``key``, columns unchanged.

    Of rows of a component that repeat that key one stays; rows with a null key all stay.
    """
    mark = free_name(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = fingerprint_components(marked, key, text, more=(mark,))
    # components of different texts may have the same smallest key
    kept = found.filter(F.col(key) == F.col("component_id")).groupBy(key, "root").agg(F.min(mark).alias(mark)).select(key, mark)
    return marked.join(kept, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))
