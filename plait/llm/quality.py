"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Every word stands for two tokens, itself and its shape (runs of letters, capitals and
digits as one sign each); a word that repeats the one before it adds the repeat token.
A token's vector is the sum of the sparse random index vectors of the tokens near it
in the sample.  A document is the mean of its words' vectors beside the mean of its
shapes'.  The network (one hidden layer, numpy) learns from the pooled vectors, and one
temperature, chosen on a part of the sample that the weights never saw, calibrates it.

The vectors and weights are fitted on a bounded sample of labelled rows (``TRAIN_DOCS``
expected rows, drawn by a hash of the id).  Null texts count as empty; the empty text
has a vector of zeros and a score like any other.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.common import held_out
from plait.llm.langid import sampled

BUCKETS = 1 << 14
DIMS = 64
NONZERO = 6
NEAR = 2
HIDDEN = 32
TRAIN_DOCS = 20_000
TRAIN_TASKS = 12
#: Rows of the table of vectors that travel together.
BLOCKS = 8
CACHED_WORDS = 200_000
#: Words pooled at a time.
PIECE_WORDS = 1 << 16
#: Bucket of the repeat token.
REPEAT = 0
_RUNS = ((re.compile(r"[a-zà-öø-ÿœß]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-ÞŒ]+"), "X"), (re.compile(r"[0-9]+"), "0"), (re.compile(r"(.)\1+"), r"\1"))


class _Tokens(dict):
    """Word to its own bucket and its shape's, packed in one integer."""

    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, sign in _RUNS:
            shape = pattern.sub(sign, shape)
        own = 1 + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        packed = own << 16 | 1 + zlib.crc32(b"shape " + shape.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = packed
        return packed


_tokens = _Tokens()


def token_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the words, buckets of their shapes and the number of repeats."""
    words = (text or "").split()
    packed = np.fromiter(map(_tokens.__getitem__, words), np.int64, len(words))
    own = packed >> 16
    return own, packed & 0xFFFF, int((own[1:] == own[:-1]).sum())


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, a fixed function of the bucket."""
    rng = np.random.default_rng(20240117)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for sign in (1, -1):
        at = rng.integers(0, DIMS, (BUCKETS, NONZERO // 2))
        out[np.arange(BUCKETS)[:, None], at] = sign
    return out


def add_contexts(total: np.ndarray, index: np.ndarray, text: str | None, piece: int = PIECE_WORDS) -> None:
    """Add to each token's row the index vectors of the tokens near it."""
    all_own, all_shape, _ = token_buckets(text)
    for k in range(0, len(all_own), piece):
        first, stop = max(0, k - NEAR), min(len(all_own), k + piece + NEAR)  # what the neighbours of the piece's words need
        own, shape = all_own[first:stop], all_shape[first:stop]
        context = index[shape].copy()
        for d in range(1, NEAR + 1):
            for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                context[a] += index[own[b]] + index[shape[b]]
        inside = slice(k - first, min(k + piece, len(all_own)) - first)
        np.add.at(total, own[inside], context[inside])
        np.add.at(total, shape[inside], context[inside])
        again = np.concatenate([[False], own[1:] == own[:-1]])[inside]
        total[REPEAT] += context[inside][again].sum(0)


def pool(vectors: np.ndarray, text: str | None) -> np.ndarray:
    own, shape, repeats = token_buckets(text)
    if not len(own):
        return np.zeros(2 * DIMS, np.float32)
    words, shapes = np.zeros(DIMS, np.float64), np.zeros(DIMS, np.float64)
    for k in range(0, len(own), PIECE_WORDS):
        words += vectors[own[k : k + PIECE_WORDS]].sum(0)
        shapes += vectors[shape[k : k + PIECE_WORDS]].sum(0)
    shapes += repeats * vectors[REPEAT]
    return np.concatenate([words, shapes]).astype(np.float32) / np.float32(len(own))


class Network:
    """Two layers; ``scale`` standardises the input and ``temperature`` calibrates the output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 150) -> None:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        aside = order[: max(1, len(x) // 5)] if len(x) > 20 else order
        rest = order[len(aside) :] if len(x) > 20 else order
        self.mean, self.scale = x[rest].mean(0), x[rest].std(0) + 1e-3
        self.temperature = 1.0
        self.w1 = rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN))
        self.b1, self.b2 = np.zeros(HIDDEN), 0.0
        self.w2 = rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN)
        names = ("w1", "b1", "w2", "b2")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        z, size = (x - self.mean) / self.scale, 128
        best, kept = np.inf, None
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(rest), max(1, len(rest) // size)):
                h = np.maximum(z[at] @ self.w1 + self.b1, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[at]) / len(at)
                back = np.outer(g, self.w2) * (h > 0)
                grads = {"w1": z[at].T @ back + 1e-4 * self.w1, "b1": back.sum(0), "w2": h.T @ g + 1e-4 * self.w2, "b2": g.sum()}
                t += 1
                for k in names:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
            if (now := self._loss(self._logits(x[aside]), y[aside])) < best:
                best, kept = now, {k: np.copy(getattr(self, k)) for k in names}
        for k in names if kept else ():
            setattr(self, k, kept[k])
        logits = self._logits(x[aside])
        self.temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 4.0), key=lambda s: self._loss(logits / s, y[aside]))

    @staticmethod
    def _loss(logits: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


class Model:
    def __init__(self, vectors: np.ndarray, network: Network | None) -> None:
        self.vectors, self.network = vectors, network

    def score(self, texts: list[str | None]) -> list[float]:
        if self.network is None:  # nothing to learn from
            return [0.5] * len(texts)
        return self.network.score(np.array([pool(self.vectors, t) for t in texts]).reshape(len(texts), 2 * DIMS)).tolist()


def train(labelled: DataFrame, text: str = "text", label: str = "quality") -> Model:
    """Learn from a bounded DataFrame of texts and 0/1 labels (null labels are left out)."""
    sample = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y")).filter("y is not null").repartition(TRAIN_TASKS)
    rows = BUCKETS // BLOCKS

    def contexts(it):
        total, index = np.zeros((BUCKETS, DIMS), np.float32), index_vectors()
        for b in it:
            for t in b.column(0).to_pylist():
                add_contexts(total, index, t)
        for k in range(BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * rows : (k + 1) * rows].tobytes()], pa.binary())], names=["k", "v"])

    def add(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(v, np.float32)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    blocks = sample.mapInArrow(contexts, "k int, v binary").repartition(BLOCKS, "k").mapInArrow(add, "k int, v binary").collect()  # BLOCKS rows
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    for r in blocks:
        vectors[r["k"] * rows : (r["k"] + 1) * rows] = np.frombuffer(r["v"], np.float32).reshape(rows, DIMS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)

    def pooled(it):
        for b in it:
            x = [pool(vectors, t).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], names=["x", "y"])

    found = sorted((r["x"], r["y"]) for r in sample.mapInArrow(pooled, "x binary, y int").collect())  # the bounded sample
    if len({y for _, y in found}) < 2:
        return Model(vectors, None)
    x = np.array([np.frombuffer(x, np.float32) for x, _ in found])
    return Model(vectors, Network(x, np.array([y for _, y in found], float)))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add the column ``column``, the probability of label 1."""
    out = docs.drop(column).withColumn(column, F.lit(None).cast("double"))
    names = out.columns

    def batches(it):
        for b in it:
            scores = model.score(b.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=names)

    return out.mapInArrow(batches, out.schema)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of ``docs``, learned from the labelled rows that are not held out."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = known.count()
    few = sampled(known, n, bound, "doc_id")
    texts = sampled(docs.select("doc_id", "text").filter(~held_out()), n, bound, "doc_id")  # the same draw, before the join
    if n > bound:  # a row that is repeated without end is learned once
        few, texts = few.distinct(), texts.distinct()
    model = train(texts.join(few, "doc_id"))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(slim, model).drop("text").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
