"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows (``TRAIN_DOCS`` expected
rows, drawn by a hash of the id; with fewer eligible rows, all of them).  The matrix of
log-probabilities, languages by ``BUCKETS``, goes to the workers with the function;
documents are scored in batches as sparse rows.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if
there is nothing to learn from.  Null languages are not learned; repeated rows are judged
one by one; ties go to the language first in code point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.common import free_name, held_out

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the sample to learn from, in expectation, and the tasks that count it.
TRAIN_DOCS = 20_000
TRAIN_TASKS = 12
#: Rows of each language to learn from, in expectation, however rare it is.
LEAST_DOCS = 200
#: Characters scored at a time.
BATCH_CHARS = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def _codes(text: str) -> np.ndarray:
    """The characters of the lower-cased text, one space around it."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(codes: np.ndarray, stop: int) -> np.ndarray:
    """Bucket of every n-gram that begins before ``stop``."""
    found, key = [], np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS[-1] + 1):
        key = key[: max(0, len(codes) - n + 1)] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            found.append((key[:stop] * _MIX) >> np.uint32(16))
    return np.concatenate(found)


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text, one space around it."""
    codes = _codes(text)
    return _buckets(codes, len(codes))


def bucket_counts(text: str, piece: int = BATCH_CHARS) -> np.ndarray:
    """How often each bucket occurs, counted a piece at a time; n-grams across the cuts count like any other."""
    codes, total = _codes(text), np.zeros(BUCKETS, np.int64)
    for k in range(0, len(codes), piece):
        total += np.bincount(_buckets(codes[k : k + piece + ORDERS[-1] - 1], piece), minlength=BUCKETS)
    return total


def sampled(rows: DataFrame, n: int, bound: int, *of: str, by: str | None = None, least: int = LEAST_DOCS) -> DataFrame:
    """About ``bound`` of the ``n`` rows, by a hash of the columns ``of``; all if there are no more.

    Of each value of ``by`` about ``least`` rows are taken at least, so that rare ones are learned, too; the values are few, as
    a model has a row for each.
    """
    part = min(1.0, bound / max(n, 1))
    share = F.lit(part)
    if by is not None and part < 1:
        for value, times in rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * part < least).toLocalIterator():
            share = F.when(F.col(by) == value, F.lit(least / times)).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *of), F.lit(1_000_000)) < F.ceil(share * 1_000_000))


class NaiveBayes:
    """Languages in order and their log-probabilities: prior by language, and language by bucket."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray) -> None:
        self.langs = langs
        self.prior = np.log(docs / docs.sum()) if len(langs) else docs
        smooth = counts + 0.5
        self.log_p = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)) if len(langs) else counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at: list[int] = []
        rows: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            if rows:
                starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
                total = np.add.reduceat(self.log_p[np.concatenate(rows)].astype(np.float64), starts, axis=0) + self.prior
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i, b, s in zip(at, best.tolist(), share.tolist(), strict=True):
                    langs[i], scores[i] = self.langs[b], s
            at.clear()
            rows.clear()

        for i, t in enumerate(texts):
            if t and self.langs and _LETTER.search(t):
                if len(t) > BATCH_CHARS:
                    flush()
                    langs[i], scores[i] = self._long(t)
                    continue
                if size + len(t) > BATCH_CHARS:
                    flush()
                    size = 0
                at.append(i)
                rows.append(ngram_buckets(t))
                size += len(t)
        flush()
        return langs, scores

    def _long(self, text: str) -> tuple[str, float]:
        """A very long text, whose n-grams are counted a piece at a time."""
        total = self.prior + bucket_counts(text) @ self.log_p.astype(np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total.max()).sum())


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = TRAIN_DOCS) -> NaiveBayes:
    """Learn from ``rows`` with a text and a language; every row offered may be used."""
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    n = rows.count()
    sample = sampled(rows, n, bound, "k", "t", "l", by="l")
    if n > bound:  # a row that is repeated without end is learned once
        sample = sample.distinct()
    sample = sample.select("t", "l").repartition(TRAIN_TASKS)

    def count(it):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in it:
            for t, la in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if la not in total:
                    total[la], docs[la] = np.zeros(BUCKETS, np.int64), 0
                docs[la] += 1
                total[la] += bucket_counts(t)
        yield from _rows([(la, docs[la], total[la]) for la in total])

    def add(it):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in it:
            for la, n, i, c in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if la not in total:
                    total[la], docs[la] = np.zeros(BUCKETS, np.int64), 0
                docs[la] += n
                total[la][np.frombuffer(i, np.uint16)] += np.frombuffer(c, np.int64)
        yield from _rows([(la, docs[la], total[la]) for la in total])

    schema = "lang string, docs long, buckets binary, counts binary"
    found = sample.mapInArrow(count, schema).repartition(TRAIN_TASKS, "lang").mapInArrow(add, schema).collect()  # a row a language
    found.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(found), BUCKETS))
    for k, r in enumerate(found):
        counts[k, np.frombuffer(r["buckets"], np.uint16)] = np.frombuffer(r["counts"], np.int64)
    return NaiveBayes([r["lang"] for r in found], np.array([r["docs"] for r in found], float), counts)


def _rows(found: list[tuple[str, int, np.ndarray]]):
    for la, n, c in found:
        i = np.flatnonzero(c)
        arrays = [pa.array([la]), pa.array([n], pa.int64()), pa.array([i.astype(np.uint16).tobytes()], pa.binary()), pa.array([c[i].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "docs", "buckets", "counts"])


def predict(docs: DataFrame, model: NaiveBayes, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the columns ``lang`` and ``score``."""
    out = docs.drop(lang, score).withColumns({lang: F.lit(None).cast("string"), score: F.lit(None).cast("double")})
    names = out.columns

    def batches(it):
        for b in it:
            langs, scores = model.predict(b.column(names.index(text)).to_pylist())
            arrays = [*b.columns[:-2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return out.mapInArrow(batches, out.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of ``documents``; learned from the rows that are not held out."""
    model = train(docs.filter(~held_out()))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(slim, model, score="score").drop("text")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with a score of ``least`` or more, columns unchanged."""
    model = train(docs.filter(~held_out()))
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    found = predict(docs, model, lang=lang, score=score)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
