"""op2_passages: what the driver has to plan, and what is counted."""

import random

import numpy as np
from pyspark.sql import functions as F

from plait.llm import passages, simhash
from plait.llm.simhash import components, roots_of


def test_links_are_joined_at_once_without_rounds(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1400)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(map(tuple, components(links).collect()))
    rounds = []
    monkeypatch.setattr(simhash, "_large_star", lambda edges: rounds.append(1))
    assert sorted(map(tuple, components(links, at_once=1000).collect())) == want
    assert not rounds
    assert components(links.filter("a = b"), at_once=1000).count() == 0


def test_roots_of_a_long_shuffled_chain():
    order = np.random.default_rng(1).permutation(5000)
    node, root = roots_of(order[:-1], order[1:])
    assert (node == np.arange(5000)).all() and not root.any()


def test_frequent_shingles_are_counted_on_all_rows(spark, monkeypatch):
    """With a share of 1 in 4 of 80 rows, 20 texts are the limit; copies count once, in whichever partition they are."""
    monkeypatch.setattr(passages, "SAMPLE", 32)
    rng = random.Random(6)
    words = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(12)) for _ in range(80)]
    for k in range(21):
        words[3 * k] += " a b c d e"  # one more than the limit
    for k in range(20):
        words[3 * k + 1] += " v w x y z"
    words[-8:] = [words[1]] * 8  # repeats a text with the second one
    rows = spark.createDataFrame([(t,) for t in words], "data string").select(F.xxhash64("data").alias("text"), "data").repartition(7)
    copied = rows.groupBy("text").count().filter("count > 1").select("text")
    for chunk in (20, 1 << 22):
        monkeypatch.setattr(passages, "CHUNK_TOKENS", chunk)
        found = passages.frequent_shingles(rows, 80, copied)
        assert found.tolist() == passages.shingle_hashes("a b c d e").tolist()


def test_candidates_for_frequent_shingles_are_those_of_all_rows(spark, monkeypatch):
    """Shingles that are crowded in one partition, but rare in all, are no candidates, and what is counted grows with the rows only."""
    monkeypatch.setattr(passages, "SAMPLE", 32)
    monkeypatch.setattr(passages, "CHUNK_ROWS", 10)
    seen = []
    crowded = passages.crowded
    monkeypatch.setattr(passages, "crowded", lambda some, limit: seen.append(crowded(some, limit)) or seen[-1])
    words = [" ".join([f"w{k // 8} x{k // 8} y{k // 8} z{k // 8}", *(f"v{k}_{i}" if i > 8 else f"u{k // 8}_{i}" for i in range(12))]) for k in range(80)]  # eight alike beside each other
    rows = spark.createDataFrame([(t,) for t in words], "data string").coalesce(8).select(F.xxhash64("data").alias("text"), "data")
    assert not len(passages.frequent_shingles(rows, 80, rows.limit(0).select("text")))
    assert not seen[0].any()


def test_shingles_of_texts_laid_end_to_end():
    rng = random.Random(8)
    texts = ["", " ", "a", "a b c d", "A b\tc d E", *(" ".join(rng.choice(["foo", "Bär", "x", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(50))]
    rng.shuffle(texts)
    alone = [passages.shingle_hashes(t).tolist() for t in texts]
    for size in (1, 100, 1 << 20):
        groups = list(passages.in_groups(enumerate(t.encode() for t in texts), size))
        assert [k for g in groups for k, _ in g] == list(range(len(texts)))
        assert sum((passages.shingles_together([t for _, t in g])[0].tolist() for g in groups), []) == sum(alone, [])
    assert [t.tolist() for _, t in passages.each_shingles(enumerate(t.encode() for t in texts))] == alone
