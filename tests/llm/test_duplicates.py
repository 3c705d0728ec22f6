"""Operators 2, 4, 9 and 10 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from plait.llm import decontaminate, passages, simhash, suffixes
from plait.llm.common import table

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(spark, n=200):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").limit(n).collect()]


# -- SimHash ---------------------------------------------------------------------------
def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^ \x09-\x0d]+", low)
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, linked):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_all_pairs(spark):
    rows = corpus(spark) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "a b"), (1005, "a b"), (1006, "x y z " * 5000), (1007, "É B c d e")]
    got = {r.doc_id: r for r in simhash.duplicate_classes(docs(spark, rows)).collect()}
    prints = [slow_print(t) for _, t in rows]
    assert all(int(got[k].fingerprint, 16) == p for (k, _), p in zip(rows, prints, strict=True))
    roots = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for (k, _), r in zip(rows, roots, strict=True):
        least[r].append(k)
    assert all(got[k].component_id == min(least[r]) for (k, _), r in zip(rows, roots, strict=True))


@pytest.mark.parametrize("rows", [4, 512])
def test_links_of_crowded_shards(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b for b in base}
    for b in base:
        at = b
        for _ in range(25):
            at ^= 1 << rng.randrange(64)
            values |= {at, b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = slow_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    for v, r in zip(values, roots, strict=True):
        s, t = simhash._signed(v), simhash._signed(values[r])
        assert found.get(s, s) == found.get(t, t)
    assert len({found.get(simhash._signed(v), simhash._signed(v)) for v in values}) == len(set(roots))


def test_tree_follows_the_radius():
    rng = random.Random(2)
    tree, values = simhash.BKTree(), [rng.getrandbits(16) for _ in range(400)]
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_components_of_a_long_path(spark):
    got = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")).collect()
    assert {r.root for r in got} == {0}
    assert len(got) == 61


def test_one_document_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = docs(spark, [(3, text), (2, text), (5, "other words here"), (5, "other words here"), (None, "no id")])
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one_each(df).collect()) == [(0, "no id"), (2, text), (5, "other words here")]
    assert simhash.duplicate_classes(df.limit(0)).count() == 0


def test_different_texts_of_one_id_stay(spark):
    text, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "wz")
    df = docs(spark, [(5, text), (5, other), (5, text), (7, text), (8, other)])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one_each(df).collect()) == [(5, text), (5, other)]


# -- repeated windows --------------------------------------------------------------------
def slow_removal(rows, depth=100):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            w = data[p : p + depth]
            if w in seen:
                covered[p : p + depth] = b"\1" * depth
            seen.add(w)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[k] = (len(data), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(data, covered, strict=True) if not c)).hexdigest())
    return out


def planted(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcd é") for _ in range(2500))
    some = lambda: "".join(rng.choice("xyz") for _ in range(rng.randrange(200)))
    rows = []
    for k in range(50):
        a = rng.randrange(2200)
        rows.append((k, some() + base[a : a + rng.choice([50, 99, 100, 101, 150, 300])] + some()))
    return rows + [(100, "ha " * 300), (101, "ha " * 200), (102, None), (103, ""), (104, base), (105, base), (106, "a" * 1000), (None, base[:400])]


@pytest.mark.parametrize(("open_runs", "piece"), [(4096, 1 << 20), (1, 1 << 20), (4096, 700)])
def test_removal_against_all_windows(spark, monkeypatch, open_runs, piece):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    rows = planted(4)
    want = slow_removal(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digests(docs(spark, rows).repartition(3), open_runs=open_runs).collect()}
    assert got == want


def test_removal_of_the_corpus(spark):
    rows = corpus(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digests(docs(spark, rows)).collect()}
    assert got == slow_removal(rows)


def test_removal_of_repeated_and_absent_rows(spark):
    df = docs(spark, [(1, "q" * 50 + "".join(map(str, range(100)))), (1, "q" * 50 + "".join(map(str, range(100))))])
    assert {(r.n_removed, r.n_spans) for r in suffixes.removal_digests(df).collect()} == {(0, 0)}
    assert suffixes.removal_digests(df.limit(0)).count() == 0
    kept = {r.doc_id: r for r in suffixes.remove(docs(spark, [(1, "".join(map(str, range(60)))), (2, "".join(map(str, range(60))) + "END")])).collect()}
    assert kept[2].text == "END"
    assert [tuple(s) for s in kept[2].spans] == [(0, 110)]


def test_removal_of_different_texts_of_one_id(spark):
    """Many texts under null ids or one id: none is taken for another."""
    rng = random.Random(40)
    base = "".join(rng.choice("abcdefgh") for _ in range(300))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(300)] + [base, base[:200] + "zz", base]
    df = docs(spark, [(None, t) for t in texts] + [(3, t + "!") for t in texts[:3]] + [(3, base), (4, "short")]).repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.removal_digests(df).collect())
    # id 3 comes before the null ids: its texts stay, those of null ids lose what they share with them
    removed = [0] * 300
    for k in range(3):
        removed[k] = 120
    want = [("None", 120, n) for n in removed] + [("None", 300, 300), ("None", 202, 200), ("None", 300, 300)] + [("3", 121, 0)] * 3 + [("3", 300, 0), ("4", 5, 0)]
    assert got == sorted(want)


# -- passages ------------------------------------------------------------------------------
def slow_windows(hashes, least):
    """Every passage's min-hash must be that of a window that holds it, by the tree and by its nodes read off at once."""
    hashes = hashes << np.uint64(20)
    found = passages.compact_windows(hashes, least)
    text, lo, c, hi = passages.tree_nodes(np.concatenate([hashes, hashes[:least]]), np.array([len(hashes), len(hashes) + least]), least)
    nodes = {(a, m, z) for t, a, m, z in zip(text.tolist(), lo.tolist(), c.tolist(), hi.tolist(), strict=True) if t == 0}
    assert set(found) <= nodes
    assert len(set(found) ^ nodes) == 0 or len(np.unique(hashes)) < len(hashes)
    assert 1 in text
    for i in range(len(hashes) - least + 1):
        for j in range(i + least, min(i + least + 9, len(hashes)) + 1):
            least_hash = hashes[i:j].min()
            assert any(lo <= i and j - 1 <= hi and hashes[c] == least_hash for lo, c, hi in found)


def test_windows_hold_every_passage():
    rng = np.random.default_rng(5)
    slow_windows(rng.integers(0, 1 << 40, 150).astype(np.uint64), 10)
    slow_windows(rng.integers(0, 4, 120).astype(np.uint64), 10)
    slow_windows(np.zeros(80, np.uint64), 10)


def test_stretches():
    shared = np.array([1] * 50 + [0] * 5 + [1] * 40 + [0] * 60 + [1] * 46, bool)
    assert (0, 95) in passages.stretches(shared, 46, 0.8)
    assert (155, 201) in passages.stretches(shared, 46, 0.8)
    assert passages.stretches(np.zeros(90, bool), 46, 0.8) == []


def test_passages_against_all_runs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    p, q, near = some(60), some(55), some(120)
    edited = [*near]
    edited[60] = word()
    texts = [some(30) + p + some(40), p + some(80), some(70) + q, q + some(3), some(200), some(20) + near + some(30), some(50) + edited, None, "".split(), ["the"] * 49, p[:40] + some(60)]
    rows = [(k, None if t is None else " ".join(t)) for k, t in enumerate(texts)] + [(20, " ".join(texts[4])), (21, "ha " * 3000), (22, "ha " * 2000)]
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, rows).repartition(3)).collect()}
    classes = defaultdict(set)
    for k, r in got.items():
        classes[r.class_id].add(k)
    assert sorted(map(sorted, classes.values())) == [[0, 1], [2, 3], [4, 20], [5, 6], [21, 22]]
    assert got[0].passages == "30:90"
    assert got[1].passages == "0:60"
    assert got[20].n_copies == 2
    assert passages.near_passages(docs(spark, rows).limit(0)).count() == 0


def test_passages_of_the_corpus(spark):
    rows = corpus(spark)
    runs = defaultdict(set)
    for k, t in rows:
        w = passages.split_words(t)
        for i in range(len(w) - passages.WORDS + 1):
            runs[tuple(w[i : i + passages.WORDS])].add(k)
    got = {r.doc_id: r.class_id for r in passages.near_passages(docs(spark, rows)).collect()}
    for s in runs.values():
        if len(s) > 1:
            assert len({got.get(k) for k in s}) == 1
            assert None not in {got.get(k) for k in s}


def near_rows(texts):
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def random_words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def slow_similarity(a, b, least):
    """The best Jaccard similarity of all stretches of ``least`` tokens or more."""
    x, y = (passages.shingle_hashes([w.encode() for w in t]).tolist() for t in (a, b))
    best = 0.0
    for i in range(len(x) - least + 1):
        for j in range(i + least, len(x) + 1):
            p = set(x[i:j])
            for k in range(len(y) - least + 1):
                for m in range(k + least, len(y) + 1):
                    q = set(y[k:m])
                    best = max(best, len(p & q) / len(p | q))
    return best


def test_rows_of_a_key_meet_or_are_left(spark):  # finding 1
    rng = np.random.default_rng(27)
    texts = rng.integers(-(1 << 62), 1 << 62, 40)
    rows, groups = [], {}
    for key in range(30):
        own = rng.choice(texts, rng.integers(1, 12), replace=False)
        part = (passages._bucket(own, 3) + 1).tolist() if key % 3 == 0 else [0] * len(own)
        rows += [(key, p, t, key) for t, p in zip(own.tolist(), part, strict=True)] * 2
        groups[key] = set(own.tolist())
    met = passages.meetings(spark.createDataFrame(rows, passages.WINDOW)).collect()
    left = defaultdict(set)
    for r in met:
        if r.kind in (0, 2):
            left[r.key].add(r.a)
    assert all(left[k] == (own if k % 3 == 0 or len(own) > passages.FEW else set()) for k, own in groups.items())
    pairs = passages.met_pairs(spark.createDataFrame(met, passages.MEETING)).collect()
    assert len(pairs) < 2 * len(rows)
    for key, own in groups.items():
        meets = {(r.a, r.b) for r in pairs if r.loc_a == key}
        assert all(a < b for a, b in meets)
        order = sorted(own)
        assert len(set(slow_components(order, lambda a, b: (min(a, b), max(a, b)) in meets))) <= 1  # noqa: B023
        if len(own) <= passages.FEW and key % 3:
            assert len(meets) == len(own) * (len(own) - 1) // 2


def context_links(rows, root):
    return passages.context_links(np.arange(len(rows)), np.array(root), np.full(len(rows), 30), [r.tobytes() for r in rows], 46, 0.8)


def test_contexts_that_are_similar():
    rng = np.random.default_rng(31)
    base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    near, far = base.copy(), base.copy()
    near[50:54] = rng.integers(0, 1 << 16, 4)
    far[10:40] = rng.integers(0, 1 << 16, 30)
    rows = [base, base, near, far]
    assert {tuple(sorted(o[:2])) for o in context_links(rows, [1, 2, 3, 4])} == {(0, 1), (0, 2)}
    assert context_links(rows, [1, 1, 1, 4]) == []
    counts = passages._shared_counts(rows, rows)
    assert (np.triu(counts, 1) == np.triu(passages._own_counts(rows), 1)).all()
    assert all(counts[a, b] == len(np.intersect1d(rows[a], rows[b])) for a in range(4) for b in range(4) if a != b)


def test_crowds_are_linked_by_a_forest():
    """Copies around one original, alike to it but not to each other, and some that are alike to none."""
    rng = np.random.default_rng(32)
    base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    rows = []
    for k in range(40):
        rows.append(base.copy())
        rows[-1][10 + k % 40 : 15 + k % 40] = k
    rows.append(base)
    for _ in range(20):
        rows.append(base.copy())
        rows[-1][rng.permutation(60)[:15]] = rng.integers(0, 1 << 32, 15)
    links = context_links(rows, range(len(rows)))
    assert len({o[:2] for o in links}) < len(rows)
    pairs = {o[:2] for o in links}
    found = slow_components(list(range(len(rows))), lambda a, b: (min(a, b), max(a, b)) in {(min(p), max(p)) for p in pairs})
    true = slow_components(list(range(len(rows))), lambda a, b: bool(passages.compare_tokens(rows[a], rows[b], 46, 0.8)))
    partition = lambda c: {frozenset(k for k, x in enumerate(c) if x == r) for r in set(c)}
    assert partition(found) == partition(true)


def test_word_hashes(monkeypatch):
    rng = random.Random(34)
    text = " ".join(random_words(rng, 300)).replace("e", "É\t\n").encode() + b"\x0b\x0cThe  END the end  "
    words = passages.split_words(text)
    for piece in (1 << 20, 100):
        monkeypatch.setattr(passages, "PIECE_BYTES", piece)
        found = passages.word_hashes(text)
        assert len(found) == len(words)
        assert len(set(zip(words, found.tolist(), strict=True))) == len(set(words)) == len(set(found.tolist()))
    assert len(passages.word_hashes(b" \t")) == len(passages.word_hashes(b"")) == 0


def test_tokens_beside():
    pack = lambda *t: np.array([sum(v << 4 * k for k, v in enumerate(t))])
    assert passages._run_on(pack(1, 2, 3, 4), pack(1, 2, 9, 4))[0]
    assert passages._run_on(pack(1, 2, 3, 4), pack(9, 2, 3, 9))[0]
    assert not passages._run_on(pack(1, 2, 3, 4), pack(1, 9, 3, 9))[0]


def test_fewest_tokens_of_a_stretch():
    rng = np.random.default_rng(33)
    for n in (50, 80):
        tokens = rng.integers(0, 30, n).astype(np.uint16)
        c = n // 2
        want = min(len(set(tokens[i : i + 46].tolist())) for i in range(n - 45) if i <= c < i + 46)
        assert passages._fewest(tokens, c, 46) == want


def test_one_shared_hash_is_enough(spark):  # finding 2
    loc = lambda lo, c, hi: int(passages._packed(0, np.array([lo]), np.array([c]), np.array([hi]))[0])
    schema = "a long, loc_a long, b long, loc_b long, near boolean"
    assert passages.widest_pairs(spark.createDataFrame([(1, loc(0, 5, 60), 2, loc(3, 9, 70), True)], schema)).count() == 1
    assert passages.widest_pairs(spark.createDataFrame([(1, loc(0, 5, 60), 2, loc(3, 9, 70), False)], schema)).count() == 0
    other = int(passages._packed(1, np.array([4]), np.array([8]), np.array([70]))[0])
    assert passages.widest_pairs(spark.createDataFrame([(1, loc(0, 5, 60), 2, loc(3, 9, 70), False), (1, other, 2, other, False)], schema)).count() == 2
    # a window whose centre a wider one holds, but not the window itself, stays
    two = spark.createDataFrame([(1, loc(0, 50, 99), 2, loc(0, 50, 99), True), (1, loc(60, 80, 120), 2, loc(60, 80, 120), False), (1, loc(10, 20, 80), 2, loc(10, 20, 80), True)], schema)
    assert passages.widest_pairs(two).count() == 2


def test_near_copies_at_the_least_similarity(spark):  # finding 2
    rng = random.Random(22)
    texts = []
    for _ in range(300):
        t = random_words(rng, 50)
        u = [*t]
        u[rng.randrange(10, 40)] = random_words(rng, 1)[0]
        texts += [t, u]
    got = {r.doc_id: r.class_id for r in passages.near_passages(docs(spark, near_rows(texts)).repartition(4)).collect()}
    assert sum(got.get(2 * k) == got.get(2 * k + 1) == 2 * k for k in range(300)) >= 299


def test_stretches_between_the_levels():  # finding 5
    rng = random.Random(25)
    a = random_words(rng, 94)
    b = [*a]
    for k in (25, 51, 52, 53, 54):
        b[k] = random_words(rng, 1)[0]
    a, b = ([w.encode() for w in t] for t in (a, b))
    assert any(a1 - a0 >= 46 and j >= 0.8 for a0, a1, _, _, j in passages.compare(a, b, 46, 0.8))


def test_compare_against_all_stretches():  # finding 5
    rng = random.Random(26)
    for _ in range(60):
        a = random_words(rng, rng.randrange(18, 30))
        b = [*a]
        for _ in range(rng.randrange(1, 4)):
            k, how = rng.randrange(len(b)), rng.random()
            if how < 0.25:
                del b[k]
            elif how < 0.5:
                b.insert(k, random_words(rng, 1)[0])
            else:
                b[k] = random_words(rng, 1)[0]
        found = passages.compare([w.encode() for w in a], [w.encode() for w in b], 12, 0.6)
        assert bool(found) == (slow_similarity(a, b, 12) >= 0.6)


def test_every_place_of_a_passage_is_found(spark):  # finding 4
    rng = random.Random(24)
    passage, other = random_words(rng, 60), random_words(rng, 55)
    texts = [random_words(rng, 20) + passage + random_words(rng, 300) + passage + random_words(rng, 20), random_words(rng, 5) + passage]
    # the line stands alone first, and later within the shared passage
    texts += [random_words(rng, 60) + other[:30] + random_words(rng, 200) + other + random_words(rng, 60), random_words(rng, 70) + other]
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, near_rows(texts)).repartition(2)).collect()}
    assert got[0].passages == "20:80,380:440"
    assert got[1].passages == "5:65"
    assert got[2].class_id == got[3].class_id == 2
    assert got[2].passages.endswith("290:345")


def test_a_frequent_line_hides_no_passage(spark):  # finding 3
    rng = random.Random(23)
    line = random_words(rng, 30)
    texts = [random_words(rng, 40) + line + random_words(rng, 40) for _ in range(400)]
    for k in range(50):
        shared = random_words(rng, 20)
        texts[k] = random_words(rng, 30) + line + shared + random_words(rng, 30)
        texts[399 - k] = random_words(rng, 10) + line + shared + random_words(rng, 50)
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, near_rows(texts)).repartition(6)).collect()}
    assert sum(k in got and 399 - k in got and got[k].class_id == got[399 - k].class_id == k for k in range(50)) >= 49
    assert not set(got) & set(range(50, 350))


def test_copies_around_one_original_are_all_linked(spark):  # finding 1
    rng = random.Random(21)
    hub = random_words(rng, 60)
    copies = []
    for k in range(200):
        copies.append([*hub])
        copies[-1][25 + k % 10] = random_words(rng, 1)[0]
    apart = [slow_similarity(copies[0], copies[d or 10], 46) >= 0.8 for d in range(10)]
    assert slow_similarity(hub, copies[0], 46) >= 0.8
    assert not all(apart)
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, near_rows([hub, *copies])).repartition(5)).collect()}
    assert set(got) == set(range(201))
    assert {r.class_id for r in got.values()} == {0}
    assert got[0].passages == "0:60"


# -- benchmark -----------------------------------------------------------------------------
def slow_tiles(x, y, least):
    """Greedy tiling by comparing every pair of places."""
    used_x, used_y, out = [v < 0 for v in x], [v < 0 for v in y], []
    while True:
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and not used_x[i + n] and not used_y[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return out
        out.append(best)
        for k in range(n):
            used_x[i + k] = used_y[j + k] = True


def test_tiling_covers_as_the_slow_one():
    rng = random.Random(3)
    for _ in range(150):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(1, 22))] for _ in range(2))
        fast, slow = decontaminate.tile(np.array(x), np.array(y), 3), slow_tiles(x, y, 3)
        assert sorted(n for _, _, n in fast)[::-1][:1] == sorted(n for _, _, n in slow)[::-1][:1]
        taken_x, taken_y = set(), set()
        for i, j, n in fast:
            assert x[i : i + n] == y[j : j + n]
            a, b = set(range(i, i + n)), set(range(j, j + n))
            assert not a & taken_x
            assert not b & taken_y
            taken_x |= a
            taken_y |= b
        left = [-1 if k in taken_x else v for k, v in enumerate(x)], [-2 if k in taken_y else v for k, v in enumerate(y)]
        assert slow_tiles(*left, 3) == []


def test_contaminated_documents(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, ""), (4, ""), (5, "never seen words at all here now")], "item_id long, text string")
    rows = [(0, "x y " + item.upper() + "! z"), (1, " ".join(w[8:] + ["gap"] + w[:8])), (2, " ".join(w[:7])), (3, None), (4, ""), (5, "a short, item."), (6, "clean words only"), (None, item), (7, "pad " * 30000 + item), (7, "pad " * 30000 + item)]
    want = [(None, 1), (0, 1), (1, 1), (5, 2), (7, 1), (7, 1)]
    for size in (32 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.contaminated(docs(spark, rows), items).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str)
        assert {r.n_tiles for r in got if r.doc_id == 1} == {2}
        kept = decontaminate.keep_uncontaminated(docs(spark, rows), items)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontaminate.contaminated(docs(spark, rows), items.limit(0)).count() == 0
