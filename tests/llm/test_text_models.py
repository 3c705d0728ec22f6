"""Operators 1, 3, 5 and 6: library comparison, round trips, held-out accuracy, odd inputs."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from plait.llm import bpe, flac, langid, quality
from plait.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "   x", "x  ", "\n", "\n--", "a\n\nb", "▁", " a ▁b", "日本語 テキスト", "😀👍🏽", "<s> </s>", "\x00", "é́", "==== ----", "ha " * 3000, "x" * 5000]
ALPHABET = ["a", "b", "e", "the", " ", "  ", "▁", "\n", "é", "中", "😀", "\t", "0", "==", "--", "́", "ing", '"', "</s>", "\x00", " \n "]


def docs(spark, texts, extra="x"):
    return spark.createDataFrame([(k, t, extra) for k, t in enumerate(texts)], "doc_id long, text string, token_ids string")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=bpe.default_model())


def test_encoding_is_the_librarys(library):
    c = bpe.codec(bpe.default_model())
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16))) for _ in range(6000)]
    for t in [x or "" for x in ODD] + made:
        want = library.encode(t, add_bos=True, add_eos=True)
        assert c.encode(t) == want, repr(t)
        assert c.decode(want) == library.decode(want), repr(t)


def test_decoding_of_any_ids(library):
    c = bpe.codec(bpe.default_model())
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(library.get_piece_size()) for _ in range(rng.randint(0, 9))]
        assert c.decode(ids) == library.decode(ids)


def test_merging_by_priority_agrees_with_the_table():
    c = bpe.codec(bpe.default_model())
    for word in ["▁internationalization", "▁aaaaaaaa", "▁▁▁▁▁▁▁x", "▁thththth", "1234567890" * 5]:
        assert [c.text[i] for i in c.encode_segment(word)] == c.merge(word)


def test_token_digests(spark, library):
    rows = bpe.token_digests(docs(spark, [*ODD, ODD[3]])).collect()
    assert len(rows) == len(ODD) + 1
    for r, t in zip(sorted(rows), [*ODD, ODD[3]], strict=True):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert bpe.token_digests(docs(spark, []).limit(0)).count() == 0


def test_columns_of_ids_and_back(spark):
    out = bpe.decode_documents(bpe.encode_documents(docs(spark, ["a b", None]))).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["a b", ""]
    assert out[1].token_ids == [1, 2]


def test_flac_round_trips():
    rng = np.random.default_rng(3)
    streams = [rng.integers(-128, 128, n).astype(np.int8) for n in (1, 15, 576, 577, 4000)]
    streams += [np.cumsum(rng.integers(-2, 3, n)).astype(np.int8) for n in (576, 1152, 3001)] + [np.full(700, -5, np.int8)]
    for block in (576, 192, 333):
        media = flac.encode_many(streams, block)
        for x, m, y in zip(streams, media, flac.decode_many(media), strict=True):
            assert (x == y).all()
            info = flac.stream_info(m)
            assert (info["samples"], info["block"], info["channels"], info["bits"]) == (len(x), block, 1, 8)
            assert info["seek"]["sample"].tolist() == list(range(0, len(x), block))
            assert [s for s, _, _ in flac.pcm_blocks(m)] == info["seek"]["sample"].tolist()


def test_flac_damage_is_seen():
    media = bytearray(flac.encode((np.arange(2000) % 90).astype(np.int8)))
    at = flac.stream_info(bytes(media))["frames"]
    for place in (at + 3, at + 40, len(media) - 1):
        broken = bytearray(media)
        broken[place] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode(bytes(broken))


def _bits(*fields):
    text = "".join(format(v & (1 << n) - 1, f"0{n}b") if n else "" for v, n in fields)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def test_linear_predictors_partitions_and_escapes():
    """A subframe with a quantised predictor, two partitions (one escaped), built by hand."""
    taps, shift, warm = [3, -2], 1, [10, 12]
    residuals = [1, -1, 0, 2, -3, 1]
    want = list(warm)
    for e in residuals:
        want.append(e + (sum(c * want[-1 - j] for j, c in enumerate(taps)) >> shift))
    fields = [(0, 1), (32 + 1, 6), (0, 1), *((w, 8) for w in warm), (4 - 1, 4), (shift, 5), *((t, 4) for t in taps), (0, 2), (1, 4), (0, 4)]
    for e in residuals[:2]:  # Rice parameter 0: unary only
        z = 2 * e if e >= 0 else -2 * e - 1
        fields += [(0, z), (1, 1)]
    fields += [(15, 4), (4, 5), *((e, 4) for e in residuals[2:])]
    assert flac._subframe(flac._Reader(_bits(*fields)), 8, 8) == want


def _subframe_types(media):
    return [f[flac._head_size(f)[0]] >> 1 for f in flac._frames_of(media)[2]]


def test_linear_predictors_are_written_and_read():
    """The encoder's linear subframes, read a block at a time as a whole and sample by sample."""
    rng = np.random.default_rng(8)
    wave = (60 * np.sin(np.arange(6000) / 3) + 40 * np.sin(np.arange(6000) / 1.7) + rng.integers(-3, 4, 6000)).astype(np.int8)
    prose = (np.frombuffer((sentence := "the quick brown fox jumps over the lazy dog again " * 60).encode(), np.uint8) ^ 0x80).view(np.int8)
    edge = np.where(rng.integers(0, 2, 4000), 127, -128).astype(np.int8)
    steep = np.tile(np.array([-128, 127], np.int8), 1500)
    assert len(sentence) == len(prose)
    for x in (wave, prose, edge, steep):
        for block in (576, 192, 17, 16, 4):
            assert (flac.decode(flac.encode(x, block)) == x).all()
    media = flac.encode(wave)
    assert set(_subframe_types(media)) == {0b100000 | flac.TAPS - 1}
    for f, (_, _, x) in zip(flac._frames_of(media)[2], flac.pcm_blocks(media), strict=True):
        assert flac._subframe(flac._Reader(f[flac._head_size(f)[0] : -2]), len(x), 8) == x.tolist()
    alone = [flac.encode(x) for x in (wave, prose, edge)]
    assert flac.encode_many([edge, prose, wave, prose]) == [alone[2], alone[1], alone[0], alone[1]]


def test_media_digests(spark):
    texts = [None, "", "a", "é" * 800, "b" * 576, "abc " * 20000, "a"]
    rows = sorted(flac.media_digests(docs(spark, texts)).collect())
    for r, t in zip(rows, texts, strict=True):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert rows[2][1:] == rows[6][1:]
    assert flac.media_digests(docs(spark, []).limit(0)).count() == 0


def test_pcm_blocks_of_a_column(spark):
    out = flac.decode_column(flac.encode_column(docs(spark, ["a" * 1000, None]))).orderBy("doc_id", "block").collect()
    assert [(r.doc_id, r.block, r.sample_offset, len(r.pcm)) for r in out] == [(0, 0, 0, 576), (0, 1, 576, 576), (1, 0, 0, 576)]


def test_language_on_held_out_rows(spark):
    got = langid.identify(table(spark, SF, "documents")).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_inputs(spark):
    rows = [(k, t, la) for k, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("die katze und der hund", "de"), ("the dog", None), (None, "en"), ("", "fr"), ("123 !?", "de"), ("the cat " * 200_000, "en")] * 2)]
    rows.append((None, "der hund", "de"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id % 8 in (4, 5, 6)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id % 8 == 7} == {"en"}
    assert {(r.lang_pred, r.score) for r in langid.identify(df.limit(0).union(df.filter("lang is null"))).collect()} == {("und", 0.0)}
    kept = langid.keep_identified(df.withColumn("_x", held_out()))
    assert kept.columns == ["doc_id", "text", "lang", "_x"]


def test_quality_on_held_out_rows(spark):
    labels = table(spark, SF, "labels")
    got = quality.score_documents(table(spark, SF, "documents"), labels)
    joined = got.join(labels, "doc_id").collect()
    held = [r for r in joined if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in joined)


def test_quality_of_odd_inputs(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x y"), (3, "w " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score_documents(df, none).collect()
    assert len(got) == 5
    assert {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_documents(df, one).count() == 5


@pytest.mark.parametrize("piece", [7, 50, 1 << 20])
def test_counts_do_not_depend_on_pieces(piece):
    text = "Łódź and ΟΔΟΣ, " * 9
    assert (langid.bucket_counts(text, piece) == np.bincount(langid.ngram_buckets(text), minlength=langid.BUCKETS)).all()
    assert (langid.bucket_counts("a", piece) == np.bincount(langid.ngram_buckets("a"), minlength=langid.BUCKETS)).all()
    index = quality.index_vectors()
    whole, cut = np.zeros_like(index), np.zeros_like(index)
    quality.add_contexts(whole, index, "one two two three four four five " * 9)
    quality.add_contexts(cut, index, "one two two three four four five " * 9, piece)
    assert (whole == cut).all()


def slow_bayes(rows, text):
    """Naive Bayes by plain loops over the n-grams."""
    docs, counts = {}, {}
    for t, la in rows:
        docs[la] = docs.get(la, 0) + 1
        for b in langid.ngram_buckets(t).tolist():
            counts.setdefault(la, {})[b] = counts.setdefault(la, {}).get(b, 0) + 1
    out = {}
    for la in docs:
        size = sum(counts[la].values()) + 0.5 * langid.BUCKETS
        out[la] = np.log(docs[la] / len(rows)) + sum(np.log((counts[la].get(b, 0) + 0.5) / size) for b in langid.ngram_buckets(text).tolist())
    return out


def test_language_against_plain_loops(spark):
    rows = [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("die Maus", "de")]
    df = spark.createDataFrame([(None if k % 2 else 5, t, la) for k, (t, la) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(df)
    for text in ("the mouse", "die Katze", "chat", "zzz", "le " * 3000):
        want = slow_bayes(rows, text)
        best = max(sorted(want), key=want.get)
        (lang,), (score,) = model.predict([text])
        assert lang == best
        assert score == pytest.approx(1 / sum(np.exp(v - want[best]) for v in want.values()), abs=2e-3)


def test_rare_languages_are_sampled(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 4000 = 0, 'rare', 'usual') as l", "cast(id as string) as t")
    got = langid.sampled(df, 20_000, 1000, "id", "t", by="l").groupBy("l").count().collect()
    found = {r.l: r["count"] for r in got}
    assert found["rare"] == 5
    assert 700 < found["usual"] < 1300


def _stream(samples, bits, drop):
    """A stream of samples with ``bits`` in verbatim frames of 16, with the seek points that ``drop`` leaves."""
    frames = []
    for k in range(0, len(samples), 16):
        part = samples[k : k + 16]
        head = bytes([0xFF, 0xF8, 0x60, {8: 2, 16: 8, 24: 12}[bits], k // 16, len(part) - 1])
        head += bytes([_crc(head, 0x07, 8)])
        body = head + bytes([2]) + b"".join(int(v).to_bytes(bits // 8, "big", signed=True) for v in part)
        frames.append(body + _crc(body, 0x8005, 16).to_bytes(2, "big"))
    kind = flac.sample_type(bits)
    raw = np.array(samples, kind).tobytes() if bits != 24 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in samples)
    packed = (8000 << 44 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + packed + (hashlib.md5(raw).digest() if bits != 24 else bytes(16))
    offsets = np.cumsum([0, *(len(f) for f in frames[:-1])]).tolist()
    points = [(16 * k, o, min(16, len(samples) - 16 * k)) for k, o in enumerate(offsets) if not drop(k)]
    table = b"".join(s.to_bytes(8, "big") + o.to_bytes(8, "big") + n.to_bytes(2, "big") for s, o, n in points)
    seek = bytes([0x83]) + len(table).to_bytes(3, "big") + table if points else b""
    first = bytes([0x00 if points else 0x80]) + len(info).to_bytes(3, "big") + info
    return b"fLaC" + first + seek + b"".join(frames)


def _crc(data, poly, bits):
    crc, top, mask = 0, 1 << (bits - 1), (1 << bits) - 1
    for b in data:
        crc ^= b << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & mask
    return crc


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("drop", [lambda k: True, lambda k: k % 2, lambda k: False], ids=["none", "sparse", "full"])
def test_streams_by_others(spark, bits, drop):
    rng = np.random.default_rng(bits)
    samples = rng.integers(-(1 << bits - 1), 1 << bits - 1, 100)
    samples[20:24] = [-1, -8, -1, -8]  # bytes like a frame's beginning
    media = _stream(samples.tolist(), bits, drop)
    blocks = list(flac.pcm_blocks(media))
    assert [s for s, _, _ in blocks] == list(range(0, 100, 16))
    assert np.concatenate([x for _, _, x in blocks]).tolist() == samples.tolist()
    df = spark.createDataFrame([(1, media), (2, None)], "doc_id long, media binary")
    rows = sorted(flac.decode_column(df).collect(), key=lambda r: r.block)
    assert b"".join(r.pcm for r in rows) == samples.astype(flac.sample_type(bits)).tobytes()
    if bits < 24:
        assert flac.decode(media).tolist() == samples.tolist()
