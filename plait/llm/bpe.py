"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a segment exactly one vocabulary piece can be the last token of
its BPE encoding.  An Aho-Corasick automaton over the pieces proposes the pieces that
end at a position; a proposal stands if the piece is compatible with the last token of
the prefix before it, that is, if BPE over the two pieces' joined text gives the pair
back.  The ids are then recovered from the end backwards.  Both tests depend on pieces
only, not on text, so they are remembered.

Nulls count as the empty text.  The empty text has no ids but the begin and end ones.
Repeated rows give equal results; extra columns pass through ``encode_documents``.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments kept in a worker's memory; beyond it the store starts afresh (no effect on results).
CACHED_SEGMENTS = 300_000
#: Longer segments are not kept.
CACHED_CHARS = 48


def _replace_each_byte(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


codecs.register_error("plait_each_byte", _replace_each_byte)


class PieceCodec:
    """Encoder and decoder for one model file (BPE type, identity normalizer, byte fallback, dummy prefix)."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.out = [b""] * n
        self.is_byte = bytearray(n)
        for i, piece in enumerate(self.text):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.out[i] = bytes([int(piece[3:5], 16)])
                self.is_byte[i] = 1
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.id_of[piece] = i
                self.out[i] = piece.replace(SPACE, " ").encode()
        joined = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            joined.add_word(piece, (i, len(piece)))
        joined.make_automaton()
        self._automaton = joined
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._words = _Segments(self)

    # -- the two tests -------------------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the adjacent pair whose piece scores highest, leftmost first, until none is left."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                both = parts[left] + parts[right]
                found = self.id_of.get(both)
                if found is not None:
                    heapq.heappush(heap, (-self.score[found], left, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, left, both = heapq.heappop(heap)
            if parts[left] is None:
                continue
            right = after[left]
            if right >= len(parts) or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in parts if p is not None]

    def stands_alone(self, piece: int) -> bool:
        known = self._own.get(piece)
        if known is None:
            known = self._own[piece] = self.merge(self.text[piece]) == [self.text[piece]]
        return known

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            a, b = self.text[left], self.text[right]
            known = self._pairs[key] = self.merge(a + b) == [a, b]
        return known

    # -- the prefix table ----------------------------------------------------------
    def encode_segment(self, segment: str) -> list[int]:
        """Ids of a text in which spaces already are SPACE."""
        last = [-1] * (len(segment) + 1)
        pairs = self._pairs
        for end, (piece, length) in self._automaton.iter(segment):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start and (prev := last[start]) >= 0:
                fits = pairs.get(prev << 20 | piece)
                if fits is None:
                    fits = self.stands_alone(piece) and self.compatible(prev, piece)
                    pairs[prev << 20 | piece] = fits
                if not fits:
                    continue
            elif not self.stands_alone(piece):
                continue
            last[end] = piece
        ids: list[int] = []
        at = len(segment)
        while at:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= len(self.text[piece])
            else:  # in no piece: its bytes
                at -= 1
                ids.extend(self.byte_id[b] for b in reversed(segment[at].encode("utf-8", "surrogatepass")))
        ids.reverse()
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers.

        No piece has a space after another character, so each run of spaces begins a segment of its own.
        """
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.split(" ")
        if "" in parts:  # runs of spaces, or spaces at an end
            parts = [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        get = self._words.__getitem__
        return b"".join(map(get, parts))

    def encode(self, text: str | None, add_ends: bool = True) -> list[int]:
        body = self.encode_bytes(text)
        ids = list(struct.unpack(f"<{len(body) // 4}I", body))
        return [self.bos, *ids, self.eos] if add_ends else ids

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): control ids vanish, the dummy prefix goes, bytes become characters."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "plait_each_byte")
        first = next((i for i in ids if i != self.bos and i != self.eos), None)
        return text[1:] if first is not None and self.text[first].startswith(SPACE) else text


class _Segments(dict):
    """Segment (without its first space) to the bytes of its ids."""

    def __init__(self, codec: PieceCodec) -> None:
        super().__init__()
        self.codec = codec
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:  # the line feed is in no piece, so nothing joins across it
            lf = struct.pack("<I", self.codec.byte_id[10])
            first, *rest = word.split("\n")
            return self[first] + b"".join(lf + (self.part(x) if x else b"") for x in rest)
        return self.keep(self, word, SPACE + word.replace(" ", SPACE))

    def part(self, text: str) -> bytes:
        """A part that doesn't begin with a space."""
        return self.parts.get(text) or self.keep(self.parts, text, text)

    def keep(self, store: dict[str, bytes], key: str, segment: str) -> bytes:
        ids = self.codec.encode_segment(segment)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(key) <= CACHED_CHARS:
            if len(store) >= CACHED_SEGMENTS:
                store.clear()
            store[key] = packed
        return packed


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a model and worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, text: str = "text", ids: str = "token_ids", model_file: str | None = None) -> DataFrame:
    """Add the array column ``ids`` with begin and end ids."""
    model = model_file or default_model()
    out = docs.drop(ids).withColumn(ids, F.array().cast("array<int>"))

    def batches(it):
        c = codec(model)
        at = None
        for b in it:
            at = b.schema.get_field_index(ids)
            col = b.column(b.schema.get_field_index(text)).to_pylist()
            rows = pa.array([c.encode(t) for t in col], pa.list_(pa.int32()))
            yield b.set_column(at, ids, rows)

    return out.mapInArrow(batches, out.schema)


def decode_documents(docs: DataFrame, ids: str = "token_ids", text: str = "decoded", model_file: str | None = None) -> DataFrame:
    """Add the column ``text`` decoded from the array column ``ids`` (null: null)."""
    model = model_file or default_model()
    out = docs.drop(text).withColumn(text, F.lit(None).cast("string"))

    def batches(it):
        c = codec(model)
        for b in it:
            rows = [None if x is None else c.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(rows, pa.string()))

    return out.mapInArrow(batches, out.schema)


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256 of each row, encoded and decoded in one pass without an id array."""
    model = model_file or default_model()
    slim = docs.select(key, F.col(text).alias("text"))
    schema = slim.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def batches(it):
        c = codec(model)
        begin, end = struct.pack("<I", c.bos), struct.pack("<I", c.eos)
        for b in it:
            counts, ids, texts = [], [], []
            for t in b.column(1):
                packed = begin + c.encode_bytes(t.as_py()) + end
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back = c.decode(struct.unpack(f"<{len(packed) // 4}I", packed))
                texts.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim.mapInArrow(batches, schema)
