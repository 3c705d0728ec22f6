"""FLAC media columns: an encoder and a decoder for mono PCM in numpy.

Blocks of many streams are encoded and decoded together, ``PIECE_BLOCKS`` at a time.
The encoder cuts the samples into blocks, picks for each block the cheapest of the
constant, verbatim, fixed (orders 0 to 4) and quantised linear (order ``TAPS``) predictors
with one Rice parameter, and writes STREAMINFO, a SEEKTABLE with the byte offset of every block's frame, and frames with
CRC-8 and CRC-16.  The decoder reads constant, verbatim, fixed and quantised linear
(LPC) subframes with Rice partitions of either parameter size and escapes, verifies both checksums and
the stream's MD5, and gives PCM blocks with their sample and byte offsets.  Subframes
that the encoder doesn't write are decoded sample by sample.

Null texts count as empty.  A payload is the text in UTF-8, padded with bytes 255 to a
positive multiple of ``BLOCK``, as 8-bit samples (byte - 128).  Repeated rows
give equal results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 576
RATE = 8000
BITS = 8
#: Blocks encoded or decoded at a time; bounds memory for long texts.
PIECE_BLOCKS = 2048
#: Order of the linear predictors that the encoder tries, and the bits of a coefficient.
TAPS = 8
PRECISION = 12


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc_rows(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of the first ``lengths`` bytes of each row (starting value zero), all rows a byte column at a time."""
    crc = np.zeros(len(rows), np.uint32)
    least = int(lengths.min()) if len(lengths) else 0
    for k in range(rows.shape[1]):
        new = (crc << 8 & ((1 << bits) - 1)) ^ table[(crc >> (bits - 8)) ^ rows[:, k]]
        crc = new if k < least else np.where(k < lengths, new, crc)
    return crc


def _utf8_number(n: int) -> bytes:
    """FLAC's extended UTF-8 coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
        if n < lead:
            return bytes([(0xFF << (lead.bit_length()) & 0xFF) | n, *reversed(tail)])


@lru_cache(1 << 16)
def _frame_head(number: int, block: int) -> bytes:
    """Header with CRC-8: fixed block size stream, block size given in 16 bits unless it is 576, mono, 8-bit."""
    code, extra = (0b0010, b"") if block == BLOCK else (0b0111, (block - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0000 << 4 | 0b001 << 1]) + _utf8_number(number) + extra
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    return head + bytes([crc])


class _Bits:
    """Bits of many rows, appended a column at a time and packed at the end."""

    def __init__(self, width: np.ndarray) -> None:
        self.bits = np.zeros((len(width), int(width.max()) + 7 & ~7), np.uint8)

    def packed(self) -> np.ndarray:
        return np.packbits(self.bits, axis=1)


def _fold(r: np.ndarray) -> np.ndarray:
    """Signed residuals as unsigned, small ones first."""
    return ((r << 1) ^ (r >> 31)).astype(np.uint32)


def _rice_costs(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row and the bits of its codes."""
    costs = np.array([(z >> p).sum(1, dtype=np.int64) + (1 + p) * z.shape[1] for p in range(BITS + 1)])
    return costs.argmin(0), costs.min(0)


def _linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (of the latest sample first) and shifts of the rows, none constant, by Levinson and Durbin's recursion on exact autocorrelations."""
    size = x.shape[1]
    r = np.stack([(x[:, : size - lag] * x[:, lag:]).sum(1, dtype=np.int64) for lag in range(TAPS + 1)], axis=1).astype(np.float64)
    a, error = np.zeros((len(x), TAPS)), r[:, 0].copy()
    for k in range(TAPS):
        left = r[:, k + 1].copy()
        for j in range(k):
            left -= a[:, j] * r[:, k - j]
        gain = np.where(error > 0, left / np.where(error > 0, error, 1.0), 0.0)
        old = a[:, :k].copy()
        a[:, :k] -= gain[:, None] * old[:, ::-1]
        a[:, k] = gain
        error *= 1 - gain * gain
    top = (1 << PRECISION - 1) - 1
    _, exponent = np.frexp(np.abs(a).max(1))
    shift = np.clip(PRECISION - 1 - exponent, 0, 15).astype(np.int32)
    return np.clip(np.rint(np.ldexp(a, shift[:, None])), -top, top).astype(np.int32), shift


def _encode_blocks(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the rows of ``x`` (blocks by samples)."""
    n, size = x.shape
    x = x.astype(np.int32)
    orders, folded = [], []
    r = x
    for order in range(5):
        if order >= size:
            break
        if order:
            r = np.diff(x, order, axis=1)
        z = _fold(r)
        sums = z.sum(1, dtype=np.int64)
        orders.append(sums)
        folded.append(z)
    order = np.argmin(np.array(orders), axis=0)
    constant = (x == x[:, :1]).all(1)
    frames: list[bytes] = [b""] * n
    rice, best = np.zeros(n, np.int64), np.full(n, 8 * size, np.int64)
    for k, z in enumerate(folded):
        at = np.flatnonzero((order == k) & ~constant)
        if len(at):
            rice[at], best[at] = _rice_costs(z[at])
            best[at] += 8 * k + 10
    order[best >= 8 * size] = -1  # verbatim
    if size > 2 * TAPS:
        at = np.flatnonzero(~constant)
        taps, shift = _linear_predictors(x[at])
        z = _fold(x[at, TAPS:] - (sum(taps[:, j, None] * x[at, TAPS - 1 - j : size - 1 - j] for j in range(TAPS)) >> shift[:, None]))
        params, costs = _rice_costs(z)
        won = costs + 8 * TAPS + 9 + PRECISION * TAPS + 10 < best[at]
        order[at[won]] = TAPS
        for p in np.unique(params[won]):
            rows = np.flatnonzero(won & (params == p))
            fields = [(np.full(len(rows), PRECISION - 1), 4), (shift[rows], 5), *((taps[rows, j], PRECISION) for j in range(TAPS))]
            for i, body in zip(at[rows], _rice_bodies(x[at[rows], :TAPS], z[rows], 0b100000 | TAPS - 1, int(p), fields), strict=True):
                frames[i] = body
    for k, z in enumerate(folded):
        for p in np.unique(rice[(order == k) & ~constant]):
            rows = np.flatnonzero((order == k) & ~constant & (rice == p))
            for i, body in zip(rows, _rice_bodies(x[rows, :k], z[rows], 0b001000 | k, int(p)), strict=True):
                frames[i] = body
    for i in np.flatnonzero((order < 0) & ~constant):
        frames[i] = bytes([0b00000010]) + (x[i] & 0xFF).astype(np.uint8).tobytes()
    for i in np.flatnonzero(constant):
        frames[i] = bytes([0b00000000, int(x[i, 0]) & 0xFF])
    bodies = [_frame_head(i, size) + f for i, f in zip(numbers, frames, strict=True)]
    lengths = np.array([len(b) for b in bodies])
    rows = np.zeros((n, int(lengths.max())), np.uint8)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat
    crcs = _crc_rows(rows, lengths, _CRC16, 16)
    return [b + int(c).to_bytes(2, "big") for b, c in zip(bodies, crcs, strict=True)]


def _rice_bodies(warm: np.ndarray, z: np.ndarray, kind: int, p: int, fields: list[tuple[np.ndarray, int]] | None = None) -> list[bytes]:
    """Subframes of one type and Rice parameter: type, warm-up samples, ``fields`` (values and their bits), one partition."""
    n, count = z.shape
    fields = [*((warm[:, k], 8) for k in range(warm.shape[1])), *(fields or []), (np.full(n, p), 10)]  # method 00, partition order 0000, then the parameter
    lead = 8 + sum(size for _, size in fields)
    high = (z >> p).astype(np.int64)
    ends = lead + np.cumsum(high + 1 + p, axis=1)
    width = ends[:, -1]
    out = _Bits(width)
    bits = out.bits
    bits[:, :8] = [0, *(kind >> s & 1 for s in range(5, -1, -1)), 0]
    at = 8
    for values, size in fields:
        for s in range(size):
            bits[:, at + s] = values >> (size - 1 - s) & 1
        at += size
    flat, base = bits.reshape(-1), np.arange(n)[:, None] * bits.shape[1]
    stop = (base + ends).reshape(-1)
    flat[stop - p - 1] = 1
    low = z.reshape(-1)
    for s in range(p):
        flat[stop - p + s] = low >> np.uint32(p - 1 - s) & 1
    packed = out.packed()
    return [packed[i, : (w + 7) // 8].tobytes() for i, w in enumerate(width.tolist())]


def encode_many(streams: list[np.ndarray], block: int = BLOCK, rate: int = RATE) -> list[bytes]:
    """A FLAC stream for each array of 8-bit mono samples (int8, at least one each)."""
    whole = [len(x) // block for x in streams]
    frames: list[list[bytes]] = [[] for _ in streams]
    owner = np.repeat(np.arange(len(streams)), whole)
    number = np.concatenate([np.arange(n) for n in whole])
    matrix = np.concatenate([x[: n * block] for x, n in zip(streams, whole, strict=True)]).reshape(-1, block)
    for k in range(0, len(matrix), PIECE_BLOCKS):
        piece = slice(k, k + PIECE_BLOCKS)
        for o, f in zip(owner[piece].tolist(), _encode_blocks(matrix[piece], number[piece].tolist()), strict=True):
            frames[o].append(f)
    out = []
    for x, n, own in zip(streams, whole, frames, strict=True):
        if n * block < len(x):
            own += _encode_blocks(x[n * block :].reshape(1, -1), [n])
        out.append(_stream(x, own, block, rate))
    return out


def _stream(samples: np.ndarray, frames: list[bytes], block: int, rate: int) -> bytes:
    sizes = [len(f) for f in frames]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (rate << 44 | 0 << 41 | (BITS - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    points = np.zeros(len(frames), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
    points["sample"] = np.arange(len(frames)) * block
    points["byte"][1:] = np.cumsum(sizes[:-1])
    points["count"] = block
    points["count"][-1] = len(samples) - (len(frames) - 1) * block
    seek = points[: (1 << 24) // 18].tobytes()  # the most one block of metadata can hold
    return b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, *frames])


class _Reader:
    """Bits of one frame."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, z = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[a:z], "big") >> (8 * z - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(r: _Reader, size: int, order: int) -> list[int]:
    bits = 5 if r.take(2) == 1 else 4
    parts, out = 1 << r.take(4), []
    for k in range(parts):
        p = r.take(bits)
        count = size // parts - (order if k == 0 else 0)
        if p == (1 << bits) - 1:
            raw = r.take(5)
            out += [r.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                z = r.unary() << p | r.take(p)
                out.append(z >> 1 ^ -(z & 1))
    return out


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(r: _Reader, size: int, depth: int) -> list[int]:
    """One subframe of any kind, sample by sample."""
    r.take(1)
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [r.signed(depth)] * size
    elif kind == 1:
        out = [r.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [r.signed(depth) for _ in range(order)]
        taps, shift = _FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision = r.take(4) + 1
            shift = r.signed(5)
            taps = [r.signed(precision) for _ in range(order)]
        for e in _residual(r, size, order):
            out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(taps)) >> shift))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    return [v << wasted for v in out]


def stream_info(media: bytes) -> dict:
    """Fields of STREAMINFO, the seek points (sample, byte offset, samples) and where the frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {"seek": ()}
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
            out["seek"] = points[points["sample"] != (1 << 64) - 1]
        at += 4 + size
    return out | {"frames": at}


def _head_size(frame: bytes) -> tuple[int, int]:
    """Bytes of the header with its CRC-8, which must hold, and the block size."""
    if frame[0] != 0xFF or frame[1] & 0xFE != 0xF8:
        raise ValueError("a frame doesn't begin with the sync code")
    at = 5
    if frame[4] >= 0xC0:
        at += 8 - (frame[4] ^ 0xFF).bit_length() - 1
    code = frame[2] >> 4
    if code == 6:
        size, at = frame[at] + 1, at + 1
    elif code == 7:
        size, at = int.from_bytes(frame[at : at + 2], "big") + 1, at + 2
    else:
        size = 192 if code == 1 else 144 << code if code < 6 else 1 << code
    at += {12: 1, 13: 2, 14: 2}.get(frame[2] & 15, 0)
    crc = 0
    for b in frame[:at]:
        crc = int(_CRC8[crc ^ b])
    if crc != frame[at]:
        raise ValueError("a frame header's CRC-8 is wrong")
    return at + 1, size


def _frame_starts(media: bytes, base: int) -> list[int]:
    """Where the frames begin, by sync code, header CRC-8 and the CRC-16 of the bytes up to the next header."""
    places, at = [], base
    while (at := media.find(b"\xff", at)) >= 0:
        if at + 5 < len(media) and media[at + 1] & 0xFE == 0xF8:
            try:
                _head_size(media[at : at + 16])
                places.append(at)
            except (ValueError, IndexError):
                pass
        at += 1
    if not places or places[0] != base:
        raise ValueError("the frames don't begin where the metadata ends")
    out, tail = [base], 1
    while tail <= len(places):  # a header within a frame's data doesn't end a frame with a right CRC-16
        stop = places[tail] if tail < len(places) else len(media)
        if _crc16(media[out[-1] : stop]) == 0:
            if stop < len(media):
                out.append(stop)
        elif stop == len(media):
            raise ValueError("a frame's CRC-16 is wrong")
        tail += 1
    return [a - base for a in out]


def _crc16(data: bytes) -> int:
    """CRC-16 of FLAC; zero for a frame with its own CRC at the end."""
    crc, table = 0, _CRC16.tolist()
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b]
    return crc


def _frames_of(media: bytes) -> tuple[dict, list[int], list[bytes]]:
    """Stream info, the byte offsets of the frames and the frames.

    Seek points that name every sample's frame give the offsets; where there are none, or fewer, the frames are found by their headers.
    """
    info = stream_info(media)
    if info["channels"] != 1:
        raise ValueError("only mono streams are read")
    base, seek = info["frames"], info["seek"]
    if len(seek) and seek["sample"][0] == 0 and np.array_equal(np.cumsum(seek["count"].astype(np.int64))[:-1], seek["sample"][1:].astype(np.int64)) and int(seek["count"].sum()) == info["samples"]:
        at = seek["byte"].tolist()
    else:
        at = _frame_starts(media, base) if len(media) > base else []
    return info, at, [media[base + a : z] for a, z in zip(at, [*(base + a for a in at[1:]), len(media)], strict=True)]


def pcm_blocks(media: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(sample offset, byte offset of the frame, samples) of every block, in order; the stream's length must hold."""
    info, at, frames = _frames_of(media)
    sample = 0
    for k in range(0, len(frames), PIECE_BLOCKS):
        for offset, x in zip(at[k : k + PIECE_BLOCKS], _decode_frames(frames[k : k + PIECE_BLOCKS], info["bits"]), strict=True):
            yield sample, offset, x
            sample += len(x)
    if info["samples"] and sample != info["samples"]:
        raise ValueError("the stream doesn't have the length it states")


def sample_type(bits: int) -> np.dtype:
    """The little-endian integers that hold samples of so many bits."""
    return np.dtype("<i1" if bits <= 8 else "<i2" if bits <= 16 else "<i4")


def decode_many(media: list[bytes]) -> list[np.ndarray]:
    """All samples of each stream; every stream's length and MD5 must hold."""
    infos, frames, owner = [], [], []
    for k, m in enumerate(media):
        info, _, own = _frames_of(m)
        infos.append(info)
        frames += own
        owner += [k] * len(own)
    if len({i["bits"] for i in infos}) > 1:
        return [decode_many([m])[0] for m in media]
    parts: list[list[np.ndarray]] = [[] for _ in media]
    for k in range(0, len(frames), PIECE_BLOCKS):
        for o, x in zip(owner[k : k + PIECE_BLOCKS], _decode_frames(frames[k : k + PIECE_BLOCKS], infos[0]["bits"]), strict=True):
            parts[o].append(x)
    out = []
    for info, own in zip(infos, parts, strict=True):
        pcm = np.concatenate(own).astype(sample_type(info["bits"])) if own else np.zeros(0, np.int8)
        if len(pcm) != info["samples"] or any(info["md5"]) and hashlib.md5(pcm.tobytes()).digest() != info["md5"]:
            raise ValueError("the samples don't have the length or MD5 that the stream states")
        out.append(pcm)
    return out


def encode(samples: np.ndarray, block: int = BLOCK, rate: int = RATE) -> bytes:
    return encode_many([samples], block, rate)[0]


def decode(media: bytes) -> np.ndarray:
    return decode_many([media])[0]


def _decode_frames(frames: list[bytes], depth: int) -> list[np.ndarray]:
    lengths = np.array([len(f) for f in frames])
    rows = np.zeros((len(frames), int(lengths.max()) + 8), np.uint8)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(frames), np.uint8)
    every = np.arange(len(frames))
    told = rows[every, lengths - 2].astype(np.uint32) << 8 | rows[every, lengths - 1]
    if (_crc_rows(rows[:, : int(lengths.max())], lengths - 2, _CRC16, 16) != told).any():
        raise ValueError("a frame's CRC-16 is wrong")
    out: list[np.ndarray | None] = [None] * len(frames)
    alike: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, f in enumerate(frames):
        head, size = _head_size(f)
        kind = f[head] >> 1
        plain = depth == 8 and not f[head] & 1
        if plain and kind == 1:
            out[i] = np.frombuffer(f, np.int8, size, head + 1)
        elif plain and (8 <= kind <= 12 or kind >= 32):
            order, r = kind - 8 if kind <= 12 else kind - 31, _Reader(f)
            r.at = (head + 1 + order) * 8
            taps, shift = (), 0
            if kind >= 32:
                precision, shift = r.take(4) + 1, r.signed(5)
                taps = _split(r.take(precision * order), precision, order)
            after = r.take(10)
            if after < 9 and shift >= 0:  # 4-bit parameter, one partition
                alike.setdefault(size, []).append((i, head, order, after, r.at, shift, taps))
                continue
        if out[i] is None:
            out[i] = np.array(_subframe(_Reader(f[head:-2]), size, depth), np.int32)
    for size, found in alike.items():
        *columns, taps = zip(*found, strict=True)
        at, heads, orders, params, starts, shifts = (np.array(c) for c in columns)
        for i, x in zip(at.tolist(), _decode_alike(rows[at], heads, size, orders, params, starts, shifts, taps), strict=True):
            out[i] = x
    return out


def _split(packed: int, bits: int, count: int) -> tuple[int, ...]:
    """Signed integers of so many bits, packed one after the other."""
    half, mask = 1 << bits - 1, (1 << bits) - 1
    return tuple((packed >> bits * k & mask ^ half) - half for k in range(count - 1, -1, -1))


def _decode_alike(rows: np.ndarray, heads: np.ndarray, size: int, orders: np.ndarray, params: np.ndarray, starts: np.ndarray, shifts: np.ndarray, taps: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Fixed and linear subframes of one size, one Rice partition each: all rows a residual at a time, then the predictors undone."""
    n = len(rows)
    wide = rows.astype(np.int32).reshape(-1)
    window = wide << 16  # the 24 bits from each byte on
    window[:-1] |= wide[1:] << 8
    window[:-2] |= wide[2:]
    flat = np.unpackbits(rows.reshape(-1))
    places = np.where(flat, np.arange(len(flat), dtype=np.int32), np.int32(len(flat) - 1))
    nxt = np.minimum.accumulate(places[::-1])[::-1]  # the next set bit
    at = (np.arange(n) * rows.shape[1] * 8 + starts).astype(np.int32)
    p = params.astype(np.int32)
    mask, step, top = (1 << p) - 1, p + 1, 24 - p
    z = np.empty((size, n), np.int32)
    limit = np.int32(len(flat) - 32)
    for k in range(size - int(orders.min())):
        one = nxt[at]
        after = np.minimum(one + 1, limit)
        z[k] = one - at << p | window[after >> 3] >> top - (after & 7) & mask
        at = np.minimum(one + step, limit)
    z = (z >> 1) ^ -(z & 1)
    out = np.empty((n, size), np.int32)
    linear = np.array([bool(t) for t in taps])
    for order, by_taps in sorted(set(zip(orders.tolist(), linear.tolist(), strict=True))):
        own = np.flatnonzero((orders == order) & (linear == by_taps))
        warm = rows[own[:, None], heads[own, None] + 1 + np.arange(order)].astype(np.int8).astype(np.int32)
        if by_taps:
            out[own] = _predicted(warm, z[: size - order, own], np.array([taps[i] for i in own.tolist()], np.int32), shifts[own].astype(np.int32))
            continue
        r = z[: size - order, own].T
        for d in range(order, 0, -1):  # sum up: the last (d-1)-th difference of the warm-up samples begins each sum
            r = np.cumsum(r, axis=1, dtype=np.int32) + (np.diff(warm, d - 1, axis=1)[:, -1:] if d > 1 else warm[:, -1:])
        out[own] = np.concatenate([warm, r], axis=1)
    return out


def _predicted(warm: np.ndarray, r: np.ndarray, taps: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Samples of linear subframes of one order (rows by samples): all rows a sample at a time."""
    n, order = warm.shape
    x = np.empty((order + len(r), n), np.int32)
    x[:order] = warm.T
    back = np.ascontiguousarray(taps[:, ::-1].T)  # of the earliest sample first
    for k in range(len(r)):
        x[order + k] = r[k] + ((back * x[k : k + order]).sum(0, dtype=np.int32) >> shifts)
    return x.T


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK), len(data)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    return encode_many([(np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8) for p in payloads]) if payloads else []


def decode_payloads(media: list[bytes]) -> list[bytes]:
    return [(x.view(np.uint8) ^ 0x80).tobytes() for x in decode_many(media)] if media else []


def pieces(column: pa.Array) -> Iterator[list[tuple[bytes, int]]]:
    """Payloads and unpadded sizes of the rows, some PIECE_BLOCKS blocks at a time."""
    held, size = [], 0
    for t in column:
        held.append(payload_of(t.as_py()))
        size += len(held[-1][0])
        if size >= PIECE_BLOCKS * BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(payload: bytes) -> str:
    """Length in blocks, mean, root mean square, zero crossings and peak of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    level = np.arange(-128, 128)
    below = np.frombuffer(payload, np.uint8) < 128
    n, seen = len(payload), level[counts > 0]
    crossings = np.count_nonzero(below[1:] != below[:-1])
    return f"blocks={n // BLOCK};mean={int(counts @ level) / n:.4f};rms={(int(counts @ level**2) / n) ** 0.5:.4f};zc={crossings};peak={max(-int(seen[0]), int(seen[-1]))}"


def encode_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add the binary column ``media``, the text's payload as a FLAC stream."""
    out = docs.drop(media).withColumn(media, F.lit(None).cast("binary"))
    names = out.columns

    def batches(it):
        for b in it:
            made = [m for part in pieces(b.column(names.index(text))) for m in encode_payloads([p for p, _ in part])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=names)

    return out.mapInArrow(batches, out.schema)


def decode_column(docs: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """PCM blocks of the binary column ``media``: ``key``, block, sample_offset, byte_offset (of the frame, from the first), pcm (``sample_type`` of the stream's bits).  Null media give no rows."""
    slim = docs.select(key, media)
    schema = slim.select(key, *(F.lit(0).cast("long").alias(c) for c in ("block", "sample_offset", "byte_offset")), F.lit(b"").alias("pcm")).schema

    def batches(it):
        for b in it:
            for k in range(b.num_rows):
                m = b.column(1)[k].as_py()
                if m is None:
                    continue
                found, kind = list(pcm_blocks(m)), sample_type(stream_info(m)["bits"])
                ids = pa.concat_arrays([b.column(0).slice(k, 1)] * len(found)) if found else b.column(0).slice(0, 0)
                cols = [ids, pa.array(range(len(found)), pa.int64()), pa.array([s for s, _, _ in found], pa.int64()), pa.array([o for _, o, _ in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.astype(kind).tobytes() for _, _, x in found], pa.binary())], names=schema.names)

    return slim.mapInArrow(batches, schema)


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode the texts, decode the stored streams and digest what was read back."""
    slim = docs.select(key, F.col(text).alias("text"))
    longs, texts = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes"), ("payload_sha256", "media_sha256", "feature")
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = slim.select(key, *(F.lit(0).cast("long").alias(c) if c in longs else F.lit("").alias(c) for c in names)).schema
    kinds = [pa.string() if c in texts else pa.int64() for c in names]

    def batches(it):
        for b in it:
            rows = []
            for part in pieces(b.column(1)):
                stored = encode_payloads([p for p, _ in part])
                for (_, n), media, back in zip(part, stored, decode_payloads(stored), strict=True):
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back)))
            cols = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[key, *names])

    return slim.mapInArrow(batches, schema)
