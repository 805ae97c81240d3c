"""Media columns: FLAC streams of 8-bit mono audio.

The encoder writes blocks of 192 samples, each with the cheapest of the fixed
predictors, a linear predictor estimated from the block's autocorrelation
(Levinson-Durbin, quantised) and no predictor, Rice-coded residuals, and a seek
point every SEEK_FRAMES frames.  Its streams are decoded many frames in lockstep
with numpy, every seek point from its own offset; the CRC-8 of every frame
header, the CRC-16 of every frame and the stream's MD5 are checked.
``read_samples`` reads any range of samples from the seek point before it.
``decode_any`` reads FLAC at large, one frame after the other: any block size,
4 to 24 bits, one to eight channels with stereo decorrelation, wasted bits,
partitions, five-bit parameters and escaped partitions.

Streams are handled in slices of BLOCK_FRAMES frames, so that beside the text,
its stream and its samples, all of them bytes, memory does not grow with them.

Defined results: a null text is the empty payload, padded to one block; texts
of any length are stored whole; equal texts have equal streams and features,
repeated rows each theirs; an empty table gives no rows; columns other than
doc_id and text are ignored, whatever their names; damaged streams raise
``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_or_empty

BLOCK = 192
SEEK_FRAMES = 8
BLOCK_FRAMES = 8_192
FEATURE_BYTES = 1 << 20
RATE = 8_000
ORDER = 4  # of the estimated predictors
PRECISION = 10  # bits of their coefficients


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each of many slices, in lockstep; longer slices come first so that the active ones are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    crc = np.zeros(len(s), dtype=np.int64)
    active = len(s)
    for i in range(int(n[0]) if len(n) else 0):
        while active and n[active - 1] <= i:
            active = int(np.searchsorted(-n, -i, side="left"))
        c = crc[:active]
        crc[:active] = ((c << 8) & ((1 << bits) - 1)) ^ table[(c >> (bits - 8)) ^ data[s[:active] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


_LIMITS = (0x80, 0x800, 0x10000, 0x200000, 0x4000000, 0x80000000)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def estimate(x: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, order) and shifts (frames,) of the linear predictors of blocks of samples.

    The predictor after Levinson and Durbin for the windowed block's autocorrelation; whole
    numbers up to the division, so that it does not depend on which blocks come together.
    """
    n = x.shape[1]
    place = 2 * np.arange(n) - (n - 1)
    weighed = x * (n * n - place * place)  # a parabola over the block
    r = np.stack([(weighed[:, : n - k] * weighed[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1).astype(np.float64)
    error = np.maximum(r[:, 0], 1.0)
    c = np.zeros((len(x), order))
    for i in range(order):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= c[:, j] * r[:, i - j]
        k = np.clip(k / error, -0.999, 0.999)
        before = c[:, :i].copy()
        for j in range(i):
            c[:, j] = before[:, j] - k * before[:, i - 1 - j]
        c[:, i] = k
        error = np.maximum(error * (1 - k * k), 1.0)
    top = np.maximum(np.abs(c).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.frexp(top)[1], 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.floor(c * (1 << shift)[:, None] + 0.5), -most - 1, most).astype(np.int64), shift.astype(np.int64)


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the best parameter of each block, and the bits with it."""
    u = (r << 1) ^ (r >> 63)
    sizes = np.stack([(u >> k).sum(axis=1) + (k + 1) * u.shape[1] for k in range(9)], axis=1)
    k = sizes.argmin(axis=1)
    return u, k, np.take_along_axis(sizes, k[:, None], 1)[:, 0]


#: Kinds of subframes: fixed predictors of order 0 to 2, an estimated one, verbatim, constant.
LPC, VERBATIM, CONSTANT = 3, 4, 5


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames, length of each) for samples (frames, BLOCK) in -128..127 and ascending frame numbers per stream."""
    m = len(samples)
    x = samples.astype(np.int64)
    residuals, cost, rice = [], [], []
    r = x
    for order in range(3):
        if order:
            r = np.diff(r, axis=1)
        u, k, size = _rice(r)
        residuals.append(u)
        rice.append(k)
        cost.append(size + 8 * order + 10)
    coef, shift = estimate(x)
    guess = sum(coef[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> shift[:, None]
    u, k, size = _rice(x[:, ORDER:] - guess)
    residuals.append(u)
    rice.append(k)
    cost.append(size + 8 * ORDER + 10 + 9 + PRECISION * ORDER)
    cost.append(np.full(m, 8 * BLOCK))
    constant = (x == x[:, :1]).all(axis=1)
    costs = np.stack(cost, axis=1)
    kind = np.where(constant, CONSTANT, costs.argmin(axis=1))
    body = np.where(constant, 8, np.take_along_axis(costs, np.minimum(kind, VERBATIM)[:, None], 1)[:, 0]) + 8
    coded = 1 + np.searchsorted(np.array(_LIMITS), numbers, side="right")
    head = 4 + coded + 1
    length = head + (body + 7) // 8 + 2
    start = np.cumsum(length) - length
    bits = np.zeros(8 * int(length.sum()), dtype=np.uint8)
    for j, value in enumerate((0xFF, 0xF8, 0x14, 0x02)):
        _put(bits, 8 * (start + j), value, 8)
    for n in np.unique(coded):
        at = np.flatnonzero(coded == n)
        for j, column in enumerate(_coded(numbers[at], int(n))):
            _put(bits, 8 * (start[at] + 4 + j), column, 8)
    pos = 8 * (start + head)
    for group in np.unique(kind):
        of_kind = np.flatnonzero(kind == group)
        if group == CONSTANT:
            _put(bits, pos[of_kind], 0, 8)
            _put(bits, pos[of_kind] + 8, x[of_kind, 0] & 0xFF, 8)
        elif group == VERBATIM:
            _put(bits, pos[of_kind], 0x02, 8)
            _put(bits, (pos[of_kind] + 8)[:, None] + 8 * np.arange(BLOCK), x[of_kind] & 0xFF, 8)
        else:
            order = ORDER if group == LPC else int(group)
            for k in np.unique(rice[group][of_kind]):
                at = of_kind[rice[group][of_kind] == k]
                p = pos[at]
                _put(bits, p, (0x20 | (ORDER - 1) if group == LPC else 0x08 | order) << 1, 8)
                p = p + 8
                for j in range(order):
                    _put(bits, p, x[at, j] & 0xFF, 8)
                    p = p + 8
                if group == LPC:
                    _put(bits, p, PRECISION - 1, 4)
                    _put(bits, p + 4, shift[at], 5)
                    for j in range(ORDER):
                        _put(bits, p + 9 + PRECISION * j, coef[at, j] & ((1 << PRECISION) - 1), PRECISION)
                    p = p + 9 + PRECISION * ORDER
                _put(bits, p, 0, 6)  # four-bit parameters, one partition
                _put(bits, p + 6, int(k), 4)
                u = residuals[group][at]
                q = u >> int(k)
                size = q + 1 + int(k)
                first = (p + 10)[:, None] + np.cumsum(size, axis=1) - size
                bits[first + q] = 1
                _put(bits, first + q + 1, u, int(k))
    data = np.packbits(bits)
    wide = data.astype(np.int64)
    data[start + head - 1] = _crc(wide, start, head - 1, CRC8, 8)
    wide = data.astype(np.int64)
    crc = _crc(wide, start, length - 2, CRC16, 16)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 0xFF
    return data, length


def _coded(n: np.ndarray, length: int) -> list[np.ndarray]:
    if length == 1:
        return [n]
    lead = (0xFF00 >> length) & 0xFF
    return [lead | (n >> (6 * (length - 1))), *[0x80 | ((n >> (6 * j)) & 0x3F) for j in range(length - 2, -1, -1)]]


def payload(text: bytes) -> bytes:
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text + b"\x20" * (size - len(text))


def assemble(pcm: bytes, frames: bytes, lengths: np.ndarray) -> bytes:
    """A whole stream from its frames: marker, STREAMINFO, SEEKTABLE, frames."""
    n = len(lengths) * BLOCK
    signed = (np.frombuffer(pcm, dtype=np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    offsets = np.cumsum(lengths) - lengths
    points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, len(lengths), SEEK_FRAMES))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + frames


def encode(pcm: bytes) -> bytes:
    return encode_many([pcm])[0]


def _header(media: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
    """Samples, MD5, the seek points (sample, byte offset from the first frame), and where the frames begin, of a stream of this encoder's kind."""
    info, points, at = metadata(media)
    if info.block != BLOCK or info.bits != 8 or info.channels != 1:
        raise FlacError("only 8-bit mono streams in blocks of 192 are read in lockstep: use decode_any")
    return info.samples, info.md5, points, at


@dataclass(frozen=True)
class StreamInfo:
    block: int  # 0 where the sizes differ
    rate: int
    channels: int
    bits: int
    samples: int  # 0 where it is not known
    md5: bytes


def metadata(media: bytes) -> tuple[StreamInfo, list[tuple[int, int]], int]:
    """STREAMINFO, the seek points, and where the frames begin."""
    if media[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, info, points = 4, False, None, [(0, 0)]
    while not last:
        if at + 4 > len(media):
            raise FlacError("the metadata are cut short")
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if kind == 0:
            low, high = struct.unpack(">HH", block[:4])
            packed = int.from_bytes(block[10:18], "big")
            info = StreamInfo(low if low == high else 0, packed >> 44, ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), block[18:34])
        elif kind == 3:
            found = (struct.unpack(">QQH", block[i : i + 18]) for i in range(0, size - size % 18, 18))
            points = [(sample, offset) for sample, offset, _ in found if sample != (1 << 64) - 1] or points
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    return info, points, at


def _decode_round(data: np.ndarray, word: np.ndarray, one: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, end offset and header length of the frame at each start."""
    if not ((data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] == 0x14) & (data[start + 3] == 0x02)).all():
        raise FlacError("lost the frame sync")
    lead = data[start + 4]
    coded = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    head = 4 + coded + 1
    out = np.zeros((len(start), BLOCK), dtype=np.int64)
    pos = 8 * (start + head)

    def get(p: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return (word[p >> 3] >> (24 - (p & 7) - width)) & ((1 << width) - 1)

    kind = get(pos, 8) >> 1
    pos = pos + 8
    for t in np.unique(kind):
        at = np.flatnonzero(kind == t)
        p = pos[at]
        if t == 0:
            out[at] = _signed(get(p, 8))[:, None]
            pos[at] = p + 8
            continue
        if t == 1:
            out[at] = _signed(data[(p >> 3)[:, None] + np.arange(BLOCK)])
            pos[at] = p + 8 * BLOCK
            continue
        order = int(t) - 8 if 8 <= t <= 12 else int(t) - 31 if t >= 32 else -1
        if order < 0:
            raise FlacError("reserved subframe type")
        x = np.zeros((len(at), BLOCK), dtype=np.int64)
        for j in range(order):
            x[:, j] = _signed(get(p, 8))
            p = p + 8
        shift = np.zeros(len(at), dtype=np.int64)
        if t >= 32:
            precision, shift = get(p, 4) + 1, get(p + 4, 5)
            p = p + 9
            coef = []
            for _ in range(order):
                c = get(p, precision)
                coef.append(c - ((c >> (precision - 1)) << precision))
                p = p + precision
        else:
            coef = [np.full(len(at), c) for c in _FIXED[order]]
        if (get(p, 6) != 0).any():
            raise FlacError("only four-bit Rice parameters in one partition are read here")
        k = get(p + 6, 4)
        p = p + 10
        mask, back = (1 << k) - 1, 24 - k
        for i in range(order, BLOCK):
            stop = one[p].astype(np.int64)
            q = stop - p
            p = stop + 1
            u = (q << k) | ((word[p >> 3] >> (back - (p & 7))) & mask)
            p = p + k
            x[:, i] = (u >> 1) ^ -(u & 1)
        if order and t < 32:  # a fixed predictor of order n is n running sums
            d = x[:, :order].copy()
            res = x[:, order:]
            for level in range(order, 0, -1):
                seed = np.diff(d, n=level - 1, axis=1)[:, -1] if level > 1 else d[:, -1]
                res = np.cumsum(np.concatenate([seed[:, None], res], axis=1), axis=1)[:, 1:]
            x[:, order:] = res
        elif order:
            for i in range(order, BLOCK):
                x[:, i] += sum(c * x[:, i - 1 - j] for j, c in enumerate(coef)) >> shift
        out[at] = x
        pos[at] = p
    return out, (pos + 7) // 8 + 2, head


def _signed(b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) ^ 0x80) - 0x80


def decode_units(buffer: bytes, starts: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """PCM bytes (all frames, BLOCK): for each unit, ``frames`` frames from byte ``starts`` on, in order; checks both CRCs."""
    data = np.frombuffer(buffer + b"\x00" * 8, dtype=np.uint8)
    wide = data.astype(np.int64)
    word = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bits = np.unpackbits(data)
    n = len(bits)
    one = np.where(bits, np.arange(n, dtype=np.int32), np.int32(n - 1))
    one = np.minimum.accumulate(one[::-1])[::-1]
    base = np.cumsum(frames) - frames
    out = np.zeros((int(frames.sum()), BLOCK), dtype=np.uint8)
    begin, finish, heads = (np.zeros(len(out), dtype=np.int64) for _ in range(3))
    at = starts.astype(np.int64).copy()
    for j in range(int(frames.max(initial=0))):
        live = np.flatnonzero(frames > j)
        samples, end, head = _decode_round(wide, word, one, at[live])
        place = base[live] + j
        out[place] = (samples + 128).astype(np.uint8)
        begin[place], finish[place], heads[place] = at[live], end, head
        at[live] = end
    if (_crc(wide, begin, heads - 1, CRC8, 8) != wide[begin + heads - 1]).any():
        raise FlacError("a frame header's CRC-8 is wrong")
    crc = _crc(wide, begin, finish - begin - 2, CRC16, 16)
    if (crc != (wide[finish - 2] << 8 | wide[finish - 1])).any():
        raise FlacError("a frame's CRC-16 is wrong")
    return out


def decode_blocks(streams: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(stream, first sample, PCM) of the stretch after every seek point, in order; each is decoded from its own offset, many side by side.

    The MD5 of a stream is checked when its last block has been given.
    """
    heads = [_header(s) for s in streams]
    units: list[tuple[int, int, int, int, int]] = []  # stream, first sample, first byte, end byte, frames
    for k, (samples, _, points, first) in enumerate(heads):
        ends = [*points[1:], (samples, len(streams[k]) - first)]
        units += [(k, s, first + b, first + e, (t - s) // BLOCK) for (s, b), (t, e) in zip(points, ends, strict=True)]
    digests = [(hashlib.md5(), 0)] * len(streams)
    step = max(1, BLOCK_FRAMES // SEEK_FRAMES)
    for a in range(0, len(units), step):
        some = units[a : a + step]
        pieces = [streams[k][s:e] for k, _, s, e, _ in some]
        sizes = np.array([len(p) for p in pieces])
        frames = np.array([f for *_, f in some])
        pcm = decode_units(b"".join(pieces), np.cumsum(sizes) - sizes, frames)
        ends = np.cumsum(frames)
        for n, (k, first, *_, f) in enumerate(some):
            block = pcm[ends[n] - f : ends[n]].tobytes()
            md5, size = digests[k]
            md5 = md5.copy() if not size else md5
            md5.update((np.frombuffer(block, dtype=np.uint8) ^ 0x80).tobytes())
            digests[k] = (md5, size + len(block))
            yield k, first, block
            last = a + n + 1 == len(units) or units[a + n + 1][0] != k
            if last and (digests[k][1] != heads[k][0] or md5.digest() != heads[k][1]):
                raise FlacError("the stream's MD5 is wrong")


def decode_many(streams: list[bytes]) -> list[bytes]:
    """PCM of each stream, put together from its blocks."""
    parts: list[list[bytes]] = [[] for _ in streams]
    for k, _, block in decode_blocks(streams):
        parts[k].append(block)
    return [b"".join(p) for p in parts]


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """The PCM of ``count`` samples from ``first`` on, less at the end: read from the last seek point at or before it, and no further than needed."""
    samples, _, points, begin = _header(media)
    last = min(samples, first + count)
    if not 0 <= first < last:
        return b""
    n = bisect_right([s for s, _ in points], first) - 1
    start, offset = points[n]
    stop = bisect_left([s for s, _ in points], last)
    end = begin + points[stop][1] if stop < len(points) else len(media)
    frames = -(-(last - start) // BLOCK)
    pcm = decode_units(media[begin + offset : end], np.zeros(1, dtype=np.int64), np.array([frames])).tobytes()
    return pcm[first - start : last - start]


def encode_many(pcms: list[bytes]) -> list[bytes]:
    """A stream for each payload; frames of several payloads are coded side by side, BLOCK_FRAMES at a time."""
    x = np.frombuffer(b"".join(pcms), dtype=np.uint8).reshape(-1, BLOCK)
    counts = np.array([len(p) // BLOCK for p in pcms])
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    frames, lengths = [], []
    for a in range(0, len(x), BLOCK_FRAMES):
        f, n = encode_frames(x[a : a + BLOCK_FRAMES].astype(np.int64) - 128, numbers[a : a + BLOCK_FRAMES])
        frames.append(f.tobytes())
        lengths.append(n)
    data, size = b"".join(frames), np.concatenate(lengths)
    ends = np.cumsum(size)
    out, row, byte = [], 0, 0
    for pcm, c in zip(pcms, counts.tolist(), strict=True):
        end = int(ends[row + c - 1])
        out.append(assemble(pcm, data[byte:end], size[row : row + c]))
        row, byte = row + c, end
    return out


# ---- FLAC at large

_SIZES = {1: 192, **{i: 144 << i for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class Bits:
    """Reads big-endian bits."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise FlacError("the stream is cut short")
        self.at += n
        return (int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        start = self.at
        while True:
            room = 64 - (self.at & 7)
            room = min(room, 8 * len(self.data) - self.at)
            if room <= 0:
                raise FlacError("the stream is cut short")
            word = self.take(room)
            if word:
                self.at -= word.bit_length() - 1
                return self.at - 1 - start


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    method, partitions = bits.take(2), 1 << bits.take(4)
    if method > 1 or size % partitions or size // partitions < order:
        raise FlacError("reserved residual coding")
    width, out = (4, 5)[method], []
    for p in range(partitions):
        n = size // partitions - (order if p == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.unary() << k | (bits.take(k) if k else 0)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> list[int]:
    if bits.take(1):
        raise FlacError("lost the subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        coef, shift = _FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("reserved predictor")
            coef = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, size, order):
            out.append(r + (sum(c * x for c, x in zip(coef, reversed(out[len(out) - order :]), strict=True)) >> shift))
    else:
        raise FlacError("reserved subframe type")
    return [x << wasted for x in out] if wasted else out


def _frame(media: bytes, at: int, info: StreamInfo) -> tuple[list[list[int]], int]:
    """The channels' samples of the frame at a byte, and where it ends."""
    bits = Bits(media, at)
    if bits.take(14) != 0x3FFE or bits.take(1):
        raise FlacError("lost the frame sync")
    bits.take(1)
    size_code, rate_code, layout, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    for _ in range(0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3 if lead < 0xF8 else 4 if lead < 0xFC else 5 if lead < 0xFE else 6):
        bits.take(8)
    size = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else _SIZES.get(size_code, 0)
    if rate_code in (12, 13, 14):
        bits.take(8 if rate_code == 12 else 16)
    depth = info.bits if depth_code == 0 else _DEPTHS.get(depth_code, 0)
    if not size or not depth or layout > 10:
        raise FlacError("reserved frame header")
    wide = np.frombuffer(media[at:] if at + 32 > len(media) else media[at : at + 32], dtype=np.uint8).astype(np.int64)
    head = bits.at // 8 - at
    if bits.take(8) != int(_crc(wide, np.zeros(1, dtype=np.int64), np.array([head]), CRC8, 8)[0]):
        raise FlacError("a frame header's CRC-8 is wrong")
    sides = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(layout, (0,) * (layout + 1))
    channels = [_subframe(bits, size, depth + extra) for extra in sides]
    if layout == 8:
        channels[1] = [a - b for a, b in zip(*channels, strict=True)]
    elif layout == 9:
        channels[0] = [a + b for a, b in zip(*channels, strict=True)]
    elif layout == 10:
        middle = [2 * m + (s & 1) for m, s in zip(*channels, strict=True)]
        channels = [[(m + s) >> 1 for m, s in zip(middle, channels[1], strict=True)], [(m - s) >> 1 for m, s in zip(middle, channels[1], strict=True)]]
    end = -(-bits.at // 8)
    wide = np.frombuffer(media[at : end + 2], dtype=np.uint8).astype(np.int64)
    if len(wide) < end + 2 - at or int(wide[-2] << 8 | wide[-1]) != int(_crc(wide, np.zeros(1, dtype=np.int64), np.array([end - at]), CRC16, 16)[0]):
        raise FlacError("a frame's CRC-16 is wrong")
    return channels, end + 2


def decode_any(media: bytes) -> tuple[StreamInfo, list[list[int]]]:
    """STREAMINFO and the samples of every channel of any FLAC stream; all checksums are verified."""
    info, _, at = metadata(media)
    channels: list[list[int]] = [[] for _ in range(info.channels)]
    while at < len(media):
        found, at = _frame(media, at, info)
        if len(found) != info.channels:
            raise FlacError("the number of channels changes")
        for have, more in zip(channels, found, strict=True):
            have += more
    if info.samples and len(channels[0]) != info.samples:
        raise FlacError("samples are missing")
    width = (info.bits + 7) // 8
    if any(info.md5):
        raw = b"".join(x.to_bytes(width, "little", signed=True) for row in zip(*channels, strict=True) for x in row)
        if hashlib.md5(raw).digest() != info.md5:
            raise FlacError("the stream's MD5 is wrong")
    return info, channels


def feature(blocks: list[bytes]) -> str:
    """Sum, energy, zero crossings and range of the signed samples of consecutive blocks, as text."""
    n = total = energy = crossings = 0
    low, high, before = 127, -128, None
    for block in blocks:
        x = np.frombuffer(block, dtype=np.uint8).astype(np.int64) - 128
        down = x < 0
        crossings += int(np.count_nonzero(down[1:] != down[:-1])) + (before is not None and bool(down[0]) != before)
        n, total, energy, before = n + len(x), total + int(x.sum()), energy + int((x * x).sum()), bool(down[-1])
        low, high = min(low, int(x.min())), max(high, int(x.max()))
    return f"n={n};sum={total};energy={energy};crossings={crossings};min={low};max={high}"


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Payloads in groups of about BLOCK_FRAMES frames; a longer one is alone."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        p = payload(t)
        if group and size + len(p) > BLOCK_FRAMES * BLOCK:
            yield group
            group, size = [], 0
        group.append(p)
        size += len(p)
    if group:
        yield group


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media (the FLAC stream of the padded text) for every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([m for g in _slices([t.encode() for t in texts]) for m in encode_many(g)], dtype=object)

    return docs.select("doc_id", F.pandas_udf(run, "binary")(text_or_empty()).alias("media"))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, n_samples, pcm: the checked samples in the blocks that the seek points begin."""
    id_type = dict(media.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for doc, m in zip(rows["doc_id"], rows["media"], strict=True):
                found = decode_blocks([bytes(m)])
                while part := list(islice(found, 1_024)):
                    yield pd.DataFrame({"doc_id": [doc] * len(part), "first_sample": [s for _, s, _ in part], "n_samples": [len(b) for *_, b in part], "pcm": [b for *_, b in part]})

    return media.select("doc_id", "media").mapInPandas(run, f"doc_id {id_type}, first_sample long, n_samples long, pcm binary")


def samples_at(media: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, first_sample, n_samples, pcm for ranges (doc_id, first_sample, n_samples) of the streams."""
    cut = F.pandas_udf(lambda m, a, n: pd.Series([read_samples(bytes(x), int(i), int(k)) for x, i, k in zip(m, a, n, strict=True)], dtype=object), "binary")
    rows = media.select("doc_id", "media").join(wanted.select("doc_id", "first_sample", "n_samples"), "doc_id")
    return rows.select("doc_id", "first_sample", "n_samples", cut("media", "first_sample", "n_samples").alias("pcm"))


def digest(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back block by block, and describe both; see the columns."""
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for group in _slices(texts):
                streams = encode_many(group)
                for k, own in groupby(decode_blocks(streams), key=lambda x: x[0]):
                    blocks, media = [b for *_, b in own], streams[k]
                    pcm = b"".join(blocks)
                    rows.append((len(texts[len(rows)]), len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature([pcm[i : i + FEATURE_BYTES] for i in range(0, len(pcm), FEATURE_BYTES)])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
