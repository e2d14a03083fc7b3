"""Media columns: FLAC streams of 8-bit samples, written and read with all frames of a batch side by side.

Writing chooses for each frame the smallest of a constant, verbatim, fixed (orders 0 to 2) and linear (order 4) predictor with Rice-coded
residuals. A seek table names every frame, so that reading decodes all frames of many streams at once: residuals sample by sample
over all frames, then the predictors. The CRC-8 of each header and the CRC-16 of each frame are verified, and the MD5 of the samples.
A plain frame-by-frame reader takes streams without a full seek table and frames with rarer features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import lengths, map_batches, texts

BLOCK, RATE, LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 1024, 8000, 4, 10, 8
#: A payload is padded with zero bytes to a positive multiple of this.
PAD = 64
MOST_K = 14
#: Frames that are written or read side by side: bounds memory, however long a text is.
RUN = 1024


def _crc_table(poly: int, width: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) if c >> (width - 1) & 1 else c << 1
        table[i] = c & (1 << width) - 1
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """CRC of data[start : start + size] for each start, a byte of all at a time."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.zeros(len(start), np.uint32)
    active = len(start)
    for i in range(int(size.max(initial=0))):
        while active and size[active - 1] <= i:
            active -= 1
        byte = data[start[:active] + i]
        c = crc[:active]
        crc[:active] = (c << np.uint32(8) & np.uint32((1 << width) - 1)) ^ table[c >> np.uint32(width - 8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % PAD if payload else PAD)


# --- writing ---------------------------------------------------------------------------------------------------------


def _number_bytes(n: np.ndarray) -> np.ndarray:
    """How many bytes the coded frame number takes."""
    return 1 + (n >= 1 << 7) + (n >= 1 << 11).astype(int) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients (frames, LPC_ORDER) by Levinson and Durbin's recursion."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(axis=1) for lag in range(LPC_ORDER + 1)], 1)
    error = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = error * np.maximum(1 - k * k, 1e-12)
    most = (1 << LPC_PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most, most).astype(np.int32)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload: mono, 8 bits a sample, byte b as sample b - 128. Payloads mustn't be empty."""
    size = np.array([len(x) for x in payloads], np.int64)
    per = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    n = np.minimum(BLOCK, size[owner] - number * BLOCK).astype(np.int32)
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    begin = (np.cumsum(size) - size)[owner] + number * BLOCK
    runs = [_encode_frames(flat, begin[i : i + RUN], n[i : i + RUN], number[i : i + RUN]) for i in range(0, len(n), RUN)]
    raw = memoryview(b"".join(x for x, _ in runs))
    frame = np.concatenate([x for _, x in runs])
    at = np.cumsum(frame) - frame

    streams = []
    last_frame = np.cumsum(per)
    for d, payload in enumerate(payloads):
        a, b = last_frame[d] - per[d], last_frame[d]
        samples = np.frombuffer(payload, np.uint8) ^ 128  # two's complement of b - 128
        info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + (RATE << 44 | 7 << 36 | int(size[d])).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points = np.zeros(b - a, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = number[a:b] * BLOCK, at[a:b] - at[a], n[a:b]
        seek = b"".join(_block(3, points[i : i + MOST_POINTS].tobytes(), i + MOST_POINTS >= b - a) for i in range(0, b - a, MOST_POINTS))
        streams.append(b"".join((b"fLaC", _block(0, info, False), seek, raw[at[a] : at[b - 1] + frame[b - 1]])))
    return streams


def _encode_frames(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of ``n`` samples from ``begin`` on in the payloads' bytes, one after the other, and the size of each; ``number`` counts a stream's frames."""
    column = np.arange(BLOCK, dtype=np.int32)
    valid = column < n[:, None]
    x = np.zeros((len(n), BLOCK), np.int32)
    x[valid] = flat[begin[0] : begin[-1] + n[-1]].astype(np.int32) - 128

    coefficients = _lpc(x)
    predicted = np.zeros_like(x)
    for j in range(LPC_ORDER):
        predicted[:, j + 1 :] += coefficients[:, j : j + 1] * x[:, : -(j + 1)]
    first = np.diff(x, axis=1, prepend=0)
    residuals = [x, first, np.diff(first, axis=1, prepend=0), x - (predicted >> LPC_SHIFT)]
    orders, extra = [0, 1, 2, LPC_ORDER], [0, 0, 0, 9 + LPC_PRECISION * LPC_ORDER]
    best, kind, rice = n * 8, np.zeros(len(n), np.int8), np.zeros(len(n), np.int32)  # kind 0: verbatim, 1 to 4: as in residuals, 5: constant
    for i, (r, order) in enumerate(zip(residuals, orders, strict=True), 1):
        z = _zigzag(r)
        z[~valid] = 0
        z[:, :order] = 0
        residuals[i - 1] = z
        count = np.maximum(n - order, 1)
        guess = np.floor(np.log2(np.maximum(z.sum(axis=1) / count, 1))).astype(np.int32)
        for k in (guess - 1, guess, guess + 1):
            k = np.clip(k, 0, MOST_K)
            bits = order * 8 + 10 + extra[i - 1] + (n - order) * (1 + k) + (z >> k[:, None]).sum(axis=1)
            bits[n <= order] = 1 << 30
            better = bits < best
            best, kind, rice = np.where(better, bits, best), np.where(better, i, kind), np.where(better, k, rice)
    constant = ((x == x[:, :1]) | ~valid).all(axis=1)
    best, kind = np.where(constant, 8, best), np.where(constant, 5, kind)

    short = n != BLOCK
    head = 4 + _number_bytes(number) + 2 * short + 1  # a short block gives its size in 16 bits
    frame = head + -(-(best + 8) // 8) + 2
    at = np.cumsum(frame) - frame
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(bit: np.ndarray, value: np.ndarray, width: int | np.ndarray) -> None:
        fields.append((bit, value.astype(np.int64), np.broadcast_to(np.asarray(width), bit.shape)))

    bit = at * 8
    put(bit, np.full(len(n), 0xFFF8), 16)
    put(bit + 16, np.where(short, 0x74, 0xA4), 8)  # 16-bit size or 1024; 8 kHz
    put(bit + 24, np.full(len(n), 0x02), 8)  # mono, 8 bits
    size_of_number = _number_bytes(number)
    for width in np.unique(size_of_number):
        of = np.flatnonzero(size_of_number == width)
        v = number[of].astype(np.int64)
        if width == 1:
            put(bit[of] + 32, v, 8)
            continue
        lead = 0xFF << (8 - width) & 0xFF
        put(bit[of] + 32, lead | v >> 6 * (width - 1), 8)
        for j in range(1, width):
            put(bit[of] + 32 + 8 * j, 0x80 | v >> 6 * (width - 1 - j) & 0x3F, 8)
    of = np.flatnonzero(short)
    put(bit[of] + 32 + 8 * size_of_number[of], n[of] - 1, 16)
    body = bit + head * 8
    types = np.array([1, 8, 9, 10, 32 + LPC_ORDER - 1, 0])
    put(body, types[kind] << 1, 8)
    body = body + 8
    of = np.flatnonzero(kind == 5)
    put(body[of], x[of, 0] & 255, 8)
    of = np.flatnonzero(kind == 0)
    row, col = np.nonzero(valid[of])
    put(body[of][row] + 8 * col, x[of[row], col] & 255, 8)
    for i, order in enumerate(orders, 1):
        of = np.flatnonzero(kind == i)
        if not len(of):
            continue
        p = body[of]
        for j in range(order):
            put(p + 8 * j, x[of, j] & 255, 8)
        p = p + 8 * order
        if i == 4:
            put(p, np.full(len(of), LPC_PRECISION - 1), 4)
            put(p + 4, np.full(len(of), LPC_SHIFT), 5)
            for j in range(order):
                put(p + 9 + LPC_PRECISION * j, coefficients[of, j] & (1 << LPC_PRECISION) - 1, LPC_PRECISION)
            p = p + 9 + LPC_PRECISION * order
        k = rice[of]
        put(p, k, 10)  # method 0, partition order 0, parameter
        inside = (column >= order) & (column < n[of][:, None])
        z = residuals[i - 1][of]
        q = z >> k[:, None]
        width = np.where(inside, q + 1 + k[:, None], 0)
        start = np.cumsum(width, axis=1) - width + (p + 10)[:, None]
        ks = np.broadcast_to(k[:, None], z.shape)[inside]
        put(start[inside] + q[inside], 1 << ks | z[inside] & (1 << ks) - 1, ks + 1)
    out = _gather(fields, int(frame.sum()))
    out[at + head - 1] = _crcs(out, at, head - 1, CRC8, 8)
    crc = _crcs(out, at, frame - 2, CRC16, 16)
    out[at + frame - 2], out[at + frame - 1] = crc >> 8, crc & 255
    return out.tobytes(), frame


#: Seek points in one metadata block, whose length has 24 bits.
MOST_POINTS = (1 << 24) // 18 - 1


def _block(kind: int, data: bytes, last: bool) -> bytes:
    return bytes([kind | 128 * last]) + len(data).to_bytes(3, "big") + data


def _gather(fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Bytes that hold each field (value, up to 16 bits) at its bit. Fields don't overlap, so sums of their parts do for an OR."""
    total = np.zeros(size + 3)
    for bit, value, width in fields:
        if len(bit):
            byte = bit >> 3
            shifted = value << (24 - (bit & 7) - width)
            for i in range(3):
                part = shifted >> 8 * (2 - i) & 255
                total += np.bincount(byte + i, weights=part, minlength=size + 3)
    return total[:size].astype(np.uint8)


# --- reading ---------------------------------------------------------------------------------------------------------


class Corrupt(ValueError):
    pass


def _metadata(stream: bytes) -> tuple[int, bytes, np.ndarray | None, int]:
    """Samples, MD5, offsets of all frames from the start of the stream (null if the seek table lacks some), and where frames begin."""
    if stream[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, total, digest, points = 4, 0, b"", []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            total, digest = int.from_bytes(data[10:18], "big") & (1 << 36) - 1, data[18:34]
            if int.from_bytes(data[10:18], "big") >> 36 & 31 != 7 or int.from_bytes(data[10:18], "big") >> 41 & 7:
                raise Corrupt("not mono with 8 bits a sample")
        elif kind & 127 == 3:
            points.append(np.frombuffer(data, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])))
        at += 4 + size
        if kind & 128:
            break
    if points:
        p = np.concatenate(points)
        p = p[p["sample"] != (1 << 64) - 1]
        sample, n = p["sample"].astype(np.int64), p["n"].astype(np.int64)
        offset = p["offset"].astype(np.int64) + at
        if len(p) and sample[0] == 0 and (sample[1:] == (sample + n)[:-1]).all() and sample[-1] + n[-1] == total and (np.diff(offset) > 0).all():
            return total, digest, offset, at
    return total, digest, None, at


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.bit = data, at * 8

    def read(self, n: int) -> int:
        a, b = self.bit >> 3, self.bit + n + 7 >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.bit - n) & (1 << n) - 1
        self.bit += n
        return v

    def signed(self, n: int) -> int:
        v = self.read(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
            if self.bit > len(self.data) * 8:
                raise Corrupt("frame without end")
        return n


def decode_frame(data: bytes, at: int) -> tuple[list[int], int]:
    """Samples of the frame at ``at``, and where it ends. Reads every kind of mono 8-bit frame, bit by bit."""
    bits = _Bits(data, at)
    if bits.read(15) != 0x7FFC:
        raise Corrupt("no frame here")
    bits.read(1)
    size_code, rate_code, channels, depth = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    if channels or depth not in (0, 1):
        raise Corrupt("not mono with 8 bits a sample")
    lead, more = bits.read(8), 0
    while lead >> (7 - more) & 1:
        more += 1
    for _ in range(max(0, more - 1)):
        bits.read(8)
    n = {1: 192, 6: 0, 7: 0}.get(size_code, 576 << (size_code - 2) if size_code < 6 else 1 << size_code)
    n = bits.read(8) + 1 if size_code == 6 else bits.read(16) + 1 if size_code == 7 else n
    bits.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    head = bits.bit >> 3
    if int(_crcs(np.frombuffer(data[at:head], np.uint8), np.zeros(1, np.int64), np.array([head - at]), CRC8, 8)[0]) != bits.read(8):
        raise Corrupt("header checksum")
    bits.read(1)
    kind, wasted = bits.read(6), 0
    if bits.read(1):
        wasted = bits.unary() + 1
    depth = 8 - wasted
    if kind == 0:
        found = [bits.signed(depth)] * n
    elif kind == 1:
        found = [bits.signed(depth) for _ in range(n)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        if not (8 <= kind <= 12 or kind >= 32):
            raise Corrupt("reserved subframe")
        found = [bits.signed(depth) for _ in range(order)]
        weights, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order, []), 0
        if kind >= 32:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        wide, parts = (5 if bits.read(2) else 4), bits.read(4)
        for p in range(1 << parts):
            k = bits.read(wide)
            raw = bits.read(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if raw is None:
                    z = bits.unary() << k | bits.read(k)
                    r = z >> 1 ^ -(z & 1)
                else:
                    r = bits.signed(raw)
                total = sum(w * s for w, s in zip(weights, reversed(found[-order:] if order else []), strict=True))
                found.append(r + (total >> shift))
    end = bits.bit + 7 >> 3
    if int(_crcs(np.frombuffer(data[at:end], np.uint8), np.zeros(1, np.int64), np.array([end - at]), CRC16, 16)[0]) != int.from_bytes(data[end : end + 2], "big"):
        raise Corrupt("frame checksum")
    return [s << wasted for s in found], end + 2


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Of each stream: its payload (sample s as byte s + 128), and first sample and size of each frame. Checksums that don't hold raise Corrupt."""
    heads = [_metadata(s) for s in streams]
    base = np.cumsum([0] + [len(s) for s in streams])
    seekable = [d for d, h in enumerate(heads) if h[2] is not None]
    data = np.frombuffer(b"".join((*streams, bytes(16))), np.uint8)
    start = np.concatenate([heads[d][2] + base[d] for d in seekable]) if seekable else np.zeros(0, np.int64)
    pcm, sizes = [np.zeros(0, np.int8)], [np.zeros(0, np.int64)]
    for i in range(0, len(start), RUN):
        upto = int(start[i + RUN]) + 16 if i + RUN < len(start) else len(data)
        rows, n = _decode_frames(data[start[i] : upto], start[i : i + RUN] - start[i])
        pcm.append(rows[np.arange(rows.shape[1]) < n[:, None]].astype(np.int8))
        sizes.append(n)
    samples, sizes = np.concatenate(pcm), np.concatenate(sizes)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out: list = [None] * len(streams)
    upto = np.cumsum(np.concatenate(([0], [len(heads[d][2]) for d in seekable]))).astype(int)
    for i, d in enumerate(seekable):
        out[d] = samples[ends[upto[i]] : ends[upto[i + 1]]], sizes[upto[i] : upto[i + 1]]
    for d, (total, _, offsets, at) in enumerate(heads):
        if offsets is None:
            found, n = [], []
            while at < len(streams[d]) and len(found) < total:
                more, at = decode_frame(streams[d], at)
                found += more
                n.append(len(more))
            out[d] = np.array(found, np.int64), np.array(n, np.int64)
    results = []
    for (total, digest, _, _), (found, n) in zip(heads, out, strict=True):
        pcm = found.astype(np.int8).view(np.uint8)
        if len(pcm) != total or any(digest) and hashlib.md5(pcm).digest() != digest:
            raise Corrupt("samples don't match the stream's MD5")
        results.append(((pcm ^ 128).tobytes(), np.cumsum(n) - n, n))
    return results


def _decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row for each frame, filled up with 0) and sizes of frames."""
    count = len(start)
    if not count:
        return np.zeros((0, 1), np.int32), np.zeros(0, np.int64)
    byte = lambda i: data[start + i].astype(np.int64)
    plain = (byte(0) == 0xFF) & (byte(1) == 0xF8) & ((byte(2) & 15) < 12) & (byte(3) == 2)
    code, lead = byte(2) >> 4, byte(4)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    n = np.select([code == 1, code == 6, code == 7, code < 6], [192, byte(4 + more) + 1, (byte(4 + more) << 8 | byte(5 + more)) + 1, 144 << np.minimum(code, 5)], 1 << code)
    head = 4 + more + (code == 6) + 2 * (code == 7)
    if (_crcs(data, start, head, CRC8, 8)[plain] != data[start + head][plain]).any():
        raise Corrupt("header checksum")
    kind = data[start + head + 1].astype(np.int64)
    plain &= (kind & 0x81) == 0
    kind >>= 1
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    coded = (kind >= 8) & plain
    plain &= (kind <= 1) | (kind >= 8) & (kind <= 12) | lpc
    # 64 bits from each byte on, for fields of up to 57 bits
    window = data[:-8].astype(np.uint64)
    for i in range(1, 8):
        window = window << np.uint64(8) | data[i : i - 8]

    def read(bit: np.ndarray, width) -> np.ndarray:
        w = window[bit >> 3] << (bit & 7).astype(np.uint64)
        return (w >> np.asarray(64 - width, np.uint64)).astype(np.int64)

    samples = np.zeros((count, int(n.max())), np.int32)
    bit = (start + head + 2) * 8
    of = np.flatnonzero(plain & (kind == 0))
    samples[of] = np.where(np.arange(samples.shape[1]) < n[of][:, None], data[bit[of] >> 3].astype(np.int8)[:, None], 0)
    end = bit + 8
    of = np.flatnonzero(plain & (kind == 1))
    if len(of):
        row, col = np.nonzero(np.arange(samples.shape[1]) < n[of][:, None])
        samples[of[row], col] = data[(bit[of] >> 3)[row] + col].astype(np.int8)
        end[of] = bit[of] + 8 * n[of]
    rare = ~plain
    of = np.flatnonzero(plain & coded)
    if len(of):
        of = of[np.argsort(order[of] - n[of], kind="stable")]  # most residuals first
        p, o = bit[of], order[of]
        for j in range(int(o.max(initial=0))):
            has = np.flatnonzero(o > j)
            samples[of[has], j] = data[(p[has] >> 3) + j].astype(np.int8)
        p = p + 8 * o
        shift, weights = np.zeros(len(of), np.int64), np.zeros((len(of), 32), np.int64)
        for j, w in {1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.items():
            weights[(o == j) & ~lpc[of], :j] = w
        has = np.flatnonzero(lpc[of])
        if len(has):
            precision, q = read(p[has], 4) + 1, p[has]
            shift[has] = (read(q + 4, 5) ^ 16) - 16
            for j in range(int(o[has].max())):
                on = j < o[has]
                v = read(q[on] + 9 + precision[on] * j, precision[on])
                weights[has[on], j] = v - (v >> precision[on] - 1 << precision[on])
            p[has] = q + 9 + precision * o[has]
            rare[of[has[shift[has] < 0]]] = True
        method, parts = read(p, 2), read(p + 2, 4)
        wide = np.where(method == 1, 5, 4)
        p = p + 6
        part_size = n[of] >> parts
        left = part_size - o
        k = read(p, wide)
        rare[of[k == (1 << wide) - 1]] = True
        p = p + wide
        todo, several = n[of] - o, parts > 0
        residual = np.zeros((int(todo.max()), len(of)), np.int32)
        active, any_parts = len(of), bool(several.any())
        limit = np.int64((len(data) - 9) * 8)
        for t in range(len(residual)):
            while active and todo[active - 1] <= t:
                active -= 1
            if any_parts:
                new = np.flatnonzero(left[:active] == 0)
                while len(new):
                    k[new] = read(p[new], wide[new])
                    rare[of[new[k[new] == (1 << wide[new]) - 1]]] = True
                    p[new] += wide[new]
                    left[new] = part_size[new]
                    new = new[left[new] == 0]
                left[:active] -= 1
            at, ks = p[:active], k[:active]
            w = window[at >> 3] << (at & 7).astype(np.uint64)
            q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            far = np.flatnonzero(q >= 32)
            if len(far) or any_parts:
                for i in far:  # long runs of zero bits, one at a time
                    b = at[i] + 32
                    while b < limit and not data[b >> 3] >> (7 - (b & 7)) & 1:
                        b += 1
                    q[i] = b - at[i]
                w = window[np.minimum(at + q, limit) >> 3] << ((at + q) & 7).astype(np.uint64)
                w <<= np.uint64(1)
            else:
                w <<= (q + 1).astype(np.uint64)
            z = q << ks | np.where(ks > 0, (w >> (64 - np.maximum(ks, 1)).astype(np.uint64)).astype(np.int64), 0)
            residual[t, :active] = z >> 1 ^ -(z & 1)
            p[:active] = np.minimum(at + q + 1 + ks, limit)
        end[of] = p
        _predict(samples, residual, of, o, todo, shift, weights, lpc[of])
    end = end + 7 >> 3
    ok = ~rare
    crc = _crcs(data, start[ok], (end - start)[ok], CRC16, 16)
    if (crc != (data[end[ok]].astype(np.uint32) << 8 | data[end[ok] + 1])).any():
        raise Corrupt("frame checksum")
    for i in np.flatnonzero(rare):
        found, _ = decode_frame(data.tobytes(), int(start[i]))
        if len(found) > samples.shape[1]:
            samples = np.pad(samples, ((0, 0), (0, len(found) - samples.shape[1])))
        samples[i, : len(found)], n[i] = found, len(found)
        samples[i, len(found) :] = 0
    return samples, n


def _predict(samples: np.ndarray, residual: np.ndarray, of: np.ndarray, order: np.ndarray, todo: np.ndarray, shift: np.ndarray, weights: np.ndarray, lpc: np.ndarray) -> None:
    """Puts the samples of coded frames in place: running sums for fixed predictors, a sample of all frames at a time for linear ones."""
    for j in range(5):
        which = np.flatnonzero(~lpc & (order == j))
        if not len(which):
            continue
        d = residual[:, which].T
        if j:
            warm = samples[of[which], :j].astype(np.int64)
            for level in range(j - 1, -1, -1):  # the level-th difference at the last warm-up sample, then its running sum
                d = np.cumsum(d, axis=1, dtype=np.int64) + np.diff(warm, n=level, axis=1)[:, -1:]
        inside = np.arange(d.shape[1]) < todo[which][:, None]
        samples[of[which], j : j + d.shape[1]] = np.where(inside, d, 0)[:, : samples.shape[1] - j]
    for j in np.unique(order[lpc]):
        which = np.flatnonzero(lpc & (order == j))
        past = samples[of[which], :j].T[::-1].astype(np.int64)  # latest first
        w, s = weights[which, :j].T, shift[which]
        rows = np.zeros((int(todo[which].max()), len(which)), np.int32)
        active = len(which)
        ring = np.zeros((len(rows) + j, len(which)), np.int64)
        ring[:j] = past[::-1]
        for t in range(len(rows)):
            while active and todo[which[active - 1]] <= t:
                active -= 1
            total = w[0, :active] * ring[t + j - 1, :active]
            for i in range(1, j):
                total += w[i, :active] * ring[t + j - 1 - i, :active]
            ring[t + j, :active] = (total >> s[:active]) + residual[t, which[:active]]
        samples[of[which], j : j + len(rows)] = ring[j:].T


# --- columns ---------------------------------------------------------------------------------------------------------


def feature(payload: bytes) -> str:
    """Samples, least, largest, sum, sum of squares and changes of sign, of the payload as samples b - 128."""
    least, largest, total, squares, changes, before = 127, -128, 0, 0, 0, None
    for i in range(0, len(payload), 1 << 20):
        x = np.frombuffer(payload[i : i + (1 << 20)], np.uint8).astype(np.int32) - 128
        below = np.concatenate(([x[0] < 0 if before is None else before], x < 0))
        least, largest, total, squares, changes, before = min(least, int(x.min())), max(largest, int(x.max())), total + int(x.sum(dtype=np.int64)), squares + int((x * x).sum(dtype=np.int64)), changes + int((below[1:] != below[:-1]).sum()), below[-1]
    return f"n={len(payload)};min={least};max={largest};sum={total};sq={squares};zc={changes}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media, the FLAC stream of the text's UTF-8 bytes padded with zeros to a positive multiple of 64 (null: empty)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        streams = encode([padded(x) for x in texts(part.column("text"))])
        return pa.record_batch([part.column("id"), pa.array(lengths(part.column("text"))), pa.array(streams, pa.binary())], ["id", "n_bytes", "media"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", "id long, n_bytes long, media binary", work)


def blocks(media: DataFrame) -> DataFrame:
    """The PCM blocks of ``media(id, media)``: id, block_no, first_sample, n_samples, pcm (signed bytes). A block can be sought by its sample offset. Null media and streams without samples have none; repeated rows keep their blocks, an empty table gives none."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, b, int(a), int(n), (np.frombuffer(payload, np.uint8)[a : a + n] ^ 128).tobytes()) for i, (payload, first, size) in zip(part.column("id").to_pylist(), decode(part.column("media").to_pylist()), strict=True) for b, (a, n) in enumerate(zip(first, size, strict=True))]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "block_no", "first_sample", "n_samples", "pcm"])

    return map_batches(media.select("id", "media").where("media is not null"), "media", "id long, block_no int, first_sample long, n_samples int, pcm binary", work)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text is stored as by ``store`` and what is stored is read back with all checksums verified; payload values are of the bytes read back. Null counts as
    empty (64 zero bytes). Equal texts have equal values, repeated rows keep their rows, an empty table gives none, other columns are ignored.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        media = encode([padded(x) for x in texts(part.column("text"))])
        back = [payload for payload, _, _ in decode(media)]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        size = lambda xs: pa.array([len(x) for x in xs], pa.int64())
        columns = [part.column("id"), pa.array(lengths(part.column("text"))), size(back), sha(back), pa.array([zlib.crc32(x[-PAD:]) for x in back], pa.int64()), size(media), sha(media), pa.array(map(feature, back), pa.string())]
        return pa.record_batch(columns, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", schema, work)
