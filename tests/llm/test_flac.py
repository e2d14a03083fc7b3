from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestream.llm import flac, queries

SF = "/root/testdata/sf0.001"


def kinds(stream: bytes) -> Counter:
    """Subframe types of a stream's frames."""
    found = Counter()
    for at in flac._metadata(stream)[2]:
        more = 1 if stream[at + 4] < 0x80 else 2 if stream[at + 4] < 0xE0 else 3
        head = at + 4 + more + {6: 1, 7: 2}.get(stream[at + 2] >> 4, 0) + 1
        found[stream[head] >> 1] += 1
    return found


def plain(stream: bytes) -> bytes:
    """The payload by the bit-by-bit reader."""
    total, _, _, at = flac._metadata(stream)
    found: list[int] = []
    while len(found) < total:
        more, at = flac.decode_frame(stream, at)
        found += more
    assert at == len(stream)
    return bytes(s + 128 for s in found)


def samples():
    rng = np.random.default_rng(4)
    wave = (100 * np.sin(np.arange(5000) / 30) + 128).astype(np.uint8).tobytes()
    ramp = bytes(i // 8 % 256 for i in range(4000))
    text = ("Some ordinary words of a text, und noch mehr davon. " * 60).encode()
    return [flac.padded(x) for x in (b"", b"a" * 64, wave, ramp, text, rng.integers(0, 256, 3000).astype(np.uint8).tobytes(), bytes(2048), b"\xff\x00" * 700, rng.integers(100, 110, 9000).astype(np.uint8).tobytes())]


def test_both_readers_and_all_predictors():
    payloads = samples()
    streams = flac.encode(payloads)
    assert [p for p, _, _ in flac.decode(streams)] == payloads
    assert [plain(s) for s in streams] == payloads
    seen = sum(map(kinds, streams), Counter())
    assert seen[0] and seen[1] and seen[32 + 3] and (seen[8] or seen[9] or seen[10])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=2500), min_size=1, max_size=4))
def test_any_bytes(raw):
    payloads = [flac.padded(x) for x in raw]
    streams = flac.encode(payloads)
    assert [p for p, _, _ in flac.decode(streams)] == payloads
    assert [flac.encode([p])[0] for p in payloads] == streams  # a stream depends on its payload alone


def bits(*fields: tuple[int, int]) -> bytes:
    value = "".join(format(v & (1 << n) - 1, f"0{n}b") for v, n in fields)
    value += "0" * (-len(value) % 8)
    return int(value, 2).to_bytes(len(value) // 8, "big")


def crc(data: bytes, table, width) -> int:
    return int(flac._crcs(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]), table, width)[0])


def frame(n: int, *fields: tuple[int, int]) -> bytes:
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0, n - 1])
    head += bytes([crc(head, flac.CRC8, 8)])
    body = head + bits(*fields)
    return body + crc(body, flac.CRC16, 16).to_bytes(2, "big")


def stream(frames: list[bytes], sizes: list[int], seek: bool) -> bytes:
    import struct

    total = sum(sizes)
    info = struct.pack(">HH", 16, 1024) + bytes(6) + (8000 << 44 | 7 << 36 | total).to_bytes(8, "big") + bytes(16)
    out, first, offset, points = b"fLaC" + flac._block(0, info, not seek), 0, 0, b""
    for f, n in zip(frames, sizes, strict=True):
        points += struct.pack(">QQH", first, offset, n)
        first, offset = first + n, offset + len(f)
    return out + (flac._block(3, points, True) if seek else b"") + b"".join(frames)


def test_frames_of_other_writers():
    """Hand-made frames: two partitions with their own parameters, an escape partition, a wasted bit, a long unary code, 5-bit parameters."""
    zigzag = lambda v: (v << 1) ^ (v >> 31)
    rice = lambda v, k: [(0, zigzag(v) >> k), (1, 1), (zigzag(v) & (1 << k) - 1, k)]
    code = lambda vs, k: [x for v in vs for x in rice(v, k) if x[1]]
    values = [3, -2, 0, 5, 1, -1, 7, 2]
    two = frame(8, (8 << 1, 8), (0, 2), (1, 4), (2, 4), *code(values[:4], 2), (0, 4), *code(values[4:], 0))
    escape = frame(8, (8 << 1, 8), (0, 2), (0, 4), (15, 4), (6, 5), *((v, 6) for v in values))
    wasted = frame(8, (1 << 1 | 1, 8), (1, 1), *((v, 7) for v in values))
    far = frame(8, (8 << 1, 8), (1, 2), (0, 4), (0, 5), *code([100, *values[1:]], 0))
    want = [*values, *values, *(v * 2 for v in values), 100, *values[1:]]
    for seek in (True, False):
        payload, first, sizes = flac.decode([stream([two, escape, wasted, far], [8] * 4, seek)])[0]
        assert [b - 128 for b in payload] == want and list(first) == [0, 8, 16, 24] and list(sizes) == [8] * 4


def test_damage_is_found():
    good = flac.encode([flac.padded(b"some words " * 300)])[0]
    at = flac._metadata(good)[3]
    for place in (at + 2, at + 5, at + 40, len(good) - 1, 30):
        bad = bytearray(good)
        bad[place] ^= 8
        with pytest.raises((flac.Corrupt, IndexError)):
            flac.decode([bytes(bad)])


def test_columns(documents, odd, empty, spark):
    for df in (documents.select("doc_id", "text"), odd):
        rows = flac.digests(df).collect()
        want = Counter()
        for r in df.collect():
            raw = (r.text or "").encode()
            p = flac.padded(raw)
            want[(r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), flac.feature(p))] += 1
        assert Counter((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in rows) == want
        assert len({(r.payload_sha256, r.media_sha256, r.media_bytes) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert flac.digests(empty).count() == 0
    assert queries.op9_flac_media(spark, SF).columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_blocks_can_be_sought(odd):
    rows = flac.blocks(flac.store(odd.where("doc_id in (7, 4)"))).collect()
    long = sorted((r.first_sample, r.n_samples, bytes(r.pcm)) for r in rows if r.id == 7)
    payload = flac.padded(b"word " * 60_000)
    assert all(bytes(x ^ 128 for x in pcm) == payload[a : a + n] for a, n, pcm in long)
    assert sum(n for _, n, _ in long) == len(payload) and [r.n_samples for r in rows if r.id == 4] == [64]


def test_blocks_of_odd_streams(odd, spark):
    schema = "id long, media binary, first_sample string"
    bare = stream([], [], False)
    assert flac.blocks(spark.createDataFrame([(1, bare, "x"), (2, None, "x"), (3, bare, None)], schema)).count() == 0
    assert flac.blocks(spark.createDataFrame([], schema)).count() == 0
    twice = flac.store(odd.where("doc_id in (1, 4)"))
    assert sorted((r.id, r.n_samples) for r in flac.blocks(twice).collect()) == [(1, 64), (1, 64), (4, 64)]


def test_memory_of_a_long_text():
    import tracemalloc

    payload = flac.padded(b"Some ordinary words of a text, und noch mehr davon. " * 400_000)
    tracemalloc.start()
    (stream,) = flac.encode([payload])
    ((back, first, size),) = flac.decode([stream])
    assert back == payload and size.sum() == len(payload) and (first == np.cumsum(size) - size).all()
    flac.feature(back)
    assert tracemalloc.get_traced_memory()[1] < 280 << 20
    tracemalloc.stop()
