"""32-bit hashes over characters: FNV-1a, SimHash and Hamming distance."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.vectorized import vectorized

OFFSET, PRIME, MASK = 2166136261, 16777619, 4294967295


def fnv1a(text: Column) -> Column:
    """FNV-1a over code points as a long of 32 bits; null for null. For words: long texts take fnv1a_long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
    return F.when(text == "", F.lit(OFFSET).cast("long")).otherwise(F.aggregate(codes, F.lit(OFFSET).cast("long"), step))


def fnv1a_codes(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """fnv1a of texts that stand one behind the other as code points (uint32), ``size`` of each: the n-th ones of all at once."""
    order = np.argsort(-size, kind="stable")
    flat, start, size = np.append(flat, np.uint32(0)), (np.cumsum(size) - size)[order], size[order]
    hashes, active = np.full(len(size), OFFSET, np.uint64), len(size)
    for n in range(int(size[0]) if len(size) else 0):
        while size[active - 1] <= n:
            active -= 1
        hashes[:active] = (hashes[:active] ^ flat[start[:active] + n]) * np.uint64(PRIME) & np.uint64(MASK)
    found = np.empty_like(hashes)
    found[order] = hashes
    return found


@vectorized("bigint")
def fnv1a_long(text: pd.Series) -> pd.Series:
    """fnv1a for long texts: the n-th code points of all texts of a batch at once, in runs of bounded size."""
    found, rows, held = [None] * len(text), [], 0

    def close() -> None:
        codes = [np.frombuffer(text.iloc[i].encode("utf-32-le"), np.uint32) for i in rows]
        hashes = fnv1a_codes(np.concatenate(codes), np.array([len(c) for c in codes], np.int64))
        for i, h in zip(rows, hashes.tolist(), strict=True):
            found[i] = h

    for i, t in enumerate(text):
        if t is None:
            continue
        rows.append(i)
        held += len(t)
        if held > 1 << 21:
            close()
            rows, held = [], 0
    if rows:
        close()
    return pd.Series(found, dtype="Int64")


def hex8(value: Column) -> Column:
    """At least eight digits; longer values are not cut."""
    digits = F.lower(F.hex(value))
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tokens(text: Column) -> Column:
    """Latin words of 2 to 31 characters, and pairs of neighbouring Han characters."""
    lower = F.lower(text)
    latin = F.regexp_extract_all(lower, F.lit(r"[a-z\d][a-z\d-]{1,30}"), F.lit(0))
    runs = F.regexp_extract_all(lower, F.lit(r"[\p{IsHan}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, pairs)


VOTES = [f"v{b}" for b in range(32)]


def simhash_votes(words: pa.Array, start: np.ndarray) -> list[np.ndarray]:
    """For each of 32 bits the vote of the words from each ``start`` to the next (at least one): those whose hash has it against the others. Different words are hashed once; two bits are added up in one number."""
    coded = words.dictionary_encode()
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(coded.dictionary.to_pylist()).encode("utf-32-le"), np.uint32)
    hashes, codes = fnv1a_codes(flat, lengths), coded.indices.to_numpy(zero_copy_only=False)
    count, one = np.diff(np.append(start, len(codes))), np.uint64(1)
    low, high = [], []
    for b in range(16):
        pair = (hashes >> np.uint64(b) & one) | (hashes >> np.uint64(b + 16) & one) << np.uint64(32)
        sums = np.add.reduceat(pair[codes], start)
        low.append(2 * (sums & np.uint64(MASK)).astype(np.int64) - count)
        high.append(2 * (sums >> np.uint64(32)).astype(np.int64) - count)
    return low + high


def simhash_of_votes() -> Column:
    value = F.lit(0).cast("long")
    for b in range(32):
        value = value + F.when(F.col(f"v{b}") >= 0, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return value


def band_keys(value: Column, bands: int = 8, together: int = 3) -> Column:
    """A key for each ``together`` of the equally wide bands of 32 bits: values that differ in at most ``bands - together`` bits share one. Eight bands by threes
    make 56 keys of 12 bits."""
    width = 32 // bands
    part = [F.shiftrightunsigned(value, b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for b in range(bands)]
    keys = []
    for i, chosen in enumerate(itertools.combinations(part, together)):
        key = F.lit(i).cast("long")
        for bits in chosen:
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)
