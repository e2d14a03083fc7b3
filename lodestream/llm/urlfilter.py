"""URL filters by a Bloom filter cascade: exact membership of listed keys over the corpus's complete key universe, without joins.

Odd levels encode listed keys, even levels the other keys that the level before lets through by mistake, until there are none. A key of the
universe is listed if the first level that rejects it is an even one, or if it passes all of an odd number of levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint, map_batches

#: Rules are a list of the driver's. A cascade, and what is broadcast to build it, is for so many of them at most; more rules have several cascades.
MOST_RULES = 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bloom:
    def __init__(self, expected: int, false_rate: float, level: int):
        self.bits = max(64, math.ceil(-max(1, expected) * math.log(false_rate) / math.log(2) ** 2) + 63 & ~63)
        self.hashes = max(1, round(self.bits / max(1, expected) * math.log(2))) if false_rate < 0.5 else 1
        self.hashes = min(self.hashes, 24)
        self.level = level
        self.words = np.zeros(self.bits // 64, np.uint64)

    def places(self, key: str) -> list[int]:
        raw = key.encode()
        a, b = xxhash.xxh64_intdigest(raw, 2 * self.level), xxhash.xxh64_intdigest(raw, 2 * self.level + 1) | 1
        return [(a + i * b) % (1 << 64) % self.bits for i in range(self.hashes)]

    def add(self, key: str) -> None:
        for p in self.places(key):
            self.words[p >> 6] |= np.uint64(1 << (p & 63))

    def __contains__(self, key: str) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in self.places(key))


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def build(listed: set[str], universe: DataFrame) -> Cascade:
    """A cascade of ``listed`` over the distinct keys of ``universe(key)``: exact for them and for the listed keys.

    Keys outside the list never reach the driver: a level of them comes as the set words of its bits, whose number the first level's rate holds near the list's.
    """
    context = universe.sparkSession.sparkContext
    size = universe.count()
    levels = [Bloom(len(listed), min(0.5, max(1e-6, len(listed) / max(1, size))), 1)]
    for key in listed:
        levels[0].add(key)
    shared_list = context.broadcast(listed)
    inside, wrong = listed, universe
    while True:
        wrong = _let_through(wrong, context.broadcast(levels[-1]), shared_list if len(levels) == 1 else None)
        wrong = checkpoint(wrong)
        n = wrong.count()
        if not n:
            return Cascade(levels)
        level = Bloom(n, 0.5, len(levels) + 1)
        for word, bits in _set_words(wrong, level).collect():  # no more than the level has words
            level.words[word] = np.uint64(bits & (1 << 64) - 1)
        levels.append(level)
        inside = {x for x in inside if x in level}
        if not inside:
            return Cascade(levels)
        levels.append(Bloom(len(inside), 0.5, len(levels) + 1))
        for key in inside:
            levels[-1].add(key)


class Cascades:
    """Those of blocks of listed keys: a key is listed if it is in one of them."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    def __contains__(self, key: str) -> bool:
        return any(key in x for x in self.parts)


def build_all(listed: set[str], universe: DataFrame) -> Cascades:
    keys = sorted(listed)
    return Cascades([build(set(keys[i : i + MOST_RULES]), universe) for i in range(0, max(1, len(keys)), MOST_RULES)])


def _let_through(keys: DataFrame, level, listed=None) -> DataFrame:
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for x in part.column("key").to_pylist() if x in level.value and (listed is None or x not in listed.value)]
        return pa.record_batch([pa.array(found, pa.string())], ["key"])

    return map_batches(keys, "key", "key string", work)


def _set_words(keys: DataFrame, level: Bloom) -> DataFrame:
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        places = np.array([p for x in part.column("key").to_pylist() for p in level.places(x)], np.int64)
        bits = np.left_shift(np.uint64(1), (places & 63).astype(np.uint64)).view(np.int64)
        return pa.record_batch([pa.array(places >> 6), pa.array(bits)], ["word", "bits"])

    return map_batches(keys, "key", "word long, bits long", work).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def parsed(pages: DataFrame, url_col: str = "url") -> tuple:
    """Columns host and path: host after the first :// up to / ? # or the end, A-Z as lower case; path from there up to ? or #. Null or no ://: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, pattern, 2).alias("path")


def candidates(path_lengths: list[int]) -> Callable[[str, str], list[str]]:
    """Rule keys that fit a host and path, longest first: each label suffix of the host with each path prefix as long as some rule's."""

    def of(host: str, path: str) -> list[str]:
        labels = host.split(".")
        suffixes = [".".join(labels[i:]) for i in range(len(labels))]
        found = {s + path[:n] for s in suffixes for n in path_lengths if n <= len(path)} if host else set()
        return sorted(found, key=lambda x: (-len(x), x))

    return of


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``rules``: (verdict, key), key a host followed by a path from its slash. A rule fits its host and all subdomains where the path starts with its path;
    the longest wins, and ``default`` holds where none fits: the cascade says that no key of the url is listed. Null and hostless urls get the
    default. Repeated rows keep their rows, an empty table gives none, other columns are ignored. A host of a third of all rows costs no more:
    keys are made distinct in each task before the shuffle.
    """
    lengths = sorted({len(key) - key.index("/") for _, key in rules})
    keys_of = candidates(lengths)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *parsed(pages, url_col))

    def keys(part: pa.RecordBatch) -> pa.RecordBatch:
        pairs = set(zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True))
        found = sorted({k for host, path in pairs for k in keys_of(host, path)})
        return pa.record_batch([pa.array(found, pa.string())], ["key"])

    universe = checkpoint(map_batches(rows.select("host", "path"), "path", "key string", keys).distinct())
    listed = {key for _, key in rules}
    context = pages.sparkSession.sparkContext
    verdicts = sorted({v for v, _ in rules})
    known = context.broadcast(build_all(listed, universe))
    # which verdict a listed key has: a cascade for each but the last, over the listed keys
    among = pages.sparkSession.createDataFrame([(k,) for k in sorted(listed)], "key string") if listed else universe.limit(0)
    with_verdict = context.broadcast([(v, build_all({k for w, k in rules if w == v}, among)) for v in verdicts[:-1]])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rule_of: dict[tuple[str, str], tuple[str | None, str]] = {}
        out = []
        for pair in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True):
            if pair not in rule_of:
                rule = next((k for k in keys_of(*pair) if k in known.value), None)
                verdict = default if rule is None else next((v for v, c in with_verdict.value if rule in c), verdicts[-1])
                rule_of[pair] = (rule, verdict)
            out.append(rule_of[pair])
        rule, verdict = zip(*out, strict=True)
        return pa.record_batch([part.column("id"), part.column("host"), part.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return map_batches(rows, "path", "id long, host string, path string, rule string, verdict string", work)
