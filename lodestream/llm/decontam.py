"""Benchmark decontamination: a prefix-filtered containment join of benchmark windows with whole documents.

A window is contained exactly or not at all, so of its shingles, ordered by rarity over all documents, one prefix shingle is
necessary: the rarest. Windows are indexed by it alone. A document's occurrence of it puts the window at one place; the length
and positional bounds say whether it fits there, and the words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint, filter_batches, map_batches, texts

WINDOW, SHINGLE = 10, 3
#: Bytes of benchmark text in one index, which is broadcast (some 10 bytes a byte); a larger benchmark is worked through in blocks of items.
BLOCK_BYTES = 12 << 20
#: What words consist of: ASCII letters (as lower case), digits, and every character beyond ASCII.
WORD_BYTES = bytes(b | 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Index:
    """Windows of items as places in one array of word numbers (from 1; 0: not in any item). Equal windows are one, with all their items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.number: dict[bytes, int] = {}
        self.items: list[str] = []
        number, parts, size = self.number, [], []
        for item, text in items:
            found = words(text)
            if found:
                parts.append(np.array([number.setdefault(w, len(number) + 1) for w in found], np.int32))
                size.append(len(found))
                self.items.append(item)
        self.base = len(number) + 1
        self.flat = np.concatenate([*parts, np.zeros(WINDOW, np.int32)])
        size = np.array(size, np.int64)
        begin = np.cumsum(size) - size
        each = np.maximum(1, size - WINDOW + 1)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), each)
        start = (np.arange(each.sum()) + np.repeat(begin - (np.cumsum(each) - each), each)).astype(np.int32)
        length = np.minimum(WINDOW, size)[owner].astype(np.int8)
        order = np.argsort(self._mixed(start, length), kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        first = np.ones(len(start), bool)
        first[1:] = length[1:] != length[:-1]
        for j in range(WINDOW):
            first[1:] |= (self.flat[start[1:] + j] != self.flat[start[:-1] + j]) & (j < length[1:])
        self.start, self.length = start[first], length[first]
        self.owner, self.owned = owner, np.append(np.flatnonzero(first), len(first))
        #: of each shingle length the sorted codes of the windows' shingles
        self.codes = {k: np.unique(self._codes(self.flat, k)[0][self._inside(k)]) for k in range(1, SHINGLE + 1)}
        self.sizes = {k: len(c) for k, c in self.codes.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _mixed(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of each window, so that equal ones come together."""
        mixed = length.astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                mixed = (mixed ^ np.where(j < length, self.flat[start + j], 0).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        return mixed

    def _of(self, k: int) -> np.ndarray:
        """The windows whose shingles have k words: SHINGLE, or all of fewer."""
        return np.flatnonzero(np.minimum(SHINGLE, self.length) == k)

    def _inside(self, k: int) -> np.ndarray:
        """Places where a shingle of k words of some window begins."""
        at = np.zeros(len(self.flat), bool)
        which = self._of(k)
        for j in range(WINDOW - k + 1):
            at[self.start[which[self.length[which] >= j + k]] + j] = True
        return np.flatnonzero(at)

    def _codes(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A number for each run of k words (equal runs have equal ones), and whether all its words are in items."""
        n = max(0, len(ids) - k + 1)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for i in range(k):
                code = code * self.base + ids[i : i + n]
                known &= ids[i : i + n] > 0
        return code, known

    def numbers(self, text: bytes) -> np.ndarray:
        get, found = self.number.get, words(text)
        return np.array([get(w, 0) for w in found], np.int64)

    def shingles(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document's shingles that are in a window, and their numbers among ``codes[k]``."""
        codes = self.codes[k]
        if not len(codes) or len(ids) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, known = self._codes(ids, k)
        at = np.flatnonzero(known)
        place = np.minimum(np.searchsorted(codes, found[at]), len(codes) - 1)
        hit = codes[place] == found[at]
        return at[hit], place[hit]

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Takes as each window's prefix its rarest shingle by ``counts`` (ties: the first)."""
        for k, codes in self.codes.items():
            which, inside = self._of(k), self._inside(k)
            shingle_at = np.zeros(len(self.flat), np.int32)
            shingle_at[inside] = np.searchsorted(codes, self._codes(self.flat, k)[0][inside])
            start, last = self.start[which], self.length[which] - k
            offset, shingle = np.zeros(len(which), np.int8), shingle_at[start]
            least = counts[k][shingle]
            for j in range(1, WINDOW - k + 1):
                other = shingle_at[start + np.minimum(j, last)]
                fewer = counts[k][other] < least
                offset[fewer], shingle[fewer] = j, other[fewer]
                least = np.where(fewer, counts[k][other], least)
            by_shingle = np.argsort(shingle, kind="stable")
            first = np.searchsorted(shingle[by_shingle], np.arange(len(codes) + 1)).astype(np.int32)
            self.prefix[k] = (first[:-1], np.diff(first), which[by_shingle].astype(np.int32), offset[by_shingle])

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence of a window."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.codes:
            at, shingle = self.shingles(ids, k)
            first, size, window, offset = self.prefix[k]
            for i in range(0, len(at), 1 << 14):
                n = size[shingle[i : i + (1 << 14)]]
                posting = np.repeat(first[shingle[i : i + (1 << 14)]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                w = window[posting]
                start = np.repeat(at[i : i + (1 << 14)], n) - offset[posting]
                fits = (start >= 0) & (start + self.length[w] <= len(ids))
                start, w = start[fits], w[fits]
                for j in range(WINDOW):
                    same = (self.length[w] <= j) | (ids[np.minimum(start + j, len(ids) - 1)] == self.flat[self.start[w] + j])
                    start, w = start[same], w[same]
                starts.append(start)
                windows.append(w)
        return np.concatenate(starts), np.concatenate(windows)

    def scan(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray, set[str]]:
        """Words of a text, starts and ends of what is hit, and the items that hit."""
        ids = self.numbers(text)
        start, window = self.matches(ids) if len(ids) else (np.zeros(0, np.int64),) * 2
        hit = np.unique(window)
        owners = np.unique(np.concatenate([self.owner[self.owned[w] : self.owned[w + 1]] for w in hit])) if len(hit) else ()
        return len(ids), start, start + self.length[window], {self.items[i] for i in owners}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size, one after the other; items without id or text have no windows."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.encode(F.col(text_col), "UTF-8").alias("text")).where("item is not null and text is not null")
    n = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_BYTES
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).toArrow()  # BLOCK_BYTES of text or so
        yield list(zip(block.column("item").to_pylist(), block.column("text").to_pylist(), strict=True))


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str):
    """Broadcast indexes, ordered by how often each shingle occurs in all of ``docs(text)``."""
    context = docs.sparkSession.sparkContext
    for items in _blocks(benchmark, item_col, text_col):
        index = Index(items)
        counts = {k: np.zeros(n, np.int64) for k, n in index.sizes.items()}
        if len(index.start):
            bare = context.broadcast(index)

            def work(part: pa.RecordBatch, bare=bare) -> pa.RecordBatch:
                index = bare.value
                counts = {k: np.zeros(n, np.int64) for k, n in index.sizes.items()}
                for text in texts(part.column("text")):
                    ids = index.numbers(text)
                    for k, total in counts.items():
                        np.add.at(total, index.shingles(ids, k)[1], 1)
                rows = [(np.full(len(i := np.flatnonzero(c)), k), i, c[i]) for k, c in counts.items()]
                return pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows, strict=True)], ["k", "shingle", "n"])

            counted = map_batches(docs.select("text"), "text", "k long, shingle long, n long", work).groupBy("k", "shingle").agg(F.sum("n").alias("n")).toArrow()  # no more rows than the block has shingles
            which, shingle, n = (counted.column(i).to_numpy() for i in range(3))
            for k in counts:
                counts[k][shingle[which == k]] = n[which == k]
            bare.destroy()
        index.order(counts)
        yield context.broadcast(index)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, items, starts, ends (the hit windows' words, from 0).

    A null text has no words; items without words, id or text have no windows; items that share a window are both found. With an
    empty benchmark nothing is hit, an empty table gives no row, repeated rows keep their rows, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_words long, items array<string>, starts array<int>, ends array<int>"
    if _large(benchmark, item_text_col):
        rows = checkpoint(rows.withColumn("id", F.struct("id", F.monotonically_increasing_id().alias("row"))))
        schema = schema.replace("id long", "id struct<id:bigint,row:bigint>")
    found = None
    for shared in _indexes(rows, benchmark, item_col, item_text_col):

        def work(part: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            n, starts, ends, items = zip(*map(shared.value.scan, texts(part.column("text"))), strict=True)
            columns = [part.column("id"), pa.array(n, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            return pa.record_batch(columns + [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)], ["id", "n_words", "items", "starts", "ends"])

        block = map_batches(rows, "text", schema, work)
        found = block if found is None else found.unionByName(block)
    if "struct" in schema:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "starts", "ends")]
        found = found.groupBy("id").agg(F.max("n_words").alias("n_words"), *lists).withColumn("id", F.col("id.id"))
    items = F.array_sort(F.array_distinct("items"))
    out = found.withColumns({"items": items, "items_sha256": F.sha2(F.array_join(items, ","), 256), "n_items": F.size(items).cast("long"), "contaminated": F.size("starts") > 0})
    return out.withColumn("n_hit", _union_length()).select("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "starts", "ends")


def _union_length():
    """Words in the union of the intervals of starts and ends."""
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(s["starts"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["ends"]).alias("upto"))
    return F.when(F.size("starts") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(spans, zero, step)["n"])


def _large(benchmark: DataFrame, text_col: str) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) >= BLOCK_BYTES


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that hold no window of the benchmark. A large benchmark is worked through in blocks, with the rows kept so far written between."""
    large = _large(benchmark, item_text_col)
    for shared in _indexes(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col):
        docs = filter_batches(docs, text_col, lambda part, shared=shared: np.array([not len(shared.value.scan(x)[1]) for x in texts(part.column(text_col))], bool))
        docs = checkpoint(docs) if large else docs
    return docs
