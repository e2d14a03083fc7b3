"""Near-duplicates by SimHash, with an exact check by the Jaccard similarity of word shingle sets, and what SimHash can't see.

The SimHash operator's links over fingerprints of 5-word shingles are checked by whole sets: they join most copies into groups. Fingerprints of 64 bits
are some 10 bits apart at a similarity of 0.8, where no filter on them is selective, so the pairs that they miss come from prefix filtering, which loses none: two
sets that are SIMILAR share a shingle among the first fifth (and one more) of each in any order that all sets have in common. The order is by how
common a shingle's bucket is, so passages of many texts come last. Sizes and places bound the overlap of candidates, and so do the differing bits of parity
bitmaps of whole sets, of which each member turns one bit; then whole sets are compared. Large groups are linked by fingerprints, along chains and by each
text's nearest ones in a bucket first; after that only pairs of different groups that all bounds let through are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import bound_batches, checkpoint, map_batches, slices, texts
from lodestream.llm.simhash import candidate_pairs, components

SEED, SHINGLE = 42, 5
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Bits of a shingle's hash that name its bucket in the table of counts that the driver holds.
COUNTED = 18
#: Words of 64 bits of a text's parity bitmap.
WORDS = 4


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the shingles of a text's ASCII-lower-cased words, sorted. Fewer words than a shingle, or none: the whole sequence is the only one."""
    words = text.lower().split()
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in shingles), "<u8", count=max(1, len(words) - size + 1)))


def _enough(overlap: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of ``both`` members together that share ``overlap`` are SIMILAR."""
    return overlap * sum(SIMILAR) >= both * SIMILAR[0]


def _possible(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members may be SIMILAR if places p and q hold the first that they share."""
    return _enough(np.minimum(n - p, m - q), n + m)


def _parity(shingles: np.ndarray) -> np.ndarray:
    """WORDS numbers: a bitmap in which each member of a set turns one bit. Two of them differ in no more bits than the sets in members."""
    return np.packbits(np.bincount((shingles % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1, bitorder="little").view("<u8")


def _near(n: np.ndarray, m: np.ndarray, bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members may be SIMILAR by their bitmaps."""
    both = n.astype(np.int64) + m
    return np.bitwise_count(bits ^ others).sum(axis=-1, dtype=np.int64) * sum(SIMILAR) <= both * (sum(SIMILAR) - 2 * SIMILAR[0])


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in columns], names.split())


def _counts(rows: DataFrame) -> np.ndarray:
    """Shingles of all rows by bucket: 2**COUNTED numbers, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << COUNTED, np.int64)
        for batch in batches:
            for text in texts(batch.column("text")):
                np.add.at(found, (shingle_set(text) >> np.uint64(64 - COUNTED)).astype(np.int64), 1)
        at = np.flatnonzero(found)
        yield _batch("bucket n", at, found[at])

    counts = np.zeros(1 << COUNTED, np.int64)
    for r in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return counts


def _prefixes(rows: DataFrame) -> DataFrame:
    """(k, c, n, p): the shingles of each text's prefix, the text's hash, its number of shingles and the place. A task gives each text once.

    Rows with p under 0 have the words of the text's bitmap that aren't zero: -1 the first, -2 the second, and so on.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_counts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, size, ids, places = [], [], [], []
                for c, text in zip(part.column("c").to_pylist(), texts(part.column("text")), strict=True):
                    if c in seen:
                        continue
                    seen.add(c)
                    s = shingle_set(text)
                    length = len(s) - -(-len(s) * SIMILAR[0] // SIMILAR[1]) + 1
                    parity = _parity(s)
                    words = np.flatnonzero(parity)
                    keys.append(np.concatenate((s[np.lexsort((s, counts[(s >> np.uint64(64 - COUNTED)).astype(np.int64)]))[:length]], parity[words])))
                    places.append(np.concatenate((np.arange(length), -1 - words)).astype(np.int32))
                    size.append(len(s))
                    ids.append(c)
                if keys:
                    each = [len(x) for x in keys]
                    yield _batch("k c n p", np.concatenate(keys).view("<i8"), np.repeat(np.array(ids, np.int64), each), np.repeat(np.array(size, np.int32), each), np.concatenate(places))

    return rows.mapInArrow(run, "k long, c long, n int, p int")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first, cut only where it changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or held and held[-1][0][-1] != columns[0][-1]:
            held.append([x[:cut] for x in columns])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([x[cut:] for x in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, c, n, p) sorted by k and c: those whose k two texts have at least, and all of bitmaps."""
    for run in _whole_runs(batches):
        bitmap = run[3] < 0
        if bitmap.any():
            yield _batch("k c n p", *(x[bitmap] for x in run))
        k, c, n, p = (x[~bitmap] for x in run)
        if not len(k):
            continue
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        k, c, n, p = k[once], c[once], n[once], p[once]
        same = k[1:] == k[:-1]
        some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if some.any():
            yield _batch("k c n p", k[some], c[some], n[some], p[some])


def _bits(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns, 1).view(np.uint64)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, c, n, p, bitmap) sorted by k and n: candidates among neighbours."""
    for k, c, n, p, *words in _whole_runs(batches):
        bits = _bits(words)
        near = np.flatnonzero((k[1:] == k[:-1]) & _possible(n[1:], p[1:], n[:-1], p[:-1]) & _near(n[1:], n[:-1], bits[1:], bits[:-1]))
        if len(near):
            yield _batch("a b", np.minimum(c[near], c[near + 1]), np.maximum(c[near], c[near + 1]))


def _across(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (k, c, n, p, bitmap, root) sorted by k and root: all candidates of different roots, or of each row but the largest root's only the
    ``nearest`` by bitmaps, of all and of the largest root."""
    for k, c, n, p, *words, root in _whole_runs(batches):
        bits = _bits(words)
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        for a, z in zip(starts, np.append(starts[1:], len(k)), strict=True):
            if root[a] == root[z - 1]:
                continue
            # each root's rows with all rows after them, but those of the largest root last
            roots, first, size = np.unique(root[a:z], return_index=True, return_counts=True)
            largest = int(size.argmax())
            order = np.concatenate([np.arange(f, f + s) for i, (f, s) in enumerate(zip(first, size, strict=True)) if i != largest] + [np.arange(first[largest], first[largest] + size[largest])]) + a
            oc, on, op, ob, oroot = c[order], n[order], p[order], bits[order], root[order]
            for i in range(len(order) - int(size[largest])):
                later = slice(i + 1, None)
                found = np.flatnonzero((oroot[later] != oroot[i]) & _possible(on[i], op[i], on[later], op[later])) + i + 1
                found = found[_near(on[i], on[found], ob[i], ob[found])]
                if nearest and len(found):
                    apart = np.bitwise_count(ob[i] ^ ob[found]).sum(axis=1) / (on[i] + on[found])
                    inside = found >= len(order) - int(size[largest])
                    found = np.unique([found[apart.argmin()], *found[inside][apart[inside].argsort()[:1]]])
                if len(found):
                    yield _batch("a b", np.minimum(oc[i], oc[found]), np.maximum(oc[i], oc[found]))


def _similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole shingle sets are SIMILAR."""
    pairs = checkpoint(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    whole = rows.join(needed, "c", "left_semi").dropDuplicates(["c"])
    both = pairs.join(whole.select(F.col("c").alias("a"), F.col("text").alias("text")), "a").join(whole.select(F.col("c").alias("b"), F.col("text").alias("other")), "b")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(texts(part.column("text")), texts(part.column("other")), strict=True):
            s, t = shingle_set(x), shingle_set(y)
            keep.append(bool(_enough(len(np.intersect1d(s, t, assume_unique=True)), len(s) + len(t))))
        return part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return checkpoint(map_batches(both.select("a", "b", "text", "other"), "text", "a long, b long", work))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, root. Rows of one root are linked by pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 at least.

    Null counts as empty; repeated rows and ids keep their rows; an empty table gives none; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(text_col).alias("c"), F.col(text_col).alias("text"))

    def dealt(df: DataFrame, by: str) -> DataFrame:
        return df.repartition("k").sortWithinPartitions("k", by)

    met = checkpoint(dealt(_prefixes(rows), "c").mapInArrow(_met, "k long, c long, n int, p int"))
    words = [f"b{i}" for i in range(WORDS)]
    bitmaps = met.where("p < 0").groupBy("c").agg(*(F.coalesce(F.max(F.when(F.col("p") == -1 - i, F.col("k"))), F.lit(0).cast("long")).alias(b) for i, b in enumerate(words)))
    met = checkpoint(met.where("p >= 0").join(bitmaps, "c").select("k", "c", "n", "p", *words))
    edges = _similar(candidate_pairs(rows, SHINGLE).unionByName(dealt(met, "n").mapInArrow(_chains, "a long, b long")), rows)
    for nearest in (True, False):
        roots = components(edges).withColumnRenamed("node", "c")
        rooted = met.join(roots, "c", "left").select("k", "c", "n", "p", *words, F.coalesce("root", "c").alias("root"))
        more = dealt(rooted, "root").mapInArrow(lambda x, nearest=nearest: _across(x, nearest), "a long, b long")
        edges = edges.unionByName(_similar(more, rows))
    roots = components(edges).withColumnRenamed("node", "text_hash")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"))
    return found.join(roots, "text_hash", "left").select("id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
