"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a pigeonring filter and an exact Hamming check.

Rows with equal fingerprints are one class before any search. Classes are searched by keys drawn from chains of
consecutive segments on the ring; inside a key's bucket only a spanning forest is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint, fresh_names, map_batches, texts

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Segments of the ring; a chain of ``l`` of them may hold DISTANCE * l // SEGMENTS differing bits.
SEGMENTS = 8
#: Fingerprints of one bucket that are compared in one go; a larger bucket is keyed anew by its free bits. Two levels fix
#: 48 of the 64 bits, and what they leave has 2**16 values: no bucket of the second level can be larger than this.
BUCKET = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all shingles (with repeats) of a text's ASCII-lower-cased words.

    bytes.lower and bytes.split work on A-Z and on 20, 09-0D alone, whatever the locale.
    Fewer words than a shingle: the whole sequence is the only one. No word: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in shingles), "<u8", count=max(1, len(words) - size + 1))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp) for every row; fp is the fingerprint as a signed long. Null text: 0, as for a text without words."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, size) for x in texts(part.column("text"))], "<u8").view("<i8")
        return pa.record_batch([part.column("id"), part.column("text_hash"), pa.array(fps)], ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_batches(rows, "text", "id long, text_hash long, fp long", work)


def ring_fixed() -> list[list[int]]:
    """The segments that each key fixes, by start and then by the segment left out.

    Pigeonring: two values within DISTANCE have a start from which the first l segments hold, for every l, at most
    DISTANCE * l // SEGMENTS differing bits. So the segments of the longest chain with budget 0 agree, and of the further
    ones with budget 1 at most one differs: a key leaves that one out, and such values share one of the keys at least.
    """
    exact = max(n for n in range(SEGMENTS + 1) if DISTANCE * n // SEGMENTS == 0)
    chain = max(n for n in range(SEGMENTS + 1) if DISTANCE * n // SEGMENTS <= 1)
    return [[(start + i) % SEGMENTS for i in range(chain) if i != out] for start in range(SEGMENTS) for out in range(exact, chain)]


def ring_keys(bits: Column, width: int) -> list[Column]:
    """The keys of a value of ``width`` bits: the key's number, then its fixed segments."""
    step, keys = width // SEGMENTS, []
    for n, fixed in enumerate(ring_fixed()):
        value = F.lit(n).cast("long")
        for s in fixed:
            value = F.shiftleft(value, step).bitwiseOR(F.shiftrightunsigned(bits, s * step).bitwiseAND(F.lit((1 << step) - 1)))
        keys.append(value)
    return keys


def _budgets(start: int) -> list[tuple[np.uint64, int]]:
    """(mask, most differing bits) of the chains from ``start`` that say more than the key has said already, the whole ring last."""
    step, found = 64 // SEGMENTS, []
    for n in range(1, SEGMENTS + 1):
        most = DISTANCE * n // SEGMENTS
        if most > 1 and (n == SEGMENTS or DISTANCE * (n + 1) // SEGMENTS > most):
            mask = sum((1 << step) - 1 << (start + i) % SEGMENTS * step for i in range(n))
            found.append((np.uint64(mask), most))
    return found


def _forest(values: np.ndarray, budgets: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of values whose differences keep within all ``budgets``. Each value is compared only with those not yet reached."""
    edges, rest = [], values.copy()
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.arange(len(rest))
            for mask, most in budgets:
                near = near[np.bitwise_count((rest[near] ^ at) & mask) <= most]
            found = rest[near]
            edges += [(int(at), int(x)) for x in found]
            front += list(found)
            rest = np.delete(rest, near)
    return edges


def _search(batches: Iterator[pa.RecordBatch], finer: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by k: a forest of each bucket as (a, b); buckets over ``most`` as (k, fp) in (hot, a).

    ``finer``: the keys are those of _finer, which name no chain of the whole ring, so only the full check is made.
    """
    starts_each, whole = len(ring_fixed()) // SEGMENTS, [(np.uint64((1 << 64) - 1), DISTANCE)]
    held_k: int | None = None
    held: list[np.ndarray] = []
    spilled = False

    def batch(edges: list[tuple[int, int]], hot: tuple[int, np.ndarray] | None = None) -> pa.RecordBatch:
        a, b = np.array(edges, "<i8").reshape(-1, 2).T
        k = np.full(len(a), -1, "<i8")
        if hot:
            k, a, b = np.full(len(hot[1]), hot[0], "<i8"), hot[1].view("<i8"), np.zeros(len(hot[1]), "<i8")
        return pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in (k, a, b)], ["hot", "a", "b"])

    def close() -> list[tuple[int, int]]:
        values = np.concatenate(held) if held else np.zeros(0, "<u8")
        if spilled or len(values) < 2:
            return []
        start = (held_k >> 32) // starts_each
        return [tuple(np.array(e, "<u8").view("<i8")) for e in _forest(np.unique(values), whole if finer else _budgets(start))]

    for part in batches:
        k, fp = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)]))
        edges: list[tuple[int, int]] = []
        # runs of one row inside the batch have no pair; only its first and last run can meet other batches
        for i in np.unique(np.concatenate((np.flatnonzero(ends - starts > 1), [0, len(starts) - 1]))):
            key, values = int(k[starts[i]]), fp[starts[i] : ends[i]].view("<u8")
            if key != held_k:
                edges += close()
                held_k, held, spilled = key, [], False
            held.append(values)
            if spilled or sum(map(len, held)) > most:
                spilled = True
                for x in held:
                    yield batch([], (key, x))
                held = []
        if edges:
            yield batch(edges)
    if edges := close():
        yield batch(edges)


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``classes(fp)``: their components are those of all pairs at most DISTANCE bits apart."""

    def search(rows: DataFrame, finer: bool, most: int) -> DataFrame:
        return rows.repartition("k").sortWithinPartitions("k").mapInArrow(lambda x: _search(x, finer, most), "hot long, a long, b long")

    found = checkpoint(search(classes.select(F.explode(F.array(*ring_keys(F.col("fp"), 64))).alias("k"), "fp"), False, BUCKET))
    hot = found.where("hot >= 0")
    edges = found.where("hot < 0").select("a", "b")
    if not hot.isEmpty():
        edges = edges.unionByName(search(_finer(hot), True, 1 << 16).select("a", "b"))
    return edges


def _finer(hot: DataFrame) -> DataFrame:
    """Rows of large buckets under keys of the bits that their first key leaves free: those are at most DISTANCE apart as well."""
    step, cases = 64 // SEGMENTS, None
    for n, fixed in enumerate(ring_fixed()):
        free = F.lit(0).cast("long")
        for s in (s for s in range(SEGMENTS) if s not in fixed):
            free = F.shiftleft(free, step).bitwiseOR(F.shiftrightunsigned("a", s * step).bitwiseAND(F.lit((1 << step) - 1)))
        test = F.shiftrightunsigned("hot", step * (SEGMENTS // 2)) == n
        cases = F.when(test, free) if cases is None else cases.when(test, free)
    fine = F.array(*ring_keys(F.col("free"), step * (SEGMENTS // 2)))
    rows = hot.select("hot", F.col("a").alias("fp"), cases.alias("free")).select("hot", "fp", F.explode(fine).alias("fine"))
    # 5 + 32 bits of the bucket's key and 5 + 16 of the finer one fit in one long
    return rows.select(F.shiftleft("hot", 21).bitwiseOR(F.col("fine")).alias("k"), "fp")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of the components of edges, for every node but the least of each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[x], label[y])
        for end in (before[x], before[y], x, y):
            np.minimum.at(label, end, least)
        label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task as stars: no more of them than nodes, and nearer to the ends. Worked out for ``most`` edges at once."""

    def stars() -> pa.RecordBatch:
        node, least = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.record_batch([pa.array(node), pa.array(least)], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in batches:
        held.append(tuple(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        if sum(len(x[0]) for x in held) >= most:
            yield stars()
            held = []
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches.

    Each task first makes stars of its own edges, which takes most rounds away; then alternating large and small stars, a checkpoint each round, until every
    node hangs on one root that hangs on none.
    """
    edges = checkpoint(edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "u long, v long").distinct())
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        ups = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if not ups.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())


def candidate_pairs(texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of keys of ``texts(c, text)``, c a text's hash: a spanning forest of the texts whose fingerprints (of ``size``-word shingles) are linked."""
    rows = checkpoint(fingerprints(texts, "c", "text", size).select(F.col("id").alias("c"), "fp").distinct())
    classes = checkpoint(rows.groupBy("fp").agg(F.min("c").alias("least")))
    same = rows.join(classes, "fp").select(F.col("least").alias("a"), F.col("c").alias("b"))
    linked = links(classes.select("fp")).distinct()
    for end in "ab":
        linked = linked.join(classes.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_least")), end)
    linked = linked.select(F.least("a_least", "b_least").alias("a"), F.greatest("a_least", "b_least").alias("b"))
    return same.unionByName(linked).where("a < b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp, root, component_id.

    component_id is the smallest id reachable over links of at most DISTANCE differing bits, itself included.
    root names the component by a fingerprint of it. Null texts count as empty; rows with a null id take part and get the smallest id of their component, null if it has none.
    Repeated rows and ids keep their rows. An empty table gives no row. Other columns are ignored.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp")))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = linked.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(by_class, "fp").select("id", "text_hash", "fp", "root", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """One row, with all columns, of each component: the one of smallest id (a row without id only if no row has one; ties by the text's hash, then by that of the whole row).

    Null texts count as empty, an empty table gives no row.

    ``found`` has the components as (id, text_hash, root); without it they are those of near_duplicates.
    """
    found = (near_duplicates(docs, id_col, text_col) if found is None else found).groupBy("root", "id", "text_hash").agg(F.count("*").alias("copies"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "copies")).alias("first"))
    names = fresh_names(docs, "id", "hash", "copies")
    keep = checkpoint(first.select(*(F.col(f"first.{c}").alias(n) for c, n in zip(("id", "text_hash", "copies"), names, strict=True))))
    key, (own_id, own_hash, copies) = list(names[:2]), names
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    many = keep.where(F.col(copies) > 1).select(*key)
    if many.isEmpty():
        return docs.join(keep.select(*key), same, "left_semi")
    once = docs.join(keep.where(F.col(copies) == 1).select(*key), same, "left_semi")
    repeated = docs.join(many, same, "left_semi").groupBy(F.col(id_col).alias(own_id), F.xxhash64(text_col).alias(own_hash))
    columns = [F.col(c) for c in docs.columns]
    hashed = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind))
    return once.unionByName(repeated.agg(F.min_by(F.struct(*columns), hashed).alias(copies)).select(f"{copies}.*"))
