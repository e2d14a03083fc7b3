"""Sharding by minimax contiguous partition: ordered atomic groups, the smallest feasible capacity by binary search, then the cuts.

Rows with equal texts share a bucket of the text's hash; buckets, in order, are the atomic groups. Their number is fixed, so their sizes
fit on the driver whatever the input, and a shard's size is off the mean by no more than a bucket's. All row work is native.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint

#: Atomic groups: bounds what the driver holds (8 bytes each) and broadcasts.
BUCKETS = 1 << 16
#: Bytes that a row has besides its text.
ROW_BYTES = 16


def feasible(ends: np.ndarray, parts: int, capacity: int) -> bool:
    """Whether groups with these running totals fit in ``parts`` contiguous shards of ``capacity``, filled greedily."""
    used = at = 0
    for _ in range(parts):
        at = int(np.searchsorted(ends, used + capacity, side="right"))
        if at == len(ends):
            return True
        used = int(ends[at - 1]) if at else 0
    return False


def smallest_capacity(sizes: np.ndarray, parts: int) -> int:
    """The least capacity for which the groups fit in ``parts`` contiguous shards."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    low, high = max(int(sizes.max(initial=0)), -(-total // parts)), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(ends, parts, middle) else (middle + 1, high)
    return low


def cuts(sizes: np.ndarray, parts: int) -> list[int]:
    """First group of each shard but the first: no shard is over the smallest capacity, and each cut is as near to even as that allows."""
    capacity = smallest_capacity(sizes, parts)
    ends = [0, *np.cumsum(sizes).tolist()]
    total = ends[-1]
    latest_start = [0] * (parts + 1)  # of the last p shards: the earliest group from which they can hold the rest
    latest_start[0] = len(sizes)
    for p in range(1, parts + 1):
        need = ends[latest_start[p - 1]] - capacity
        latest_start[p] = int(np.searchsorted(ends, need, side="left")) if need > 0 else 0
    found, start = [], 0
    for shard in range(1, parts):
        least, most = max(start, latest_start[parts - shard]), bisect_right(ends, ends[start] + capacity) - 1
        ideal = total * shard / parts
        at = min(max(bisect_right(ends, ideal) - 1, least), most)
        if at < most and abs(ends[at + 1] - ideal) < abs(ends[at] - ideal):
            at += 1
        start = max(least, min(at, most))
        found.append(start)
    return found


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, bucket, shard, slot.

    size: UTF-8 bytes of the text (null: none) and ROW_BYTES; text_crc32 of a null text is that of no bytes. Equal texts share a shard. Slots
    of a shard run from 0 without a gap, by bucket and a hash of the id; equal rows get different slots. An empty table gives no row, a shard may be
    empty if there are fewer groups than shards, other columns are ignored. A bucket may hold a third of all rows: ranges split it over
    tasks by the hash, and slots come from counts by task, not from a window.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    ordered = F.xxhash64("id", "size")
    dealt = checkpoint(rows.withColumn("at", ordered).repartitionByRange("bucket", "at").sortWithinPartitions("bucket", "at", "id"))
    sizes = np.zeros(BUCKETS, np.int64)
    for r in dealt.groupBy("bucket").agg(F.sum("size").alias("size")).collect():  # no more rows than BUCKETS
        sizes[r.bucket] = r.size
    owner = np.searchsorted(np.array(cuts(sizes, shards)), np.arange(BUCKETS), side="right")
    spark = docs.sparkSession
    by_bucket = spark.createDataFrame([(int(b), int(s)) for b, s in enumerate(owner)], "bucket int, shard int")
    # the checkpoint's partitions are files: their number and the order inside them stay, so a row's place can be counted
    placed = dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).join(F.broadcast(by_bucket), "bucket")
    runs = placed.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect()  # partitions and shards together at most
    base, upto = [], {}
    for r in sorted(runs):
        base.append((r.shard, r.part, upto.get(r.shard, 0) - r.first))
        upto[r.shard] = upto.get(r.shard, 0) + r.n
    bases = spark.createDataFrame(base, "shard int, part int, base long")
    return placed.join(F.broadcast(bases), ["shard", "part"]).select("id", "size", "text_crc32", "bucket", "shard", (F.col("place") + F.col("base")).alias("slot"))
