"""Leaderboards of items by nation as a change feed: a stateful stream replays arrival days and says whose rank changed.

Lines are cut into batches by their arrival day and fed one batch after the other to a streaming query that is started anew for each on one
checkpoint. Tasks add their own lines up first. Revenues are then kept by nation and bucket of items, so that no nation's items meet in one task: a bucket passes
on what changed among its own ten best, which hold all of the nation's ten best. Those few rows are all that the stream writes;
after its last start each nation's days are replayed from them and boards are compared. That step keeps no state, as a second state would
double the stores that every start opens. Stores are Spark's default ones: a store of RocksDB leaves about half a megabyte of native memory
with its executor for good (its statistics are never closed), and each start opens new ones for all parts of the state.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.llm.common import filesystem, shared_folder

#: Places of a board; batches; the first day (1 January 2024) and the days that are dealt over the batches; days that a line may lag behind the largest day of earlier batches.
PLACES, BATCHES, FIRST_DAY, SPAN, LAG = 10, 10, 19723, 180, 3
#: Parts of a nation's items that have states of their own. More of them make smaller states.
BUCKETS = 16
#: Leading items that a bucket keeps in order, and lines that a task adds up at once.
LEADING, ADDED = 64, 500_000
LINE = "nation_id int, item_id long, day int, arrival_day int, cents double, batch int"
DELTA = "nation_id int, bucket int, batch int, items binary, days binary, cents binary"
REVENUES = "items binary, cents binary"
CANDIDATE = "nation_id int, arrival_day long, batch int, item_id long, cents double, listed boolean"
CHANGE = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def days(lines: DataFrame) -> DataFrame:
    """vendor_id, item_id, day, arrival_day, batch, cents (null where the price decides) and quantity of each line, both negated for returned ones.

    Days before the first belong to the first batch.
    """
    keys = F.concat(_text("sale_id"), F.lit(","), _text("item_id"), F.lit(","), _text("vendor_id"), F.lit(","), _text("line_no"))
    h = F.crc32(F.encode(keys, "utf-8"))
    day = F.coalesce(F.unix_date(F.to_date("shipped_at")), (FIRST_DAY + h % 150).cast("int"))
    arrival = (F.col("day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int")
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * BATCHES / SPAN))).cast("int")
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    cents = sign * F.floor(F.lit(100.0) * F.col("amount") + 0.5).cast("double")
    rows = lines.select("vendor_id", "item_id", day.alias("day"), h.alias("h"), cents.alias("cents"), (sign * F.col("quantity")).cast("int").alias("quantity"))
    return rows.select("vendor_id", "item_id", "day", arrival.alias("arrival_day"), "cents", "quantity").withColumn("batch", batch)


def cut(lines: DataFrame, vendors: DataFrame, items: DataFrame, folder: str) -> None:
    """Writes all lines, with nation and cents where they count, in one part of ``folder`` for each batch.

    Of vendors or items that occur twice, the one of smallest nation or price counts. Neither table is broadcast: both sides are shuffled on their keys,
    and Spark splits keys that many lines share. It does so only where a join reads its shuffles directly, so the two tables of distinct keys are written first.
    """
    spark = lines.sparkSession
    nations = vendors.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    prices = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("price").alias("price"))
    nations.write.parquet(f"{folder}-vendors")
    prices.write.parquet(f"{folder}-items")
    nations, prices = spark.read.parquet(f"{folder}-vendors"), spark.read.parquet(f"{folder}-items").withColumn("known", F.lit(True))
    rows = days(lines).join(nations.hint("merge"), "vendor_id", "left").drop("vendor_id").join(prices.hint("merge"), "item_id", "left")
    worth = F.coalesce("cents", F.col("quantity") * F.floor(F.lit(100.0) * F.col("price") + 0.5).cast("double"), F.lit(0.0))
    counts = F.col("nation_id").isNotNull() & F.col("known").isNotNull()
    rows.select("nation_id", "item_id", "day", "arrival_day", F.when(counts, worth).alias("cents"), "batch").write.partitionBy("batch").parquet(folder)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each nation and bucket of what a task reads, in runs of bounded size: items, arrival days and sums of cents as bytes.

    Spark hands a state over with each chunk of a group's rows, so that a group has few of them.
    """
    keys, held, count = ["nation_id", "bucket", "batch", "item_id", "arrival_day"], [], 0
    kinds = (("item_id", np.int64), ("arrival_day", np.int32), ("cents", np.float64))

    def close() -> pa.RecordBatch:
        added = pa.Table.from_batches(held).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"]).sort_by([(k, "ascending") for k in keys[:3]])
        group = np.stack([added[k].to_numpy() for k in keys[:3]])
        starts = np.append(np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))), added.num_rows)
        values = [added[name].to_numpy().astype(kind) for name, kind in kinds]
        packed = [pa.array([x[i:j].tobytes() for i, j in itertools.pairwise(starts.tolist())], pa.binary()) for x in values]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in group[:, starts[:-1]]] + packed, names=["nation_id", "bucket", "batch", "items", "days", "cents"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= ADDED:
            yield close()
            held, count = [], 0
    if count:
        yield close()


class Ladder:
    """The leading revenues of many items, as a list ordered by negative revenue and item that is kept by bisection.

    All items with a positive revenue whose key is not beyond ``floor`` stand in the list; those behind it are looked up again only when fewer than ``places`` are left.
    """

    def __init__(self, items: np.ndarray, cents: np.ndarray, places: int = PLACES, leading: int = LEADING):
        self.items, self.cents, self.places, self.leading = items, cents, places, max(leading, places)
        self._fill()

    def _fill(self) -> None:
        some = np.flatnonzero(self.cents > 0)
        if whole := len(some) <= self.leading:
            self.floor = (0.0, 0)
        else:
            least = np.partition(self.cents[some], -self.leading)[-self.leading]
            some = some[self.cents[some] >= least]
        self.list = sorted(zip((-self.cents[some]).tolist(), self.items[some].tolist(), strict=True))
        if not whole:
            self._trim()

    def _trim(self) -> None:
        del self.list[self.leading :]
        self.floor = self.list[-1]

    def add(self, at: np.ndarray, cents: np.ndarray) -> None:
        """Adds ``cents`` to the revenues at distinct places ``at``."""
        old, new = self.cents[at], self.cents[at] + cents
        self.cents[at] = new
        bound = -self.floor[0]
        for i in np.flatnonzero(((old > 0) & (old >= bound)) | ((new > 0) & (new >= bound))).tolist():
            item = int(self.items[at[i]])
            before, after = (-float(old[i]), item), (-float(new[i]), item)
            if before[0] < 0 and before <= self.floor:
                del self.list[bisect_left(self.list, before)]
            if after[0] < 0 and after <= self.floor:
                insort(self.list, after)
        if len(self.list) < self.places and self.floor != (0.0, 0):
            self._fill()
        elif len(self.list) > 4 * self.leading:
            self._trim()

    def best(self) -> dict[int, float]:
        return {item: -cents for cents, item in self.list[: self.places]}


def bucket_boards(places: int = PLACES) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of one nation's bucket of items. Its state is the bucket's items, ascending, and their revenues, as bytes; gives, for each arrival day, what changed among the bucket's best: items that entered, left or have another revenue."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [tuple(row) for part in rows for row in part[["batch", "items", "days", "cents"]].itertuples(index=False)]
        touched, day, delta = (np.frombuffer(b"".join(x[n] for x in parts), kind) for n, kind in ((1, np.int64), (2, np.int32), (3, np.float64)))
        held, saved = (bytes(x) for x in state.getOption or (b"", b""))
        known, batch = np.frombuffer(held, np.int64), int(parts[0][0])
        items = np.union1d(known, touched)
        cents = np.zeros(len(items))
        cents[np.searchsorted(items, known)] = np.frombuffer(saved, np.float64)
        at = np.searchsorted(items, touched)
        ladder, out = Ladder(items, cents, places), []
        before = ladder.best()
        by_day = np.argsort(day, kind="stable")
        for today in np.split(by_day, np.flatnonzero(np.diff(day[by_day])) + 1):
            where, which = np.unique(at[today], return_inverse=True)
            ladder.add(where, np.bincount(which, delta[today], len(where)))
            now = ladder.best()
            out += [(int(day[today[0]]), i, c, True) for i, c in now.items() if before.get(i) != c]
            gone = [i for i in before if i not in now]
            out += [(int(day[today[0]]), i, float(c), False) for i, c in zip(gone, cents[np.searchsorted(items, np.array(gone, np.int64))], strict=True)]
            before = now
        state.update((items.tobytes(), cents.tobytes()))
        if out:
            found = pd.DataFrame(out, columns=["arrival_day", "item_id", "cents", "listed"])
            yield found.assign(nation_id=np.int32(key[0]), batch=np.int32(batch))[["nation_id", "arrival_day", "batch", "item_id", "cents", "listed"]]

    return step


def board_changes(found: pd.DataFrame, places: int = PLACES) -> pd.DataFrame:
    """The differences of one nation's boards from day to day, from what changed on its bucket boards over all days, in any order of rows."""
    nation, revenue, ladder, saved, out = int(found["nation_id"].iloc[0]), {}, [], {}, []
    for day, rows_of_day in found.groupby("arrival_day", sort=True):
        left = {}
        for item, cents, listed in zip(rows_of_day["item_id"].tolist(), rows_of_day["cents"].tolist(), rows_of_day["listed"].tolist(), strict=True):
            if (old := revenue.pop(item, None)) is not None:
                del ladder[bisect_left(ladder, (-old, item))]
            if listed:
                revenue[item] = cents
                insort(ladder, (-cents, item))
            else:
                left[item] = cents
        board = {item: rank for rank, (_, item) in enumerate(ladder[:places], 1)}
        for item in board.keys() | saved.keys():
            was, now = saved.get(item), board.get(item)
            if was != now:
                change = "enter" if was is None else "exit" if now is None else "move"
                cents = revenue[item] if item in revenue else left[item]
                out.append((nation, int(day), item, int(rows_of_day["batch"].iloc[0]), change, was, now, int(cents)))
        saved = board
    made = pd.DataFrame(out, columns=["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"])
    return made.astype({"nation_id": "int32", "arrival_day": "int64", "item_id": "int64", "batch": "int32", "old_rank": "Int32", "new_rank": "Int32", "revenue": "int64"})


def candidates(lines: DataFrame, floor: int | None, buckets: int = BUCKETS, places: int = PLACES) -> DataFrame:
    """What changes on the bucket boards by a stream of lines as ``cut`` writes them; those whose day is more than LAG days below ``floor`` are dropped."""
    kept = lines.where(F.col("cents").isNotNull() & (F.lit(True) if floor is None else F.col("day") + LAG >= floor))
    deltas = kept.select("nation_id", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int").alias("bucket"), "item_id", "arrival_day", "batch", "cents").mapInArrow(_add_up, DELTA)
    return deltas.groupBy("nation_id", "bucket").applyInPandasWithState(bucket_boards(places), CANDIDATE, REVENUES, "append", GroupStateTimeout.NoTimeout)


def changes(found: DataFrame, places: int = PLACES) -> DataFrame:
    """The change feed from what the stream gave.

    A nation's rows are some twice ``places`` for each bucket and day at most, however many lines there are, so that one group holds them.
    """
    return found.groupBy("nation_id").applyInPandas(lambda rows: board_changes(rows, places), CHANGE)


#: Spark's default stores, which hold a part of the state in the heap while its task runs: a start has one batch, so nothing is kept for a next one. Those of earlier starts are let go soon. Packed rows are long, so batches of them are bounded by bytes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "0",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def state_partitions(spark: SparkSession) -> int:
    """Parts of the state of one start: two for each core, at most the session's shuffle partitions.

    Keys are a few hundred (nations times buckets), each part is a store of its own, and a store costs a read and a commit at every start, rows or not.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def feed(lines: DataFrame, vendors: DataFrame, items: DataFrame, buckets: int = BUCKETS, places: int = PLACES, partitions: int | None = None) -> DataFrame:
    """(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue): one row for each item whose rank on its nation's board differs from the board before, from day to day.

    Lines without a vendor, a nation or an item of the table are ignored, but their days count for what is late; repeated lines count as
    often as they occur; equal revenues go by the smaller item; an empty table gives no rows; other columns, whatever their names, are ignored. Every
    call works in a new folder under the shared checkpoint folder. To the driver come the largest days of the ten batches. ``partitions``: parts of
    the state, by default ``state_partitions``; results don't depend on it. All starts keep the first one's.
    """
    spark, home = lines.sparkSession, shared_folder(lines.sparkSession, "leaderboard")
    cut(lines, vendors, items, f"{home}/cut")
    last = dict(spark.read.schema(LINE).parquet(f"{home}/cut").groupBy("batch").agg(F.max("day")).collect())
    fs, base = filesystem(home)
    fs.create_dir(f"{base}/feed", recursive=True)
    settings = STATE | {"spark.sql.shuffle.partitions": str(partitions or state_partitions(spark))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        floor = None
        for batch in sorted(last):
            fs.move(f"{base}/cut/batch={batch}", f"{base}/feed/batch={batch}")
            arriving = spark.readStream.schema(LINE).parquet(f"{home}/feed")
            query = candidates(arriving, floor, buckets, places).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/candidates")
            query.awaitTermination()
            floor = last[batch] if floor is None else max(floor, last[batch])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return changes(spark.read.schema(CANDIDATE).parquet(f"{home}/candidates"), places) if last else spark.createDataFrame([], CHANGE)
