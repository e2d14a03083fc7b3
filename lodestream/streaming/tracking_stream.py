"""The tracking test as a stream: state for each run, capped at the last observations, closed by a mark, a lost page or time.

Batches of validated observations go through one stateful operator keyed by run, so a run's rows are handled one after the other. Ids held already are
dropped, since a retry may send a batch again. A closed run gives the rows that the batch functions of operators.tracking take: batch and stream agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestream.operators.tracking import KEPT, TTL_MS, accepted

ROW = "seq long, id string, platform string, type string, name string, relative_ms long"
OUT = f"run_id string, {ROW}, closed string"
COLUMNS = ["seq", "id", "platform", "type", "name", "relative_ms"]
#: How long a closed run is remembered: rows that come within that time are rejected.
REMEMBERED_MS = 86_400_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


#: For streams with an entry for each of many rows: no look-up before a write only to count entries, larger write buffers, and whole snapshots, of which a start reads one instead of the changes of all earlier starts.
MANY_KEYS = {
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession, drain: bool = True, more: dict[str, str] | None = None) -> Iterator[None]:
    """The options that queries with ``watch`` are started under; a query keeps those it was started with, and the session gets its own back.

    A ``drain`` (trigger availableNow) runs no batches without rows, which timers would ask for without end; its timers go off with the next rows of any run. A live query
    takes ``drain=False``: its trigger runs them. ``more`` are options of one kind of stream.
    """
    options = STATE | (more or {}) | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if drain else {})
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Runs(StatefulProcessor):
    """One run: its last observations, a timer from its first row on, and, once it is closed, nothing but the reason."""

    def __init__(self, most: int, ttl_ms: int, timeout: bool, remembered_ms: int):
        self.most, self.ttl_ms, self.timeout, self.remembered_ms = most, ttl_ms, timeout, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        # the tombstone of a closed run goes after a while by itself, where time is known
        self.closed = handle.getValueState("closed", "reason string", self.remembered_ms if self.timeout else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)  # the rows of one run in one batch, which the source's options bound
        if self.closed.exists():
            return
        held = [tuple(r) for r in self.rows.get()]
        if self.timeout:
            now, timers = timerValues.getCurrentProcessingTimeInMs(), list(self.handle.listTimers())
            if timers and min(timers) <= now:  # timers go off after a batch's rows, but these rows came after the run's time
                yield from self._close(key, held, "expired")
                return
            if not timers:
                self.handle.registerTimer(now + self.ttl_ms)
        new = pd.concat(frames, ignore_index=True).sort_values("seq", kind="stable").drop_duplicates("id")
        new = new[~new["id"].isin({r[1] for r in held})]
        late = (new["relative_ms"] > self.ttl_ms).to_numpy(bool)
        left = ((new["type"] == "route") & new["name"].isin(["stop", "leave"])).to_numpy(bool)
        ends, reason = np.flatnonzero(late | left), None
        if len(ends):
            last = new.iloc[ends[0]]
            reason = "expired" if late[ends[0]] else "stopped" if last["name"] == "stop" else "paused"
            new = new.iloc[: ends[0]]
        fresh = zip(*(new[c].iloc[-self.most :].tolist() for c in COLUMNS), strict=True)
        held = (held + list(fresh))[-self.most :]
        if reason:
            yield from self._close(key, held, reason)
        elif held:
            self.rows.put(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.closed.exists():
            yield from self._close(key, [tuple(r) for r in self.rows.get()], "expired")

    def _close(self, key, held: list[tuple], reason: str) -> Iterator[pd.DataFrame]:
        self.closed.update((reason,))
        self.rows.clear()
        if self.timeout:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held:
            yield pd.DataFrame(held, columns=COLUMNS).assign(run_id=key[0], closed=reason)[["run_id", *COLUMNS, "closed"]]

    def close(self) -> None:
        pass


def watch(observations: DataFrame, most: int = KEPT, ttl_ms: int = TTL_MS, timeout: bool = True, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """The kept observations of each run when it closes: by a route row named stop or leave, by an observation past ``ttl_ms``, or by a timer that long after its first row.

    closed says why: stopped, paused or expired. A run closed by whatever stays closed: its rows are rejected for ``remembered_ms``, and for good without ``timeout``.
    Of a batch, a run's rows are taken by seq. Start the query under ``state_store``.
    """
    rows = accepted(observations).select("run_id", *COLUMNS)
    return rows.groupBy("run_id").transformWithStateInPandas(Runs(most, ttl_ms, timeout, remembered_ms), OUT, "append", "ProcessingTime" if timeout else "None")


def bursts(events: DataFrame, gap_us: int = 1_500_000, late: str = "15 seconds") -> DataFrame:
    """Events (run_id, id, platform, name, ts) in sessions of less than a gap: their number, the first one's time, and the last one's with the gap. Session windows that touch are joined, so theirs is a microsecond less. Rows alike in all five count once within the watermark, so retries don't count twice."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "platform", "name", "id", "ts"])
    return once.groupBy("run_id", "platform", F.lower("name").alias("name"), F.session_window("ts", f"{gap_us - 1} microseconds").alias("w")).agg(F.count("*").alias("n")).select("run_id", "platform", "name", "w.start", (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "n")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def replay_bursts(events: DataFrame, folder: str, gap_us: int = 1_500_000, late_us: int = 86_400_000_000) -> DataFrame:
    """The bursts (run_id, platform, name, start_us, end_us, n; more than one event) of stored events (run_id, id, platform, name, ts_us, arrived_us), fed by the month of their arrival.

    Each month is one start of the streaming query on one checkpoint in ``folder``. Events that arrive before their time or over ``late_us`` after it are dropped, as are those without a run, id or time;
    the watermark lies as far back, so no other is. Sessions that may still grow when the last month is in stay in the state. Partial sessions are merged in each task before the shuffle, so that
    a run with a large share of the events sends few rows. To the driver come the months. An empty table gives no rows, other columns are ignored.
    """
    spark = events.sparkSession
    kept = events.where("run_id is not null and id is not null and ts_us is not null").where((F.col("arrived_us") >= F.col("ts_us")) & (F.col("arrived_us") - F.col("ts_us") <= late_us))
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("arrived_us") / 86_400_000_000).cast("int")), "yyyy-MM")
    kept.select("run_id", "id", "platform", "name", F.timestamp_micros("ts_us").alias("ts"), month.alias("month")).write.partitionBy("month").parquet(f"{folder}/cut")
    schema = "run_id string, id string, platform string, name string, ts timestamp"
    out = "run_id string, platform string, name string, start_us long, end_us long, n long"
    months = sorted(r.month for r in spark.read.schema(f"{schema}, month string").parquet(f"{folder}/cut").select("month").distinct().collect())
    merging = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    with state_store(spark, drain=False, more=MANY_KEYS):
        before = spark.conf.get(merging, None)
        spark.conf.set(merging, "true")
        try:
            for m in months:
                spark.read.schema(schema).parquet(f"{folder}/cut/month={m}").write.mode("append").parquet(f"{folder}/in")
                found = bursts(spark.readStream.schema(schema).parquet(f"{folder}/in"), gap_us, f"{late_us // 1000} milliseconds").where("n > 1")
                found = found.select("run_id", "platform", "name", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
                found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        finally:
            spark.conf.unset(merging) if before is None else spark.conf.set(merging, before)
    return spark.read.schema(out).parquet(f"{folder}/out") if months else spark.createDataFrame([], out)
