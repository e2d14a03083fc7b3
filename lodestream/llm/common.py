"""Shared plumbing of the training-data operators: Arrow batches cut by bytes, and the tables by name."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once (a longer single text is handled alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts as none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose values in ``column`` hold about ``limit`` bytes."""
    if not batch.num_rows:
        return
    ends = np.cumsum(lengths(batch.column(column)) + 16)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, column: str, schema, work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """``work`` over slices of each Arrow batch: rows stay in their task, so nothing is shuffled and a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = work(part)
                if out.num_rows:
                    yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches from the JVM are bounded by bytes as well as by rows, so that very long texts don't pile up in one.

    Plans read these options when they run, so they stay set in the session; smaller values of the user's own are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def _checkpoints(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, set in the context if it wasn't. Where none is named, one of our own serves in local mode (tests) only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the cluster's shared checkpoint folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, under the shared checkpoint folder; whoever asks for it leaves it to the cluster's cleaning of that folder."""
    return f"{_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """A folder that Spark names by URI or path, for Arrow."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return pa.fs.LocalFileSystem(), folder
    return pa.fs.FileSystem.from_uri(folder)


def filter_batches(df: DataFrame, column: str, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for which ``keep`` (a mask for each slice) holds; rows stay in their task."""
    return map_batches(df, column, df.schema, lambda part: part.filter(pa.array(keep(part))))


def fresh_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each made longer until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name += "_"
        found.append(f"_{name}")
    return tuple(found)


_resident: list = [None, None]


def resident(key, make: Callable[[], object]):
    """What ``make`` gives, kept in this worker until another key is asked for: a worker that goes from one operator to the next holds the tables of one."""
    if _resident[0] != key:
        _resident[:] = [None, None]
        _resident[:] = [key, make()]
    return _resident[1]
