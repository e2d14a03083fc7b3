"""Arrow-batched functions whose schemas are parsed when they are used, so that modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectorized(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


#: Words that are worked on at once; the words of a single longer text are worked on alone.
WORDS = 1 << 20


def map_words(rows: DataFrame, key: list[str], words: Column, schema: str, work: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, list]]) -> DataFrame:
    """The rows' ``key`` and the columns of ``schema``, worked out from the array ``words`` of each row in its own task; rows without words are left out.

    ``work`` takes the words of some rows one behind the other and where each row's start, and gives the number of each result's row, and the columns.
    """
    made = [part.split()[0] for part in schema.split(", ")]
    chosen = rows.select(*key, words.alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("_words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch, sizes = batch.filter(pa.array(sizes > 0)), sizes[sizes > 0]
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + WORDS, side="right")))
                part = batch.slice(first, last - first)
                row, columns = work(part.column("_words").flatten(), np.cumsum(sizes[first:last]) - sizes[first:last])
                yield pa.RecordBatch.from_arrays([*part.select(key).take(pa.array(row)).columns, *map(pa.array, columns)], names=[*key, *made])
                first = last

    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]]
    return chosen.mapInArrow(run, ", ".join([*keys, schema]))
