"""Records of CSV files whose quoted cells hold line breaks, read in parts of files by many tasks.

Spark splits text files at line ends, also inside quotes. Two passes find the true row ends: the first says of each part of a file in which state, inside or outside
quotes, it ends when it begins in either; these are chained from part to part, one row each; the second, knowing how its part begins, puts lines together
into records. Only records that cross the border of two parts are brought together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.store import cut

PART = "file string, block long, out_end boolean, out_starts long, in_end boolean, in_starts long"
CHAIN = "file string, block long, inside boolean, origin long, ragged boolean"
PIECE = "file string, origin long, block long, row_seq long, first boolean, record string"
#: Records of a batch that a task gives at once, and their characters.
ROWS, CHARS = 2000, 4 << 20
#: Parts of files (one row of some 200 bytes for each 128 MB of text) that are sent to all tasks; with more of them lines meet their part by a shuffle.
BROADCAST = 100_000


def _closed(line: str, at: int) -> int:
    """The place after the quote that ends a quoted cell, -1 if the line doesn't hold it. A doubled quote is one of the cell's."""
    while (quote := line.find('"', at)) >= 0:
        if line[quote + 1 : quote + 2] != '"':
            return quote + 1
        at = quote + 2
    return -1


def inside_after(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the line break after ``line`` stands inside a quoted cell. A cell is quoted if a quote is its first character; what follows its closing quote, up to the delimiter, opens nothing."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            if (at := _closed(line, at + (not inside))) < 0:
                return True
            inside = False
        if (at := line.find(delimiter, at) + 1) == 0:
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of a file: how it ends, and how many records begin in it, for either state at its start."""
    now, found = None, []

    def close() -> None:
        if now is not None:
            found.append((*now, states[0], starts[0], states[1], starts[1]))

    for file, block, line in _runs(batches):
        if (file, block) != now:
            close()
            now, states, starts = (file, block), [False, True], [0, 0]
        line = line.removesuffix("\r")
        for k in (0, 1):
            starts[k] += not states[k]
        if '"' in line:
            ends = inside_after(line, states[0])
            states = [ends, ends if states[0] == states[1] else inside_after(line, states[1])]
    close()
    names = ["file", "block", "out_end", "out_starts", "in_end", "in_starts"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.record_batch([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)


def _chained(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one file, some 128 MB each, with how they begin, where the record they begin in began, and whether a record crosses one of their borders."""
    inside, origin, rows = False, 0, []
    for part in parts.sort_values("block").itertuples():
        end, starts = (part.in_end, part.in_starts) if inside else (part.out_end, part.out_starts)
        rows.append((part.file, part.block, inside, origin, bool(inside or end)))
        inside, origin = bool(end), part.block if starts else origin
    return pd.DataFrame(rows, columns=["file", "block", "inside", "origin", "ragged"])


def _pieces(whole: bool):
    """Records that begin and end in their part (``whole``), or the pieces of the others with the part where their record began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held, chars = None, [], [], 0

        def flush(ended: bool) -> None:
            nonlocal chars
            if held and (begun and ended) == whole:
                text = "\n".join(held)
                chars += len(text)
                out.append((now[0], None if whole else now[1] if begun else came_from, now[1], at, first, text))

        def batch_of() -> pa.RecordBatch:
            nonlocal chars
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            made = pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["file", "origin", "block", "row_seq", "first", "record"])
            out.clear()
            chars = 0
            return made

        inside = False
        for file, block, starts_inside, origin, seq, line in _runs(batches):
            if (file, block) != now:
                flush(not inside)
                now, inside, came_from, held, begun, first, at = (file, block), starts_inside, origin, [], not starts_inside, block == 0, seq
            elif not inside:
                flush(True)
                held, begun, first, at = [], True, False, seq
            line = line.removesuffix("\r")
            held.append(line)
            inside = inside_after(line, inside)
            if len(out) >= ROWS or chars >= CHARS:
                yield batch_of()
        flush(not inside)
        if out:
            yield batch_of()

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(row_seq, first, record): all records of the files as text, in the files' order by row_seq; ``first`` marks each file's first. Line ends inside a record are \\\\n.

    A record longer than a part of a file is put together in one task; an empty file gives none; a file that can't be split (compressed) is one part.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_seq"), "value")
    parts = cut(lines.select("file", "block", "value").mapInArrow(_summaries, PART).groupBy("file").applyInPandas(_chained, CHAIN))
    if parts.count() <= BROADCAST:
        parts = F.broadcast(parts)
    begun = lambda known: lines.join(known, ["file", "block"]).select("file", "block", "inside", "origin", "row_seq", "value").sortWithinPartitions("file", "block", "row_seq")
    whole = begun(parts.drop("ragged")).mapInArrow(_pieces(True), PIECE).select("row_seq", "first", "record")
    across = begun(parts.where("ragged").drop("ragged")).mapInArrow(_pieces(False), PIECE)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n")
    joined = across.groupBy("file", "origin").agg(F.min("row_seq").alias("row_seq"), F.bool_or("first").alias("first"), text.alias("record"))
    return whole.unionByName(joined.select("row_seq", "first", "record"))
