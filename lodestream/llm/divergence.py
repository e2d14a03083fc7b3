"""Audit of sources: how far the words of one source of a language are from those of its other sources and of the whole language.

Texts are cut into terms by a table over the bytes of a batch; equal terms are found by their XXH64 and compared byte by byte.
Counts of kept terms form sparse matrices, sources by terms, in blocks of terms that are handled apart, so that no language, source or term meets in one task. All
arithmetic is in integers: shares are ``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms))``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint, map_batches

#: What a byte stands for in a term: small letters and bytes beyond ASCII for themselves, A-Z for their small letters, all others (0) for none.
LOOKUP = np.zeros(256, np.uint8)
LOOKUP[97:123] = LOOKUP[65:91] = np.arange(97, 123)
LOOKUP[128:] = np.arange(128, 256)
SCALE, SMOOTH, MIN_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Bytes of text whose terms are counted together, and cells (counts of one term in one source) of a block on average.
SLICE, CELLS = 8 << 20, 100_000


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of terms or 0, starts, stops) of all terms of texts that lie one after the other in ``data``; a term ends where its text does."""
    low = LOOKUP[data]
    inside = low != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    opens[edge] |= inside[edge]
    closes[edge - 1] |= inside[edge - 1]
    return low, np.flatnonzero(opens), np.flatnonzero(closes) + 1


def group_slices(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(class of each slice, bytes of each class). Slices of one hash are one class once all their bytes agree; those that differ from the first of their hash are told apart by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    _, first, classes = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = stops - starts, first[classes]
    differs = size != size[like]
    same = np.flatnonzero(~differs)
    length = size[same]
    begin = np.cumsum(length) - length
    step = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
    unlike = low[np.repeat(starts[same], length) + step] != low[np.repeat(starts[like[same]], length) + step]
    differs[same] = np.logical_or.reduceat(unlike, begin)
    names = [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(differs).tolist():
        term = raw[starts[i] : stops[i]]
        if term not in more:
            more[term] = len(names)
            names.append(term)
        classes[i] = more[term]
    return classes.astype(np.int64), names


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and each value's start with the end of the last; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, count, docs) of one slice of rows."""
    data, offsets = _buffers(part.column("text"))
    low, starts, stops = boundaries(data, offsets)
    term, names = group_slices(low, starts, stops)
    keys: dict[tuple, int] = {}
    group = np.array([keys.setdefault(k, len(keys)) for k in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    seen, times = np.unique(row * len(names) + term, return_counts=True)
    cell, at = np.unique(group[seen // max(1, len(names))] * len(names) + seen % max(1, len(names)), return_inverse=True)
    count, docs = np.bincount(at, times, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell))
    of, which = np.divmod(cell, max(1, len(names)))
    langs, sources = (pa.array([k[n] for k in keys], pa.string()) for n in (0, 1))
    words = pa.array(names, pa.binary()).cast(pa.string())
    return pa.record_batch([langs.take(pa.array(of)), sources.take(pa.array(of)), words.take(pa.array(which)), pa.array(count), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source of a language, and the rows that have it. Slices of 8 MB are counted before anything is shuffled; a longer text is one slice."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counted = map_batches(rows, "text", "lang string, source string, term string, n long, docs long", _counted, SLICE)
    # dealt by (lang, term), which serves the sums by source and the document frequencies alike
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, terms: int, scale: int = SCALE, smooth: int = SMOOTH) -> np.ndarray:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)) in 64 bits: a long division in steps of 1000, exact while the divisor is below 9 * 10**15."""
    rest, under, found = count + smooth, total + smooth * terms, np.zeros(np.broadcast(count, total).shape, np.int64)
    while scale > 1:
        step = min(scale, 1000)
        digit, rest = np.divmod(rest * step, under)
        found, scale = found * step + digit, scale // step
    return found + 1


def _distances(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sum of abs(point - value) over all values, for each point."""
    order = np.sort(values)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(order)])
    below = np.searchsorted(order, points, "right")
    return points * below - sums[below] + (sums[-1] - sums[below]) - points * (len(order) - below)


def pair_distances(indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, base: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row of a CSR matrix, its sums of absolute differences from every row. A row has ``base`` where it stores nothing.

    Against one row spread out, the stored cells of all others are compared at once and summed by row with reduceat; what they don't store is worth
    their base, whose distance from the whole row comes from its sorted values.
    """
    stored = np.diff(indptr)
    some = stored > 0
    base_of = np.repeat(base, stored)
    for g in range(len(base)):
        mine = slice(indptr[g], indptr[g + 1])
        row = np.full(width, base[g], np.int64)
        row[indices[mine]] = data[mine]
        found = _distances(data[mine], base) + (width - stored[g]) * np.abs(base - base[g])
        here = row[indices]
        if some.any():
            found[some] += np.add.reduceat(np.abs(data - here) - np.abs(base_of - here), indptr[:-1][some])
        yield found


CELL = "lang string, block int, source string, term string, n long, total long, lang_total long, terms long"
OUT = "lang string, source string, part string, item string, value long"


def _block(table: pa.Table, top: int) -> pa.Table:
    """What one block of terms adds: distances of all pairs of sources, and each source's most over-used terms."""
    marks = table.filter(pc.is_null(table["term"]))
    cells = table.filter(pc.is_valid(table["term"]))
    sources = marks["source"].to_pylist()
    total, lang_total, terms = (marks[c].to_numpy() for c in ("total", "lang_total", "terms"))
    lang, place, n_terms = marks["lang"][0].as_py(), {s: i for i, s in enumerate(sources)}, int(terms[0])
    out: list[tuple[str, str, str, int]] = []
    if cells.num_rows:
        coded = pc.dictionary_encode(cells["term"]).combine_chunks()
        names, column = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        row = np.array([place[s] for s in cells["source"].to_pylist()], np.int64)
        order = np.lexsort((column, row))
        row, column, n = row[order], column[order], cells["n"].to_numpy()[order].astype(np.int64)
        indptr = np.searchsorted(row, np.arange(len(sources) + 1))
        p, base = shares(n, total[row], n_terms), shares(np.zeros(len(sources), np.int64), total, n_terms)
        of_lang = np.bincount(column, n, len(names)).astype(np.int64) if n.sum() < 1 << 53 else np.array([n[column == c].sum() for c in range(len(names))])
        over = p - shares(of_lang, lang_total[:1], n_terms)[column]
        for g, s in enumerate(sources):
            mine = slice(indptr[g], indptr[g + 1])
            value, which = over[mine], column[mine]
            keep = value > 0
            if keep.sum() > top:
                keep &= value >= np.partition(value[keep], -top)[-top]
            best = sorted(((-int(v), names[c].encode()) for v, c in zip(value[keep], which[keep], strict=True)))[:top]
            out += [(s, "term", t.decode(), -v) for v, t in best]
        width = len(names)
    else:
        indptr, column, p, base, width = np.zeros(len(sources) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(sources), np.int64), 0
    parts = [pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64())))], ["lang", "source", "part", "item", "value"])]
    for g, distances in enumerate(pair_distances(indptr, column, p, base, width)):
        others = [i for i in range(len(sources)) if i != g]
        parts.append(pa.table([pa.array([x] * len(others), pa.string()) for x in (lang, sources[g], "pair")] + [pa.array([sources[i] for i in others], pa.string()), pa.array(distances[others])], ["lang", "source", "part", "item", "value"]))
    return pa.concat_tables(parts)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) that occurs. Part pair: every other source of the language, by the sum of absolute
    differences of shares over the language's kept terms (those in ``min_docs`` of its rows or more). Part term: the ``top`` kept terms that the source uses more than its language, by the difference.

    Null text, lang and source count as ''. Repeated rows count as often as they occur; ties of a value go by the item's UTF-8 bytes; a group without any kept term has
    the shares that smoothing gives it; a language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; an empty table gives no
    rows; other columns, whatever their names, are ignored. A very long text is counted alone.

    Tables of a language's or a group's totals are joined without a hint: Spark broadcasts them while it finds them small, and splits hot keys beyond.
    """
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col).withColumn("lang_docs", F.sum("docs").over(by_term)).where(F.col("lang_docs") >= min_docs)
    counts = checkpoint(counts.select("lang", "source", "term", "n", (F.min("source").over(by_term) == F.col("source")).alias("leads")))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"), F.count_if("leads").alias("terms"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col)))).distinct()
    groups = checkpoint(groups.join(totals, ["lang", "source"], "left").na.fill(0))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / cells)).cast("int").alias("blocks"))
    marks = groups.drop("terms").join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "lang_total", "terms")
    none = F.lit(None).cast("long")
    rows = counts.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", none.alias("total"), none.alias("lang_total"), none.alias("terms"))
    # dealt by block: the joins leave rows by language, and a language's blocks would meet in one task
    found = rows.unionByName(marks).repartition("lang", "block").groupBy("lang", "block").applyInArrow(lambda t: _block(t, top), OUT)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
