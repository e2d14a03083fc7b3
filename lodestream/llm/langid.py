"""Language ID by prediction by partial matching: per-language byte context trees of orders 0 to 3, method C escapes with exclusion.

The statistics are frozen after training, so the cost of a byte depends on it and the three bytes before it alone. Workers
keep the costs of the four-byte strings that they have met in a hash table; scoring is a vectorised lookup and a sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import filter_batches, map_batches, resident, texts

ORDER = 3
#: What stands before a text.
LEAD = b"\n" * ORDER
#: The training sample: this many documents of least hash from each of so many classes of ids of each language, of texts of so many bytes at most, of the
#: languages with the most rows. Together they bound the model's size.
DOCS_PER_CLASS, CLASSES, TEXT_BYTES, LANGUAGES = 7, 64, 1 << 18, 200
#: Slots (a power of two) of a worker's table and costs that it holds at most; those of further strings are worked out each time.
SLOTS, HELD = 1 << 21, 4 << 20
LETTER = regex.compile(r"\p{L}")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4. Null ids: 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4, F.lit(0))


def _grams(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, one after the other: each byte with the three before it as a number, and where each text begins and ends among them."""
    raw = np.frombuffer(LEAD + LEAD.join(batch), np.uint8).astype(np.uint32)
    codes = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:] if len(raw) > ORDER else np.zeros(0, np.uint32)
    size = np.fromiter(map(len, batch), np.int64, count=len(batch))
    starts = np.cumsum(size + ORDER) - size - ORDER
    return codes, starts, starts + size


class Model:
    """grams: for each language and order the sorted strings (as numbers) with their counts."""

    def __init__(self, languages: list[str], grams: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.languages, self.grams = languages, grams

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: of each language its four-byte strings, any number of times, with counts. Shorter contexts have the sums."""
        languages = sorted(counts)
        grams = []
        for lang in languages:
            codes, n = counts[lang]
            orders = []
            for order in range(ORDER + 1):
                keys, at = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
                orders.append((keys, np.bincount(at, weights=n, minlength=len(keys))))
            grams.append(orders)
        return cls(languages, grams)

    def costs(self, lang: int, context: int) -> np.ndarray:
        """Bits of each byte after three bytes. 2**-bits sum to 1 (to the escaped mass short of it once all 256 bytes are known)."""
        bits, seen, spent = np.zeros(256), np.zeros(256, bool), 0.0
        for order in range(ORDER, -1, -1):
            keys, counts = self.grams[lang][order]
            low = (context & ((1 << 8 * order) - 1)) << 8
            a, b = np.searchsorted(keys, [low, low + 256]) if low + 256 <= 0xFFFFFFFF else (np.searchsorted(keys, low), len(keys))
            symbols = (keys[a:b] & np.uint32(255)).astype(np.int64)
            new = ~seen[symbols]
            symbols, n = symbols[new], counts[a:b][new]
            if not len(symbols):
                continue
            total = n.sum() + len(symbols)
            bits[symbols] = spent + np.log2(total / n)
            spent += math.log2(total / len(symbols))
            seen[symbols] = True
        if not seen.all():
            bits[~seen] = spent + math.log2(256 - seen.sum())
        return bits


class Scorer:
    """Code lengths of texts under every language, from a table of costs that fills as strings are met."""

    def __init__(self, model: Model):
        self.model = model
        self.key, self.place = np.zeros(SLOTS, np.uint32), np.full(SLOTS, -1, np.int32)
        self.cost = np.zeros((1 << 14, len(model.languages)))
        self.size, self.held = 0, min(SLOTS // 2, HELD // max(1, len(model.languages)))

    def _slot(self, codes: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint32(2654435761)) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64) + probe & SLOTS - 1

    def _work_out(self, codes: np.ndarray) -> np.ndarray:
        """Costs of distinct, sorted strings."""
        found = np.empty((len(codes), len(self.model.languages)))
        contexts, first = np.unique(codes >> np.uint32(8), return_index=True)
        ends = np.append(first[1:], len(codes))
        for context, a, b in zip(contexts.tolist(), first, ends, strict=True):
            symbols = codes[a:b] & np.uint32(255)
            for lang in range(found.shape[1]):
                found[a:b, lang] = self.model.costs(lang, context)[symbols]
        return found

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each string's costs, -1 if unknown."""
        slot = self._slot(codes, 0)
        place = self.place[slot]
        wrong = np.flatnonzero((self.key[slot] != codes) & (place >= 0))
        probe = 1
        while len(wrong):
            slot = self._slot(codes[wrong], probe)
            place[wrong] = self.place[slot]
            wrong = wrong[(self.key[slot] != codes[wrong]) & (place[wrong] >= 0)]
            probe += 1
        return place

    def _learn(self, codes: np.ndarray) -> None:
        if self.size + len(codes) > len(self.cost):
            grown = np.zeros((2 * (self.size + len(codes)), self.cost.shape[1]))
            grown[: self.size] = self.cost[: self.size]
            self.cost = grown
        self.cost[self.size : self.size + len(codes)] = self._work_out(codes)
        rest, at, probe = codes, np.arange(self.size, self.size + len(codes)), 0
        self.size += len(codes)
        while len(rest):
            slot = self._slot(rest, probe)
            _, one = np.unique(slot, return_index=True)
            one = one[self.place[slot[one]] < 0]
            self.key[slot[one]], self.place[slot[one]] = rest[one], at[one]
            left = np.ones(len(rest), bool)
            left[one] = False
            rest, at, probe = rest[left], at[left], probe + 1

    def code_lengths(self, batch: list[bytes]) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        codes, starts, ends = _grams(batch)
        out = np.zeros((len(batch), len(self.model.languages)))
        place = self._find(codes)
        unknown = np.unique(codes[place < 0])
        extra = None
        if len(unknown) and self.size + len(unknown) <= self.held:
            self._learn(unknown)
            place = self._find(codes)
        elif len(unknown):
            extra = self._work_out(unknown)
        full = np.flatnonzero(ends > starts)
        if not len(full):
            return out
        bounds = np.stack((starts[full], np.minimum(ends[full], len(codes))), 1).ravel()
        if bounds[-1] == len(codes):
            bounds = bounds[:-1]
        for lang in range(out.shape[1]):
            cost = self.cost[:, lang][place]
            if extra is not None:
                miss = np.flatnonzero(place < 0)
                cost[miss] = extra[np.searchsorted(unknown, codes[miss]), lang]
            out[full, lang] = np.add.reduceat(cost, bounds)[::2]
        return out

    def predict(self, batch: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior under even priors, and bits a byte of the best model; und, 0 and null bits without a letter or model."""
        bits = self.code_lengths(batch)
        lang, score, rate = ["und"] * len(batch), np.zeros(len(batch)), np.full(len(batch), np.nan)
        if not bits.shape[1]:
            return lang, score, rate
        best = bits.argmin(axis=1)
        odds = np.exp2(bits[np.arange(len(batch)), best][:, None] - bits).sum(axis=1)
        for i, text in enumerate(batch):
            if LETTER.search(text.decode()):
                lang[i], score[i], rate[i] = self.model.languages[best[i]], 1 / odds[i], bits[i, best[i]] / len(text)
        return lang, score, rate


def train(docs: DataFrame, docs_per_class: int = DOCS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES, text_bytes: int = TEXT_BYTES) -> Model:
    """A model of the whole texts of up to ``docs_per_class`` * CLASSES documents of each language, never of fold 2 or without a language.

    Of more than ``languages`` values of lang those with the most rows are learnt (ties: first by name), and texts over ``text_bytes`` aren't drawn: a language that has
    no shorter one isn't learnt. The limits take hold in each task before the shuffle, and classes of ids split a language that holds most of the
    rows. Repeated ids count as often as they occur. Nulls in id, text or lang aren't drawn; a table without labelled rows gives a model of nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (fold(F.col("id")) != 2))
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages + 1).collect()
    if len(known) > languages:
        rows = rows.where(F.col("lang").isin([r.lang for r in known[:languages]]))
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("id"), F.lit(CLASSES))).orderBy(F.xxhash64("id"), "id"))
    chosen = rows.where((F.octet_length("text") <= text_bytes) & F.col("id").isNotNull()).select("lang", "id").withColumn("rank", rank).where(F.col("rank") <= docs_per_class).select("lang", "id").distinct()
    few = chosen.collect()  # docs_per_class * CLASSES rows of each language at most
    if not few:
        return Model.of_counts({})
    names = sorted({r.lang for r in few})
    wanted = F.broadcast(docs.sparkSession.createDataFrame(few))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        langs = np.array([names.index(x) for x in part.column("lang").to_pylist()])
        batch, out = texts(part.column("text")), []
        for lang in np.unique(langs):
            codes, starts, ends = _grams([x for x, of in zip(batch, langs, strict=True) if of == lang])
            inside = np.zeros(len(codes) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, np.minimum(ends, len(codes)), -1)
            keys, n = np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True)
            out.append((np.full(len(keys), lang), keys, n))
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        return pa.record_batch([pa.array(x) for x in columns], ["lang", "gram", "n"])

    counted = map_batches(rows.where(F.octet_length("text") <= text_bytes).join(wanted, ["id", "lang"], "left_semi"), "text", "lang long, gram long, n long", work).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (counted.column(i).to_numpy() for i in range(3))
    return Model.of_counts({name: (gram[lang == i].astype(np.uint32), n[lang == i].astype(np.float64)) for i, name in enumerate(names) if (lang == i).any()})


def _scorer(shared) -> Scorer:
    return resident(("langid", shared.value.stamp), lambda: Scorer(shared.value))


def _shared(docs: DataFrame, model: Model):
    model.stamp = hash((id(model), tuple(model.languages), sum(int(g[0].sum()) for x in model.grams for g in x)))
    return docs.sparkSession.sparkContext.broadcast(model)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, bits_per_byte. Only the whole text counts.

    lang_pred is und, with score 0 and bits_per_byte null, if the text is null or has no letter (or nothing was learnt); ties go to the language
    first in order. held_out: the id's fold is 2 (null id: false). Repeated rows keep their rows, an empty table gives none, other columns are ignored.
    """
    shared = _shared(docs, model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rate = _scorer(shared).predict(texts(part.column("text")))
        return pa.record_batch([part.column("id"), part.column("held_out"), pa.array(lang), pa.array(score), pa.array(rate, mask=np.isnan(rate))], ["id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == 2).alias("held_out"))
    return map_batches(rows, "text", "id long, held_out boolean, lang_pred string, score double, bits_per_byte double", work)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that have a language, which means all with a letter, whatever was learnt: how well a model fits is no reason to drop a text with letters."""
    shared, model_languages = _shared(docs, model), len(model.languages)

    def keep(part: pa.RecordBatch) -> np.ndarray:
        batch = texts(part.column(text_col))
        if not model_languages:
            return np.array([LETTER.search(x.decode()) is not None for x in batch], bool)
        return np.array([x != "und" for x in _scorer(shared).predict(batch)[0]], bool)

    return filter_batches(docs, text_col, keep)
