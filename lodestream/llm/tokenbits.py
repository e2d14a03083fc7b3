"""Token ids of a corpus in files of fixed-width bits.

Each id takes the least number of bits that the vocabulary needs. A file is a head, blocks of packed ids, and a foot with
the documents' ids and ends, the blocks' byte offsets and their checksums, so that any run of ids is read by seeking to
its blocks and unpacked by whole arrays. Rows are dealt to tasks by ranges of the document id; a task writes its range in
order as it comes, so its memory follows neither the range nor a text.

Fixed values of the format, all little-endian: head ``8s B 3x I I`` (magic, bits, ids a block, vocabulary); blocks, each of
whole bytes, an id's lowest bit first; foot ``i8`` ids of documents, ``u1`` 1 where such an id is null, ``u8`` ends of
documents in ids, ``u8`` byte offsets of the blocks and of their end, ``u4`` CRC-32 of the blocks; tail ``Q Q Q Q 8s``
(documents, ids, blocks, byte offset of the foot, magic).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import bound_batches, filesystem, resident, slices

MAGIC = b"IDBITS\x00\x01"
HEAD, TAIL = struct.Struct("<8sB3xII"), struct.Struct("<QQQQ8s")
#: Ids of a block (a multiple of 8, so that a full block ends at a whole byte), and blocks that are read or unpacked at once.
BLOCK, TOGETHER = 1 << 16, 16
#: A file is closed after the document with which it holds so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
#: Words that a worker remembers at most, the longest such word, the new words encoded in one call, the bytes of a text that make a window, and of windows that are split at once.
REMEMBERED, LONGEST, CALL_WORDS, WINDOW, AT_ONCE = 1_000_000, 64, 4096, 1 << 20, 4 << 20
MARKS, SPACE = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", re.compile(rb"[ \t\n\r\v\f]")


def bits_for(vocabulary: int) -> int:
    """The least width that holds the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each (1 to 32), lowest bit first; zero bits fill the last byte. Eight ids make ``bits`` whole bytes: every one of the eight is shifted to its place for all groups at once."""
    groups = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    groups[: len(ids)] = ids
    groups, out = groups.reshape(-1, 8), np.zeros((len(groups) // 8, bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = groups[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(packed, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of what ``pack`` gave."""
    groups = -(-count // 8)
    raw = np.zeros(groups * bits, np.uint8)
    held = np.frombuffer(packed, np.uint8, -(-count * bits // 8))
    raw[: len(held)] = held
    raw, out, mask = raw.reshape(groups, bits), np.empty((groups, 8), np.uint32), np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = value >> np.uint64(shift) & mask
    return out.reshape(-1)[:count]


class Writer:
    """Writes one file to a binary sink: ``add`` ids, ``end`` a document, ``close``. Holds less than a block and what was added last, and the foot."""

    def __init__(self, sink, vocabulary: int, block: int = BLOCK):
        self.sink, self.vocabulary, self.bits, self.block = sink, vocabulary, bits_for(vocabulary), block
        self.rest, self.n_ids = np.zeros(0, np.uint32), 0
        self.docs, self.nulls, self.ends, self.offsets, self.sums = array("q"), bytearray(), array("Q"), array("Q", [HEAD.size]), array("I")
        sink.write(HEAD.pack(MAGIC, self.bits, block, vocabulary))

    def _block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.bits)
        self.sink.write(packed)
        self.offsets.append(self.offsets[-1] + len(packed))
        self.sums.append(zlib.crc32(packed))

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError(f"id {int(ids.max())} is beyond the vocabulary of {self.vocabulary}")
        self.n_ids += len(ids)
        held = np.concatenate([self.rest, ids])
        whole = len(held) // self.block * self.block
        for at in range(0, whole, self.block):
            self._block(held[at : at + self.block])
        self.rest = held[whole:].copy()

    def end(self, doc_id: int | None, at: int | None = None) -> None:
        """A document ends after the ids added so far, or ``at`` an earlier count of them."""
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.n_ids if at is None else at)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for part in (self.docs, self.nulls, self.ends, self.offsets, self.sums):
            self.sink.write(bytes(part))
        self.sink.write(TAIL.pack(len(self.docs), self.n_ids, len(self.sums), self.offsets[-1], MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file: any run of ids, or any document's, by its blocks alone. A block whose checksum differs raises ValueError."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, self.vocabulary = HEAD.unpack(self._bytes(0, HEAD.size))
        n_docs, self.n_ids, n_blocks, foot, last = TAIL.unpack(self._bytes(size - TAIL.size, TAIL.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError("no file of packed ids, or one cut short")
        held, at = self._bytes(foot, size - TAIL.size - foot), 0

        def column(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(held, kind, count, at)
            at += found.nbytes
            return found

        self.docs, self.nulls, self.ends = column("<i8", n_docs), column("u1", n_docs).astype(bool), column("<u8", n_docs).astype(np.int64)
        self.offsets, self.sums = column("<u8", n_blocks + 1).astype(np.int64), column("<u4", n_blocks)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends])[:n_docs]

    def _bytes(self, at: int, count: int) -> bytes:
        self.source.seek(at)
        return self.source.read(count)

    def _blocks(self, first: int, stop: int) -> np.ndarray:
        raw = memoryview(self._bytes(int(self.offsets[first]), int(self.offsets[stop] - self.offsets[first])))
        for b in range(first, stop):
            lo, hi = int(self.offsets[b] - self.offsets[first]), int(self.offsets[b + 1] - self.offsets[first])
            if zlib.crc32(raw[lo:hi]) != self.sums[b]:
                raise ValueError(f"block {b} is damaged")
        return unpack(raw, self.bits, min(stop * self.block, self.n_ids) - first * self.block)

    def runs(self, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place of its first id, ids) of runs that make up the ids from ``start`` to before ``stop``."""
        for first in range(start // self.block, -(-stop // self.block), TOGETHER):
            last, base = min(first + TOGETHER, -(-stop // self.block)), first * self.block
            lo, hi = max(start, base), min(stop, last * self.block)
            yield lo, self._blocks(first, last)[lo - base : hi - base]

    def ids(self, start: int, stop: int) -> np.ndarray:
        found = [x for _, x in self.runs(start, stop)] if stop > start else []
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def document(self, n: int) -> np.ndarray:
        return self.ids(int(self.starts[n]), int(self.ends[n]))


class Encoder:
    """Ids as the tokenizers library gives them for whole texts, without added special tokens, as little-endian bytes of four an id.

    Where the tokenizer drops white space, texts are split there by Arrow, many at a time, and each different word is encoded once; where it
    also lower-cases, A-Z are lowered before words are compared, and marks after a word's last letter are taken apart; where it marks the ends of
    words, new words of letters alone are encoded together and cut at those marks. Which of these hold is probed when it is loaded; a tokenizer of
    another kind gets whole texts. Ids of words seen before are gathered by whole arrays.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        words = ["ab", "7", "x9", "it's", "'s", "é", "Ünï", "日本", "--", "…", "<|", "|>", "a<|endoftext|>b", "\u0301a", "ﬁ", "#1!"]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits = all(one(a + s + b) == one(a) + one(b) for a in words for b in words for s in (" ", "\n", "\t\r", "\v ", "\f")) and not any(len(x.split()) != 1 or x != x.strip() for x in added)
        self.lowers = self.splits and all(one(x) == one(x.lower()) for x in ("AZ", "aMZb", "QUICK'S", "ÀB", "X9Y"))
        marks = "".join(m for m in MARKS if not any(m in x for x in added))
        runs = [*marks, *(m + n for m, n in pairwise(marks)), "),", '."', "?!;:", "***", marks, marks[::-1]]
        self.marks = marks if self.lowers and all(one(x + m) == one(x) + one(m) for x in ("ab", "éz", "it's", "9q", "zü") for m in runs) else ""
        self.added = [x.encode().lower() for x in added]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.vocabulary, bool)
        if suffix and self.splits:
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self._remember([b""], pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.uint32())), np.zeros(1, np.int64))
        self.round, self.long = 0, []

    def _remember(self, words: Iterable[bytes], ids: pa.ListArray, used: np.ndarray) -> None:
        """The words known, each with its place in ``ids`` and the round that last had it. The first is empty and has no ids."""
        self.known, self.ids, self.used = {w: k for k, w in enumerate(words)}, ids, used

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each has) of words, encoded as one text and cut after each id that ends a word; None if there are more or fewer of these than words (each word has one at least)."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return None
        return ids, np.diff(stops, prepend=0)

    def _learn(self, words: list[bytes]) -> list[int]:
        """Makes the ids of new words known, and gives their places."""
        plain, others, order, ids, counts = [], [], [], [], []
        for w in words:
            text = w.decode()
            (plain if text.isalpha() and len(w) <= LONGEST else others).append((w, text))
        if not self.last.any():
            plain, others = [], others + plain
        for at in range(0, len(plain), CALL_WORDS):
            some = plain[at : at + CALL_WORDS]
            if found := self._together([x for _, x in some]):
                order += [w for w, _ in some]
                ids.append(found[0])
                counts.append(found[1])
            else:
                others += some
        for at in range(0, len(others), CALL_WORDS):
            some = others[at : at + CALL_WORDS]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([x for _, x in some], add_special_tokens=False)]
            order += [w for w, _ in some]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            counts.append(list(map(len, found)))
        offsets = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
        known, first = self.known, len(self.known)
        known.update((w, k) for k, w in enumerate(order, first))
        self.long += [k for k, w in enumerate(order, first) if len(w) > LONGEST]
        self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))])
        self.used = np.concatenate([self.used, np.zeros(len(order), np.int64)])
        return [known[w] for w in words]

    def _forget(self) -> None:
        """Words too long to be kept go, and of too many the half that was not used for longest."""
        if not self.long and len(self.known) <= REMEMBERED:
            return
        keep = np.ones(len(self.known), bool)
        keep[self.long] = False
        if len(keep) > REMEMBERED:
            keep &= self.used > np.partition(self.used, -(REMEMBERED // 2))[-(REMEMBERED // 2)] - 1
            if keep.sum() > REMEMBERED:  # one round had as many
                keep[:] = False
        keep[0], self.long = True, []
        self._remember(compress(self.known, keep.tolist()), self.ids.filter(pa.array(keep)), self.used[keep])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of these different words stand; words not seen before are encoded."""
        words = words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.known
        found = [known.get(w, -1) for w in words]
        places = np.array(found, np.int32)
        if len(new := np.flatnonzero(places < 0)):
            places[new] = self._learn([words[k] for k in new.tolist()])
        self.round += 1
        self.used[places] = self.round
        return places

    def _apart(self, words: pa.Array) -> pa.Array:
        """Each word without the marks after its last letter (a-z, or a letter of Latin-1), then those marks: two rows a word, over the same bytes."""
        words = pa.concat_arrays([words, pa.array([""])])  # without an offset, and with some bytes' room
        n, (_, offsets, data) = len(words), words.buffers()
        starts = np.frombuffer(offsets, np.int32, n + 1)
        text = np.concatenate([np.zeros(2, np.uint8), np.frombuffer(data, np.uint8, starts[-1]) if data else np.zeros(0, np.uint8)])
        cuts = starts[:-1] + pc.binary_length(pc.ascii_rtrim(words, self.marks)).to_numpy()
        before, last = text[cuts], text[cuts + 1]
        letter = (cuts > starts[:-1]) & ((last >= 97) & (last <= 122) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        both = np.empty(2 * n - 1, np.int32)
        both[0::2], both[1::2] = starts[:-1], np.where(letter, cuts, starts[1:])[:-1]
        return pa.Array.from_buffers(pa.string(), 2 * n - 2, [None, pa.py_buffer(both), data])

    def low(self, text: bytes) -> bytes:
        """The text lowered where that changes no id: not where it would make an added token, nor with combining marks (U+0300 to U+037F), as some compose with small letters only."""
        low = text.lower() if self.lowers and b"\xcc" not in text and b"\xcd" not in text else text
        return text if any(x in low for x in self.added) else low

    def windows(self, text: bytes) -> Iterator[bytes]:
        """The text in windows cut at white space; a word longer than a window makes that window longer."""
        at = 0
        while at < len(text):
            space = SPACE.search(text, at + WINDOW)
            stop = space.start() if space else len(text)
            yield self.low(text[at:stop])
            at = stop

    def _windows(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each window."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        words = split.flatten().dictionary_encode()
        parts = self._apart(words.dictionary).dictionary_encode()
        places = self._places(parts.dictionary)[parts.indices.to_numpy()]
        of_parts = self.ids.take(pa.array(places))
        of_words = pa.ListArray.from_arrays(of_parts.offsets[::2], of_parts.values).take(words.indices)
        stops = of_words.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        ids = of_words.values.to_numpy().astype("<u4", copy=False)
        self._forget()
        return [ids[a:b].tobytes() for a, b in pairwise(stops)]

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(place of the text, some of its ids), in order."""
        if not self.splits:
            for i, e in enumerate(self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)):
                yield i, array("I", e.ids).tobytes()
            return
        owners, held, size = [], [], 0
        for i, text in enumerate(texts):
            for window in self.windows(text):
                owners.append(i)
                held.append(window)
                size += len(window)
                if size >= AT_ONCE:
                    yield from zip(owners, self._windows(held), strict=True)
                    owners, held, size = [], [], 0
        if held:
            yield from zip(owners, self._windows(held), strict=True)


MANIFEST = "part int, file string, first long, n_docs long, n_ids long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every whole text, each followed by ``end_id``, as files in ``folder`` (a URI that all executors reach), in ascending order of the id; gives the manifest of the files.

    Ids of documents are read as long. Rows without an id come first, rows of one id in the order of a hash of their text; null and empty texts have the end id alone; repeated
    rows are written as often as they occur, an empty table gives no file; other columns, whatever their names, are ignored. A very long
    text is split by windows of 1 MB; where the tokenizer doesn't drop white space it is encoded whole.

    A file's name holds the number of the attempt that wrote it, and the manifest, a Parquet table in ``folder``, names those of attempts that
    succeeded: what a lost executor left behind is never read. There are as many ranges as the session's shuffle partitions, or as the scan has if more.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select(id_col).rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = resident(("tokenbits", tokenizer), lambda: Encoder(tokenizer)), TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        end, part, made, first = np.array([end_id], "<u4"), context.partitionId(), [], 0
        writer = None

        def close() -> None:
            nonlocal writer, first
            writer.close()
            made.append((part, name, first, len(writer.docs), writer.n_ids))
            first += writer.n_ids
            writer = None

        for batch in batches:
            for some in slices(batch, "text", AT_ONCE):
                if writer is None:
                    name = f"ids-{part:06d}-{len(made):05d}-{context.taskAttemptId()}.bits"
                    writer = Writer(fs.open_output_stream(f"{base}/{name}"), encoder.vocabulary)
                ids, at = some.column("id").to_pylist(), 0
                held: list[np.ndarray] = []
                texts = [x or b"" for x in some.column("text").cast(pa.binary()).to_pylist()]
                total, ends = writer.n_ids, []
                for i, found in encoder.encode(texts):
                    while at < i:
                        held.append(end)
                        total += 1
                        ends.append(total)
                        at += 1
                    held.append(np.frombuffer(found, "<u4"))
                    total += len(held[-1])
                    if len(texts) == 1:  # a long text's windows are written as they come
                        writer.add(held.pop())
                while at < len(texts):
                    held.append(end)
                    total += 1
                    ends.append(total)
                    at += 1
                writer.add(np.concatenate(held))
                for doc, stop in zip(ids, ends, strict=True):
                    writer.end(doc, stop)
                if writer.n_ids >= file_ids or len(writer.docs) >= FILE_DOCS:
                    close()
        if writer is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "file", "first", "n_docs", "n_ids"), x, strict=True)) for x in made], pa.schema([("part", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, start, n_docs, n_ids): the files of a folder, start being the ids of all documents in files before. Sums run over one row for each range, then inside a range."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(bases, "part").select("file", (F.col("base") + F.col("first")).alias("start"), "n_docs", "n_ids")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone: the place of its first id among all, its ids with the end id, and the CRC-32 of these as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as source:
                    held = Reader(source)
                    sums = np.zeros(len(held.docs), np.int64)
                    for at, ids in held.runs(0, held.n_ids):
                        raw = memoryview(ids.astype("<u4").tobytes())
                        lo, hi = np.searchsorted(held.ends, at, "right"), np.searchsorted(held.starts, at + len(ids), "left")
                        begins = np.maximum(held.starts[lo:hi] - at, 0) * 4
                        stops = np.minimum(held.ends[lo:hi] - at, len(ids)) * 4
                        for n, a, b in zip(range(lo, hi), begins.tolist(), stops.tolist(), strict=True):
                            sums[n] = zlib.crc32(raw[a:b], int(sums[n]))
                    for at in range(0, len(sums), 10_000):
                        some = slice(at, at + 10_000)
                        yield pa.record_batch([pa.array(held.docs[some], mask=held.nulls[some]), pa.array(held.starts[some] + start), pa.array(held.ends[some] - held.starts[some]), pa.array(sums[some])], ["id", "start", "n_tokens", "ids_crc32"])

    files = manifest(spark, folder).select("file", "start")
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), "file").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")
