"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are split at ASCII white space, where the tokenizer's own pre-tokenizer always
cuts, so the counts of the pieces add up to the count of the text; a piece seen before isn't encoded again.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import lengths, map_batches, resident, texts

#: Pieces that a Python worker remembers, and the longest one that it does (bytes): bounds its memory.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of pieces encoded in one call.
CALL_BYTES = 1 << 20


class Counter:
    """Counts tokens with a ``tokenizers`` file whose pre-tokenizer drops white space, as ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of the library would only wait on each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[bytes, int] = {}

    def encode(self, pieces: list[bytes]) -> list[int]:
        found: list[int] = []
        start = held = 0
        for i, piece in enumerate(pieces):
            held += len(piece) + 16
            if held > CALL_BYTES or i == len(pieces) - 1:
                batch = [x.decode() for x in pieces[start : i + 1]]
                found += map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                start, held = i + 1, 0
        return found

    def count(self, batch: list[bytes]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, split = self.known, [x.split() for x in batch]
        new = set()
        for pieces in split:
            new.update(pieces)
        new = [x for x in new if x not in known]
        sizes = dict(zip(new, self.encode(new), strict=True))
        known.update(sizes)
        counts = [sum(map(known.__getitem__, pieces)) for pieces in split]
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return counts


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Begin, end and other added special tokens aren't counted; strings of special tokens inside a text are one token
    each, as the library has it by default. Null counts as empty: 0 bytes, 0 tokens. Repeated rows keep their rows, an empty
    table gives none, and other columns, whatever their names, are ignored.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        counter = resident(("tokencount", tokenizer), lambda: Counter(tokenizer))
        n = np.array(counter.count(texts(part.column("text"))), np.int64)
        return pa.record_batch([part.column("id"), pa.array(lengths(part.column("text"))), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, "text", "id long, n_bytes long, n_tokens long, over_limit boolean", work)
