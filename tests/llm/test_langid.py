from __future__ import annotations

import math
import zlib

from lodestream.llm import langid, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_costs_are_a_code(documents):
    model = langid.train(documents)
    for lang in range(len(model.languages)):
        for context in (0x0A0A0A, int.from_bytes(b"the", "big"), 0x010203, 0xFFFFFF, 0):
            assert abs((2.0 ** -model.costs(lang, context)).sum() - 1) < 1e-9


def slow_bits(counts: dict, text: bytes) -> float:
    """Prediction by partial matching with exclusion, byte by byte, from counts of four-byte strings."""
    total, raw = 0.0, langid.LEAD + text
    for at in range(3, len(raw)):
        seen: set[int] = set()
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                total += math.log2(256 - len(seen))
                break
            context = raw[at - order : at]
            after: dict[int, float] = {}
            for gram, n in counts.items():
                if gram[3 - order : 3] == context and gram[3] not in seen:
                    after[gram[3]] = after.get(gram[3], 0) + n
            if not after:
                continue
            whole = sum(after.values()) + len(after)
            if raw[at] in after:
                total -= math.log2(after[raw[at]] / whole)
                break
            total -= math.log2(len(after) / whole)
            seen |= after.keys()
    return total


def test_code_lengths_against_brute_force():
    import numpy as np

    texts = {"a": b"abracadabra abraca dabra", "b": b"the cat sat on the mat"}
    counts = {}
    for lang, t in texts.items():
        counts[lang] = {}
        raw = langid.LEAD + t
        for i in range(3, len(raw)):
            counts[lang][raw[i - 3 : i + 1]] = counts[lang].get(raw[i - 3 : i + 1], 0) + 1
    model = langid.Model.of_counts({k: (np.array([int.from_bytes(g, "big") for g in c], np.uint32), np.array(list(c.values()), float)) for k, c in counts.items()})
    batch = [b"abra", b"", b"the mat\x00\xff", b"cadabra the", b"\n"]
    scorer = langid.Scorer(model)
    for _ in range(2):  # the second time from the table
        found = scorer.code_lengths(batch)
        for i, t in enumerate(batch):
            for j, lang in enumerate(model.languages):
                assert abs(found[i, j] - slow_bits(counts[lang], t)) < 1e-6
    scorer = langid.Scorer(model)
    scorer.held = 0  # strings beyond the table are worked out each time
    assert abs(scorer.code_lengths(batch) - found).max() < 1e-6


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    rows = docs.collect()
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if found[r.doc_id].held_out]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= found[r.doc_id].score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(make):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    model = langid.train(make([(i, "geheim", "de") for i in out] + [(3, "the cat", None)]))
    assert model.languages == []


def test_odd_rows_and_empty_table(odd, empty):
    model = langid.train(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    und = sorted(str(r.id) for r in rows if r.lang_pred == "und")
    assert und == ["3", "4", "5", "6", "None"] and all(r.score == 0 and r.bits_per_byte is None for r in rows if r.lang_pred == "und")
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    nothing = langid.train(empty)
    assert langid.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_letters_stay_when_nothing_was_learnt(odd):
    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.accepted(rows, langid.train(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "7", "8", "9", "None"]


def test_more_languages_than_are_learnt_and_long_texts(make):
    rows = [(i, f"word{i % 7} text of language {i % 6}", f"l{i % 6}") for i in range(0, 120)] + [(1000 + i, "long " * 100, "only-long") for i in range(40)] + [(2000, None, "l0"), (None, "x", "l0")]
    model = langid.train(make(rows), languages=3, text_bytes=400)
    counts = {}
    for i, _, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 or i is None:
            counts[lang] = counts.get(lang, 0) + 1
    most = sorted(sorted(counts), key=lambda x: -counts[x])[:3]
    assert model.languages == [x for x in sorted(most) if x != "only-long"]
    many = make([(i, f"abc{i}", f"v{i}") for i in range(1000)])
    assert len(langid.train(many).languages) == langid.LANGUAGES
