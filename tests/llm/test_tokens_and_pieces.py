from __future__ import annotations

import collections
import math

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestream.llm import pieces, queries, tokencount
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COUNTER = tokencount.Counter("word_bpe_49k.json")
SAMPLER = pieces.Sampler("piece_bpe_32k.model", 1.0, 7)


def library(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_library_s(documents, odd):
    for df in (documents.select("doc_id", "text"), odd):
        texts = [r.text or "" for r in df.collect()]
        found = collections.Counter((r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(df).collect())
        assert found == collections.Counter((len(t.encode()), library(t), library(t) > 2048) for t in texts)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="aI'sSé́ \t\n\x0b\x1c\x85\xa0<|>endoftext1Σ", max_size=60))
def test_counts_of_any_text(text):
    assert COUNTER.count([text.encode()]) == [library(text)]


def test_forgets_without_change(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 2)
    counter = tokencount.Counter("word_bpe_49k.json")
    for _ in range(3):
        assert counter.count([b"one two three four"]) == [library("one two three four")]


def all_segmentations(text: str) -> dict[tuple[int, ...], float]:
    """Every way to put a text together, by recursion over characters; units as the sampler has them; normalised weights."""
    whole = {(): 0.0}
    for unit in pieces.UNITS.findall(b" " + text.encode()):
        unit = unit.replace(b" ", pieces.SPACE).decode()

        def rest(i: int, unit: str = unit) -> list[tuple[tuple[int, ...], float]]:
            if i == len(unit):
                return [((), 0.0)]
            found = [(SAMPLER.pieces.of[unit[i:j].encode()], j) for j in range(i + 1, len(unit) + 1) if unit[i:j].encode() in SAMPLER.pieces.of]
            steps = [((p,), s, j) for (p, s), j in found]
            if unit[i].encode() not in SAMPLER.pieces.of:
                raw = unit[i].encode()
                steps.append((tuple(SAMPLER.pieces.byte_id[b] for b in raw), SAMPLER.pieces.fallback * len(raw), i + 1))
            return [(p + q, s + t) for p, s, j in steps for q, t in rest(j)]

        whole = {a + b: s + t for a, s in whole.items() for b, t in rest(0)}
    total = math.log(sum(map(math.exp, whole.values())))
    return {k: v - total for k, v in whole.items()}


def test_all_segmentations_come_once_with_their_probabilities():
    for text in ("the cat", "a\nb", "né 日", "x  y ", "▁", "mint\n\n"):
        want = all_segmentations(text)
        found = SAMPLER.sample([text.encode()], ["k"], 10_000)[0]
        assert len(found) == len(want) == len({tuple(f[0]) for f in found})
        for ids, lp, _, inclusion in found:
            assert abs(lp - want[tuple(ids.tolist())]) < 1e-4
            assert inclusion == 0.0  # none is left out
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False))


def test_samples_follow_sampling_without_replacement():
    p, n = {k: math.exp(v) for k, v in all_segmentations("the cat").items()}, 3000
    first, second, estimate = collections.Counter(), collections.Counter(), 0.0
    for i in range(n):
        a, b = SAMPLER.sample([b"the cat"], [f"k{i}"], 2)[0]
        first[tuple(a[0].tolist())] += 1
        second[tuple(b[0].tolist())] += 1
        estimate += math.exp(a[1] - a[3]) + math.exp(b[1] - b[3])
    for k in sorted(p, key=p.get)[-4:]:
        again = sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)
        for seen, want in ((first[k] / n, p[k]), (second[k] / n, again)):
            assert abs(seen - want) < 4 * math.sqrt(want * (1 - want) / n) + 1e-3
    assert abs(estimate / n - 1) < 0.05  # inclusion scores weigh the samples to one


def test_round_trip_and_independence_of_batches(documents, odd):
    for df in (documents.select("doc_id", "text"), odd):
        whole = pieces.sample_segmentations(df, k=2, with_ids=True).collect()
        assert all(r.decodes for r in whole)
        assert len({(r.id, r.ids_xxh64) for r in whole if r.id is not None}) == len({(r.id, r.sample_no, r.ids_xxh64) for r in whole if r.id is not None})
        again = pieces.sample_segmentations(df.repartition(7), k=2).collect()
        key = lambda r: (str(r.id), r.sample_no, r.ids_xxh64, round(r.priority, 6))
        assert sorted(map(key, whole)) == sorted(map(key, again))


def test_null_and_empty(odd, empty):
    rows = {r.id: r for r in pieces.sample_segmentations(odd.where("doc_id in (3, 4)"), k=3).collect()}
    assert {i: (r.sample_no, r.n_pieces, r.decodes) for i, r in rows.items()} == {3: (0, 0, True), 4: (0, 0, True)}
    assert pieces.sample_segmentations(empty).count() == 0 and tokencount.count_tokens(empty).count() == 0


def test_queries(spark):
    assert queries.op2_token_counts(spark, SF).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert queries.op8_sentencepiece(spark, SF).count() >= 200


def test_query_and_pipeline_give_whole_segmentations(spark, make):
    import corpus_pipeline
    import numpy as np
    import xxhash

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    few = make([(i, texts[i], "en") for i in sorted(texts)[:20]])
    for rows in (queries.op8_sentencepiece(spark, SF).collect(), corpus_pipeline.segment(spark, few, SF).collect()):
        assert rows
        for r in rows:
            assert len(r.ids) == r.n_pieces and xxhash.xxh64_hexdigest(np.array(r.ids, "<i4").tobytes()) == r.ids_xxh64
            assert SAMPLER.pieces.decode(r.ids) == texts[r.doc_id].encode().replace(pieces.SPACE, b" ")
