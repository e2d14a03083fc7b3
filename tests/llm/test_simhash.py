from __future__ import annotations

import random
from collections import defaultdict

import xxhash
from lodestream.llm import queries, simhash
from pyspark.sql import functions as F


def slow_fingerprint(text: str | None) -> int:
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values: list[int]) -> dict[int, int]:
    values, root = sorted(set(values)), {}
    for v in values:
        if v in root:
            continue
        front, root[v] = [v], v
        while front:
            at = front.pop()
            for w in values:
                if w not in root and (w ^ at).bit_count() <= 3:
                    root[w] = v
                    front.append(w)
    return root


def check(rows, of_id, of_text):
    root = slow_components([slow_fingerprint(t) for t in of_text])
    least = defaultdict(list)
    for i, t in zip(of_id, of_text, strict=True):
        least[root[slow_fingerprint(t)]] += [i] if i is not None else []
    want = sorted(((i, slow_fingerprint(t), min(least[root[slow_fingerprint(t)]], default=None)) for i, t in zip(of_id, of_text, strict=True)), key=str)
    assert sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in rows), key=str) == want


def test_against_brute_force(documents):
    rows = documents.collect()
    check(simhash.near_duplicates(documents).collect(), [r.doc_id for r in rows], [r.text for r in rows])


def test_odd_rows_and_empty_table(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    check(simhash.near_duplicates(odd).collect(), [r.doc_id for r in rows], [r.text for r in rows])
    assert simhash.near_duplicates(empty).count() == 0


def near_values(rng, n):
    values = set()
    while len(values) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            values.add(base)
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                base ^= 1 << bit
    return sorted(values)


def components_of(spark, values):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[roots.get(v, v)].add(v)
    return sorted(map(sorted, groups.values()))


def test_ring_loses_no_link(spark):
    values = near_values(random.Random(5), 3000)
    want = defaultdict(set)
    for v, r in slow_components(values).items():
        want[r].add(v)
    assert components_of(spark, values) == sorted(map(sorted, want.values()))


def test_large_buckets_are_keyed_anew(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 6))) for _ in range(600)})
    want = defaultdict(set)
    for v, r in slow_components(values).items():
        want[r].add(v)
    monkeypatch.setattr(simhash, "BUCKET", 20)
    assert components_of(spark, values) == sorted(map(sorted, want.values()))


def test_one_row_of_each_group_stays(odd):
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    found = sorted(((r.doc_id, r.text[:10] if r.text else r.text) for r in kept.collect()), key=str)
    # 3, 4, 5 and the null row have no words, so they are one group; 1 and 2 have one text
    assert found == sorted([(1, "the cat sa"), (3, None), (None, "der Hund l"), (6, "12 + 30 = "), (7, "word word "), (8, "日本語のテキスト<|"), (9, "yyyyyyyyyy")], key=str)


def test_query_columns(spark):
    found = queries.op1_simhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert found.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0
