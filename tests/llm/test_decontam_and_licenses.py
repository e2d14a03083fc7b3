from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from lodestream.llm import decontam, licenses, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = slow_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = slow_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return spark.createDataFrame([*rows, (9001, "The"), (9002, None), (9003, "..."), (9004, "of the"), (9004, "the mat"), (None, "and"), (9005, "word " * 11), (9006, "DER Hund läuft")], "item_id long, text string")


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 3000])
def test_against_brute_force(documents, odd, benchmark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [(str(r.item_id), r.text) for r in benchmark.collect() if r.item_id is not None]
    for df in (documents.select("doc_id", "text"), odd):
        found = decontam.contamination(df, benchmark).collect()
        assert sorted(((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=str) == slow([(r.doc_id, r.text) for r in df.collect()], items)
        clean = decontam.clean(df, benchmark)
        assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.id) for r in found if not r.contaminated)


def test_empty_tables(odd, empty, benchmark, spark):
    assert decontam.contamination(empty, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(odd, none).where("contaminated").count() == 0 and decontam.clean(odd, none).count() == odd.count()


def test_query_columns(spark):
    assert queries.op4_decontamination(spark, SF).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def slow_scan(text: str) -> list[tuple[str, int]]:
    """Whole notices word for word, with the place of their first word, the longest of overlapping ones."""
    words, found = licenses.words(text.encode()), []
    for name, template in licenses.TEMPLATES.items():
        t = licenses.words(template.encode())
        found += [(len(t), name, i) for i in range(len(words) - len(t) + 1) if words[i : i + len(t)] == t]
    kept: list[tuple[int, str, int]] = []
    for n, name, i in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if all(i + n <= j or i >= j + m for m, _, j in kept):
            kept.append((n, name, i))
    return sorted((i, name) for _, name, i in kept)


def test_whole_notices_against_brute_force(documents, make):
    index = licenses.Index(licenses.TEMPLATES)
    extra = [f"before {t} between {licenses.TEMPLATES['MIT-notice']} after" for t in licenses.TEMPLATES.values()]
    for text in [r.text for r in documents.collect()] + extra:
        assert sorted((m[3], m[0]) for m in index.scan(text.encode()) if m[1] == 1.0) == slow_scan(text)


def test_changed_templates_and_spans():
    index = licenses.Index(licenses.TEMPLATES)
    text = b"x y. " + licenses.TEMPLATES["MIT"].replace("free of charge", "gratis").replace("merge,", "merge, mix,").encode() + b" z"
    ((name, coverage, matched, a, b, start, end),) = index.scan(text)
    assert name == "MIT" and 0.95 < coverage < 1 and text[start:].startswith(b"Permission is hereby") and text[:end].endswith(b"THE SOFTWARE")
    assert matched <= b - a + 1
    assert index.scan(b"the license of the software is free") == []


def slow_align(template, ids, low, high):
    """Most pairs of equal words in order whose diagonals are all in the band, by plain recursion over the next pair."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, p):
        pairs = [(j, q) for j in range(i, len(template)) for q in range(p, len(ids)) if template[j] == ids[q] and low <= q - j <= high]
        return max((1 + best(j + 1, q + 1) for j, q in pairs), default=0)

    return best(0, 0)


def test_alignment_finds_the_most_words():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        template = [rng.randint(1, 4) for _ in range(rng.randint(3, 7))]
        ids = [rng.randint(0, 4) for _ in range(rng.randint(3, 12))]
        low = rng.randint(-2, 3)
        high = low + rng.randint(0, 5)
        matched, a, b = licenses.align(np.array(template), np.array(ids), low, high)
        assert matched == slow_align(tuple(template), tuple(ids), low, high)
        assert not matched or matched <= b - a + 1


def test_license_rows(odd, empty, make, spark):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    two = make([(1, "Released under the MIT License. Licensed under CC BY-NC 4.0.", None)] * 2 + [(None, "released under the mit license", None)])
    rows = licenses.scan(two).collect()
    assert sorted((str(r.id), r.match_no, r.license) for r in rows) == sorted([("1", 0, "MIT-notice"), ("1", 1, "CC-BY-NC-4.0-notice")] * 2 + [("None", 0, "MIT-notice")])
    assert queries.op10_license_scan(spark, SF).columns[0] == "doc_id"
    with pytest.raises(ValueError):
        licenses.scan(two, {"short": "two words"})


def test_query_against_sql(spark):
    import oracle

    sf = "/root/testdata/sf0.01"
    assert oracle.difference(queries.op4_decontamination(spark, sf), oracle.connect(sf), queries.OP4_SQL) is None


def test_changed_notices_against_brute_force_alignment():
    import random

    index, rng = licenses.Index(licenses.TEMPLATES), random.Random(6)
    for text in ("Licensed under the MIT License.", "Distributed under the MIT License.", "Released under an MIT License.", "Released, see, under the, old, MIT, or so, License."):
        assert [m[0] for m in index.scan(text.encode())] == ["MIT-notice"], text
    assert [m[0] for m in index.scan(b"Licensed under the MIT License. Distributed under the MIT License.")] == ["MIT-notice"] * 2
    for t, name in enumerate(index.names):
        n, band = len(index.words[t]), index.band(t)
        if n > 10:
            continue
        for _ in range(10):
            words = licenses.words(licenses.TEMPLATES[name].encode())
            for i in rng.sample(range(n), rng.randint(0, n // 4 + 1)):
                words[i] = rng.choice([b"zz", b"the", b"zz the"])
            ids = index.numbers(b" ".join([b"before", *words, b"after"]).split())
            best = max(slow_align(tuple(index.words[t].tolist()), tuple(ids.tolist()), d, d + 2 * band) for d in range(-2 * band, len(ids)))
            regions = [(a, b) for u, a, b in index.dense(ids) if u == t]
            found = max((licenses.align(index.words[t], ids, a - band, b + band)[0] for a, b in regions), default=0)
            assert found == best if best >= licenses.COVERAGE * n else found < licenses.COVERAGE * n


def test_whole_licenses_in_long_texts():
    index = licenses.Index(licenses.TEMPLATES)
    whole = sorted(n for n in index.names if not n.endswith(("-notice", "-header")))
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"} <= set(whole)
    for name in whole:
        words = licenses.TEMPLATES[name].split()
        cut = words[: -(len(words) // 8)]
        changed = [w if i % 12 else "other" for i, w in enumerate(words)]
        gap = len(words)  # nearer copies may share one band
        text = " ".join(["lead"] * 4000 + words + ["between"] * gap + cut + ["between"] * gap + changed + ["end"] * 4000)
        found = index.scan(text.encode())
        assert [m[0] for m in found] == [name] * 3, (name, found)
        assert found[0][1] == 1.0 and 0.8 <= found[1][1] < 1 and 0.8 <= found[2][1] < 1
        assert text.encode()[found[0][5] : found[0][6]].split()[:3] == [x.strip("(").encode() for x in words[:3]]


def test_repeated_phrases_stay_cheap():
    import time

    index = licenses.Index(licenses.TEMPLATES)
    start = time.perf_counter()
    assert index.scan(b"permission is hereby " * 50_000) == []
    assert len(index.scan(b"the software is provided as is without warranty of any kind " * 17_000)) == 0
    assert len(index.scan(b"Released under the MIT License. " * 2_000)) == 2_000
    assert time.perf_counter() - start < 60


def test_memory_of_a_whole_benchmark_block():
    import random
    import tracemalloc

    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(50_000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=300)).encode()) for i in range(decontam.BLOCK_BYTES // 2_700)]
    tracemalloc.start()
    index = decontam.Index(items)
    index.order({k: np.ones(n, np.int64) for k, n in index.sizes.items()})
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    n, starts, _, found = index.scan(b"other " * 10 + items[77][1])
    assert (n, len(starts), found) == (310, 291, {"77"})


def test_alignments_given_up_early_are_too_short():
    """With a wanted number of words an alignment gives the same result where it reaches it, and fewer words where it doesn't."""
    rng, reached = random.Random(12), 0
    for _ in range(300):
        template = np.array([rng.randint(1, 12) for _ in range(rng.randint(3, 90))], np.int64)
        ids = template.copy()
        for _ in range(rng.randint(0, 60)):
            ids[rng.randrange(len(ids))] = rng.randint(0, 12)
        low, high, enough = -rng.randint(0, 6), rng.randint(0, 6), int(0.8 * len(template))
        whole, early = licenses.align(template, ids, low, high), licenses.align(template, ids, low, high, enough)
        assert early == whole if whole[0] >= enough else early[0] < enough
        reached += whole[0] >= enough
    assert 50 < reached < 280


def test_blocks_bound_alignments():
    index = licenses.Index({"long": " ".join(f"w{i % 37}" for i in range(400)), "short": "a b c a b d"})
    rng = random.Random(13)
    for _ in range(300):
        t = rng.randint(0, 1)
        ids = index.words[t].copy()
        for _ in range(rng.randint(0, len(ids) // 3)):
            ids[rng.randrange(len(ids))] = rng.randint(0, index.base - 1)
        low, high = -rng.randint(0, 20), rng.randint(0, 20)
        if licenses.align(index.words[t], ids, low, high)[0] >= index.enough[t]:
            assert index._in_reach(t, ids, low, high)
    assert not index._in_reach(0, np.zeros(400, np.int64), -5, 5)
