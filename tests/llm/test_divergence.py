"""Source divergence: boundaries, hash collisions, exact shares and whole results against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from lodestream.llm import divergence, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def cut(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    return divergence.boundaries(data, offsets)


def test_boundaries():
    texts = [b"", b"Ab", "cÉd1x".encode(), b"", b"..", b"z", b"q", b"a-B_c"]
    low, starts, stops = cut(texts)
    assert [low.tobytes()[a:b] for a, b in zip(starts, stops, strict=True)] == [m for t in texts for m in TERM.findall(t.lower())]


@pytest.mark.parametrize("digest", [divergence.xxhash.xxh64_intdigest, lambda x: len(x) % 3, lambda x: 7])
def test_slices_of_one_hash_are_told_apart(digest):
    low, starts, stops = cut([b"one two three one six two four five", b"one six tw on"])
    classes, names = divergence.group_slices(low, starts, stops, digest)
    assert [names[c] for c in classes] == [low.tobytes()[a:b] for a, b in zip(starts, stops, strict=True)]
    assert len(set(names)) == len(names)


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    for top in (10, 10**6, 10**12, 8 * 10**15):
        count, total = rng.integers(0, top, 500), rng.integers(top, 2 * top if top < 10**15 else top + 1000, 500)
        want = [1 + 10**9 * (int(c) + 5) // (int(t) + 5 * 77) for c, t in zip(count, total, strict=True)]
        assert divergence.shares(count, total, 77).tolist() == want


def test_pair_distances():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 50, 6)
    dense, stored = np.repeat(base[:, None], 30, 1), rng.random((6, 30)) < [[0.0], [0.3], [1.0], [0.1], [0.0], [0.5]]
    dense[stored] = rng.integers(1, 900, stored.sum())
    indptr = np.concatenate([[0], np.cumsum(stored.sum(1))])
    for g, found in enumerate(divergence.pair_distances(indptr, np.nonzero(stored)[1], dense[stored], base, 30)):
        assert found.tolist() == np.abs(dense - dense[g]).sum(1).tolist()


def brute(rows, min_docs, top):
    terms = [(lang or "", source or "", [m.decode() for m in TERM.findall((text or "").encode().lower())]) for lang, source, text in rows]
    docs, out = defaultdict(Counter), []
    for lang, _, words in terms:
        docs[lang].update(set(words))
    groups = {(lang, source) for lang, source, _ in terms}
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        counts = {s: Counter() for x, s in groups if x == lang}
        for x, s, words in terms:
            if x == lang:
                counts[s].update(w for w in words if w in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [3, 100_000])
def test_audit_against_plain_python(spark, documents, cells):
    rows = [(r.lang, r.source, r.text) for r in documents.select("lang", "source", "text").collect()]
    rows += [("xx", "a", "one two"), ("xx", "b", None), ("yy", "only", "x"), (None, None, "word"), (None, "s", ""), ("en", "no terms", "12 34"), ("tie", "p", "ü ä a"), ("tie", "q", "zz")] + [("tie", "p", "ü ä a é")] * 5
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int")
    found = divergence.audit(df, min_docs=5, top=7, cells=cells if cells > 3 else 300)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 7)


def test_query_and_empty(spark, empty):
    assert oracle.difference(queries.op12_source_divergence(spark, SF), oracle.connect(SF), queries.OP12_SQL) is None
    assert divergence.audit(empty.withColumnRenamed("root", "source")).count() == 0
