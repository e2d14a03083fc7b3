from __future__ import annotations

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def slow_first(rows: list[tuple[int, str]]) -> list[int]:
    """The smallest id of each component of pairs at 0.8 or more, by comparing all sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def test_stage_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents, SF).select("doc_id").collect())
    assert kept == slow_first(rows)
    assert 145 not in kept and 177 not in kept  # copies at 0.83 whose fingerprints differ in 7 and 11 bits


def test_groups_of_changed_copies(spark, make):
    rng, rows = random.Random(4), []
    for _ in range(25):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows) + 1, " ".join(words), "en"))
            words = [w if rng.random() > 0.02 else f"x{rng.randint(0, 99)}" for w in words] + ["more"] * (rng.random() < 0.2)
    common = [f"common{i}" for i in range(30)]
    rows += [(1000 + i, " ".join([f"own{i}"] * 6 + common + [f"end{i}"]), "en") for i in range(40)]
    kept = corpus_pipeline.near_dedup(spark, make(rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == slow_first([r[:2] for r in rows])
