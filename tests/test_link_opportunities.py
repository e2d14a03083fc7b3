"""Link opportunities: the bounded search against scoring all pairs, and a site with a term on every page."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodestream.operators import site

PAGE = "origin string, url string, row_seq long, status int, robots array<string>"


def brute(pages, links, topics, limit=20):
    terms, n = defaultdict(set), Counter(p[0] for p in pages)
    for origin, url, term in topics:
        terms[origin, url].add(term)
    df = Counter((origin, term) for origin, _, term in topics)
    idf = {k: math.log((n[k[0]] + 1) / (v + 0.5)) for k, v in df.items()}
    incoming, linked, out = Counter((o, d) for o, _, d in links), set(links), []
    for origin in n:
        sources = [p for p in pages if p[0] == origin and p[3] == 200]
        best = []
        for _, dst, _, _, robots in sources:
            if "noindex" in robots or incoming[origin, dst] > 1:
                continue
            found = []
            for _, src, seq, _, _ in sources:
                both = terms[origin, src] & terms[origin, dst]
                score = sum(idf[origin, t] for t in both)
                if src != dst and score > 0 and (origin, src, dst) not in linked:
                    found.append((-round(score, 9), seq, src, len(both), score))
            if found:
                best.append((min(found)[0], dst, min(found)))
        best.sort()
        out += [(origin, f[2], dst, round(f[4], 3), f[3], incoming[origin, dst], "medium" if n[origin] >= 50 else "low") for _, dst, f in best[:limit]]
    return sorted(out)


@pytest.mark.parametrize(("seed", "rare"), [(1, 3), (2, 3), (3, 6), (4, 64), (5, 4)])
def test_search_gives_the_best_of_all_pairs(spark, seed, rare):
    rng = np.random.default_rng(seed)
    pages, links, topics = [], [], set()
    for origin, count in (("a", 70), ("b", 12)):
        urls = [f"{origin}/{i:03d}" for i in range(count)]
        for i, url in enumerate(urls):
            pages.append((origin, url, int(rng.permutation(count)[0]) * 100 + i, 200 if rng.random() < 0.9 else 404, ["noindex"] if rng.random() < 0.1 else []))
            kind = rng.integers(0, 4)
            topics.add((origin, url, "everywhere"))
            if kind:
                topics |= {(origin, url, f"t{int(x)}") for x in rng.zipf(1.4, kind * 3) if x < 60}
        for url in urls:
            for src in rng.choice(urls, rng.integers(0, 3), replace=False):
                links.append((origin, str(src), url))
    links = sorted(set(links))
    found = site.link_opportunities(spark.createDataFrame(pages, PAGE), spark.createDataFrame(links, "origin string, src string, dst string"), spark.createDataFrame(sorted(topics), "origin string, url string, term string"), limit=15, rare=rare)
    assert sorted(map(tuple, found.collect())) == brute(pages, links, topics, 15)


def test_a_term_on_every_page_of_a_large_site(spark):
    pages = spark.range(40_000).selectExpr("'a' AS origin", "concat('a/', lpad(id, 6, '0')) AS url", "id AS row_seq", "200 AS status", "array('') AS robots")
    topics = pages.selectExpr("origin", "url", "explode(array('all', concat('g', row_seq % 7), CASE WHEN row_seq % 1000 < 2 THEN concat('pair', floor(row_seq / 1000)) END)) AS term").where("term IS NOT NULL")
    links = spark.createDataFrame([("a", "a/000000", "a/000001")], "origin string, src string, dst string")
    found = site.link_opportunities(pages, links, topics, limit=30_000).select("src", "dst", "shared").collect()
    got = {r.dst: (r.src, r.shared) for r in found}
    assert len(got) == 30_000
    assert got["a/001000"] == ("a/001001", 2) and got["a/005001"] == ("a/005000", 2)  # the rare term decides
    assert got["a/000009"] == ("a/000002", 2) and got["a/000002"] == ("a/000009", 2)  # else the first of the same common terms
    assert got["a/000000"] == ("a/000001", 2) and got["a/000001"] == ("a/000008", 2)  # a linked source is passed over
