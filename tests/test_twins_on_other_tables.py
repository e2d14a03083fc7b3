"""Queries against their SQL twins over tables that the given ones don't show: long paths, texts without characters, broken and short pages."""

from __future__ import annotations

import os

import oracle
import pytest
from lodestream.operators import graph
from lodestream.plans import registry

SF = "/root/testdata/sf0.001"


def difference(spark, folder, query: str, table: str, rows, schema: str) -> str | None:
    """How a query differs from its SQL if one table is replaced."""
    for name in os.listdir(SF):
        if name != f"{table}.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{table}.parquet"))
    return oracle.difference(registry.QUERIES[query](spark, str(folder)), oracle.connect(str(folder)), registry.ORACLE_SQL[query])


#: Pages of one site, each linked from the one before.
LONG_PATH = [2, 12, 32, 72, 152, 312, 632, 1272, 2552, 5112, 10232, 20472, 40952, 13652, 27312, 54632, 18212, 6072, 12152, 24312, 48632, 16212, 32432, 10812, 3602, 1202, 402, 812, 1632, 3272, 6552, 13112, 26232, 8742, 2912, 972, 1952, 3912, 7832, 15672, 31352, 10452, 20912, 6972,
             13952, 27912, 9302, 3102, 6212, 12432, 24872, 8292, 16592, 5532, 11072, 22152, 44312, 14772, 29552, 9852, 19712, 39432, 13142, 26292, 52592, 17532, 35067]


def test_depth_of_a_long_path(spark, tmp_path):
    """Pages further than 60 clicks from the root, as the SQL has them."""
    assert difference(spark, tmp_path, "bfs_depth", "pages", [(k, f"https://x.example/{k}", "") for k in LONG_PATH], "page_id long, url string, html string") is None


@pytest.mark.parametrize("hops, within, found", [(4, None, [0, 1, 2, 3, 4, 5, 6]), (4, 5, [0, 1, 2, 3, 4, 5, None]), (2, 4, [0, 1, 2, 3, 4, None, None]), (2, 9, [0, 1, 2, 3, 4, 5, 6])])
def test_depths_within(spark, monkeypatch, hops, within, found):
    monkeypatch.setattr(graph, "HOPS", hops)
    urls = ["o/", *(f"o/{k}" for k in range(6))]
    pages = spark.createDataFrame([("o", u) for u in urls], "origin string, url string")
    links = spark.createDataFrame([("o", a, b) for a, b in zip(urls, urls[1:], strict=False)], "origin string, src string, dst string")
    assert [r.depth for r in graph.depths(links, pages, within).orderBy("url").collect()] == found


def test_hashes_of_odd_texts(spark, tmp_path):
    """Null, empty, blank and zero characters, marks that combine, and characters beyond 16 bits."""
    texts = [None, "", " ", "\n", "a\0b", "\0", "é", "\U0001f468‍\U0001f469", "\r\n", "word " * 2000, None, ""]
    assert difference(spark, tmp_path, "fnv1a_hash", "documents", list(enumerate(texts)), "doc_id long, text string") is None


def odd_pages(spark) -> list[tuple]:
    """Pages as given, 90 of each kind, so that each has all numbers' residues: empty, only words, without the first or the last part, and short."""
    given = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(18).collect()]
    short = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Avec. Les mots.</title></head><body><a href="/a">la</a><h1>Avec. Les mots.</h1>{}<footer>&copy; x.example &middot; Es &amp; es.</footer></body></html>'
    kinds = [
        lambda k: "", lambda k: "just words", lambda k: given[k % 18][90:], lambda k: given[k % 18][:60], lambda k: given[k % 18][: given[k % 18].index("</h1>") + 5],
        lambda k: short.format("x" * (k % 70)), lambda k: given[k % 18],
    ]
    return [(n * 90 + k, f"https://x.example/en/{k}" + ("?page=2&ref=x" if k % 2 else ""), kind(k)) for n, kind in enumerate(kinds) for k in range(90)]


@pytest.mark.parametrize("query", ["page_findings", "page_scores"])
def test_odd_pages(spark, tmp_path, query):
    assert difference(spark, tmp_path, query, "pages", odd_pages(spark), "page_id long, url string, html string") is None
