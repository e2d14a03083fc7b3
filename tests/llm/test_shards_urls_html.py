from __future__ import annotations

import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import oracle
import pytest
from lodestream.llm import htmltext, queries, shards, urlfilter

SF = "/root/testdata/sf0.001"


def slow_capacity(sizes, parts):
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *c, len(sizes)])) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), parts - 1))


def test_smallest_capacity_and_cuts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = rng.integers(0, 30, rng.integers(0, 9))
        if len(sizes) and rng.random() < 0.3:
            sizes[rng.integers(len(sizes))] = 100
        parts = int(rng.integers(1, 5))
        capacity = slow_capacity(sizes.tolist(), parts)
        assert shards.smallest_capacity(sizes, parts) == capacity
        at = [0, *shards.cuts(sizes, parts), len(sizes)]
        assert at == sorted(at) and len(at) == parts + 1 and max(int(sizes[a:b].sum()) for a, b in itertools.pairwise(at)) <= capacity


def test_assignment(documents, odd, empty):
    for df, n in ((documents.select("doc_id", "text"), 40), (odd, 5)):
        rows, source = shards.assign(df, n).collect(), df.collect()
        size = lambda t: len((t or "").encode()) + 16
        assert Counter((r.id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in source)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
        assert all(len({r.shard for r in rows if (r.text_crc32, r.size) == k}) == 1 for k in {(r.text_crc32, r.size) for r in rows})
        by_shard, by_bucket = Counter(), Counter()
        for r in rows:
            by_shard[r.shard] += r.size
            by_bucket[r.bucket] += r.size
        assert max(by_shard.values()) <= sum(by_shard.values()) / n + max(by_bucket.values())
    assert shards.assign(empty).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(2)
    universe = [f"k{i}.example/{rng.randint(0, 9)}" for i in range(4000)]
    listed = set(rng.sample(universe, 400))
    cascade = urlfilter.build(listed, spark.createDataFrame([(k,) for k in universe], "key string"))
    assert len(cascade.levels) > 1 and all((k in cascade) == (k in listed) for k in universe)


def test_urls_against_sql_and_rules(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.difference(queries.op7_url_filter(spark, sf), oracle.connect(sf), queries.OP7_SQL) is None
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "x://example.com/en/", "http://notexample.com/en/", "http://a.net/es/", "http://net/es/1", "http://net/es", "a://b://com/", "http://com", "http://com/", "ftp://sub.example.com/EN/", "http://É.com/"]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] + [(4, urls[4], "x", "x")], "page_id long, url string, host string, rule string")
    found = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, queries.RULES).collect()}
    assert urlfilter.judge(pages, queries.RULES).count() == len(urls) + 1
    assert [found[i] for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
        ("notexample.com", "/en/", "com/", "allow"), ("a.net", "/es/", "net/es/", "block"), ("net", "/es/1", "net/es/", "block"), ("net", "/es", None, "allow"), ("b:", "//com/", None, "allow"), ("com", "", None, "allow"), ("com", "/", "com/", "allow"),
        ("sub.example.com", "/EN/", "com/", "allow"), ("É.com", "/", "com/", "allow"),
    ]
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, [], "block").collect()} == {"block"}


def test_whole_articles(spark):
    for r in queries.op5_html_extraction(spark, SF).collect():
        page = spark_page(spark, r.page_id)
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))) for p in re.split("</?p>|</?h1>", article)]
        assert r.text == "\n".join(t for t in (" ".join(p.split()) for p in parts) if t) and r.n_chars == len(r.text)


_pages: dict[int, str] = {}


def spark_page(spark, page_id):
    if not _pages:
        _pages.update({r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()})
    return _pages[page_id]


def test_pages_without_article_elements():
    body = """<div id=top class="site-header"><h1>Site</h1></div><div class=wrap><ul class=menu><li><a href=x>a</a><li><a href=y>b</a></ul>
      <div class=post><h2>Head&lt;er</h2><p>Some long paragraph of text that <a href=q>goes</a> on&nbsp;and on with <b>plenty</b> of words in it.<p>Short.<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></div>
      <div class=box><a href=1>link one</a> <a href=2>link two</a></div></div><div class=comments>Nice!</div><div class="cookie-notice">We use cookies to make this page even longer than it should be.</div><form><p>Search</p></form><aside>More</aside>"""
    want = "Head<er\nSome long paragraph of text that goes on and on with plenty of words in it.\nShort.\none\ntwo\nx\ny"
    assert htmltext.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == want


def test_broken_and_odd_pages(spark):
    for page, want in {
        "": "", "plain text": "plain text", "<p>a<script>var x='</p>'</script>b": "ab", "<div>": "", "a < b": "a < b", "<p>un<b>closed<p>next": "unclosed\nnext", "<article><p>x</article></article></p>y": "x\ny", "<!-- <p>no</p> --><p>yes": "yes",
        "<p>a&amp;b &am &#39;": "a&b &am '", "<style>p{}</style><p>t</p><script>": "t", "<svg><text>no</text></svg>yes": "yes",
        "<body><p>beside</p><article class='has-sidebar'><p>this<article class=comment><p>not this</article></article></body>": "beside\nthis", "<div class='post no-comments'><p>kept</div><div class=readerComments><p>dropped</div>": "kept",
    }.items():
        assert htmltext.main_text(page) == want, page
    deep = "<div>" * 50_000 + "text" + "</span>" * 50_000
    assert htmltext.main_text(deep) == "text"
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a", "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.id), str(r.url), r.text, r.n_chars) for r in htmltext.extract(rows).collect()) == [("1", "None", "", 0), ("1", "u", "a", 1), ("None", "u", "", 0)]
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_text_beside_articles_is_kept():
    long = [f"A long paragraph of running text number {i} with many words in it." for i in range(20)]
    page = f"<body><div>{''.join(f'<p>{x}</p>' for x in long)}</div><article class=card><p>teaser</p></article></body>"
    assert htmltext.main_text(page).startswith("\n".join(long))
    parts = [[f"{name} is the start of a paragraph that goes on for a while, as prose does.", f"{name} ends in a second paragraph of about that size."] for name in ("Alpha", "Beta", "Gamma")]
    page = "".join(f"<article><p>{a}</p><p>{b}</p></article>" for a, b in parts)
    assert htmltext.main_text(f"<body>{page}</body>") == "\n".join(x for p in parts for x in p)


class Dom(HTMLParser):
    """A DOM of well-formed pages: [tag, children], children nodes or strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#page", []]
        self.stack = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack[-1][1].append(node := [tag, []])
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def slow_main_text(page: str) -> str:
    """Composite text density by its formula, with every sum worked out anew."""

    def nodes(x):
        yield x
        for c in x[1]:
            if isinstance(c, list):
                yield from nodes(c)

    def chars(x, linked=False, only=False):
        return sum(chars(c, linked or c[0] == "a", only) if isinstance(c, list) else len(c) * (linked or not only) for c in x[1])

    def density(x):
        c, lc = chars(x, x[0] == "a"), chars(x, x[0] == "a", True)
        if not c:
            return 0.0
        t, lt = max(1, len(list(nodes(x))) - 1), max(1, sum(n[0] == "a" for n in nodes(x)))
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e + 1)
        return c / t * math.log(c / max(1, lc) * t / lt, base)

    root = Dom(page).root
    body = next(n for n in nodes(root) if n[0] == "body")
    ratio = chars(body, False, True) / max(1, chars(body))
    order = list(nodes(body))
    parent = {id(c): n for n in order for c in n[1] if isinstance(c, list)}
    sums = {id(n): sum(density(c) for c in n[1] if isinstance(c, list)) for n in order}
    centre = max(order, key=lambda n: sums[id(n)])  # the first of equal ones
    path = [centre]
    while path[-1] is not body:
        path.append(parent[id(path[-1])])
    threshold = min(density(n) for n in path)
    while centre is not body and centre[0] in htmltext.PARTS:
        centre = parent[id(centre)]
    chosen = []

    def choose(n):
        if n is centre or not any(x is centre for x in nodes(n)) and density(n) >= threshold > 0 and chars(n, n[0] == "a", True) * 2 <= chars(n, n[0] == "a"):
            chosen.append(n)
        else:
            for c in n[1]:
                if isinstance(c, list):
                    choose(c)

    choose(body)

    def text(n):
        inner = "".join(text(c) if isinstance(c, list) else c for c in n[1])
        return f"\n{inner}\n" if n[0] in htmltext.BLOCK else inner

    lines = "\n".join(text(n) for n in chosen).split("\n")
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def test_density_against_brute_force_dom():
    rng, several = random.Random(8), 0

    def block(depth):
        kind = rng.random()
        if depth and kind < 0.45:
            return f"<div>{''.join(block(depth - 1) for _ in range(rng.randint(1, 4)))}</div>"
        words = " ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.choice([1, 3, 12, 50])))
        if kind < 0.6:
            return f"<p><a>{words}</a></p>"
        return f"<p>{words}<b>bold</b> <a>link</a></p>" if kind < 0.8 else f"<p>{words}</p>"

    for _ in range(300):
        page = f"<html><body>{''.join(block(4) for _ in range(rng.randint(1, 5)))}</body></html>"
        want = slow_main_text(page)
        assert htmltext.main_text(page) == want, page
        several += want != "\n".join(x for x in re.sub("<[^>]*>", "\n", page).split("\n") if x)
    assert several > 50  # the method leaves something out


WRAPPERS = [
    ('<div class="post-with-comments">', "</div>"), ('<div class="layout sidebar-right">', "</div>"), ('<div class="search-results">', "</div>"), ('<div id="share">', "</div>"), ('<form id="aspnetForm">', "</form>"),
    ('<form><div class="layout sidebar-right"><div role=search>', "</div></div></form>"), ("<object>", ""), ("<svg>", ""), ("<math>", ""), ("", ""),
]


@pytest.mark.parametrize("begin,end", WRAPPERS)
@pytest.mark.parametrize("n", [1, 30])
def test_marked_wrappers_keep_their_article(begin, end, n):
    lines = ["A title", *(f"Paragraph {i} of running text that has a good many words in it, as prose has them, and ends here." for i in range(n))]
    article = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    page = f"<html><body>{begin}<nav>menu</nav>{article}<div class=comments><div class=comment>Very nice!</div></div><div class=sidebar>more here</div>{end}<footer>foot</footer></body></html>"
    assert htmltext.main_text(page) == "\n".join(lines)


def test_many_comments_of_a_short_article():
    comments = "".join(f"<div class=comment><p>Comment {i} of a reader who has a lot to say about all of it.</p></div>" for i in range(60))
    for box in (comments, re.sub(" class=comment>", ">", comments)):
        page = f"<body><div><h1>Title</h1><p>{'word ' * 80}</p></div><section class=comments><h2>60 comments</h2>{box}</section><form><p>Your reply, please.</p></form></body>"
        assert htmltext.main_text(page) == "Title\n" + " ".join(["word"] * 80)


def test_what_is_left_out_against_brute_force():
    """Texts of pages whose elements are marked at random, by the rule's own words: from the inside out, the surroundings keep the heaviest marked one or none."""
    rng, kept_some, cut_some = random.Random(4), 0, 0

    def block(depth):
        marked = rng.random() < 0.4
        inner = [block(depth - 1) if depth and rng.random() < 0.6 else "x" * rng.choice([1, 3, 40, 900]) for _ in range(rng.randint(1, 4))]
        return (marked, inner)

    def page_of(b):
        return f"<div{' class=ad' if b[0] else ''}>{''.join(page_of(c) if isinstance(c, tuple) else c for c in b[1])}</div>"

    def texts(b):
        """Own unmarked texts in order, with the marked blocks right inside as they stand."""
        for c in b[1]:
            if isinstance(c, str):
                yield c
            elif c[0]:
                yield c
            else:
                yield from texts(c)

    def resolve(b):
        found = [(resolve(x) if isinstance(x, tuple) else x) for x in texts(b)]
        plain, marked = sum(len(x) for x in found if isinstance(x, str)), [x for x in found if isinstance(x, list)]
        best = max(marked, key=lambda x: sum(map(len, x)), default=None)
        keep = best is not None and sum(map(len, best)) > htmltext.OUTWEIGHS * plain
        return [t for x in found for t in ([x] if isinstance(x, str) else x if keep and x is best else [])]

    for _ in range(400):
        root = (False, [block(3) for _ in range(rng.randint(1, 3))])
        tree = htmltext.Tree(page_of(root))
        found = [t for n, t in tree.parts if t is not None and not tree.left_out[n]]
        want = resolve(root)
        assert "".join(found) == "".join(want)
        kept_some += any(m and not o for m, o in zip(tree.marked, tree.left_out))
        cut_some += any(tree.left_out)
    assert kept_some > 50 and cut_some > 50


def test_density_decides_on_pages_without_marks():
    """Pages whose menus, link lists and teasers have no telling tags or names: only density tells them from the article."""
    rng, without = random.Random(5), 0
    for _ in range(200):
        links = lambda n: "".join(f"<li><a href=/{i}>entry {rng.randint(0, 999)}</a></li>" for i in range(n))
        lines = ["Heading of the page", *(" ".join(f"word{rng.randint(0, 999)}" for _ in range(rng.randint(25, 60))) for _ in range(rng.randint(3, 9)))]
        article = f"<div class=c{rng.randint(0, 9)}><h1>{lines[0]}</h1>{''.join(f'<p>{x}</p>' for x in lines[1:])}</div>"
        boxes = [f"<div class=a><ul>{links(rng.randint(3, 12))}</ul></div>" for _ in range(rng.randint(0, 2))]
        page = f"<html><body><div class=x>{''.join(boxes)}{article}<div class=b><ul>{links(rng.randint(0, 6))}</ul></div></div></body></html>"
        assert htmltext.main_text(page) == "\n".join(lines)
        without += "entry" in page
    assert without > 50


def test_head_without_end():
    assert htmltext.main_text("<html><head><title>no</title><meta charset=utf-8><p>yes<p>more") == "yes\nmore"


def test_megabyte_pages_of_broken_tags():
    pages = [p for part in ("<a ", '<a "', "<a '", "<!", "<script>", "</script ", "<h1>", "<li>", '<a ">" ', "<p><b>", "<table><tr><td>", "<svg>", "<div class=ad>", "<p><form>") for p in (part * (1_000_000 // len(part)), "<script>" + part * (1_000_000 // len(part)) + ">")]
    pages += ["<ul><li><ul>" + "<span>" * 60_000 + "<li></li>" * 70_000, "<p><button>" + "<span>" * 80_000 + "<hr>" * 120_000, "<table><tr><table>" + "<b>" * 100_000 + "<tr></tr>" * 80_000]
    for page in pages:
        start = time.perf_counter()
        htmltext.main_text(page)
        assert time.perf_counter() - start < 10, page[:40]


def test_rules_in_several_cascades(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.org/p{i % 7}/x") for i in range(400)], "page_id long, url string")
    rules = [("block" if i % 3 else "allow", f"h{i}.org/p{i % 7}/") for i in range(30)]
    whole = {r.id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    monkeypatch.setattr(urlfilter, "MOST_RULES", 7)
    assert {r.id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()} == whole
    for i, (rule, verdict) in whole.items():
        want = next(((key, v) for v, key in rules if f"h{i % 40}.org/p{i % 7}/x".startswith(key)), (None, "allow"))
        assert (rule, verdict) == want
