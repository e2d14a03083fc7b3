"""Small worked cases of the operators, with the results that they must have."""

from __future__ import annotations

import gzip
import itertools

import pytest
from lodestream.functions import dates, delivery, numbers, text, urls
from lodestream.operators import ads, graph, reconcile, rules, scoring, search, site, store, tracking, weblogs
from lodestream.sources import csv_files, jsonld, log_files, pages, robots, sitemaps
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- cells and files ---


@pytest.mark.parametrize("cell, value", [("", 0), ("1,234.5", 1234.5), ("(12)", -12), ("45%", 0.45), ("$ 3", 3), ("5d", 0), ("NaN", 0), ("Infinity", 0), ("0x10", 0), ("1e3", 1000), (".5", 0.5), (None, 0)])
def test_numbers(spark, cell, value):
    assert one(spark, numbers.number_value(F.lit(cell).cast("string"))) == pytest.approx(value)


def test_search_csv(spark, tmp_path):
    path = tmp_path / "search.csv"
    path.write_text("﻿Query,Page,Impressions,Clicks,Position,Email\nseo audit,https://example.com/a,100,5,8.2,me@x\n,,,,,\n\"a, \"\"b\"\"\nc\",/b,0,1,,z\n", encoding="utf-8")
    headers = csv_files.headers_of(spark, str(path))
    mapping = csv_files.suggest_mapping(headers, "search")
    assert [h for h in headers if csv_files.is_sensitive(h)] == ["Email"] and csv_files.missing(mapping, "search") == []
    rows = csv_files.normalize(csv_files.read(spark, str(path)), "search", mapping, "google", ("SEO",)).orderBy("row_seq").collect()
    assert [(r.query, r.impressions, r.clicks, r.ctr, r.position, r.branded) for r in rows] == [("seo audit", 100, 5, 0.05, 8.2, True), ('a, "b"\nc', 0, 1, 0, None, False)]
    with pytest.raises(ValueError):
        csv_files.normalize(csv_files.read(spark, str(path)), "search", mapping | {"query": "Email"})


def test_chinese_ads_csv(spark, tmp_path):
    path = tmp_path / "百度.csv"
    path.write_text('﻿日期,推广计划,点击次数,消费,转化次数,搜索词,手机号\n2026年8月1日,A,"1,000",￥5,2,"品牌, 搜索",123\n', encoding="utf-8")
    headers = csv_files.headers_of(spark, str(path))
    assert csv_files.infer_platform(headers, path.name) == "baidu" and [h for h in headers if csv_files.is_sensitive(h)] == ["手机号"]
    mapping = csv_files.suggest_mapping(headers, "ads")
    assert csv_files.missing(mapping, "ads") == []
    row = csv_files.normalize(csv_files.read(spark, str(path)), "ads", mapping, "baidu").first()
    assert (row.date_raw, row.campaign, row.clicks, row.cost, row.search_term, row.platform) == ("2026-08-01", "A", 1000, 5, "品牌, 搜索", "baidu")


def test_business_rows_once(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("Date,Attribution Key,Valid Conversions\n2026-08-01,order-1,1\n2026-08-01,order-1,1\n2026-08-01,,1\n2026-08-01,,1\n")
    rows = csv_files.normalize(csv_files.read(spark, str(path)), "business", csv_files.suggest_mapping(csv_files.headers_of(spark, str(path)), "business"))
    assert sorted(r.attribution_key for r in rows.collect()) == ["", "", "order-1"]
    assert csv_files.dataset(rows, "business", "p", "d").first().n_rows == 3


def test_combined_log_lines(spark, tmp_path):
    path = tmp_path / "access.log"
    path.write_text('203.0.113.10 - - [05/Aug/2026:10:00:00 +0800] "GET /catalog?utm_source=test HTTP/1.1" 404 123 "https://secret.example/private" "Googlebot/2.1 (+http://www.google.com/bot.html)" request_time=1.200\nnot a line\n')
    rows = log_files.read(spark, str(path))
    row = rows.first()
    assert rows.count() == 1 and (row.url, row.status, row.duration_ms, row.bot_family, str(row.at)) == ("/catalog?utm_source=test", 404, 1.2, "Google", "2026-08-05 02:00:00")
    assert log_files.read(spark, str(path), duration_unit="s").first().duration_ms == 1200
    sitemap = spark.createDataFrame([(0, "/catalog"), (1, "/missing")], "row_seq long, url string")
    assert [r.url for r in weblogs.never_crawled(rows, sitemap).collect()] == ["/catalog", "/missing"]
    assert [(r.url, r.reason) for r in weblogs.wasted_urls(rows).collect()] == [("/catalog?utm_source=test", "error_status")]


def test_log_table(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("Request URL,Status Code,Time,Duration,User Agent\nhttps://x.example/a#b,200,2026-08-05 10:00:00,12ms,bingbot\n,500,,,\n/c,oops,,1.2s,Mozilla\n")
    rows = log_files.read(spark, str(path)).orderBy("row_seq").collect()
    assert [(r.url, r.status, r.duration_ms, r.bot_family) for r in rows] == [("/a", 200, 12.0, "Bing"), ("/c", 0, None, None)]


# --- search, ads, reconciliation ---


def search_rows(spark, rows):
    return spark.createDataFrame([(i, d, q, p, float(n), float(c), 5.0, b) for i, (d, q, p, n, c, b) in enumerate(rows)], "row_seq long, d string, query string, page string, impressions double, clicks double, position double, branded boolean").withColumn("date", F.to_date("d"))


def test_brand_split_and_conflicts(spark):
    rows = search_rows(spark, [(None, "brand", "/a", 100, 10, True), (None, "seo tool", "/a", 80, 8, False), (None, "seo tool", "/b", 20, 2, False)])
    total = search.totals(rows).first()
    assert (total.branded_impressions, total.other_impressions) == (100, 100)
    first = search.conflicts(rows).first()
    assert (first.query, first.impressions, first.n_pages) == ("seo tool", 100, 2)


def test_strict_periods(spark):
    days = lambda ds: search_rows(spark, [(d, "q", "/", 100, c, b) for d, c, b in zip(ds, (10, 10, 8, 6), (True, False, True, False), strict=True)])
    found = {r.segment: r for r in search.strict_periods(days(["2026-08-01", "2026-08-02", "2026-08-03", "2026-08-04"]), "2026-08-13").collect()}
    assert found["all"].days == 2 and str(found["all"].previous_start) == "2026-08-01" and found["branded"].current_clicks == 8 and found["other"].previous_clicks == 10
    for ds in (["2026-08-01", "2026-08-02", "2026-08-04", "2026-08-05"], ["2026-08-10", "2026-08-11", "2026-08-12", "2026-08-13"]):
        assert search.strict_periods(days(ds), "2026-08-13").count() == 0


def test_lenient_periods(spark):
    rows = spark.createDataFrame([(f"2026-08-0{i}", 1.0) for i in range(1, 6)], "d string, cost double").withColumn("date", F.to_date("d"))
    found = search.lenient_periods(rows, ("cost",)).first()
    assert [str(x) for x in (found.previous_start, found.previous_end, found.current_start, found.current_end)] == ["2026-08-02", "2026-08-03", "2026-08-04", "2026-08-05"]


AD = "id string, row_seq long, campaign string, click_id string, utm_campaign string, d string, landing_page string, clicks double, platform_conversions double"


def ad_rows(spark, rows):
    return spark.createDataFrame([(i, k, c, click, utm, "2026-08-01", "/en/landing", 100.0, 20.0) for k, (i, c, click, utm) in enumerate(rows)], AD).withColumn("date", F.to_date("d"))


def business_rows(spark, rows):
    return spark.createDataFrame([(i, click, utm, key, "2026-08-01", 4.0, 0.0, 0.0, None) for i, click, utm, key in rows], "id string, click_id string, utm_campaign string, attribution_key string, d string, valid_conversions double, revenue double, refunds double, conversion_delay_days double").withColumn("date", F.to_date("d"))


def test_attribution_cascade(spark):
    found = ads.attribution(ad_rows(spark, [("click-row", "Core", "gclid-1", "core-utm"), ("utm-row", "Other", "", "other-utm")]), business_rows(spark, [("b1", "gclid-1", None, ""), ("b2", "", "Other-UTM", ""), ("b3", "", "", "core"), ("b4", None, None, None)]))
    assert sorted((r.id, r.ad_id, r.confidence) for r in found.collect()) == [("b1", "click-row", "high"), ("b2", "utm-row", "medium"), ("b3", "click-row", "low")]


def test_reconciliation(spark):
    analytics = spark.createDataFrame([("2026-08-01", "/en/landing?gclid=1#x", 80.0, 8.0, "EUR")], "d string, page string, sessions double, key_events double, currency string").withColumn("date", F.to_date("d"))
    shown = ad_rows(spark, [("a", "Core", "c1", "u1")])
    business = business_rows(spark, [("b1", "c1", "", "")])
    period = reconcile.window(analytics, shown, business, "2026-09-01")
    total = reconcile.totals(analytics, shown, business, period).first()
    assert (total.clicks, total.sessions, total.key_events, total.platform_conversions, total.valid_conversions) == (100, 80, 8, 20, 4)
    assert {r.code for r in reconcile.findings(analytics, shown, business, period).collect()} == {"ads_above_analytics", "business_gap"}
    assert reconcile.matched_pages(analytics, shown).first().matched == 1
    currency = reconcile.currencies(analytics, "USD").first()
    assert not currency.comparable and currency.observed == ["EUR", "USD"]
    grades = reconcile.attribution_grades(shown, business_rows(spark, [("b1", "c1", "", ""), ("b2", "", "U1", ""), ("b3", "", "", "")]))
    assert sorted((r.id, r.grade) for r in grades.collect()) == [("b1", "high"), ("b2", "medium"), ("b3", "low")]


# --- URLs, text, delivery ---


@pytest.mark.parametrize("f, url, want", [
    (urls.tracking_page, "https://example.com/en-us/landing/?gclid=abc&utm_source=google&plan=pro#hero", "https://example.com/en-us/landing?plan=pro"), (urls.tracking_page, "/fr/landing/?utm_campaign=x", "/fr/landing"), (urls.tracking_page, "https://x.example/?b=2&a=1", "https://x.example/?a=1&b=2"),
    (urls.search_page, "https://example.com/#top", "https://example.com/"), (urls.search_page, "https://example.com/a//", "https://example.com/a"), (urls.search_page, " /b/#x ", "/b"), (urls.log_url, "https://x.example/a/b?x=1#f", "/a/b?x=1"), (urls.log_url, "a", "/a"),
    (urls.template_key, "https://x.example/catalog?page=2", "pagination:/catalog?page=:n"), (urls.template_key, "https://x.example/blog/seo-guide", "article:/blog/:slug"), (urls.template_key, "https://x.example/products/red-shoes/", "product:/products/:slug/"), (urls.template_key, "nonsense", "other:invalid"),
    (urls.first_page, "https://x.example/list/page-3?a=1", "https://x.example/list/?a=1"),
])
def test_urls(spark, f, url, want):
    assert one(spark, f(F.lit(url))) == want


@pytest.mark.parametrize("url, want", [("https://x.example/a/page/3", True), ("/list?P=2", True), ("/list?a=1&page=10", True), ("/page/x", False), ("/list?page=", False), ("/list?mypage=2", False), ("", False)])
def test_turns_page(spark, url, want):
    assert one(spark, urls.turns_page(F.lit(url))) is want


@pytest.mark.parametrize("url, want", [
    ("https://x.example/a_p2.html", "https://x.example/a/"), ("https://x.example/blog/Page_12/", "https://x.example/blog/"), ("https://x.example/shop2", "https://x.example/shop2"), ("https://x.example/list?page=4&b=1", "https://x.example/list?b=1"), ("https://x.example/page", "https://x.example/page"),
])
def test_first_page(spark, url, want):
    assert one(spark, urls.first_page(F.lit(url))) == want


@pytest.mark.parametrize("name, want", [
    ("app.0a1b2c3d.js", True), ("app-0a1b2c3d.js", True), ("0A1B-2c3d_", True), ("a-b-c-d-e.js", True), ("app.0a1b2c3.js", False), ("appdeadbeef.js", False), ("main_deadbeef-x.js", True), ("x--0a1b2c3.js", True), ("app-0a1b2c3-x", False), ("", False), ("deadbeef?v=1", True), ("a.js?deadbeef", False),
])
def test_versioned(spark, name, want):
    assert one(spark, delivery.versioned(F.lit(f"https://x.example/s/{name}"))) is want
    assert one(spark, delivery.versioned(F.lit(name))) is False


@pytest.mark.parametrize("control, want", [("max-age=60", 60), ("public,\tMax-Age = 5; x", 5), ("s-maxage=9", None), ("max-age=x, max-age=7s", 7), ("max-age", None), ("", None), (None, None), ("max-age=99999999999999999999", None)])
def test_max_age(spark, control, want):
    assert one(spark, delivery.max_age(F.lit(control).cast("string"))) == want


@pytest.mark.parametrize("tag, want", [("en", True), (" zh-Hans-CN ", True), ("e", False), ("engl", False), ("en-", False), ("en_US", False), ("en-abcdefghi", False), ("e1", False), ("", False)])
def test_language_tag(spark, tag, want):
    assert one(spark, text.is_language_tag(F.lit(tag))) is want


def test_signals_and_placeholders(spark):
    found = one(spark, text.regional_signals(F.lit("+44 (0), +0 1, +12345 6, +1-800, +49\t3, +7, +44-1 on 2026-1-2 or 1/2/26")))
    assert (found["phone_codes"], found["dates"]) == (["+44", "+1", "+49"], ["1/2/26", "2026-1-2"])
    assert one(spark, text.placeholders(F.lit("{{A_1}} {{a}} {{{B}} {{ C }} {{A_1}} G-XXXX AW-XXXXXX/label {{"))) == ["{{A_1}}", "{{B}}", "G-XXXX", "AW-XXXXXX/label"]


def test_origins():
    assert urls.project_origin("Example.com:443") == "https://example.com" and urls.project_origin("//x.example/a") == "https://x.example" and urls.project_origin("http://x.example:8080") == "http://x.example:8080"
    for bad in ("ftp://x.example", "https://me:pw@x.example", ""):
        with pytest.raises(ValueError):
            urls.project_origin(bad)
    assert urls.preferred_host("a.b.example.co.uk") == "example.co.uk" and len(urls.entry_urls("https://example.com.cn")) == 4 and len(urls.entry_urls("https://shop.example.com")) == 2 and urls.entry_urls("http://127.0.0.1") == []


def test_text(spark):
    assert one(spark, text.display_units(F.lit(" 汉a "))) == 3
    assert one(spark, text.dominant_language(F.lit("汉" * 90)))["language"] == "zh" and one(spark, text.dominant_language(F.lit("short")))["language"] is None
    assert one(spark, text.overlap(F.lit("blue shoes"), F.lit("Blue hats"))) == 0.5
    assert one(spark, text.alt_risk(F.lit("IMG_1.jpg"), F.lit(""), F.lit(False), F.lit(1))) == "filename"
    assert one(spark, text.regional_signals(F.lit("USD 5, +44 (0) on 1/2/2026")))["currencies"] == ["USD"]


def test_letters_are_counted_once_a_text(spark):
    han, kana, hangul = "汉", "かカ", "한"
    values = [("a" * 79,), ("a, " * 80,), (han * 90 + kana * 10,), (han * 90 + kana * 20,), (hangul * 60 + "a" * 40,), (" 々⺀ﾊ" + "é-" * 9 + "𠀀 ",), ("",), (None,)]
    found = spark.createDataFrame(values, "t string").select("t", text.display_units(F.col("t")).alias("n"), text.dominant_language(F.col("t")).alias("l")).select("t", "n", "l.language", "l.confidence")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 6
    assert [tuple(r)[1:] for r in found.collect()] == [
        (79, None, "low"), (239, "en", "high"), (220, "zh", "high"), (260, "ja", "high"), (100, "ko", "medium"), (26, None, "low"), (0, None, "low"), (None, None, "low")
    ]


@pytest.mark.parametrize("kind, encoding, size, want", [("text/html", None, 2000, "attention"), ("text/html", "br", 2000, "good"), ("image/png", None, 9999, "good"), ("text/css", None, 900, "good")])
def test_compression(spark, kind, encoding, size, want):
    assert one(spark, delivery.compression(F.lit(kind), F.lit(encoding).cast("string"), F.lit(size)))["status"] == want


@pytest.mark.parametrize("url, kind, control, validator, want", [
    ("https://x/app.0a1b2c3d.js", "application/javascript", "max-age=31536000, immutable", False, ("good", "long_immutable")), ("https://x/app.0a1b2c3d.js", "application/javascript", "max-age=60", False, ("attention", "versioned_short")),
    ("https://x/", "text/html", "no-store", False, ("confirm", "no_store")), ("https://x/a.js", "application/javascript", "private", False, ("attention", "private")), ("https://x/", "text/html", "", True, ("good", "revalidate")), ("https://x/", "text/html", "", False, ("confirm", "insufficient")),
])
def test_cache(spark, url, kind, control, validator, want):
    found = one(spark, delivery.cache(F.lit(url), F.lit(kind), F.lit(control), F.lit(validator)))
    assert (found["status"], found["reason"]) == want


# --- markup ---


def test_robots():
    policy = robots.Policy("User-agent: Googlebot\nDisallow: /private\nAllow: /private/open\nDisallow: /*.css$\nmystery-rule: 1\n\nUser-agent: *\nDisallow:\nSitemap: https://x.example/s.xml\n")
    assert not policy.allowed("https://x.example/private", "Googlebot") and policy.allowed("https://x.example/private", "Bingbot") and policy.allowed("https://x.example/private/open/1", "Googlebot")
    assert not policy.allowed("https://x.example/a.css", "googlebot") and policy.allowed("https://x.example/a.css?v=1", "Googlebot")
    assert policy.unknown == ["mystery-rule"] and policy.sitemaps == ["https://x.example/s.xml"] and robots.Policy("Disallow: /a\nbroken").syntax == ["1:group", "2:format"]


def test_sitemaps(spark):
    body = lambda s: s.encode()
    leaf = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.example/a</loc><lastmod>2026-99-99</lastmod></url><url><loc>https://y.example/b</loc></url></urlset>'
    files = [("https://x.example/sitemap.xml", 200, body("<sitemapindex><sitemap><loc>https://x.example/posts.xml.gz</loc></sitemap><sitemap><loc>/bad.xml</loc></sitemap></sitemapindex>"), "text/xml"), ("https://x.example/posts.xml.gz", 200, gzip.compress(body(leaf)), ""), ("https://x.example/bad.xml", 200, body("<oops"), "")]
    found = sitemaps.walk(spark.createDataFrame(files, "url string, status int, body binary, content_type string"), spark.createDataFrame([("https://x.example", "https://x.example/sitemap.xml")], "origin string, url string"))
    assert [r.url for r in found["urls"].collect()] == ["https://x.example/a"]
    row = found["summary"].first()
    assert (row.discovered, row.children, row.invalid, row.bad_dates, row.compressed) == (True, 2, 2, 1, 1)


def test_json_ld():
    codes = lambda v: {c for c, _ in jsonld.validate(v)[3]}
    assert "date-published-format" in codes({"@type": "Article", "datePublished": "昨天"})
    assert codes({"@type": "Product", "name": "x", "offers": {"price": -1, "priceCurrency": "rmb", "availability": "maybe"}}) == {"product-price-format", "product-currency-format", "product-availability-format"}
    assert codes({"@type": "Organization", "name": "x"}) == {"missing-url", "organization-logo"} and jsonld.parse("{")[3] == [("invalid-json", "error")] and jsonld.validate([])[0] is False


def test_page_record():
    html = """<html lang="en"><head><title> A  title </title><meta name=description content="D"><meta name=robots content=noindex><link rel=canonical href="/c#x"><link rel=alternate hreflang=fr href=/fr>
      <script type="application/ld+json">{"@type": "Article", "headline": "H"}</script></head><body><main><h1>Head</h1><p id=p1>Text<script>no()</script> here</p><a href="/in?x#y" rel="nofollow">in</a><a href="https://o.example/">out</a><a href="#p1">f</a><a href="#gone">g</a><img src=i.png alt="" width=1 height=1></main></body>"""
    r = pages.extract(1, "https://x.example/a", html)
    assert (r["title"], r["description"], r["robots"], r["canonical_resolved"], r["html_lang"], r["h1"]) == ("A title", "D", ["noindex"], "https://x.example/c", "en", ["Head"])
    assert r["internal_links"] == ["https://x.example/in?x", "https://x.example/a"] and r["nofollow_internal"] == 1 and "no()" not in r["text"]
    assert [(a["fragment"], a["fragment_exists"]) for a in r["links"]] == [(False, False), (False, False), (True, True), (True, False)]
    assert r["json_ld"][0]["types"] == ["Article"] and "missing-datePublished" in r["json_ld_issues"] and r["images"][0]["sized"] and r["main_count"] == 1


# --- sites and graphs ---


def test_near_groups_follow_row_order(spark):
    """Chains, ties and repeated fingerprints, against the greedy pass in plain Python."""
    import random

    draw = random.Random(5)
    values = [draw.choice([draw.getrandbits(12), draw.getrandbits(32), 7]) for _ in range(80)]
    rows = spark.createDataFrame([("https://x.example", i, f"u{i}", v) for i, v in enumerate(values)], "origin string, row_seq long, url string, near_fp long")
    want, seen = set(), set()
    for i, v in enumerate(values):
        near = [j for j, w in enumerate(values) if (v ^ w).bit_count() <= 5]
        if i not in seen and len(near) > 1:
            number = len({n for n, _ in want})
            want |= {(number, f"u{j}") for j in near}
            seen |= set(near)
    found = [(r.group_no, r.url) for r in site.near_groups(rows).collect()]
    assert len(found) == len(want) and set(found) == want
    pairs = {(r.fp_a, r.fp_b) for r in site.near_pairs(rows).collect()}
    assert pairs == {(v, w) for v in values for w in values if v < w and (v ^ w).bit_count() <= 5}
    alone = {f"u{i}" for i, v in enumerate(values)} - {r.url for r in site.near_duplicates(rows).collect()}
    assert alone == {f"u{i}" for i, v in enumerate(values) if not any(j != i and (v ^ w).bit_count() <= 5 for j, w in enumerate(values))}


def test_near_groups_are_greedy_stars(spark):
    rows = spark.createDataFrame([("o", i, f"u{i}", v) for i, v in enumerate((0, 0b11111, 0b1111111111, 1 << 31, 0))], "origin string, row_seq long, url string, near_fp long")
    groups: dict[int, list] = {}
    for r in site.near_groups(rows).collect():
        groups.setdefault(r.group_no, []).append(r.url)
    assert {k: sorted(v) for k, v in groups.items()} == {0: ["u0", "u1", "u3", "u4"], 1: ["u1", "u2"]}
    assert sorted((r.fp_a, r.fp_b) for r in site.near_pairs(rows).collect()) == [(0, 31), (0, 1 << 31), (31, 1023)]


def physical(rows) -> str:
    return rows._jdf.queryExecution().sparkPlan().toString()


def words_of(values):
    import re

    return {k: re.findall(r"[a-z0-9][a-z0-9-]{1,30}", " ".join(t.lower() for j, t in values if j == k and t)) for k in {k for k, _ in values}}


TEXTS = [("a", "The red fox and the red-hot fox x9 this"), ("b", None), ("c", ""), ("d", "Only x"), (None, "no key but words, words"), ("e", "汉字和 word 汉字")]


@pytest.mark.parametrize("more", [[], [("a", "and a hen, red hen"), (None, "more words"), ("b", None)]])
def test_simhash_shuffles_no_words(spark, monkeypatch, more):
    from lodestream.functions import hashes, vectorized

    monkeypatch.setattr(vectorized, "WORDS", 3)
    values = [*TEXTS[:5], *more]
    found = site.simhashes(spark.createDataFrame(values, "k string, text string"), ["k"])
    want = {}
    for k, words in words_of(values).items():
        votes = [0] * 32
        for w in words:
            h = hashes.OFFSET
            for c in w:
                h = (h ^ ord(c)) * hashes.PRIME & hashes.MASK
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        if words:
            want[k] = sum(1 << b for b, v in enumerate(votes) if v >= 0)
    assert {r.k: r.near_fp for r in found.collect()} == want
    assert "Generate" not in physical(found) and "Join" not in physical(found)
    pair = site.simhashes(spark.createDataFrame([("k", "汉字和 ab")], "k string, text string"), ["k"]).collect()[0].near_fp
    assert pair == site.simhashes(spark.createDataFrame([("k", "ab"), ("k", "汉字"), ("k", "字和")], "k string, text string"), ["k"]).collect()[0].near_fp


@pytest.mark.parametrize("more", [[], [("a", "and a hen, red hen"), (None, "more words"), ("b", None)]])
def test_topics_shuffle_no_words_of_texts_alone(spark, more):
    from collections import Counter

    values = [*TEXTS[:5], *more]
    found = site.page_terms(spark.createDataFrame(values, "k string, text string"), ["k"], most=4)
    want = {}
    for k, words in words_of(values).items():
        words = [w for w in words if w not in text.STOP_WORDS]
        want |= {(k, w): (n, i + 1) for i, (w, n) in enumerate(Counter(words).most_common(4))}
    got = {(r.k, r.term): (r.n, r["rank"]) for r in found.collect()}
    single = {k for k, _ in values} - ({"a", None} if more else set())
    assert {x: got[x] for x in got if x[0] in single} == {x: want[x] for x in want if x[0] in single}
    if more:  # two texts: places are those in each text
        assert {w: n for (k, w), (n, _) in got.items() if k == "a"} == {"the": 2, "and": 2, "red": 2, "hen": 2}
    else:
        assert "Exchange" not in physical(found) and "Window" not in physical(found)


def test_bands_meet_every_near_pair(spark):
    import random

    rng = random.Random(1)
    values = sorted({rng.getrandbits(32) for _ in range(150)} | {v ^ sum(1 << b for b in rng.sample(range(32), rng.randint(1, 6))) for v in [rng.getrandbits(32) for _ in range(40)] for _ in range(3)})
    rows = spark.createDataFrame([("o", v) for v in values], "origin string, near_fp long")
    want = sorted((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 5)
    assert sorted((r.fp_a, r.fp_b) for r in site.near_pairs(rows).collect()) == want


def test_redirects(spark):
    hops = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")] + [(f"n{i}", f"n{i + 1}") for i in range(12)]
    found = {r.url: r for r in graph.redirect_chains(spark.createDataFrame(hops, "src string, dst string"), spark.createDataFrame([(u,) for u in ("a", "x", "n0", "q")], "url string")).collect()}
    assert (found["a"].final_url, found["a"].hops, found["a"].complete) == ("c", 2, True) and found["x"].looped and (found["n0"].hops, found["n0"].complete) == (8, False) and found["q"].hops == 0


def test_crawl_is_breadth_first_and_bounded(spark):
    links = spark.createDataFrame([("o", i, f"u{i // 3}", f"u{i + 1}") for i in range(30)], "origin string, row_seq long, src string, dst string")
    found = sorted((r.place, r.url) for r in graph.crawl(links, spark.createDataFrame([("o", "u0", 0)], "origin string, url string, row_seq long"), 8).collect())
    assert found == [(i + 1, f"u{i}") for i in range(8)]


# --- rules and scores ---


def findings(spark, rows):
    return spark.createDataFrame([("r", f"rule{i}", "metadata", s, p, float(n), {"pass": 1.0, "warning": 0.5, "failure": 0.0}.get(s), inc, cap, conf, "low", ["u"]) for i, (s, n, p, inc, cap, conf) in enumerate(rows)],
                                 "report_id string, rule_id string, category string, status string, priority string, points double, score_ratio double, included boolean, score_cap int, confidence string, effort string, urls array<string>")


@pytest.mark.parametrize("rows, score, coverage", [
    ([("pass", 7), ("failure", 3), ("not_measurable", 90), ("not_applicable", 20)], 70, 67), ([("warning", 10)], 50, 100), ([("pass", 10), ("not_measurable", 10), ("pass", 0)], 100, 50),
    ([("pass", 10), ("warning", 3, "P3", False)], 100, 100), ([("pass", 95), ("failure", 5, "P0", True, 39)], 39, 100), ([("pass", 95), ("failure", 5, "P1", True, 69)], 69, 100), ([("pass", 95), ("failure", 5, "P1", True, 69, "medium")], 95, 100), ([("not_applicable", 3)], None, 0),
])
def test_scores(spark, rows, score, coverage):
    full = [r + ("P3", True, None, "high")[len(r) - 2 :] for r in rows]
    row = scoring.overall(findings(spark, full)).first()
    assert (row.score, row.coverage) == (score, coverage)


def test_score_details(spark):
    row = scoring.details(findings(spark, [(s, n, "P3", True, None, "high") for s, n in (("pass", 7), ("warning", 6), ("failure", 2), ("not_measurable", 50))])).first()
    assert (row.earned, row.possible, row.deducted, row.normalized) == (10, 15, 5, 67)


def test_weights_of_rules():
    totals: dict[str, int] = {}
    for r in rules.REGISTRY.values():
        totals[r.category] = totals.get(r.category, 0) + r.points
    assert totals == rules.WEIGHTS and len(rules.REGISTRY) == 39


def test_healthy_page_and_faults(spark):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(rules.SNAPSHOT)
    healthy = {
        "report_id": "r", "url": "https://x.example/a", "titles": ["A title that says enough"], "descriptions": ["A description that is long enough to be shown under a title"], "robots": [], "x_robots": "", "canonicals": ["https://x.example/a"], "canonical_resolved": "https://x.example/a/", "html_lang": "zh-CN",
        "headings": [(1, "H"), (2, "S")], "main_count": 1, "form_count": 0, "cta_texts": [], "text_length": 500, "author_present": True, "date_present": True, "links": [("https://x.example/b", "/b", "More", True, False, False, [])],
        "images": [("An image", True, "eager", True, 9.0, False, "", None)], "videos": [], "hreflangs": [], "json_ld": [], "viewport": "width=device-width", "template_type": "other", "raw_available": True, "raw_length": 490, "rendered_length": 500, "lcp": 1300.0, "cls": 0.02, "fcp": 820.0, "ttfb": 260.0,
        "status": 200, "robots_status": 200, "robots_allowed": True, "transport": "good", "compression": "good", "cache": "good", "resource_risk": 0, "crawler": "good", "expected_index_state": "index", "page_type": "article", "target_query": "", "page_task": "",
    }

    def statuses(**changes):
        rows = rules.evaluate(spark.createDataFrame([tuple((healthy | changes)[f.name] for f in kind.fields)], kind)).collect()
        return {r.rule_id: (r.status, r.score_cap) for r in rows}

    assert {s for s, _ in statuses().values()} <= {"pass", "not_applicable", "informational"}
    broken = statuses(titles=[], descriptions=[], robots=["noindex"], canonicals=["a", "b"], json_ld=[(False, [], 0)], images=[(None, True, "", False, 0.0, False, "", "missing")], links=[("", "#", "x", True, False, False, [])])
    want = {"metadata.title": "failure", "metadata.description": "warning", "discoverability.canonical": "failure", "media.json-ld": "failure", "media.image-alt": "warning", "links.valid-hrefs": "warning"}
    assert {k: broken[k][0] for k in want} == want and broken["discoverability.index-directives"] == ("failure", 39)
    assert statuses(robots=["noindex"], expected_index_state="unknown")["discoverability.index-directives"][0] == "informational"
    assert statuses(headings=[(1, "H"), (3, "S")])["content.heading-order"][0] == "warning"


# --- tracking ---

OBSERVED = "run_id string, seq long, id string, platform string, type string, name string, relative_ms long"


def observe(spark, rows):
    return spark.createDataFrame([("run", i, f"o{i}", p, "event", n, t) for i, (p, n, t) in enumerate(rows)], OBSERVED)


def test_verdict(spark):
    runs = spark.createDataFrame([("run", "purchase", "")], "run_id string, goal string, custom_event string")
    marks = [("browser", tracking.SUCCESS, 1500), ("browser", tracking.FAILURE, 20_000)]
    for first in ([("google_analytics", "purchase", 1000)], [("google_tag_manager", "purchase", 1000), ("bing_uet", "purchase", 1100)]):
        row = tracking.verdicts(runs, observe(spark, first + marks)).first()
        assert (row.status, row.successful, row.failed) == ("normal", "recorded_once", "not_recorded")
    assert tracking.verdicts(runs, observe(spark, [])).first().status == "confirm"


def test_duplicates_and_redaction(spark):
    rows = observe(spark, [("google_analytics", "purchase", 1000), ("google_analytics", "Purchase", 1800), ("google_analytics", "purchase", 6000), ("google_tag_manager", "purchase", 1900), ("google_ads", "submit_email", 5)])
    assert [r.event_key for r in tracking.duplicates(rows).collect()] == ["google_analytics:purchase"]
    assert {r.name for r in tracking.accepted(rows).collect()} == {"purchase", "Purchase", tracking.MASK}
    assert tracking.accepted(observe(spark, [("attacker", "x", 1)])).count() == 0
    assert one(spark, tracking.target_id(F.lit("secret@example.com"))) is None and one(spark, tracking.target_id(F.lit("AW-123"))) == "AW-123"


def test_stream_agrees_with_batch(spark, tmp_path):
    from lodestream.streaming.tracking_stream import state_store, watch

    rows = observe(spark, [("google_analytics", "purchase", 1000), ("google_analytics", "purchase", 1800), ("attacker", "x", 5), ("browser", tracking.SUCCESS, 2000)] + [("browser", f"e{i}", 3000 + i) for i in range(250)])
    for part in (rows, rows.limit(2)):  # the second batch is a retry
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stop = spark.createDataFrame([("run", 1000, "stop", "browser", "route", "stop", 0)], OBSERVED)
    stop.write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), timeout=False)
    with state_store(spark):
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    want = sorted((r.seq, r.name) for r in tracking.kept(tracking.accepted(rows)).collect())
    assert sorted((r.seq, r.name) for r in found.collect()) == want and {r.closed for r in found.collect()} == {"stopped"}


def test_closed_runs_stay_closed(spark, tmp_path):
    """A run that its timer closed, one that stopped and one that lost its page: each comes out once, and later rows of any are rejected."""
    import time

    from lodestream.streaming.tracking_stream import state_store, watch

    row = lambda run, seq, name, type_="event", ms=0, id_=None: (run, seq, id_ or f"{run}{seq}", "browser", type_, name, ms)
    batches = [
        [row("timed", 1, "a"), row("timed", 2, tracking.SUCCESS), row("stops", 2, "b"), row("stops", 1, "a"), row("leaves", 1, "a"), row("old", 1, "a")],
        [row("stops", 2, "b"), row("stops", 4, "stop", "route"), row("stops", 3, "c"), row("stops", 5, "after"), row("leaves", 2, "leave", "route"), row("old", 2, "late", ms=30_000)],
        [row("timed", 3, "late"), row("timed", 4, "stop", "route"), row("stops", 6, "stop", "route"), row("leaves", 3, "x"), row("old", 3, "stop", "route"), row("new", 1, "stop", "route")],
        [row("timed", 5, "stop", "route"), row("leaves", 4, "stop", "route")],
    ]
    with state_store(spark):
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, OBSERVED).write.mode("append").parquet(str(tmp_path / "in"))
            stream = watch(spark.readStream.schema(OBSERVED).parquet(str(tmp_path / "in")), ttl_ms=25_000)
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
            if i == 1:
                time.sleep(20)
    found = sorted((r.run_id, r.seq, r.closed) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    rest = [r for r in found if r[0] != "timed"]
    assert rest == [("leaves", 1, "paused"), ("old", 1, "expired"), ("stops", 1, "stopped"), ("stops", 2, "stopped"), ("stops", 3, "stopped")]
    assert [r for r in found if r[0] == "timed"] == [("timed", 1, "expired"), ("timed", 2, "expired")]


# --- store ---


def test_store(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("p1", "d1", 1), ("p1", "d2", 2), ("p2", "d3", 3)], "project_id string, dataset_id string, v int")
    data = lambda p, d, f: spark.createDataFrame([(p, d, f)], "project_id string, dataset_id string, fingerprint string")
    tables.save_dataset("rows", data("p1", "d1", "f1"), rows)
    with pytest.raises(ValueError):
        tables.save_dataset("rows", data("p1", "d9", "f1"), rows)
    tables.delete_dataset("rows", "p1", "d1")
    assert [r.v for r in tables.scan("rows", "p1").collect()] == [2] and [r.v for r in tables.scan("rows", "p2").collect()] == [3]
    tables.delete_project(["rows", "none"], "p1")
    assert tables.scan("rows", "p1").count() == 0
    for origin in ("https://a", "https://a", "https://b"):
        tables.upsert_origin(spark.createDataFrame([(origin, origin)], "project_id string, origin string"))
    assert spark.read.parquet(tables.path("projects")).count() == 2


def test_baseline_diff(spark):
    side = lambda rows: spark.createDataFrame([("k", *r) for r in rows], "key string, rule_id string, status string")
    found = scoring.baseline_diff(side([("title", "failure"), ("canonical", "pass"), ("gone", "pass")]), side([("title", "pass"), ("canonical", "warning"), ("h1", "pass")]))
    assert sorted((r.rule_id, r.change) for r in found.collect()) == [("canonical", "changed"), ("gone", "fixed"), ("h1", "new"), ("title", "fixed")]


# --- further pieces ---


def test_site_policies(spark):
    files = spark.createDataFrame([("https://a", 404, None), ("https://b", 500, None), ("https://c", 200, "User-agent: *\nDisallow: /x")], "origin string, status int, body string")
    asked = spark.createDataFrame([(o, f"{o}/x", [f"{o}/x/a.js"]) for o in ("https://a", "https://b", "https://c")], "origin string, url string, resources array<string>")
    found = {r.origin: r.robots for r in robots.site_policies(files, asked).collect()}
    assert found["https://a"].allowed and found["https://b"] is None and not found["https://c"].allowed and found["https://c"].blocked[0].kind == "script"


def test_resource_delivery(spark):
    resources = spark.createDataFrame([("https://x.example/", i, u, "script") for i, u in enumerate(("https://x.example/a.js", "https://other.example/b.js", "https://x.example/c.js"))], "page string, row_seq int, url string, kind string")
    captured = spark.createDataFrame([("https://x.example/a.js", {"content-type": "application/javascript", "content-length": "5000", "cache-control": "no-store"})], "url string, headers map<string,string>")
    rows = {r.url: r for r in delivery.resource_delivery(resources, captured).collect()}
    assert set(rows) == {"https://x.example/a.js", "https://x.example/c.js"}
    assert rows["https://x.example/a.js"].compression.status == "attention" and rows["https://x.example/a.js"].cache.status == "attention" and rows["https://x.example/c.js"].cache is None


def test_change_records_and_appends(spark):
    rows = store.change_record(spark.createDataFrame([("p", 200), ("p", None), ("p", 0)], "project_id string, days int"), "2026-01-01 00:00:00").collect()
    assert [str(r.learning_until)[:10] for r in rows] == ["2026-04-01", "2026-01-08", "2026-01-02"]
    assert store.only_new(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int"), "k").count() == 1


def test_tag_queue_and_consent(spark):
    from lodestream.operators import documents

    entries = ['{"command": "consent", "target": "default", "signals": {"ad_storage": "denied"}, "secret": "x"}', '{"command": "consent", "target": "update", "signals": {"ad_storage": "granted"}}']
    commands = documents.tag_queue(spark.createDataFrame([("p", entries)], "page string, entries array<string>"))
    assert "secret" not in commands.columns
    row = tracking.consent_state(commands).first()
    assert row.default_seen and row.update_seen and row.order_valid and row.signals["ad_storage"] == "granted"


def test_field_presence(spark):
    payload = '{"ecommerce": {"transaction_id": 1, "items": [{"value": 2}]}, "email": "x"}'
    row = one(spark, tracking.field_presence(F.lit(payload)))
    assert (row.transaction_id, row.items, row.value, row.sensitive, row.event_id) == (True, True, True, True, False)


def test_seeds(spark):
    frame = lambda *us: spark.createDataFrame([("https://x.example", i, u) for i, u in enumerate(us)], "origin string, row_seq long, url string")
    found = site.seeds(frame("https://x.example/"), frame("https://x.example/now"), frame(*(f"https://x.example/blog/{w}" for w in ("a-b", "c-d", "e-f")), "https://x.example/products/x"), 4)
    assert [r.url for r in found.orderBy("row_seq").collect()] == ["https://x.example/", "https://x.example/now", "https://x.example/blog/a-b", "https://x.example/products/x"]


def test_recommendations_have_effects(spark):
    rows = findings(spark, [("failure", 7, "P1", True, None, "high")]).withColumns({"root_cause": F.lit("metadata-title-template"), "rule_id": F.lit("metadata.title")})
    row = scoring.with_effects(scoring.recommendations(rows)).first()
    assert row.recommendation == "content_intent" and row.code.startswith("<title>") and row.direct
    assert scoring.filter_recommendations(scoring.recommendations(rows), "tracking").count() == 0


def test_web_vitals(spark):
    rows = spark.createDataFrame([("p", 1, "largest", 900.0, 0.0, False), ("p", 2, "largest", 1500.0, 0.0, False), ("p", 3, "shift", 0.0, 0.1, False), ("p", 4, "shift", 0.0, 0.5, True), ("p", 5, "interaction", 0.0, 80.0, False), ("p", 6, "navigation", 0.0, -3.0, False)],
                                 "page string, seq int, kind string, start double, value double, recent_input boolean")
    row = scoring.web_vitals(rows).first()
    assert (row.lcp, row.cls, row.inp, row.fcp, row.ttfb) == (1500, 0.1, 80, None, 0)


def test_resources(spark):
    rows = spark.createDataFrame([("p", 0, "https://x/app.js", "script", True, False, False, 10.0), ("p", 1, "https://x/app.js", "script", False, False, False, 0.0), ("p", 2, "https://y/z.css", "stylesheet", False, False, True, None)], "page string, row_seq long, url string, kind string, blocking boolean, inline boolean, third_party boolean, transfer_size double")
    row = scoring.resource_summary(rows).first()
    assert (row.blocking_scripts, row.duplicate_urls, row.third_party, row.unmeasured, row.transfer_size) == (1, 1, 1, 2, 10)
    timings = spark.createDataFrame([("p", "https://x/app.js", 5.0, 10.0), ("p", "https://w/only-timed", 1.0, 2.0)], "page string, url string, duration double, transfer_size double")
    assert [(r.url, r.duration) for r in scoring.resources_with_timings(rows, timings).orderBy("place").collect()] == [("https://x/app.js", 5), ("https://x/app.js", 5), ("https://y/z.css", None), ("https://w/only-timed", 1)]


def test_related_targets(spark):
    from lodestream.operators import documents

    declared = spark.createDataFrame([("a", 0, "b", "hreflang"), ("b", 0, "a", "hreflang"), ("a", 1, "c", "hreflang"), ("a", 2, "d", "mobile")], "url string, row_seq int, target string, kind string")
    captured = spark.createDataFrame([("a", 200), ("b", 200), ("c", 404)], "url string, status int")
    targets = documents.related_targets(declared, captured)
    assert sorted((r.url, r.target, r.state) for r in targets.collect()) == [("a", "b", "ok"), ("a", "c", "error"), ("a", "d", "skipped"), ("b", "a", "ok")]
    assert {r.url: r.status for r in documents.target_summary(targets).collect()} == {"a": "partial", "b": "complete"}


def test_long_and_short_hashes_agree(spark):
    from lodestream.functions import hashes

    rows = spark.createDataFrame([("hello",), ("",), (None,), ("汉字 é",), ("a" * 3000,)], "t string").select("t", hashes.fnv1a(F.col("t")).alias("a"), hashes.fnv1a_long(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a == 0x4F9F2CAB and rows[2].a is None
    assert text.body_fingerprint(F.lit("x" * 90)) is not None


def test_log_lines_with_escapes_and_odd_ends(spark):
    lines = [
        '1.2.3.4 - bob [05/Aug/2026:10:00:00 +0800] "GET /a?q=\\"x\\" HTTP/1.1" 200 -', '1.2.3.4 - - [05/Aug/2026:10:00:00 +0800] "-" 408 0 "-" "-"', '1.2.3.4 - - [05/Aug/2026:10:00:00 +0800] "GET /b HTTP/1.1" 200 5 duration=7',
        '1.2.3.4 - - [05/Aug/2026:10:00:00 +0800] "GET /c HTTP/1.1" 200 5 "r" "bingbot \\"2\\"" "more" request_time=0.5', '1.2.3.4 - - [] "GET /d HTTP/1.1" 200 5', '1.2.3.4 - [05/Aug/2026:10:00:00 +0800] "GET /e HTTP/1.1" 200 5',
        '1.2.3.4 - - [05/Aug/2026:10:00:00 +0800] "GET /f HTTP/1.1" 20 5', '1.2.3.4 - - [05/Aug/2026:10:00:00 +0800] "GET /g', "", None,
    ]
    rows = log_files.parse_lines(spark.createDataFrame(list(enumerate(lines)), "row_seq long, value string"), "s").orderBy("row_seq").collect()
    assert [(r.row_seq, r.status, r.duration_ms, r.bot_family) for r in rows] == [(0, 200, None, None), (1, 408, None, None), (2, 200, 7000, None), (3, 200, 500, "Bing")]
    assert [r.url for r in rows][1:] == ["/", "/b", "/c"]


def test_log_kind_is_told_by_file(spark, tmp_path):
    (tmp_path / "a.log").write_text('1.2.3.4 - - [05/Aug/2026:10:00:00 +0800] "GET /line HTTP/1.1" 200 5 "-" "x"\n')
    (tmp_path / "b.csv").write_text("URL,Status\n/table,301\n")
    assert sorted((r.url, r.status) for r in log_files.read(spark, str(tmp_path)).collect()) == [("/line", 200), ("/table", 301)]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("URL,Status\n")
    assert log_files.read(spark, str(tmp_path / "empty")).count() == 0


def test_iso_dates(spark):
    wanted = {  # of a sitemap, of page data
        "2024-01-05": (True, True), "2024-02-30": (False, False), "2024-1-5": (False, False), "2024-01-05T10:00Z": (False, True), "2024-01-05T10:00:00Z": (True, True), "2024-01-05T10:00:00.12+08:00": (True, True),
        "2024-01-05T10:00:00.1234+0800": (True, False), "2024-01-05T10:00:00": (False, False), "2024-01-05T25:00:00Z": (False, False), "2024-01-05 10:00:00Z": (False, False), "": (True, False), "soon": (False, False), "2024-01-05T10:00:00.Z": (False, False),
    }
    rows = spark.createDataFrame([(v,) for v in wanted], "v string").select("v", dates.is_sitemap_date(F.col("v")).alias("sitemap"), dates.is_iso_date(F.col("v")).alias("page")).collect()
    assert {r.v: (r.sitemap, bool(r.page)) for r in rows} == wanted
    assert {v: jsonld.is_iso_date(v) for v in wanted} == {v: page for v, (_, page) in wanted.items()}


@pytest.mark.parametrize("hops", [1, 3, 4])
def test_depths_over_several_writes(spark, monkeypatch, hops):
    monkeypatch.setattr(graph, "HOPS", hops)
    names = ["/", *(f"/{i}" for i in range(12))]
    pages = spark.createDataFrame([("o", f"o{n}") for n in [*names, "/alone"]] + [("empty", "empty/")], "origin string, url string")
    edges = [(a, b) for a, b in itertools.pairwise(names)] + [(n, "/") for n in names] + [("/3", "/1"), ("/2", "/7"), ("/2", "/7"), ("/7", "/outside")]
    links = spark.createDataFrame([("o", f"o{a}", f"o{b}") for a, b in edges], "origin string, src string, dst string")
    found = {r.url: r.depth for r in graph.depths(links, pages).collect()}
    steps = {"o/": 0} | {f"o/{k}": k + 1 if k < 7 else k - 3 for k in range(12)}
    assert found == steps | {"o/alone": None, "empty/": 0}


def test_depths_of_pages_captured_twice(spark):
    pages = spark.createDataFrame([("o", "o/"), ("o", "o/a"), ("o", "o/a"), ("o", "o/"), ("o", "o/b"), ("o", "o/b")], "origin string, url string")
    links = spark.createDataFrame([("o", "o/", "o/a"), ("o", "o/", "o/a")], "origin string, src string, dst string")
    assert sorted((r.url, r.depth) for r in graph.depths(links, pages).collect()) == [("o/", 0), ("o/a", 1), ("o/b", None)]


def test_many_keys_are_counted_by_no_lookup(spark, monkeypatch):
    """Streams of bursts start under options of their own, and the session gets its own back."""
    from lodestream.streaming import tracking_stream

    seen, names = [], ("trackTotalNumberOfRows", "changelogCheckpointing.enabled")
    asked = lambda: [spark.conf.get(f"spark.sql.streaming.stateStore.rocksdb.{n}", None) for n in names]
    before, bursts = asked(), tracking_stream.bursts
    monkeypatch.setattr(tracking_stream, "bursts", lambda *a: (seen.append(asked()), bursts(*a))[1])
    rows = spark.createDataFrame([("r", "1", "p", "n", 5, 6)], "run_id string, id string, platform string, name string, ts_us long, arrived_us long")
    from lodestream.operators.store import checkpoint_folder

    assert tracking_stream.replay_bursts(rows, f"{checkpoint_folder(spark)}/many-keys").count() == 0
    assert seen == [["false", "false"]] and asked() == before


def test_replayed_bursts(spark):
    """Late, repeated, early and broken rows, a gap that is just reached, a session over the turn of a month, and one that may still grow."""
    import uuid

    from lodestream.operators.store import checkpoint_folder
    from lodestream.streaming.tracking_stream import replay_bursts

    day, feb = 86_400_000_000, 31 * 86_400_000_000
    rows = [
        ("a", "1", "x", 0, 5), ("a", "2", "X", 1_499_999, 1_500_000), ("a", "2", "X", 1_499_999, day), ("a", "3", "x", 2_999_999, 3_000_000), ("a", "4", "x", 2_999_998 + 1_500_001, day),
        ("b", "1", "x", 0, day), ("b", "2", "x", 10, day + 11), ("b", "3", "x", 20, 19), ("b", "4", "x", 30, None), ("c", "1", None, 7, 7), ("c", "2", None, 8, 8), (None, "1", "x", 0, 0), ("a", None, "x", 1, 1), ("a", "9", "x", None, 1),
        ("d", "1", "x", feb - 1_000_000, feb - 1), ("d", "2", "x", feb, feb + 1), ("d", "3", "x", feb - 500_000, feb + day // 2), ("e", "1", "x", feb + 2 * day, feb + 2 * day), ("e", "2", "x", feb + 2 * day + 1, feb + 2 * day + 1),
    ]
    schema = "run_id string, id string, name string, ts_us long, arrived_us long, ts string, month string, platform string"
    start = 19_723 * day
    events = spark.createDataFrame([(*r[:3], *(None if t is None else start + t for t in r[3:]), "t", "m", "p") for r in rows], schema)
    new = lambda: f"{checkpoint_folder(spark)}/bursts-{uuid.uuid4().hex}"
    found = sorted((r.run_id, r.name, r.start_us - start, r.end_us - start, r.n) for r in replay_bursts(events, new()).collect())
    assert found == [("a", "x", 0, 2_999_999, 2), ("c", None, 7, 1_500_008, 2), ("d", "x", feb - 1_000_000, feb + 1_500_000, 3)]
    assert replay_bursts(events.where("false"), new()).count() == 0
