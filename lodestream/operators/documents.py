"""Assembled documents: exports, context bundles, landing-page checks, international assessment, tag evidence, issue guidance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import base_language, overlap, sanitize, tag_ids
from lodestream.functions.urls import CLICK_PARAMETERS, parameter_kept


def joint_totals(ads: DataFrame) -> DataFrame:
    """One row of the eight sums that an export holds of the ads."""
    names = ("impressions", "clicks", "cost", "platform_conversions", "conversion_value")
    sums = [F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]
    branded = [F.coalesce(F.sum(F.when(F.col("branded"), F.col(n))), F.lit(0.0)).alias(f"branded_{n}") for n in ("clicks", "cost", "platform_conversions")]
    return ads.agg(*sums, *branded)


def assemble(**parts: DataFrame) -> DataFrame:
    """One row: each part as an array of its rows, in the order of their fields. Parts are reports of bounded size, not tables."""
    frames = [df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)  # one row each


def to_json(document: DataFrame, version: int = 3) -> DataFrame:
    return document.select(F.to_json(F.struct(F.lit(version).alias("version"), *document.columns)).alias("json"))


def markdown(findings: DataFrame) -> DataFrame:
    """(report_id, text): a report's findings by priority, a line each, under a heading with their number. Lines are put in order in each report's list."""
    line = F.concat(F.lit("- **"), F.col("priority"), F.lit("** "), F.col("rule_id"), F.lit(" ("), F.col("status"), F.lit(")"))
    lists = findings.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "rule_id", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    head = F.concat(F.lit("# Report "), F.col("report_id"), F.lit("\n\n"), F.size("lines").cast("string"), F.lit(" findings\n\n"))
    return lists.select("report_id", F.concat(head, F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def context_bundle(reports: DataFrame, limits: dict[str, int], lists: dict[str, int]) -> DataFrame:
    """Reports for a conversation: texts without active markup and cut to ``limits``, arrays to their first items."""
    texts = [sanitize(F.col(c), n).alias(c) for c, n in limits.items()]
    arrays = [F.slice(c, 1, n).alias(c) for c, n in lists.items()]
    rest = [c for c in reports.columns if c not in limits and c not in lists]
    return reports.select(*rest, *texts, *arrays)


def joint_context(**parts: DataFrame) -> DataFrame:
    """The one-row aggregates of a project side by side, each under its name."""
    frames = [df.limit(1).select(F.struct(*df.columns).alias(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


#: What is done about each issue, by code; other codes have the last line.
GUIDANCE = {
    "site.response": ("crawl", "restore or redirect the failing addresses", "request them again"),
    "site.sitemap-noindex": ("index", "take hidden pages off the sitemap or show them", "compare both lists"),
    "site.canonical": ("index", "confirm that the pages are meant to be merged", "read the declared address"),
    "site.canonical-target": ("index", "point to an address that can be indexed", "request the target"),
    "site.duplicate-title": ("relevance", "give each page its own title", "audit the same pages"),
    "site.duplicate-description": ("relevance", "give each page its own description", "audit the same pages"),
    "site.near-duplicate": ("relevance", "merge or tell apart similar pages", "compare their texts"),
    "site.orphan-candidate": ("links", "link to the page from a related one", "count links to it"),
    "site.compression": ("delivery", "compress text responses", "read the response headers"),
    "site.cache": ("delivery", "set cache headers by kind of response", "read the response headers"),
    "": ("other", "look at the affected pages first", "audit the same pages"),
}


def guidance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in GUIDANCE.items()], "code string, impact string, recommendation string, verification string")


def with_guidance(issues: DataFrame) -> DataFrame:
    """Issues with what to do: a broadcast join with a table of fixed size, the line without code for the rest."""
    table = guidance(issues.sparkSession)
    other = table.where("code = ''").first()
    found = issues.join(F.broadcast(table), "code", "left")
    return found.fillna({c: other[c] for c in ("impact", "recommendation", "verification")})


def landing_checks() -> Column:
    """Ten checks of a landing page as array<struct<check, state>>. Columns: transport, variants_checked, redirect_risk, resource_risk, compression, target_query, ad_promise,
    page_promise, cta_texts, form_count, viewport, url, final_url."""
    c = F.col
    query = F.regexp_extract(c("url"), r"\?([^#]*)", 1)
    names = (*CLICK_PARAMETERS[:1], "gbraid", "wbraid", "msclkid", "bd_vid", "utm_source", "utm_campaign")
    present = [query.rlike(f"(?i)(^|&){n}=") for n in names]
    some = reduce(lambda a, b: a | b, present)
    lost = reduce(lambda a, b: a | b, [F.coalesce(~parameter_kept(c("url"), c("final_url"), n), F.lit(False)) for n in names])
    moved = (c("final_url") != "") & (c("final_url") != c("url"))
    promise = lambda text: F.when(F.trim(text) == "", "insufficient").when(overlap(text, c("page_promise")) >= 0.5, "good").otherwise("attention")
    states = {
        "https": F.when(c("transport").isNull(), "insufficient").when(c("url").startswith("https:") & (c("transport") != "attention"), "good").otherwise("risk"),
        "redirects": F.when(~c("variants_checked"), "insufficient").when(c("redirect_risk"), "risk").otherwise("good"),
        "delivery": F.when(c("transport").isNull(), "insufficient").when((c("resource_risk") > 0) | (c("compression") == "attention"), "attention").otherwise("good"),
        "query": promise(c("target_query")), "promise": promise(c("ad_promise")),
        "cta": F.when(F.size("cta_texts") > 0, "good").otherwise("attention"), "form": F.when(c("form_count") > 0, "good").otherwise("insufficient"),
        "mobile": F.when(c("viewport").rlike(r"(?i)width\s*=\s*device-width"), "good").otherwise("risk"),
        "parameters": F.when(some, "good").otherwise("insufficient"), "kept": F.when(~moved | ~some, "insufficient").when(lost, "risk").otherwise("good"),
    }
    return F.array(*(F.struct(F.lit(k).alias("check"), v.alias("state")) for k, v in states.items()))


#: Requests and scripts of analytics and advertising systems.
REQUESTS = {
    "google_analytics": r"(?i)google-analytics\.com/(?:g/)?collect|analytics\.google\.com/g/collect", "google_ads": r"(?i)googleadservices\.com|doubleclick\.net|google\.[^/]+/pagead/(?:1p-)?conversion", "bing_uet": r"(?i)bat\.bing\.com",
    "microsoft_clarity": r"(?i)clarity\.ms", "google_tag_manager": r"(?i)googletagmanager\.com/gtm\.js", "baidu": r"(?i)(?:hm|tongji)\.baidu\.com",
}


def tag_evidence(urls: Column, scripts: Column, texts: Column) -> Column:
    """struct: identifiers, duplicate identifiers, the systems whose requests and scripts are there, old identifiers, and whether a manager and a fixed tag may both send."""
    everything = F.array_join(F.concat(scripts, texts, urls), "\n")
    ids = tag_ids(everything)
    seen = lambda where: F.array_compact(F.array(*(F.when(F.exists(where, lambda u, p=p: u.rlike(p)), F.lit(k)) for k, p in REQUESTS.items())))
    every = F.transform(F.regexp_extract_all(everything, F.lit(r"(?i)\b(?:G|GTM|AW|UA)-[A-Z0-9-]+\b"), F.lit(0)), F.upper)
    repeated = F.filter(F.array_distinct(every), lambda v: F.size(F.filter(every, lambda w: w == v)) > 1)
    return F.struct(ids.alias("ids"), repeated.alias("duplicate_ids"), seen(urls).alias("requests"), seen(scripts).alias("scripts"), (F.size(ids["ua"]) > 0).alias("old_ua"), ((F.size(ids["gtm"]) > 0) & (F.size(ids["ga4"]) > 0)).alias("mixed"))


#: Capabilities of an international site.
CAPABILITIES = ("search_access", "localization", "measurement", "advertising", "business_localization")


def international() -> Column:
    """struct(market_evidence, capabilities) from html_lang, access, target_language, target_country, language_versions, language_target_ok, analytics_request, analytics_partial,
    ad_evidence, ad_request, regional, search_issues, localization_issues."""
    c = F.col
    lang = base_language(F.coalesce(c("html_lang"), F.lit("")))
    matches = (c("target_language") != "") & (lang != "") & (base_language(c("target_language")) == lang)
    ready = c("language_target_ok") | matches
    nothing = (lang == "zh") & (c("target_language") == "") & (c("target_country") == "") & (c("language_versions") == 0) & ~c("analytics_partial") & ~c("ad_evidence") & ~c("regional")
    market = F.when((lang == "") | (c("access") == "confirm"), "unknown").when(nothing, "not_observed").when((c("access") == "normal") & ready & c("analytics_request"), "established").otherwise("partial")
    states = {
        "search_access": F.when(c("search_issues") > 0, "attention").when(c("access") == "normal", "ready").when(c("access") == "confirm", "unknown").otherwise("attention"),
        "localization": F.when(c("localization_issues") > 0, "attention").when(ready, "ready").when((lang != "") & (lang != "zh"), "partial").otherwise("not_observed"),
        "measurement": F.when(c("analytics_request"), "ready").when(c("analytics_partial"), "partial").otherwise("not_observed"),
        "advertising": F.when(~c("ad_evidence"), "not_applicable").when(c("ad_request"), "ready").otherwise("partial"),
        "business_localization": F.when(c("regional"), "partial").otherwise("unknown"),
    }
    return F.struct(market.alias("market_evidence"), *(states[k].alias(k) for k in CAPABILITIES))


def international_findings() -> Column:
    """Codes of what an international check finds, once each, from the columns of international() and url, text_length, title, robots_allowed, index_blocked, expected_index_state,
    uses_google_ads, uses_microsoft_ads, google_request, uet_request, old_ua, duplicate_ids, mixed, consent_update_only, parameters_lost, tracking_status, entry_failures."""
    c = F.col
    tests = {
        "search:access": c("access") == "attention", "search:content-unreadable": (c("title") == "") | (c("text_length") == 0), "search:robots-blocked": ~c("robots_allowed"),
        "search:indexing-disabled": c("index_blocked") & (c("expected_index_state") == "index"), "search:host-entry-risk": c("entry_failures") > 0, "tracking:test-failed": c("tracking_status") == "attention",
        "tracking:google-ads-request-missing": c("uses_google_ads") & ~c("google_request"), "tracking:microsoft-ads-uet-missing": c("uses_microsoft_ads") & ~c("uet_request"), "tracking:legacy-universal-analytics": c("old_ua"),
        "tracking:duplicate-id": c("duplicate_ids") > 0, "tracking:gtm-hardcoded-candidate": c("mixed"), "tracking:consent-default-order": c("consent_update_only"), "tracking:click-parameter-loss": c("parameters_lost"),
        "tracking:measurement-google-bing": ~c("analytics_partial") & ~c("analytics_request"), "international:localized-pages-opportunity": c("language_versions") == 0, "business:market-conversion-support": F.lit(True),
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))


def related_targets(declared: DataFrame, captured: DataFrame, most: int = 20) -> DataFrame:
    """What the first targets of each page's hreflang and mobile links are: (url, target, kind, status, returns). Origins without captured pages are skipped and counted as such. A target declared twice has its first place and kind; of several captures the least status counts."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("url").orderBy("row_seq"))
    first = declared.groupBy("url", "target").agg(F.min(F.struct("row_seq", "kind")).alias("m")).select("url", "target", "m.row_seq", "m.kind").withColumn("rank", rank).where(F.col("rank") <= most)
    known = captured.groupBy(F.col("url").alias("target")).agg(F.min("status").alias("status"))
    back = declared.select(F.col("url").alias("target"), F.col("target").alias("url"), F.lit(True).alias("returns")).distinct()
    found = first.join(known, "target", "left").join(back, ["url", "target"], "left")
    state = F.when(F.col("status").isNull(), "skipped").when(F.col("status") >= 400, "error").when(F.col("returns").isNull(), "no_return").otherwise("ok")
    return found.select("url", "target", "kind", "status", state.alias("state"))


def target_summary(targets: DataFrame) -> DataFrame:
    counts = targets.groupBy("url").agg(F.count("*").alias("targets"), F.count_if(F.col("state") != "skipped").alias("checked"))
    return counts.withColumn("status", F.when(F.col("checked") == F.col("targets"), "complete").when(F.col("checked") > 0, "partial").otherwise("not_available"))


def tag_queue(queues: DataFrame, most: int = 100) -> DataFrame:
    """The last entries of each page's command queue (page, entries as JSON texts): command, target, event, cut, and the consent signals; no other values."""
    signal = "struct<analytics_storage:string,ad_storage:string,ad_user_data:string,ad_personalization:string>"
    last = F.slice("entries", F.greatest(F.lit(1), F.size("entries") - most + 1), most)
    rows = queues.select("page", F.posexplode(last).alias("seq", "entry"))
    parsed = F.from_json("entry", f"command string, target string, event string, signals {signal}")
    cut = lambda name: F.substring(F.col(f"e.{name}"), 1, 100).alias(name)
    signals = F.to_json(F.col("e.signals"))
    return rows.withColumn("e", parsed).select("page", "seq", cut("command"), cut("target"), cut("event"), F.from_json(signals, "map<string,string>").alias("signals"))


def reconciliation_report(totals: DataFrame, period: DataFrame, pages: DataFrame, currency: DataFrame) -> DataFrame:
    """One row of all that a three-way comparison says."""
    return joint_context(totals=totals, period=period, pages=pages, currency=currency)
