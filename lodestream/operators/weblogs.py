"""Web-server logs: counts by status and crawler family, slow and wasted URLs, sitemap URLs that no crawler asked for.

Requests have row_seq, url, status, at, duration_ms, bot_family. Latencies are grouped by URL; the percentile is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import any_of
from lodestream.functions.urls import log_url

#: Parameters that waste requests beside those of campaigns, and words of a crawler's agent by family.
PARAMETERS = ("gclid", "msclkid", "bd_vid", "sort", "filter", "page")
FAMILIES = {"Google": ("googlebot", "storebot", "adsbot-google"), "Bing": ("bingbot", "adidxbot"), "Baidu": ("baiduspider",), "Yandex": ("yandex",), "other": ("bot", "spider", "crawler", "slurp")}
WASTED, WASTED_STRICT = (rf"(?i)[?&](?:{'|'.join((campaign, *PARAMETERS))})=" for campaign in ("utm_", "utm_[a-z]+"))


def bot_family(agent: Column) -> Column:
    """The first family whose words an agent holds; null for people."""
    return F.coalesce(*(F.when(any_of(agent, words), family) for family, words in FAMILIES.items()))


def duration_ms(value: Column, unit: str = "ms") -> Column:
    """A duration as milliseconds; texts with a unit other than ms are null. ``unit`` s takes bare numbers as seconds."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, ",", "."), "(?i)ms$", ""))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))
    return number * 1000 if unit == "s" else number


def status_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.coalesce("status", F.lit(0)).alias("status")).agg(F.count("*").alias("requests"))


def bot_counts(requests: DataFrame) -> DataFrame:
    return requests.where("bot_family is not null").groupBy("bot_family").agg(F.count("*").alias("requests"))


def summary(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("requests"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("status") >= 400).alias("errors"))


def latencies(requests: DataFrame) -> DataFrame:
    """Requests, mean and nearest-rank 95th percentile of each URL. The percentile sorts counts of distinct durations, which aggregate before the shuffle."""
    return requests.groupBy("url").agg(F.count("*").alias("requests"), F.avg("duration_ms").alias("average_ms"), F.expr("percentile_disc(0.95) within group (order by duration_ms)").alias("p95_ms"))


def slow_urls(requests: DataFrame, limit: int = 50) -> DataFrame:
    slow = latencies(requests).where("p95_ms >= 1000 or average_ms >= 800")
    return slow.orderBy(F.desc(F.coalesce("p95_ms", F.lit(0.0))), "url").limit(limit)


def wasted_urls(requests: DataFrame, limit: int = 100, strict_utm: bool = False) -> DataFrame:
    """URLs with parameters asked for repeatedly, and URLs with errors: a row for each reason, in order of first request."""
    grouped = requests.groupBy("url").agg(F.count("*").alias("requests"), F.bool_or(F.col("status") >= 400).alias("failed"), F.min("row_seq").alias("first_seq"))
    reasons = F.array_compact(F.array(F.when(F.col("url").rlike(WASTED_STRICT if strict_utm else WASTED) & (F.col("requests") >= 2), "parameters"), F.when(F.col("failed"), "error_status")))
    rows = grouped.select("url", "requests", "first_seq", F.posexplode(reasons).alias("nth", "reason"))
    return rows.orderBy("first_seq", "nth").limit(limit).select("url", "reason", "requests")


def never_crawled(requests: DataFrame, sitemap: DataFrame, limit: int = 100) -> DataFrame:
    """Sitemap URLs (row_seq, url) that no crawler asked for, in their order."""
    seen = requests.where("bot_family is not null").select("url").distinct()
    return sitemap.withColumn("url", log_url(F.col("url"))).join(seen, "url", "left_anti").orderBy("row_seq").limit(limit).select("url")


def findings(requests: DataFrame, sitemap: DataFrame) -> DataFrame:
    errors = requests.agg(F.count_if(F.col("status") >= 400).alias("n")).select(F.lit("error-status").alias("code"), F.lit("P1").alias("priority"), "n")
    lists = [("slow-url", "P2", slow_urls(requests)), ("parameter-waste", "P2", wasted_urls(requests)), ("sitemap-never-crawled", "P3", never_crawled(requests, sitemap))]
    for code, priority, rows in lists:
        errors = errors.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(priority).alias("priority"), "n"))
    return errors.where("n > 0")
