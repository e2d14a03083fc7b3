"""Three-way reconciliation of ads, analytics and business outcomes over their common, mature days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.numbers import rows_grade
from lodestream.functions.urls import tracking_page


def window(analytics: DataFrame, ads: DataFrame, business: DataFrame, as_of: str) -> DataFrame:
    """One row: latest first day, earliest last day or the mature day if that is earlier, whether they make a period, and the maturity in days (1 to 90)."""
    bounds = None
    for name, rows in (("analytics", analytics), ("ads", ads), ("business", business)):
        one = rows.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).select(F.lit(name).alias("side"), "n", "first", "last")
        bounds = one if bounds is None else bounds.unionByName(one)
    delay = business.agg(F.greatest(F.lit(1), F.least(F.lit(90), F.ceil(F.greatest(F.lit(0.0), F.coalesce(F.max("conversion_delay_days"), F.lit(0.0)))))).cast("int").alias("maturity_days"))
    found = bounds.where("n > 0").agg(F.max("first").alias("period_start"), F.min("last").alias("raw_end")).crossJoin(F.broadcast(delay))
    mature = F.date_sub(F.to_date(F.lit(as_of)), F.col("maturity_days"))
    end = F.when(F.col("raw_end") < mature, F.col("raw_end")).otherwise(mature)
    return found.select("period_start", end.alias("period_end"), "maturity_days", F.coalesce(F.col("period_start") <= end, F.lit(False)).alias("period_valid"))


def in_window(rows: DataFrame, period: DataFrame) -> DataFrame:
    """Rows inside the period; without any first day all rows, without a valid period none of the others."""
    inside = F.when(~F.col("period_valid") | F.col("date").isNull(), F.col("period_start").isNull()).otherwise(F.col("date").between(F.col("period_start"), F.col("period_end")))
    return rows.join(F.broadcast(period)).where(inside).drop(*period.columns)


def totals(analytics: DataFrame, ads: DataFrame, business: DataFrame, period: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    a = in_window(ads, period).agg(zero("clicks"), zero("platform_conversions"))
    b = in_window(analytics, period).agg(zero("sessions"), zero("key_events"))
    c = in_window(business, period).agg(zero("valid_conversions"), zero("revenue"), zero("refunds"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def currencies(analytics: DataFrame, project: str) -> DataFrame:
    """The distinct currencies in order, and whether amounts can be compared."""
    own = analytics.sparkSession.createDataFrame([(project,)], "currency string")
    names = analytics.select("currency").union(own).select(F.upper(F.trim("currency")).alias("c")).where("c <> ''").distinct()
    return names.agg(F.array_sort(F.collect_list("c")).alias("observed"), F.count("*").alias("n")).select("observed", (F.col("n") <= 1).alias("comparable"))


def matched_pages(analytics: DataFrame, ads: DataFrame) -> DataFrame:
    """One row: pages on either side, and on both."""
    ours = analytics.where("page <> ''").select(tracking_page(F.col("page")).alias("page")).distinct().withColumn("side", F.lit(1))
    theirs = ads.where("landing_page <> ''").select(tracking_page(F.col("landing_page")).alias("page")).distinct().withColumn("side", F.lit(2))
    both = ours.unionByName(theirs).groupBy("page").agg(F.count("*").alias("sides"))
    return both.agg(F.count("*").alias("pages"), F.count_if(F.col("sides") == 2).alias("matched"))


def attribution_grades(ads: DataFrame, business: DataFrame) -> DataFrame:
    """Business rows by how surely they belong to an ad: click id (high), the only row of a campaign (medium), an ad of that day and campaign (low), unmatched.

    All lookups are distinct keys; the low one is an equi-join on the day, with the campaign or without one, never a scan of all ads for each row.
    """
    clicks = ads.select(F.trim("click_id").alias("click_key")).where("click_key <> ''").distinct().withColumn("by_click", F.lit(True))
    key = F.lower(F.trim(F.coalesce(F.nullif("utm_campaign", F.lit("")), "campaign")))
    campaigns = ads.select(key.alias("campaign_key")).where("campaign_key <> ''").groupBy("campaign_key").agg((F.count("*") == 1).alias("only"))
    names = F.explode(F.array_compact(F.array(F.lower("utm_campaign"), F.lower("campaign"), F.lit(""))))
    days = ads.where("date is not null").select("date", names.alias("day_key")).distinct().withColumn("by_day", F.lit(True))
    rows = business.withColumns({"click_key": F.trim("click_id"), "campaign_key": F.lower(F.trim("utm_campaign")), "day_key": F.lower(F.coalesce("utm_campaign", F.lit("")))})
    found = rows.join(clicks, "click_key", "left").join(campaigns, "campaign_key", "left").join(days, ["date", "day_key"], "left")
    grade = F.when(F.col("by_click"), "high").when((F.col("campaign_key") != "") & F.col("only"), "medium").when(F.col("by_day"), "low").otherwise("unmatched")
    return found.select("id", grade.alias("grade"))


def findings(analytics: DataFrame, ads: DataFrame, business: DataFrame, period: DataFrame, duplicate_events: int = 0) -> DataFrame:
    counts = ads.agg(F.count("*").alias("ad_rows")).crossJoin(F.broadcast(analytics.agg(F.count("*").alias("analytics_rows")))).crossJoin(F.broadcast(business.agg(F.count("*").alias("business_rows"))))
    row = totals(analytics, ads, business, period).crossJoin(F.broadcast(period)).crossJoin(F.broadcast(counts))
    c, ok = F.col, F.col("period_valid")
    rules = [
        ("clicks_without_sessions", ok & (c("clicks") > 0) & (c("sessions") == 0) & (c("analytics_rows") > 0), F.lit("high")),
        ("ads_above_analytics", ok & (c("key_events") > 0) & (c("platform_conversions") > 1.5 * c("key_events")), rows_grade(c("ad_rows"))),
        ("business_gap", ok & (c("platform_conversions") > 0) & (c("business_rows") > 0) & (c("valid_conversions") < 0.5 * c("platform_conversions")), rows_grade(c("business_rows"))),
        ("duplicate_events", F.lit(duplicate_events > 0), F.lit("high")),
    ]
    made = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(code).alias("code"), F.lit("P1").alias("priority"), conf.alias("confidence"))) for code, t, conf in rules)))
    return row.select(F.explode(made).alias("f")).select("f.*")
