"""Paid search: metrics, attribution of business outcomes, findings, statuses and data gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.numbers import ads_sample_grade, change, ratio_or_null
from lodestream.functions.text import any_of
from lodestream.operators.search import lenient_periods


#: Words of campaigns over all channels, of broad matches, and of an expansion that is on.
ALL_CHANNELS, BROAD, EXPANDED = ("pmax", "performance max", "效果最大化"), ("broad", "广泛", "智能"), ("enabled", "开启", "true", "yes")


def _sum(name: str, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.col(name) if where is None else F.when(where, F.col(name))), F.lit(0.0))


def ad_totals(ads: DataFrame) -> DataFrame:
    """One row of everything that findings need of the ads: a single pass."""
    term = F.trim("search_term") != ""
    kind, landing = F.coalesce("conversion_type", F.lit("unknown")), F.coalesce("landing_page", F.lit("")) != ""
    pmax, ai = any_of(F.coalesce("campaign_type", F.lit("")), ALL_CHANNELS), any_of(F.concat_ws(" | ", "campaign_type", "bid_strategy"), ("ai max",))
    return ads.agg(
        F.count("*").alias("ad_rows"), _sum("impressions").alias("impressions"), _sum("clicks").alias("clicks"), _sum("cost").alias("cost"),
        _sum("platform_conversions").alias("platform_conversions"), _sum("conversion_value").alias("conversion_value"),
        F.count_if(term).alias("term_rows"), F.count_if(term & any_of(F.col("match_type"), BROAD)).alias("broad_rows"),
        _sum("cost", term & any_of(F.col("match_type"), BROAD)).alias("broad_cost"), _sum("cost", F.col("branded")).alias("branded_cost"),
        F.count_if(kind == "primary").alias("primary_rows"), F.count_if(kind == "observation").alias("observation_rows"), F.count_if(landing).alias("landing_rows"),
        F.count_if(pmax).alias("pmax_rows"), F.count_if(pmax & (F.coalesce("asset_group", F.lit("")) != "")).alias("pmax_grouped"),
        F.count_if(ai).alias("ai_rows"), F.count_if(ai & (F.coalesce("final_url_expansion", F.lit("")) != "")).alias("ai_expanded"),
        F.count_if((F.col("platform") == "baidu") & any_of(F.coalesce("bid_strategy", F.lit("")), ("ocpc",))).alias("ocpc_rows"),
        F.count_if(any_of(F.coalesce("final_url_expansion", F.lit("")), EXPANDED) & landing).alias("expansion_rows"),
        F.min("date").alias("period_start"), F.max("date").alias("period_end"),
    )


def business_totals(business: DataFrame) -> DataFrame:
    late = F.col("conversion_delay_days") > 0
    return business.agg(
        F.count("*").alias("business_rows"), _sum("valid_conversions").alias("valid_conversions"), _sum("revenue").alias("revenue"), _sum("refunds").alias("refunds"), _sum("gross_profit").alias("gross_profit"),
        F.count_if(late).alias("delayed_rows"), F.avg(F.when(late, F.col("conversion_delay_days"))).alias("mean_delay"),
    )


def period_bounds(ads: DataFrame) -> DataFrame:
    """First and last day, inclusive days, and the equal period before."""
    found = ads.agg(F.min("date").alias("start"), F.max("date").alias("end")).withColumn("days", F.datediff("end", "start") + 1)
    return found.select("start", "end", "days", F.date_sub("start", F.col("days")).alias("previous_start"), F.date_sub("start", 1).alias("previous_end"))


def attribution(ads: DataFrame, business: DataFrame) -> DataFrame:
    """Business rows that can be linked, with ad_id and confidence: exact click id (the last ad row), else the only ad row of the campaign tag, else of the campaign.

    Three equi-joins with lookups of one row a key. Keys of the lookups are distinct, so nothing multiplies; null keys stay out.
    """
    by_click = ads.where("click_id <> ''").groupBy("click_id").agg(F.max_by("id", "row_seq").alias("click_ad"))

    def only(column: str, name: str) -> DataFrame:
        return ads.where(f"{column} <> ''").groupBy(F.lower(column).alias(f"{name}_key")).agg(F.count("*").alias("n"), F.first("id").alias(f"{name}_ad")).where("n = 1").drop("n")

    keyed = business.withColumns({"utm_key": F.lower(F.nullif("utm_campaign", F.lit(""))), "campaign_key": F.lower(F.nullif("attribution_key", F.lit("")))})
    found = keyed.join(by_click, "click_id", "left").join(only("utm_campaign", "utm"), "utm_key", "left").join(only("campaign", "campaign"), "campaign_key", "left")
    confidence = F.when(F.col("click_ad").isNotNull(), "high").when(F.col("utm_ad").isNotNull(), "medium").when(F.col("campaign_ad").isNotNull(), "low")
    return found.select("id", F.coalesce("click_ad", "utm_ad", "campaign_ad").alias("ad_id"), confidence.alias("confidence"), "valid_conversions", "revenue").where("ad_id is not null")


def attribution_summary(ads: DataFrame, business: DataFrame) -> DataFrame:
    """One row: business rows, how many are linked, and the confidence of the whole."""
    linked = attribution(ads, business).agg(F.count("*").alias("linked"), F.count_if(F.col("confidence") == "high").alias("exact"))
    total = business.agg(F.count("*").alias("total"))
    sure = (F.col("exact") >= 0.8 * F.col("linked")) & (F.col("linked") >= 5)
    grade = F.when((F.col("total") == 0) | (F.col("linked") == 0), "low").when(sure, "high").when(F.col("linked") >= 0.5 * F.col("total"), "medium").otherwise("low")
    return linked.join(F.broadcast(total)).select("total", "linked", "exact", grade.alias("link_confidence"))


def creative_checks(creatives: DataFrame) -> DataFrame:
    """One row: creatives, incomplete ones, and ad groups with several landing pages."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    counts = creatives.agg(F.count("*").alias("creatives"), F.count_if(blank("headline") | blank("description") | blank("final_url")).alias("incomplete"))
    mixed = inconsistent_groups(creatives).agg(F.count("*").alias("inconsistent"))
    return counts.join(F.broadcast(mixed))


def inconsistent_groups(creatives: DataFrame) -> DataFrame:
    named = creatives.where("trim(ad_group) <> '' and trim(final_url) <> ''")
    return named.groupBy("ad_group").agg(F.count_distinct(F.trim("final_url")).alias("n_pages")).where("n_pages > 1")


def zero_conversion_terms(ads: DataFrame, target_cpa: float | None = None) -> DataFrame:
    """Search terms with cost of the threshold or more and no conversion, dearest first. The threshold is one row, so it is broadcast."""
    total = ads.agg(_sum("cost").alias("all_cost"), _sum("platform_conversions").alias("all_conversions"))
    usual = F.when((F.col("all_conversions") > 0) & (F.col("all_cost") > 0), 1.5 * F.col("all_cost") / F.col("all_conversions")).otherwise(0.05 * F.col("all_cost"))
    threshold = F.greatest(F.lit(0.01), F.lit(float(target_cpa)) if target_cpa is not None else usual)
    limits = total.select(threshold.alias("threshold"))
    rows = ads.where("trim(search_term) <> '' and cost > 0 and platform_conversions = 0").join(F.broadcast(limits)).where("cost >= threshold")
    return rows.select("id", "row_seq", "search_term", "cost", "threshold")


class Settings:
    """A project's targets."""

    def __init__(self, currency: str = "USD", target_cpa: float | None = None, target_roas: float | None = None, profit_each: float | None = None):
        self.currency, self.target_cpa, self.target_roas, self.profit_each = currency.strip().upper(), target_cpa, target_roas, profit_each


def wide(ads: DataFrame, business: DataFrame, creatives: DataFrame, changes: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """One row with all that metrics, findings, statuses and gaps are made of: joins of one-row aggregates."""
    active = changes.where((F.col("channel") == "sem") & (F.col("learning_until") > F.to_timestamp(F.lit(as_of)))).agg(F.count("*").alias("active_changes"), F.count_distinct("sem_dimension").alias("active_dimensions"))
    periods = lenient_periods(ads, ("cost", "platform_conversions", "clicks"))
    zero = zero_conversion_terms(ads, settings.target_cpa).agg(F.count("*").alias("zero_terms"))
    frames = (business_totals(business), attribution_summary(ads, business), creative_checks(creatives), active, periods, zero)
    row = ad_totals(ads)
    for other in frames:
        row = row.crossJoin(F.broadcast(other))  # one row each
    best = F.greatest("platform_conversions", "valid_conversions")
    cost_change = change(F.col("current_cost"), F.col("previous_cost"))
    return row.withColumns(
        {
            "sample": ads_sample_grade(F.col("clicks"), best),
            "cost_change": cost_change,
            "conversion_change": change(F.col("current_platform_conversions"), F.col("previous_platform_conversions")),
            "period_sample": ads_sample_grade(F.col("current_clicks"), F.col("current_platform_conversions")),
            "valid_cpa": F.when(F.col("business_rows") > 0, ratio_or_null(F.col("cost"), F.col("valid_conversions"))),
            "target_cpa": F.lit(settings.target_cpa).cast("double"),
            "target_roas": F.lit(settings.target_roas).cast("double"),
            "profit_each": F.lit(settings.profit_each).cast("double"),
            "currency": F.lit(settings.currency),
        }
    )


def metrics(row: DataFrame) -> DataFrame:
    """Nine metrics, a row each; null: insufficient."""
    c, some = F.col, F.col("business_rows") > 0
    values = {
        "ctr": ratio_or_null(c("clicks"), c("impressions")),
        "cpc": ratio_or_null(c("cost"), c("clicks")),
        "platform-cpa": ratio_or_null(c("cost"), c("platform_conversions")),
        "valid-cpa": c("valid_cpa"),
        "platform-value-roas": ratio_or_null(c("conversion_value"), c("cost")),
        "refund-roas": F.when(some, ratio_or_null(F.greatest(F.lit(0.0), c("revenue") - c("refunds")), c("cost"))),
        "profit-return": F.when(some & (c("gross_profit") != 0), ratio_or_null(c("gross_profit"), c("cost"))),
        "period-cost-change": c("cost_change"),
        "attribution-link-rate": F.when(some, c("linked") / c("business_rows")),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value", F.when(F.col("m.value").isNull(), "insufficient").otherwise("good").alias("state"))


def _rules() -> list[tuple[str, str, Column, Column | str, Column | str]]:
    """(code, stage, condition, priority, confidence) of each finding."""
    c = F.col
    gap = (c("business_rows") > 0) & (c("platform_conversions") > 0) & (c("valid_conversions") < 0.5 * c("platform_conversions"))
    several = c("active_dimensions") > 1
    return [
        ("learning_overlap", "business", c("active_changes") > 0, F.when(several, "P2").otherwise("P3"), "high"),
        ("no_business_rows", "tracking", c("business_rows") == 0, "P1", "high"),
        ("conversion_gap", "tracking", gap, "P1", c("sample")),
        ("no_primary_conversion", "tracking", (c("primary_rows") == 0) & (c("observation_rows") > 0), "P1", "high"),
        ("zero_conversion_spend", "search_terms", c("zero_terms") > 0, "P2", c("sample")),
        ("broad_match_share", "search_terms", (c("broad_rows") > 0) & (c("cost") > 0) & (c("broad_cost") >= 0.4 * c("cost")), "P2", c("sample")),
        ("brand_share", "cost", (c("cost") > 0) & (c("branded_cost") > 0.5 * c("cost")), "P2", "medium"),
        ("conversion_delay", "business", c("mean_delay") >= 3, "P2", c("link_confidence")),
        ("cost_growth", "cost", (c("cost_change") >= 0.3) & (c("conversion_change").isNull() | (c("conversion_change") < 0.5 * c("cost_change"))), "P1", c("period_sample")),
        ("ocpc_unverified", "tracking", (c("ocpc_rows") > 0) & (c("business_rows") == 0), "P1", "high"),
        ("url_expansion", "creative_landing", c("expansion_rows") > 0, "P2", "medium"),
        ("creative_mapping", "creative_landing", (c("incomplete") > 0) | (c("inconsistent") > 0), "P2", "high"),
        ("low_sample", "business", (c("sample") == "low") & (c("ad_rows") > 0), "P3", "high"),
        ("valid_cpa_above_target", "budget", c("valid_cpa") > c("target_cpa"), "P1", c("sample")),
    ]


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def findings(row: DataFrame) -> DataFrame:
    made = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"), _column(p).alias("priority"), _column(conf).alias("confidence"), F.lit(code == "zero_conversion_spend").alias("stop_candidate"))) for code, stage, test, p, conf in _rules()]
    return row.select(F.explode(F.array_compact(F.array(*made))).alias("f")).select("f.*")


def _any(*codes: str) -> Column:
    tests = [F.coalesce(test, F.lit(False)) for code, _, test, _, _ in _rules() if code in codes]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def statuses(row: DataFrame) -> DataFrame:
    """The five areas and how they stand."""
    c = F.col
    values = {
        "tracking": F.when((c("ad_rows") == 0) | (c("business_rows") == 0), "insufficient").when(_any("no_business_rows", "conversion_gap", "no_primary_conversion", "ocpc_unverified"), "risk").otherwise("good"),
        "search_terms": F.when(c("term_rows") == 0, "insufficient").when(c("zero_terms") > 0, "attention").otherwise("good"),
        "creative_landing": F.when((c("creatives") == 0) | (c("landing_rows") == 0), "insufficient").when(_any("url_expansion", "creative_mapping"), "attention").otherwise("good"),
        "conversion_quality": F.when(c("business_rows") == 0, "insufficient").when(_any("conversion_gap"), "risk").otherwise("good"),
        "commercial_sustainability": F.when(c("target_cpa").isNull() & c("target_roas").isNull() & (c("gross_profit") == 0), "insufficient").when(_any("valid_cpa_above_target"), "risk").otherwise("good"),
    }
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("area"), v.alias("status")) for k, v in values.items()))).alias("s")).select("s.*")


def data_gaps(row: DataFrame) -> DataFrame:
    """What is missing for a full diagnosis, a code each."""
    c = F.col
    tests = {
        "currency": ~c("currency").rlike("^[A-Z]{3}$"),
        "performance": c("ad_rows") == 0,
        "business": c("business_rows") == 0,
        "linkage_none": (c("business_rows") > 0) & (c("linked") == 0),
        "linkage_partial": (c("linked") > 0) & (c("linked") < c("business_rows")),
        "conversion_type": (c("primary_rows") == 0) & (c("observation_rows") == 0),
        "search_term": (c("term_rows") == 0) & (c("ad_rows") > 0),
        "landing_page": c("landing_rows") == 0,
        "asset_group": (c("pmax_rows") > 0) & (c("pmax_grouped") == 0),
        "url_expansion": (c("ai_rows") > 0) & (c("ai_expanded") == 0),
        "creatives": c("creatives") == 0,
        "target_cpa": c("target_cpa").isNull(),
        "roas_or_profit": c("target_roas").isNull() & c("profit_each").isNull() & (c("gross_profit") == 0),
    }
    return row.select(F.explode(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))).alias("gap"))


def brand_split(ads: DataFrame) -> DataFrame:
    return ads.groupBy("branded").agg(F.count("*").alias("rows"), _sum("clicks").alias("clicks"), _sum("cost").alias("cost"), _sum("platform_conversions").alias("conversions"))
