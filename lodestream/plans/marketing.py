"""Queries of search, paid search, reconciliation and web logs over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import ads, reconcile, search, weblogs
from lodestream.plans.adapters import registrar

AS_OF = "1998-08-01"
SETTINGS = ads.Settings("USD", target_cpa=2500.0)
QUERIES, ORACLE_SQL = {}, {}
query = registrar(QUERIES, ORACLE_SQL)

PAGE = "regexp_replace(page, '/+$', '')"
BUCKET = "CASE WHEN position IS NULL THEN 'unknown' WHEN position <= 3 THEN '1-3' WHEN position <= 10 THEN '4-10' WHEN position <= 20 THEN '11-20' ELSE '21+' END"
TOTALS = "sum(greatest(0, impressions)) AS impressions, sum(greatest(0, clicks)) AS clicks, CASE WHEN sum(greatest(0, impressions)) > 0 THEN sum(greatest(0, clicks)) / sum(greatest(0, impressions)) ELSE 0 END AS ctr"
POSITION = "sum(position * impressions) FILTER (position IS NOT NULL AND impressions > 0) / nullif(sum(impressions) FILTER (position IS NOT NULL AND impressions > 0), 0)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(("search_rows",), f"""SELECT sum(impressions) AS impressions, sum(clicks) AS clicks, round(sum(clicks) / sum(impressions), 6) AS ctr, round({POSITION}, 6) AS position,
    coalesce(sum(impressions) FILTER (branded), 0) AS branded_impressions, coalesce(sum(clicks) FILTER (branded), 0) AS branded_clicks,
    coalesce(sum(impressions) FILTER (NOT branded), 0) AS other_impressions, coalesce(sum(clicks) FILTER (NOT branded), 0) AS other_clicks FROM search_rows""")  # fmt: skip
def search_totals(rows):
    return rounded(search.totals(rows), "ctr", "position")


@query(("search_rows",), f"""SELECT {PAGE} AS page, round(sum(greatest(0, clicks)) / sum(greatest(0, impressions)), 6) AS ctr, sum(greatest(0, impressions)) AS impressions, sum(greatest(0, clicks)) AS clicks,
    round({POSITION}, 6) AS position, count(DISTINCT nullif(trim(query), '')) AS queries,
    coalesce(sum(greatest(0, impressions)) FILTER (branded), 0) >= coalesce(sum(greatest(0, impressions)) FILTER (NOT branded), 0) AS mostly_branded FROM search_rows GROUP BY 1""")  # fmt: skip
def search_page_matrix(rows):
    return rounded(search.page_matrix(rows), "ctr", "position")


@query(("search_rows",), f"SELECT {BUCKET} AS bucket, sum(impressions) AS impressions, sum(clicks) AS clicks, round(sum(clicks) / sum(impressions), 6) AS ctr FROM search_rows GROUP BY 1")
def ctr_baseline_by_bucket(rows):
    return rounded(search.bucket_baselines(rows), "ctr")


@query(("search_rows",), f"""SELECT query, count(DISTINCT {PAGE}) AS n_pages, sum(impressions) AS impressions, array_to_string(list_sort(list_distinct(list({PAGE}))), ' ') AS pages
    FROM search_rows WHERE trim(query) <> '' GROUP BY query HAVING count(DISTINCT {PAGE}) > 1 ORDER BY impressions DESC, query LIMIT 20""")  # fmt: skip
def query_page_conflicts(rows):
    return search.conflicts(rows).withColumn("pages", F.array_join("pages", " "))


GRADE = "CASE WHEN impressions >= 5000 AND clicks >= 100 THEN 'high' WHEN impressions >= 1000 AND clicks >= 30 THEN 'medium' ELSE 'low' END"
PAIRS = f"g AS (SELECT query, {PAGE} AS page, {TOTALS}, arg_min(position, row_seq) FILTER (position IS NOT NULL) AS position FROM search_rows WHERE trim(query) <> '' AND trim(page) <> '' GROUP BY 1, 2)"


@query(("search_rows",), f"""{PAIRS}, b AS (SELECT {BUCKET} AS bucket, sum(clicks) / sum(impressions) AS bucket_ctr FROM search_rows GROUP BY 1)
    SELECT query, page, impressions, clicks, round(ctr, 6) AS ctr, position, x.bucket, round(bucket_ctr, 6) AS bucket_ctr, CASE WHEN position <= 10 THEN 'P1' ELSE 'P2' END AS priority, {GRADE} AS confidence
    FROM (SELECT *, {BUCKET} AS bucket FROM g) x JOIN b ON x.bucket = b.bucket WHERE impressions >= 50 AND position <= 20 AND bucket_ctr > 0 AND ctr < 0.7 * bucket_ctr ORDER BY impressions DESC, query, page LIMIT 10""")  # fmt: skip
def snippet_candidates(rows):
    return rounded(search.snippet_opportunities(rows), "ctr", "bucket_ctr")


@query(("search_rows",), f"""{PAIRS} SELECT query, page, impressions, clicks, round(ctr, 6) AS ctr, position, CASE WHEN position <= 10 THEN 'P1' ELSE 'P2' END AS priority, {GRADE} AS confidence
    FROM g WHERE impressions >= 50 AND position BETWEEN 4 AND 20 ORDER BY impressions DESC, query, page LIMIT 10""")  # fmt: skip
def near_win_candidates(rows):
    return rounded(search.near_wins(rows), "ctr")


@query(("search_rows",), f"""SELECT query, count(DISTINCT {PAGE}) AS n_pages, sum(impressions) AS impressions, CASE WHEN sum(impressions) >= 1000 THEN 'P1' ELSE 'P2' END AS priority,
    CASE WHEN count(DISTINCT {PAGE}) > 2 THEN 'medium' ELSE 'low' END AS confidence FROM search_rows WHERE trim(query) <> '' GROUP BY query HAVING count(DISTINCT {PAGE}) > 1 ORDER BY impressions DESC, query LIMIT 10""")  # fmt: skip
def conflict_candidates(rows):
    return search.conflict_opportunities(rows)


STRICT = """d AS (SELECT count(*) FILTER (date IS NULL) AS undated, count(DISTINCT date) AS n, min(date) AS a, max(date) AS z FROM recent_search_rows),
  h AS (SELECT r.*, d.n // 2 AS days, d.a, d.z, date_diff('day', d.a, r.date) >= d.n // 2 AS current FROM recent_search_rows r, d
        WHERE d.undated = 0 AND d.n >= 4 AND d.n % 2 = 0 AND date_diff('day', d.a, d.z) + 1 = d.n AND d.z <= DATE '1998-07-30'),
  s AS (SELECT *, unnest(['all', CASE WHEN branded THEN 'branded' ELSE 'other' END]) AS segment FROM h),
  p AS (SELECT segment, CAST(any_value(days) AS INTEGER) AS days, any_value(a) AS previous_start, any_value(z) AS current_end,
        coalesce(sum(impressions) FILTER (current), 0) AS current_impressions, coalesce(sum(impressions) FILTER (NOT current), 0) AS previous_impressions,
        coalesce(sum(clicks) FILTER (current), 0) AS current_clicks, coalesce(sum(clicks) FILTER (NOT current), 0) AS previous_clicks FROM s GROUP BY segment)"""


@query(("recent_search_rows",), f"""{STRICT} SELECT *, CASE WHEN previous_clicks > 0 THEN round(current_clicks / previous_clicks - 1, 6) END AS click_change,
    CASE WHEN previous_impressions > 0 THEN round(current_impressions / previous_impressions - 1, 6) END AS impression_change FROM p""")  # fmt: skip
def period_strict(rows):
    return rounded(search.strict_periods(rows, AS_OF), "click_change", "impression_change")


@query(("recent_search_rows",), f"""{STRICT} SELECT x.page, x.impressions, x.clicks, round(p.current_clicks / p.previous_clicks - 1, 6) AS click_change FROM
    (SELECT {PAGE} AS page, sum(impressions) AS impressions, sum(clicks) AS clicks FROM recent_search_rows GROUP BY 1 HAVING sum(clicks) > 0 ORDER BY 2 DESC, 1 LIMIT 10) x, p
    WHERE p.segment = 'all' AND p.previous_clicks > 0 AND p.current_clicks / p.previous_clicks - 1 < -0.2""")  # fmt: skip
def decline_pages(rows):
    return rounded(search.decline_opportunity(rows, AS_OF), "click_change")


LENIENT = """d AS (SELECT date, sum(cost) AS cost, sum(platform_conversions) AS platform_conversions, sum(clicks) AS clicks, row_number() OVER (ORDER BY date DESC) AS rank, count(*) OVER () // 2 AS k FROM ad_rows WHERE date IS NOT NULL GROUP BY date),
  pp AS (SELECT coalesce(sum(cost) FILTER (rank <= k), 0) AS current_cost, coalesce(sum(cost) FILTER (rank > k AND rank <= 2 * k), 0) AS previous_cost,
       coalesce(sum(platform_conversions) FILTER (rank <= k), 0) AS current_platform_conversions, coalesce(sum(platform_conversions) FILTER (rank > k AND rank <= 2 * k), 0) AS previous_platform_conversions,
       coalesce(sum(clicks) FILTER (rank <= k), 0) AS current_clicks, coalesce(sum(clicks) FILTER (rank > k AND rank <= 2 * k), 0) AS previous_clicks,
       min(date) FILTER (rank <= k) AS current_start, max(date) FILTER (rank <= k) AS current_end, min(date) FILTER (rank > k AND rank <= 2 * k) AS previous_start, max(date) FILTER (rank > k AND rank <= 2 * k) AS previous_end FROM d)"""


@query(("ad_rows",), f"{LENIENT} SELECT * FROM pp")
def period_lenient(rows):
    return search.lenient_periods(rows, ("cost", "platform_conversions", "clicks"))


@query(("ad_rows",), "SELECT min(date) AS start, max(date) AS \"end\", date_diff('day', min(date), max(date)) + 1 AS days, CAST(min(date) - (date_diff('day', min(date), max(date)) + 1)::INTEGER AS DATE) AS previous_start, CAST(min(date) - 1 AS DATE) AS previous_end FROM ad_rows")
def sem_period_bounds(rows):
    return ads.period_bounds(rows).withColumn("days", F.col("days").cast("long"))


@query(("ad_rows",), """t AS (SELECT greatest(0.01, CASE WHEN sum(platform_conversions) > 0 AND sum(cost) > 0 THEN 1.5 * sum(cost) / sum(platform_conversions) ELSE 0.05 * sum(cost) END) AS threshold FROM ad_rows)
    SELECT count(*) AS n, coalesce(sum(cost), 0) AS cost, round(max(threshold), 4) AS threshold FROM ad_rows, t WHERE trim(search_term) <> '' AND cost > 0 AND platform_conversions = 0 AND cost >= threshold""")  # fmt: skip
def sem_zero_conversion(rows):
    found = ads.zero_conversion_terms(rows)
    return found.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.round(F.max("threshold"), 4).alias("threshold"))


@query(("ad_rows",), """SELECT round(sum(cost) FILTER (trim(search_term) <> '' AND regexp_matches(match_type, '(?i)broad|广泛|智能')) / sum(cost), 6) AS broad_share,
    round(sum(cost) FILTER (branded) / sum(cost), 6) AS brand_share, count(*) FILTER (landing_page <> '') AS landing_rows FROM ad_rows""")  # fmt: skip
def sem_cost_mix(rows):
    return ads.ad_totals(rows).select(F.round(F.col("broad_cost") / F.col("cost"), 6).alias("broad_share"), F.round(F.col("branded_cost") / F.col("cost"), 6).alias("brand_share"), "landing_rows")


@query(("ad_rows",), "SELECT branded, count(*) AS rows, sum(clicks) AS clicks, sum(cost) AS cost, sum(platform_conversions) AS conversions FROM ad_rows GROUP BY 1")
def brand_split(rows):
    return ads.brand_split(rows)


@query(("creative_rows",), "SELECT ad_group, count(DISTINCT trim(final_url)) AS n_pages FROM creative_rows WHERE trim(ad_group) <> '' AND trim(final_url) <> '' GROUP BY 1 HAVING count(DISTINCT trim(final_url)) > 1")
def creative_consistency(rows):
    return ads.inconsistent_groups(rows)


@query(("business_rows",), "SELECT count(*) FILTER (conversion_delay_days > 0) AS delayed_rows, round(avg(conversion_delay_days) FILTER (conversion_delay_days > 0), 6) AS mean_delay FROM business_rows")
def conversion_delay(rows):
    return rounded(ads.business_totals(rows).select("delayed_rows", "mean_delay"), "mean_delay")


LINKS = """m AS (SELECT click_id, arg_max(id, row_seq) AS ad FROM ad_rows WHERE click_id <> '' GROUP BY 1),
  u AS (SELECT lower(utm_campaign) AS k, any_value(id) AS ad FROM ad_rows WHERE utm_campaign <> '' GROUP BY 1 HAVING count(*) = 1),
  c AS (SELECT lower(campaign) AS k, any_value(id) AS ad FROM ad_rows WHERE campaign <> '' GROUP BY 1 HAVING count(*) = 1),
  l AS (SELECT b.id, coalesce(m.ad, u.ad, c.ad) AS ad_id, CASE WHEN m.ad IS NOT NULL THEN 'high' WHEN u.ad IS NOT NULL THEN 'medium' WHEN c.ad IS NOT NULL THEN 'low' END AS confidence, b.valid_conversions, b.revenue
    FROM business_rows b LEFT JOIN m ON b.click_id <> '' AND m.click_id = b.click_id LEFT JOIN u ON b.utm_campaign <> '' AND u.k = lower(b.utm_campaign) LEFT JOIN c ON b.attribution_key <> '' AND c.k = lower(b.attribution_key))"""
LINKED = """s AS (SELECT (SELECT count(*) FROM business_rows) AS total, count(*) AS linked, count(*) FILTER (confidence = 'high') AS exact FROM l WHERE ad_id IS NOT NULL),
  ss AS (SELECT *, CASE WHEN total = 0 OR linked = 0 THEN 'low' WHEN exact >= 0.8 * linked AND linked >= 5 THEN 'high' WHEN linked >= 0.5 * total THEN 'medium' ELSE 'low' END AS link_confidence FROM s)"""


@query(("ad_rows", "business_rows"), f"{LINKS} SELECT * FROM l WHERE ad_id IS NOT NULL")
def attribution_cascade(a, b):
    return ads.attribution(a, b)


@query(("ad_rows", "business_rows"), f"{LINKS}, {LINKED} SELECT * FROM ss")
def attribution_summary(a, b):
    return ads.attribution_summary(a, b)


ALL = ("ad_rows", "business_rows", "creative_rows", "change_rows")
WIDE = f"""{LINKS}, {LINKED}, {LENIENT},
  a1 AS (SELECT count(*) AS ad_rows, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(cost) AS cost, sum(platform_conversions) AS platform_conversions, sum(conversion_value) AS conversion_value,
      count(*) FILTER (trim(search_term) <> '') AS term_rows, count(*) FILTER (trim(search_term) <> '' AND match_type ILIKE '%broad%') AS broad_rows, sum(cost) FILTER (trim(search_term) <> '' AND match_type ILIKE '%broad%') AS broad_cost,
      sum(cost) FILTER (branded) AS branded_cost, count(*) FILTER (conversion_type = 'primary') AS primary_rows, count(*) FILTER (conversion_type = 'observation') AS observation_rows, count(*) FILTER (landing_page <> '') AS landing_rows,
      count(*) FILTER (platform = 'baidu' AND bid_strategy ILIKE '%ocpc%') AS ocpc_rows, count(*) FILTER (final_url_expansion ILIKE '%enabled%' AND landing_page <> '') AS expansion_rows,
      count(*) FILTER (trim(search_term) <> '' AND cost > 0 AND platform_conversions = 0 AND cost >= 2500) AS zero_terms FROM ad_rows),
  b1 AS (SELECT count(*) AS business_rows, sum(valid_conversions) AS valid_conversions, sum(revenue) AS revenue, sum(refunds) AS refunds, sum(gross_profit) AS gross_profit, avg(conversion_delay_days) FILTER (conversion_delay_days > 0) AS mean_delay FROM business_rows),
  c1 AS (SELECT count(*) AS creatives, count(*) FILTER (trim(headline) = '' OR trim(description) = '' OR trim(final_url) = '') AS incomplete FROM creative_rows),
  c2 AS (SELECT count(*) AS inconsistent FROM (SELECT ad_group FROM creative_rows WHERE trim(ad_group) <> '' AND trim(final_url) <> '' GROUP BY 1 HAVING count(DISTINCT trim(final_url)) > 1)),
  h1 AS (SELECT count(*) AS active_changes, count(DISTINCT sem_dimension) AS active_dimensions FROM change_rows WHERE channel = 'sem' AND learning_until > TIMESTAMP '1998-08-01'),
  w AS (SELECT *, CASE WHEN previous_cost > 0 THEN current_cost / previous_cost - 1 END AS cost_change, CASE WHEN previous_platform_conversions > 0 THEN current_platform_conversions / previous_platform_conversions - 1 END AS conversion_change,
      CASE WHEN valid_conversions > 0 THEN cost / valid_conversions END AS valid_cpa,
      CASE WHEN clicks >= 100 AND greatest(platform_conversions, valid_conversions) >= 10 THEN 'high' WHEN clicks >= 30 AND greatest(platform_conversions, valid_conversions) >= 3 THEN 'medium' ELSE 'low' END AS sample,
      CASE WHEN current_clicks >= 100 AND current_platform_conversions >= 10 THEN 'high' WHEN current_clicks >= 30 AND current_platform_conversions >= 3 THEN 'medium' ELSE 'low' END AS period_sample
      FROM a1, b1, c1, c2, h1, ss, pp),
  f AS (SELECT unnest([
      CASE WHEN active_changes > 0 THEN {{'code': 'learning_overlap', 'stage': 'business', 'priority': CASE WHEN active_dimensions > 1 THEN 'P2' ELSE 'P3' END, 'confidence': 'high'}} END,
      CASE WHEN business_rows = 0 THEN {{'code': 'no_business_rows', 'stage': 'tracking', 'priority': 'P1', 'confidence': 'high'}} END,
      CASE WHEN business_rows > 0 AND platform_conversions > 0 AND valid_conversions < 0.5 * platform_conversions THEN {{'code': 'conversion_gap', 'stage': 'tracking', 'priority': 'P1', 'confidence': sample}} END,
      CASE WHEN primary_rows = 0 AND observation_rows > 0 THEN {{'code': 'no_primary_conversion', 'stage': 'tracking', 'priority': 'P1', 'confidence': 'high'}} END,
      CASE WHEN zero_terms > 0 THEN {{'code': 'zero_conversion_spend', 'stage': 'search_terms', 'priority': 'P2', 'confidence': sample}} END,
      CASE WHEN broad_rows > 0 AND cost > 0 AND broad_cost >= 0.4 * cost THEN {{'code': 'broad_match_share', 'stage': 'search_terms', 'priority': 'P2', 'confidence': sample}} END,
      CASE WHEN cost > 0 AND branded_cost > 0.5 * cost THEN {{'code': 'brand_share', 'stage': 'cost', 'priority': 'P2', 'confidence': 'medium'}} END,
      CASE WHEN mean_delay >= 3 THEN {{'code': 'conversion_delay', 'stage': 'business', 'priority': 'P2', 'confidence': link_confidence}} END,
      CASE WHEN cost_change >= 0.3 AND (conversion_change IS NULL OR conversion_change < 0.5 * cost_change) THEN {{'code': 'cost_growth', 'stage': 'cost', 'priority': 'P1', 'confidence': period_sample}} END,
      CASE WHEN ocpc_rows > 0 AND business_rows = 0 THEN {{'code': 'ocpc_unverified', 'stage': 'tracking', 'priority': 'P1', 'confidence': 'high'}} END,
      CASE WHEN expansion_rows > 0 THEN {{'code': 'url_expansion', 'stage': 'creative_landing', 'priority': 'P2', 'confidence': 'medium'}} END,
      CASE WHEN incomplete > 0 OR inconsistent > 0 THEN {{'code': 'creative_mapping', 'stage': 'creative_landing', 'priority': 'P2', 'confidence': 'high'}} END,
      CASE WHEN sample = 'low' AND ad_rows > 0 THEN {{'code': 'low_sample', 'stage': 'business', 'priority': 'P3', 'confidence': 'high'}} END,
      CASE WHEN valid_cpa > 2500 THEN {{'code': 'valid_cpa_above_target', 'stage': 'budget', 'priority': 'P1', 'confidence': sample}} END]) AS f FROM w)"""


def _wide(a, b, c, h):
    return ads.wide(a, b, c, h, SETTINGS, AS_OF)


@query(ALL, f"""{WIDE} SELECT m.metric, round(m.value, 6) AS value, CASE WHEN m.value IS NULL THEN 'insufficient' ELSE 'good' END AS state FROM (SELECT unnest([
    {{'metric': 'ctr', 'value': clicks / impressions}}, {{'metric': 'cpc', 'value': cost / clicks}}, {{'metric': 'platform-cpa', 'value': cost / platform_conversions}}, {{'metric': 'valid-cpa', 'value': valid_cpa}},
    {{'metric': 'platform-value-roas', 'value': conversion_value / cost}}, {{'metric': 'refund-roas', 'value': greatest(0, revenue - refunds) / cost}}, {{'metric': 'profit-return', 'value': gross_profit / cost}},
    {{'metric': 'period-cost-change', 'value': cost_change}}, {{'metric': 'attribution-link-rate', 'value': linked / business_rows}}]) AS m FROM w)""")  # fmt: skip
def sem_metrics(a, b, c, h):
    return rounded(ads.metrics(_wide(a, b, c, h)), "value")


@query(ALL, f"{WIDE} SELECT f.code, f.stage, f.priority, f.confidence, f.code = 'zero_conversion_spend' AS stop_candidate FROM f WHERE f IS NOT NULL")
def sem_findings(a, b, c, h):
    return ads.findings(_wide(a, b, c, h))


@query(ALL, f"""{WIDE} SELECT s.area, s.status FROM (SELECT unnest([
    {{'area': 'tracking', 'status': CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.stage = 'tracking' AND f.priority = 'P1') THEN 'risk' ELSE 'good' END}},
    {{'area': 'search_terms', 'status': CASE WHEN term_rows = 0 THEN 'insufficient' WHEN zero_terms > 0 THEN 'attention' ELSE 'good' END}},
    {{'area': 'creative_landing', 'status': CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.stage = 'creative_landing') THEN 'attention' ELSE 'good' END}},
    {{'area': 'conversion_quality', 'status': CASE WHEN valid_conversions < 0.5 * platform_conversions THEN 'risk' ELSE 'good' END}},
    {{'area': 'commercial_sustainability', 'status': CASE WHEN valid_cpa > 2500 THEN 'risk' ELSE 'good' END}}]) AS s FROM w)""")  # fmt: skip
def sem_statuses(a, b, c, h):
    return ads.statuses(_wide(a, b, c, h))


@query(ALL, f"""{WIDE}, mx AS (SELECT count(*) FILTER (campaign_type ILIKE '%performance max%') AS pmax, count(*) FILTER (campaign_type ILIKE '%performance max%' AND asset_group <> '') AS pg,
      count(*) FILTER (campaign_type ILIKE '%ai max%' OR bid_strategy ILIKE '%ai max%') AS ai, count(*) FILTER ((campaign_type ILIKE '%ai max%' OR bid_strategy ILIKE '%ai max%') AND final_url_expansion <> '') AS ae FROM ad_rows)
    SELECT gap FROM (SELECT unnest([CASE WHEN linked = 0 THEN 'linkage_none' END, CASE WHEN linked > 0 AND linked < business_rows THEN 'linkage_partial' END, CASE WHEN primary_rows = 0 AND observation_rows = 0 THEN 'conversion_type' END,
      CASE WHEN pmax > 0 AND pg = 0 THEN 'asset_group' END, CASE WHEN ai > 0 AND ae = 0 THEN 'url_expansion' END, CASE WHEN creatives = 0 THEN 'creatives' END, CASE WHEN gross_profit = 0 THEN 'roas_or_profit' END]) AS gap FROM w, mx) WHERE gap IS NOT NULL""")  # fmt: skip
def sem_data_gaps(a, b, c, h):
    return ads.data_gaps(_wide(a, b, c, h))


THREE = ("analytics_rows", "ad_rows", "business_rows")
WINDOW = """m AS (SELECT least(90, greatest(1, ceil(max(conversion_delay_days))))::INTEGER AS maturity_days FROM business_rows),
  e AS (SELECT min(date) AS a, max(date) AS z FROM analytics_rows UNION ALL SELECT min(date), max(date) FROM ad_rows UNION ALL SELECT min(date), max(date) FROM business_rows),
  p AS (SELECT max(a) AS period_start, CAST(least(min(z), DATE '1998-08-01' - any_value(maturity_days)) AS DATE) AS period_end, any_value(maturity_days) AS maturity_days, max(a) <= least(min(z), DATE '1998-08-01' - any_value(maturity_days)) AS period_valid FROM e, m)"""


@query(THREE, f"{WINDOW} SELECT * FROM p")
def reconcile_window(a, d, b):
    return reconcile.window(a, d, b, AS_OF)


RTOTALS = """r AS (SELECT (SELECT coalesce(sum(clicks), 0) FROM ad_rows, p WHERE date BETWEEN period_start AND period_end) AS clicks, (SELECT coalesce(sum(platform_conversions), 0) FROM ad_rows, p WHERE date BETWEEN period_start AND period_end) AS platform_conversions,
    (SELECT coalesce(sum(sessions), 0) FROM analytics_rows, p WHERE date BETWEEN period_start AND period_end) AS sessions, (SELECT coalesce(sum(key_events), 0) FROM analytics_rows, p WHERE date BETWEEN period_start AND period_end) AS key_events,
    (SELECT coalesce(sum(valid_conversions), 0) FROM business_rows, p WHERE date BETWEEN period_start AND period_end) AS valid_conversions, (SELECT coalesce(sum(revenue), 0) FROM business_rows, p WHERE date BETWEEN period_start AND period_end) AS revenue,
    (SELECT coalesce(sum(refunds), 0) FROM business_rows, p WHERE date BETWEEN period_start AND period_end) AS refunds)"""


@query(THREE, f"{WINDOW}, {RTOTALS} SELECT * FROM r")
def reconcile_totals(a, d, b):
    return reconcile.totals(a, d, b, reconcile.window(a, d, b, AS_OF))


@query(THREE, f"""{WINDOW}, {RTOTALS}, n AS (SELECT (SELECT count(*) FROM ad_rows) AS an, (SELECT count(*) FROM business_rows) AS bn)
    SELECT f.code, f.priority, f.confidence FROM (SELECT unnest([
      CASE WHEN period_valid AND clicks > 0 AND sessions = 0 THEN {{'code': 'clicks_without_sessions', 'priority': 'P1', 'confidence': 'high'}} END,
      CASE WHEN period_valid AND key_events > 0 AND platform_conversions > 1.5 * key_events THEN {{'code': 'ads_above_analytics', 'priority': 'P1', 'confidence': CASE WHEN an >= 30 THEN 'high' WHEN an >= 10 THEN 'medium' ELSE 'low' END}} END,
      CASE WHEN period_valid AND platform_conversions > 0 AND valid_conversions < 0.5 * platform_conversions THEN {{'code': 'business_gap', 'priority': 'P1', 'confidence': CASE WHEN bn >= 30 THEN 'high' WHEN bn >= 10 THEN 'medium' ELSE 'low' END}} END]) AS f FROM r, p, n) WHERE f IS NOT NULL""")  # fmt: skip
def reconcile_findings(a, d, b):
    return reconcile.findings(a, d, b, reconcile.window(a, d, b, AS_OF))


@query(("analytics_rows",), "SELECT array_to_string(list_sort(list(DISTINCT c)), ' ') AS observed, count(DISTINCT c) <= 1 AS comparable FROM (SELECT upper(trim(currency)) AS c FROM analytics_rows UNION ALL SELECT 'USD') WHERE c <> ''")
def currency_check(a):
    return reconcile.currencies(a, "USD").withColumn("observed", F.array_join("observed", " "))


@query(("analytics_rows", "ad_rows"), """SELECT count(*) AS pages, count(*) FILTER (n = 2) AS matched FROM (SELECT page, count(DISTINCT side) AS n FROM (
      SELECT replace(page, '#top', '') AS page, 1 AS side FROM analytics_rows UNION ALL SELECT replace(replace(landing_page, '/?', '?'), '?gclid=a&b=2&a=1', '?a=1&b=2'), 2 FROM ad_rows) GROUP BY 1)""")  # fmt: skip
def landing_page_match(a, d):
    return reconcile.matched_pages(a, d)


@query(("ad_rows", "business_rows"), """g AS (SELECT lower(trim(coalesce(nullif(utm_campaign, ''), campaign))) AS k, count(*) AS n FROM ad_rows GROUP BY 1)
    SELECT b.id, CASE WHEN trim(b.click_id) <> '' AND trim(b.click_id) IN (SELECT trim(click_id) FROM ad_rows) THEN 'high'
      WHEN trim(b.utm_campaign) <> '' AND lower(trim(b.utm_campaign)) IN (SELECT k FROM g WHERE n = 1) THEN 'medium'
      WHEN EXISTS (SELECT 1 FROM ad_rows a WHERE a.date = b.date AND (b.utm_campaign = '' OR lower(a.utm_campaign) = lower(b.utm_campaign) OR lower(a.campaign) = lower(b.utm_campaign))) THEN 'low' ELSE 'unmatched' END AS grade
    FROM business_rows b""")  # fmt: skip
def attribution_grade(d, b):
    return reconcile.attribution_grades(d, b)


@query(("log_rows",), "SELECT coalesce(status, 0) AS status, count(*) AS requests FROM log_rows GROUP BY 1")
def log_status_counts(rows):
    return weblogs.status_counts(rows)


@query(("log_rows",), "SELECT bot_family, count(*) AS requests FROM log_rows WHERE bot_family IS NOT NULL GROUP BY 1")
def log_bot_families(rows):
    return weblogs.bot_counts(rows)


@query(("log_rows",), 'SELECT count(*) AS requests, min("at") AS first, max("at") AS last, count(*) FILTER (status >= 400) AS errors FROM log_rows')
def log_summary(rows):
    return weblogs.summary(rows)


SLOW = "g AS (SELECT url, count(*) AS requests, round(avg(duration_ms), 4) AS average_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM log_rows GROUP BY 1)"


@query(("log_rows",), f"{SLOW} SELECT * FROM g WHERE p95_ms >= 1000 OR average_ms >= 800 ORDER BY coalesce(p95_ms, 0) DESC, url LIMIT 50")
def log_slow_urls(rows):
    return weblogs.slow_urls(rows).withColumn("average_ms", F.round("average_ms", 4))


@query(("log_rows",), "SELECT url, round(avg(duration_ms), 4) AS average_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, count(*) AS requests FROM log_rows GROUP BY 1")
def log_latencies(rows):
    return weblogs.latencies(rows).withColumn("average_ms", F.round("average_ms", 4))


WASTE = """g AS (SELECT url, count(*) AS requests, bool_or(status >= 400) AS failed, min(row_seq) AS s FROM log_rows GROUP BY 1),
  w AS (SELECT url, reason, requests FROM (SELECT url, requests, s, 0 AS nth, 'parameters' AS reason FROM g WHERE requests >= 2 AND regexp_matches(url, '(?i)[?&](?:utm_|gclid|msclkid|bd_vid|sort|filter|page)=')
    UNION ALL SELECT url, requests, s, 1, 'error_status' FROM g WHERE failed) ORDER BY s, nth LIMIT 100)"""


@query(("log_rows",), f"{WASTE} SELECT * FROM w")
def log_wasted_urls(rows):
    return weblogs.wasted_urls(rows)


NEVER = "SELECT url FROM (SELECT row_seq, regexp_replace(url, '#.*$', '') AS url FROM sitemap_rows) s WHERE url NOT IN (SELECT url FROM log_rows WHERE bot_family IS NOT NULL) ORDER BY row_seq LIMIT 100"


@query(("log_rows", "sitemap_rows"), NEVER)
def log_never_crawled(rows, sitemap):
    return weblogs.never_crawled(rows, sitemap)


@query(("log_rows", "sitemap_rows"), f"""{WASTE}, {SLOW.replace('g AS', 'sl AS')} SELECT * FROM (SELECT 'error-status' AS code, 'P1' AS priority, count(*) FILTER (status >= 400) AS n FROM log_rows
    UNION ALL SELECT 'slow-url', 'P2', least(50, count(*)) FROM sl WHERE p95_ms >= 1000 OR average_ms >= 800 UNION ALL SELECT 'parameter-waste', 'P2', count(*) FROM w
    UNION ALL SELECT 'sitemap-never-crawled', 'P3', count(*) FROM ({NEVER})) WHERE n > 0""")  # fmt: skip
def log_findings(rows, sitemap):
    return weblogs.findings(rows, sitemap)


@query(("recent_search_rows",), f"""{STRICT}, {PAIRS.replace('search_rows', 'recent_search_rows')}, b AS (SELECT {BUCKET} AS bucket, sum(clicks) / sum(impressions) AS bucket_ctr FROM recent_search_rows GROUP BY 1),
    sn AS (SELECT 'snippet' AS kind, query, page, impressions FROM (SELECT *, {BUCKET} AS bucket FROM g) x JOIN b ON x.bucket = b.bucket WHERE impressions >= 50 AND position <= 20 AND bucket_ctr > 0 AND ctr < 0.7 * bucket_ctr ORDER BY impressions DESC, query, page LIMIT 10),
    nw AS (SELECT 'near_win' AS kind, query, page, impressions FROM g WHERE impressions >= 50 AND position BETWEEN 4 AND 20 ORDER BY impressions DESC, query, page LIMIT 10),
    cf AS (SELECT 'cannibalization' AS kind, query, NULL AS page, sum(impressions) AS impressions FROM recent_search_rows WHERE trim(query) <> '' GROUP BY query HAVING count(DISTINCT {PAGE}) > 1 ORDER BY 4 DESC, query LIMIT 10)
    SELECT * FROM sn UNION ALL SELECT * FROM nw UNION ALL SELECT * FROM cf UNION ALL SELECT 'content', NULL, NULL, current_impressions FROM p WHERE segment = 'all' AND previous_clicks > 0 AND current_clicks / previous_clicks - 1 < -0.2""")  # fmt: skip
def search_opportunities(rows):
    return search.opportunities(rows, AS_OF).select("kind", "query", "page", "impressions")
