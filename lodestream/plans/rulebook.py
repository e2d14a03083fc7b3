"""Queries of rules, scores, tasks, baselines, tracking and retention over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import rules, scoring, store, tracking
from lodestream.plans.adapters import registrar

QUERIES, ORACLE_SQL = {}, {}
query = registrar(QUERIES, ORACLE_SQL)


def snapshots_of(rows: DataFrame) -> DataFrame:
    """Snapshots with every field, made of a row's numbers."""
    k, lit, array = F.col("k"), F.lit, F.array
    empty = lambda kind: array().cast(f"array<{kind}>")
    link = lambda href, internal, rel: F.struct(lit(href).alias("href"), lit(href).alias("raw_href"), F.when(k % 6 == 0, "").otherwise("More").alias("name"), lit(internal).alias("internal"), lit(False).alias("fragment"), lit(False).alias("fragment_exists"), rel.alias("rel"))
    image = F.struct(F.when(k % 4 == 0, lit(None)).otherwise("A picture").alias("alt"), (k % 3 != 0).alias("sized"), F.when(k % 5 == 0, "lazy").otherwise("eager").alias("loading"), lit(True).alias("in_viewport"), lit(10.0).alias("area"), lit(False).alias("in_link"), lit("").alias("role"), F.when(k % 4 == 0, "missing").alias("alt_risk"))
    return rows.select(
        F.concat(lit("r"), k.cast("string")).alias("report_id"), "url", F.when(k % 7 == 0, empty("string")).when(k % 7 == 1, array("title", lit("Two"))).otherwise(array("title")).alias("titles"),
        F.when(k % 5 == 0, empty("string")).otherwise(array(F.concat(lit("A description that is neither too short nor too long for it "), "title"))).alias("descriptions"), F.when(k % 11 == 0, array(lit("noindex"))).otherwise(array(lit("index"))).alias("robots"),
        lit(None).cast("string").alias("x_robots"), F.when(k % 3 == 0, empty("string")).otherwise(array("url")).alias("canonicals"), F.when(k % 4 == 0, lit("https://else.example/")).otherwise(F.col("url")).alias("canonical_resolved"), F.when(k % 9 == 0, "").otherwise("en-GB").alias("html_lang"),
        F.when(k % 8 == 0, empty("struct<level:int,text:string>")).otherwise(array(F.struct(lit(1).alias("level"), lit("Head").alias("text")), F.struct(F.when(k % 2 == 0, 3).otherwise(2).alias("level"), lit("Sub").alias("text")))).alias("headings"),
        (k % 3).cast("int").alias("main_count"), lit(0).alias("form_count"), empty("string").alias("cta_texts"), ((k % 4) * 60).cast("long").alias("text_length"), (k % 2 == 0).alias("author_present"), (k % 3 == 0).alias("date_present"),
        F.when(k % 10 == 0, empty(rules.SNAPSHOT.split("links array<")[1].split(">>,")[0] + ">")).otherwise(array(link("/a", True, F.when(k % 5 == 1, array(lit("nofollow"))).otherwise(empty("string"))), link("#", True, empty("string")))).alias("links"),
        F.when(k % 6 == 1, empty(rules.SNAPSHOT.split("images array<")[1].split(">, videos")[0])).otherwise(array(image)).alias("images"), empty("struct<poster:string,fallback:boolean>").alias("videos"),
        F.when(k % 13 == 0, array(F.struct(lit("xx-").alias("lang"), lit(False).alias("valid")))).otherwise(empty("struct<lang:string,valid:boolean>")).alias("hreflangs"),
        F.when(k % 7 == 3, array(F.struct((k % 2 == 0).alias("valid"), array(lit("Article")).alias("types"), lit(0).alias("issues")))).otherwise(empty("struct<valid:boolean,types:array<string>,issues:int>")).alias("json_ld"),
        F.when(k % 12 == 0, "").otherwise("width=device-width").alias("viewport"), lit("other").alias("template_type"), (k % 5 != 4).alias("raw_available"), ((k % 10) * 40).cast("long").alias("raw_length"), lit(500).cast("long").alias("rendered_length"),
        F.when(k % 2 == 0, (k % 5) * 1000.0).alias("lcp"), F.when(k % 3 == 0, (k % 4) * 0.05).alias("cls"), lit(900.0).alias("fcp"), lit(900.0).alias("ttfb"), F.when(k % 19 == 0, 500).when(k % 17 == 0, lit(None)).otherwise(200).alias("status"), lit(200).alias("robots_status"), (k % 16 != 0).alias("robots_allowed"),
        lit("good").alias("transport"), F.when(k % 4 == 2, "attention").otherwise("good").alias("compression"), lit("confirm").alias("cache"), (k % 2).cast("int").alias("resource_risk"), lit("good").alias("crawler"),
        F.when(k % 3 == 2, "unknown").otherwise("index").alias("expected_index_state"), F.when(k % 5 == 0, "article").otherwise("category").alias("page_type"), lit("").alias("target_query"), lit("").alias("page_task"),
    )


#: The same rules as cases over the numbers of a row.
RULE_SQL = {
    "discoverability.response": "CASE WHEN k % 19 = 0 THEN CASE WHEN k % 3 = 2 THEN 'informational' ELSE 'failure' END WHEN k % 17 = 0 THEN 'not_measurable' ELSE 'pass' END",
    "discoverability.index-directives": "CASE WHEN k % 11 = 0 THEN CASE WHEN k % 3 = 2 THEN 'informational' ELSE 'failure' END ELSE 'pass' END",
    "discoverability.robots": "CASE WHEN k % 16 = 0 THEN CASE WHEN k % 3 = 2 THEN 'informational' ELSE 'failure' END ELSE 'pass' END",
    "discoverability.canonical": "CASE WHEN k % 3 = 0 THEN 'warning' WHEN k % 4 = 0 THEN 'warning' ELSE 'pass' END",
    "discoverability.raw-render": "CASE WHEN k % 5 = 4 THEN 'not_measurable' WHEN (k % 10) * 40 < 100 THEN 'warning' ELSE 'pass' END",
    "metadata.title": "CASE WHEN k % 7 = 0 THEN 'failure' WHEN k % 7 = 1 THEN 'warning' ELSE 'pass' END",
    "metadata.title-risk": "CASE WHEN k % 7 = 0 THEN 'not_applicable' WHEN length(title) < 10 THEN 'warning' ELSE 'pass' END",
    "metadata.description": "CASE WHEN k % 5 = 0 THEN 'warning' ELSE 'pass' END", "metadata.description-risk": "CASE WHEN k % 5 = 0 THEN 'not_applicable' ELSE 'pass' END", "metadata.h1": "CASE WHEN k % 8 = 0 THEN 'warning' ELSE 'pass' END",
    "content.heading-order": "CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'pass' END", "content.main-landmark": "CASE WHEN k % 3 = 1 THEN 'pass' ELSE 'warning' END", "content.language": "CASE WHEN k % 9 = 0 THEN 'warning' ELSE 'pass' END",
    "content.visible-content": "CASE WHEN k % 4 = 0 THEN 'failure' WHEN k % 4 = 1 THEN 'warning' ELSE 'pass' END", "content.entity-signals": "CASE WHEN k % 5 <> 0 THEN 'not_applicable' WHEN k % 2 <> 0 OR k % 3 <> 0 THEN 'warning' ELSE 'pass' END",
    "links.valid-hrefs": "CASE WHEN k % 10 = 0 THEN 'not_applicable' ELSE 'warning' END", "links.anchor-text": "CASE WHEN k % 10 = 0 THEN 'not_applicable' WHEN k % 6 = 0 THEN 'warning' ELSE 'pass' END",
    "links.internal-entry": "CASE WHEN k % 10 = 0 THEN 'warning' ELSE 'pass' END", "links.fragments": "'not_applicable'", "links.pagination": "CASE WHEN k % 5 = 0 THEN 'not_applicable' ELSE 'warning' END",
    "media.image-alt": "CASE WHEN k % 6 = 1 THEN 'not_applicable' WHEN k % 4 = 0 THEN 'warning' ELSE 'pass' END", "media.image-dimensions": "CASE WHEN k % 6 = 1 THEN 'not_applicable' WHEN k % 3 = 0 THEN 'warning' ELSE 'pass' END",
    "media.image-alt-quality": "CASE WHEN k % 6 <> 1 AND k % 4 = 0 THEN 'warning' ELSE 'pass' END", "media.loading-priority": "CASE WHEN k % 6 = 1 THEN 'not_applicable' WHEN k % 5 = 0 THEN 'warning' ELSE 'pass' END",
    "media.json-ld": "CASE WHEN k % 7 <> 3 THEN 'not_applicable' WHEN k % 2 <> 0 THEN 'failure' ELSE 'pass' END", "media.conditional": "CASE WHEN k % 13 = 0 THEN 'warning' ELSE 'not_applicable' END",
    "performance.lcp": "CASE WHEN k % 2 <> 0 THEN 'not_measurable' WHEN (k % 5) * 1000 > 2500 THEN 'warning' ELSE 'pass' END", "performance.cls": "CASE WHEN k % 3 <> 0 THEN 'not_measurable' WHEN k % 4 > 2 THEN 'warning' ELSE 'pass' END",
    "performance.fcp": "'pass'", "performance.ttfb": "'warning'", "performance.viewport": "CASE WHEN k % 12 = 0 THEN 'failure' ELSE 'pass' END", "metadata.query-alignment": "'informational'",
    "content.page-value": "CASE WHEN (k % 7 = 0 OR k % 8 = 0)::INT + (k % 5 = 0 AND k % 2 <> 0 AND k % 3 <> 0 AND k % 7 <> 3)::INT + (k % 6 = 0 OR k % 10 = 0)::INT >= 2 THEN 'warning' ELSE 'informational' END",
    "technical.transport": "'pass'", "technical.compression": "CASE WHEN k % 4 = 2 THEN 'warning' ELSE 'pass' END", "technical.cache": "'warning'", "technical.resources": "CASE WHEN k % 2 = 1 THEN 'warning' ELSE 'pass' END",
    "technical.crawler-access": "'pass'", "links.nofollow-policy": "CASE WHEN k % 10 <> 0 AND k % 5 = 1 THEN 'warning' ELSE 'pass' END",
}
STATUSES = "fs AS (SELECT concat('r', k) AS report_id, unnest([" + ", ".join(f"{{'rule_id': '{r}', 'status': {s}}}" for r, s in RULE_SQL.items()) + "]) AS f FROM snapshot_rows)"


@query(("snapshot_rows",), f"{STATUSES} SELECT report_id, f.rule_id, f.status FROM fs")
def rule_findings(rows):
    return rules.evaluate(snapshots_of(rows)).select("report_id", "rule_id", "status")


@query(("snapshot_rows",), f"{STATUSES} SELECT f.rule_id, f.status, count(*) AS n FROM fs GROUP BY 1, 2")
def rule_histogram(rows):
    return rules.evaluate(snapshots_of(rows)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


def urls_of(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"urls": F.split("url_list", " "), "included": F.col("included") == 1})


MEASURED = "points > 0 AND included = 1 AND status NOT IN ('informational', 'not_measurable', 'not_applicable')"


@query(("finding_rows",), f"""s AS (SELECT report_id, sum(points * coalesce(score_ratio, 0)) FILTER ({MEASURED}) AS earned, sum(points) FILTER ({MEASURED}) AS possible, min(score_cap) FILTER ({MEASURED} AND status = 'failure' AND confidence = 'high') AS cap,
      count(*) FILTER ({MEASURED}) AS measured, count(*) FILTER (points > 0 AND included = 1 AND status <> 'not_applicable') AS measurable FROM finding_rows GROUP BY 1),
    t AS (SELECT report_id, CASE WHEN possible > 0 THEN CAST(least(floor(100 * earned / possible + 0.5), cap) AS INTEGER) END AS score, CAST(CASE WHEN measurable > 0 THEN floor(100 * measured / measurable + 0.5) ELSE 0 END AS INTEGER) AS coverage, measured, measurable FROM s)
    SELECT *, CASE WHEN coverage < 60 OR score IS NULL THEN 'insufficient' WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'improvable' ELSE 'risk' END AS label FROM t""")  # fmt: skip
def score_overall(rows):
    return scoring.overall(urls_of(rows))


@query(("finding_rows",), f"""SELECT report_id, category, CASE WHEN sum(points) FILTER ({MEASURED}) > 0 THEN CAST(floor(100 * sum(points * coalesce(score_ratio, 0)) FILTER ({MEASURED}) / sum(points) FILTER ({MEASURED}) + 0.5) AS INTEGER) END AS score,
    coalesce(sum(points * coalesce(score_ratio, 0)) FILTER ({MEASURED}), 0) AS earned, coalesce(sum(points) FILTER ({MEASURED}), 0) AS applicable, count(*) FILTER (status IN ('failure', 'warning')) AS issues FROM finding_rows GROUP BY 1, 2""")  # fmt: skip
def score_by_category(rows):
    return scoring.by_category(urls_of(rows))


@query(("finding_rows",), """x AS (SELECT *, points > 0 AND included = 1 AND score_ratio IS NOT NULL AS ok, floor(points * score_ratio * 10 + 0.5) / 10 AS e FROM finding_rows),
    s AS (SELECT report_id, coalesce(sum(e) FILTER (ok), 0) AS e, coalesce(sum(points) FILTER (ok), 0) AS p, count(*) FILTER (ok AND points > e) AS n_deducted, coalesce(array_to_string(list_sort(list(score_cap) FILTER (status = 'failure' AND confidence = 'high' AND score_cap IS NOT NULL)), ' '), '') AS caps FROM x GROUP BY 1)
    SELECT report_id, floor(e * 10 + 0.5) / 10 AS earned, p AS possible, floor((p - floor(e * 10 + 0.5) / 10) * 10 + 0.5) / 10 AS deducted, CASE WHEN p > 0 THEN CAST(floor(100 * (floor(e * 10 + 0.5) / 10) / p + 0.5) AS INTEGER) END AS normalized, n_deducted, caps FROM s""")  # fmt: skip
def score_details(rows):
    return scoring.details(urls_of(rows)).withColumn("caps", F.array_join(F.col("caps").cast("array<string>"), " "))


@query(("finding_rows",), "SELECT report_id, rule_id FROM finding_rows WHERE priority = 'P1' AND category = 'metadata' AND status IN ('failure', 'warning')")
def issue_filter(rows):
    return scoring.filter_findings(rows, "P1", "metadata", "actionable").select("report_id", "rule_id")


@query(("finding_rows",), """c AS (SELECT unnest(['all', 'discoverability', 'metadata', 'content', 'links', 'media', 'performance']) AS category), r AS (SELECT DISTINCT report_id FROM finding_rows)
    SELECT r.report_id, c.category, (SELECT count(*) FROM finding_rows f WHERE f.report_id = r.report_id AND f.status IN ('failure', 'warning') AND (c.category = 'all' OR f.category = c.category)) AS n FROM r, c""")  # fmt: skip
def category_counts(rows):
    return scoring.category_counts(rows)


LANE = "CASE WHEN priority IN ('P0', 'P1') THEN 'urgent' WHEN priority = 'P2' AND effort = 'low' THEN 'quick_wins' WHEN priority = 'P2' THEN 'planned' ELSE 'watch' END"


@query(("finding_rows",), f"SELECT {LANE} AS lane, count(*) AS n FROM finding_rows WHERE status IN ('failure', 'warning') GROUP BY 1")
def recommendation_lanes(rows):
    return scoring.actionable(rows).groupBy(scoring.lane().alias("lane")).agg(F.count("*").alias("n"))


FIRST = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE WHEN status = 'failure' THEN 0 ELSE 1 END, len(string_split(url_list, ' ')) DESC, points DESC, CASE effort WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, rule_id"


@query(("finding_rows",), f"SELECT report_id, rule_id, row_number() OVER (PARTITION BY report_id ORDER BY priority, {FIRST}) AS place FROM finding_rows WHERE status IN ('failure', 'warning')")
def finding_order(rows):
    place = F.row_number().over(Window.partitionBy("report_id").orderBy(*scoring.finding_order()))
    return scoring.actionable(urls_of(rows)).select("report_id", "rule_id", place.cast("long").alias("place"))


ROOTS = f"""a AS (SELECT *, row_number() OVER (PARTITION BY report_id, root_cause ORDER BY priority, {FIRST}) AS k FROM finding_rows WHERE status IN ('failure', 'warning')),
    g AS (SELECT report_id, root_cause, any_value(rule_id) FILTER (k = 1) AS rule_id, any_value(priority) FILTER (k = 1) AS priority, any_value(category) FILTER (k = 1) AS category, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(string_split(url_list, ' '))))), ' ') AS urls FROM a GROUP BY 1, 2)"""


@query(("finding_rows",), f"{ROOTS} SELECT report_id, root_cause, rule_id, priority, n, urls FROM g")
def root_cause_groups(rows):
    return scoring.root_causes(urls_of(rows)).select("report_id", "root_cause", "rule_id", "priority", "n", F.array_join("urls", " ").alias("urls"))


@query(("finding_rows",), f"""{ROOTS} SELECT report_id, root_cause, CASE WHEN category = 'discoverability' THEN 'access_indexing' WHEN category IN ('metadata', 'content') THEN 'content_intent' WHEN category = 'performance' THEN 'performance_resources' ELSE 'links_media_schema' END AS recommendation,
    'html_template' AS layer FROM g""")  # fmt: skip
def recommendation_plan(rows):
    return scoring.recommendations(urls_of(rows)).select("report_id", "root_cause", "recommendation", "layer")


@query(("finding_rows",), f"{ROOTS} SELECT report_id, root_cause, CASE WHEN root_cause = 'cause1' THEN 'done' ELSE 'todo' END AS state, CASE WHEN root_cause = 'cause1' THEN concat('old', report_id) ELSE sha256(concat(report_id, ':', root_cause)) END AS id FROM g")
def task_merge(rows):
    old = rows.select("report_id").distinct().select("report_id", F.lit("cause1").alias("root_cause"), F.concat(F.lit("old"), "report_id").alias("id"), F.lit("done").alias("state"), F.lit("1998-01-01").alias("created_at"))
    return scoring.tasks(urls_of(rows), old).select("report_id", "root_cause", "state", "id")


@query(("finding_rows",), """b AS (SELECT report_id AS key, rule_id, any_value(status) AS status FROM finding_rows WHERE n % 2 = 0 GROUP BY 1, 2), a AS (SELECT report_id AS key, rule_id, any_value(other) AS status FROM finding_rows WHERE n % 3 <> 0 GROUP BY 1, 2),
    d AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.rule_id, b.rule_id) AS rule_id, b.status AS before, a.status AS after FROM a FULL JOIN b ON a.key = b.key AND a.rule_id = b.rule_id)
    SELECT * FROM (SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'fixed' WHEN before = after THEN NULL WHEN after IN ('pass', 'not_applicable') THEN 'fixed' ELSE 'changed' END AS change FROM d) WHERE change IS NOT NULL""")  # fmt: skip
def baseline_diff(rows):
    before = rows.where("n % 2 = 0").select(F.col("report_id").alias("key"), "rule_id", "status")
    after = rows.where("n % 3 <> 0").select(F.col("report_id").alias("key"), "rule_id", F.col("other").alias("status"))
    return scoring.baseline_diff(before, after)


@query(("finding_rows",), "SELECT report_id, status, count(*) AS n FROM finding_rows GROUP BY 1, 2")
def baseline_statuses(rows):
    return scoring.baseline_statuses(rows)


@query(("observation_rows",), """v AS (SELECT * FROM observation_rows WHERE platform IN ('google_analytics', 'google_tag_manager', 'google_ads', 'bing_uet', 'microsoft_clarity', 'browser'))
    SELECT run_id, seq, CASE WHEN regexp_matches(name, '(?i)(email|mail|phone|mobile|telephone|name|address)') THEN 'redacted' ELSE substr(name, 1, 100) END AS name, CAST(greatest(0, relative_ms) AS BIGINT) AS relative_ms, regexp_matches(name, '(?i)(email|mail|phone|mobile|telephone|name|address)') AS sensitive FROM v""")  # fmt: skip
def tracking_validate(rows):
    return tracking.accepted(rows).select("run_id", "seq", "name", "relative_ms", "sensitive")


DUPLICATES = """k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM observation_rows) WHERE r <= 200),
    e AS (SELECT run_id, concat(platform, ':', lower(name)) AS event_key, relative_ms - lag(relative_ms) OVER (PARTITION BY run_id, platform, lower(name) ORDER BY seq) AS gap FROM k WHERE type = 'event'), d AS (SELECT DISTINCT run_id, event_key FROM e WHERE gap < 9000000)"""


@query(("observation_rows",), f"{DUPLICATES} SELECT * FROM d")
def tracking_duplicates(rows):
    return tracking.duplicates(rows, 9_000_000)


@query(("run_rows", "observation_rows"), f"""{DUPLICATES}, m AS (SELECT run_id, arg_min(relative_ms, seq) FILTER (name = 'user_confirmed_success') AS s, arg_min(relative_ms, seq) FILTER (name = 'user_confirmed_failure') AS f FROM k GROUP BY 1),
    x AS (SELECT k.run_id, k.platform, count(*) FILTER (relative_ms > -1 AND relative_ms <= s AND s - relative_ms <= 90000000) AS ns, count(*) FILTER (relative_ms > coalesce(s, -1) AND relative_ms <= f AND f - relative_ms <= 90000000) AS nf, count(*) AS n
      FROM k JOIN m ON k.run_id = m.run_id WHERE type = 'event' AND lower(name) IN ('purchase', 'order_complete') GROUP BY 1, 2),
    y AS (SELECT run_id, sum(ns) AS ns, max(ns) AS mx, sum(nf) AS nf, sum(n) AS n FROM x GROUP BY 1), z AS (SELECT run_id, count(*) AS d FROM d GROUP BY 1),
    w AS (SELECT r.run_id, CASE WHEN s IS NULL THEN 'untested' WHEN coalesce(d, 0) > 0 OR coalesce(mx, 0) > 1 THEN 'duplicate_candidate' WHEN coalesce(ns, 0) > 0 THEN 'recorded_once' ELSE 'not_observed' END AS successful,
      CASE WHEN f IS NULL THEN 'untested' WHEN coalesce(nf, 0) > 0 THEN 'recorded_candidate' ELSE 'not_recorded' END AS failed, CAST(coalesce(n, 0) AS BIGINT) AS events, coalesce(d, 0) AS duplicates FROM run_rows r LEFT JOIN m ON r.run_id = m.run_id LEFT JOIN y ON r.run_id = y.run_id LEFT JOIN z ON r.run_id = z.run_id)
    SELECT *, CASE WHEN successful = 'recorded_once' AND failed = 'not_recorded' THEN 'normal' WHEN successful = 'untested' OR failed = 'untested' THEN 'confirm' ELSE 'attention' END AS status FROM w""")  # fmt: skip
def tracking_verdict(runs, rows):
    return tracking.verdicts(runs, rows, 9_000_000, 90_000_000)


@query(("business_rows",), "SELECT id, date, attribution_key FROM (SELECT *, row_number() OVER (PARTITION BY date, attribution_key ORDER BY row_seq) AS r FROM business_rows) WHERE r = 1 OR attribution_key = ''")
def business_dedup(rows):
    return store.first_of_key(rows, ["date", "attribution_key"], "row_seq", "attribution_key").select("id", "date", "attribution_key")


@query(("business_rows",), "SELECT attribution_key, arg_max(id, row_seq) AS id, max(row_seq) AS row_seq FROM business_rows GROUP BY 1")
def latest_per_key(rows):
    return store.latest(rows, ["attribution_key"], "row_seq").select("attribution_key", "id", "row_seq")


@query(("observation_rows",), "SELECT run_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM observation_rows) WHERE r <= 20")
def retention_last_n(rows):
    return store.last_n(rows, ["run_id"], ["seq"], 20).select("run_id", "seq")


@query(("observation_rows",), "SELECT run_id, platform, min(seq) AS seq, arg_max(name, seq) AS name FROM observation_rows GROUP BY 1, 2")
def last_wins(rows):
    keyed = rows.select(F.concat_ws("|", "run_id", "platform").alias("key"), "seq", "name")
    found = store.last_wins(keyed, "key", "seq")
    return found.select(F.element_at(F.split("key", r"\|"), 1).alias("run_id"), F.element_at(F.split("key", r"\|"), 2).alias("platform"), "seq", "name")


@query(("conversation_rows",), """r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversation_rows), c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, is_context ORDER BY turn DESC) AS j FROM r WHERE k <= 4)
    SELECT conv_id, turn, role FROM c WHERE NOT is_context OR j <= 1""")  # fmt: skip
def conversation_trim(rows):
    return store.trim_conversation(rows, 4, 1).select("conv_id", "turn", "role")


@query(("conversation_rows",), "SELECT conv_id, max(turn) AS turns FROM conversation_rows GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 20")
def newest_conversations(rows):
    return store.newest_conversations(rows)
