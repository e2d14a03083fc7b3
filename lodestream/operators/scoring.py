"""Scores of findings, filters and lanes, grouping by root cause, recommendations and tasks. Findings are rows of rules.evaluate, keyed by report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.numbers import half_up
from lodestream.operators.rules import WEIGHTS

UNMEASURED = ("informational", "not_measurable", "not_applicable")
#: Orders of priority, confidence and effort.
ORDERS = {"priority": ("P0", "P1", "P2", "P3"), "confidence": ("high", "medium", "low"), "effort": ("low", "mid", "high")}


def ordinal(name: str, column: str | None = None) -> Column:
    values = ORDERS[name]
    found = F.when(F.col(column or name) == values[0], 0)
    for i, v in enumerate(values[1:], 1):
        found = found.when(F.col(column or name) == v, i)
    return found.otherwise(9)


def _measured() -> Column:
    return (F.col("points") > 0) & F.col("included") & ~F.col("status").isin(*UNMEASURED)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(100 * part / whole).cast("int"))


def label(score: Column, coverage: Column) -> Column:
    return F.when((coverage < 60) | score.isNull(), "insufficient").when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "improvable").otherwise("risk")


def overall(findings: DataFrame) -> DataFrame:
    """Score, coverage and counts of each report: one aggregation."""
    scored, measured = (F.col("points") > 0) & F.col("included"), _measured()
    sums = findings.groupBy("report_id").agg(
        F.sum(F.when(measured, F.col("points") * F.coalesce("score_ratio", F.lit(0.0)))).alias("earned"), F.sum(F.when(measured, F.col("points"))).alias("possible"),
        F.min(F.when(measured & (F.col("status") == "failure") & (F.col("confidence") == "high"), F.col("score_cap"))).alias("cap"),
        F.count_if(measured).alias("measured"), F.count_if(scored & (F.col("status") != "not_applicable")).alias("measurable"),
    )
    raw = _percent(F.col("earned"), F.col("possible"))
    score = F.when(raw.isNotNull(), F.least(raw, F.col("cap")))
    coverage = F.coalesce(_percent(F.col("measured"), F.col("measurable")), F.lit(0))
    return sums.select("report_id", score.alias("score"), coverage.alias("coverage"), "measured", "measurable", label(score, coverage).alias("label"))


def by_category(findings: DataFrame) -> DataFrame:
    """Score of each category of each report without caps, and its issues; categories without findings have none."""
    measured = _measured()
    sums = findings.groupBy("report_id", "category").agg(
        F.coalesce(F.sum(F.when(measured, F.col("points") * F.coalesce("score_ratio", F.lit(0.0)))), F.lit(0.0)).alias("earned"), F.coalesce(F.sum(F.when(measured, F.col("points"))), F.lit(0.0)).alias("applicable"),
        F.count_if(F.col("status").isin("failure", "warning")).alias("issues"),
    )
    return sums.select("report_id", "category", _percent(F.col("earned"), F.col("applicable")).alias("score"), "earned", "applicable", "issues")


def details(findings: DataFrame) -> DataFrame:
    """Earned, possible and deducted points of each report to a tenth, and the caps of all its findings."""
    tenth = lambda v: half_up(v * 10) / 10
    counts = (F.col("points") > 0) & F.col("included") & F.col("score_ratio").isNotNull()
    earned = tenth(F.col("points") * F.col("score_ratio"))
    sums = findings.groupBy("report_id").agg(
        F.coalesce(F.sum(F.when(counts, earned)), F.lit(0.0)).alias("e"), F.coalesce(F.sum(F.when(counts, F.col("points"))), F.lit(0.0)).alias("p"),
        F.array_sort(F.collect_list(F.when((F.col("status") == "failure") & (F.col("confidence") == "high"), F.col("score_cap")))).alias("caps"), F.count_if(counts & (F.col("points") > earned)).alias("n_deducted"),
    )
    e, p = tenth(F.col("e")), tenth(F.col("p"))
    return sums.select("report_id", e.alias("earned"), p.alias("possible"), tenth(p - e).alias("deducted"), _percent(e, p).alias("normalized"), "n_deducted", "caps")


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status").isin("failure", "warning"))


def filter_findings(findings: DataFrame, priority: str = "all", category: str = "all", status: str = "all") -> DataFrame:
    found = actionable(findings) if status == "actionable" else findings if status == "all" else findings.where(F.col("status") == status)
    found = found if priority == "all" else found.where(F.col("priority") == priority)
    return found if category == "all" else found.where(F.col("category") == category)


def category_counts(findings: DataFrame, priority: str = "all", status: str = "actionable") -> DataFrame:
    """Findings of each category and in all, for each report, zeros included."""
    rows = filter_findings(findings, priority, "all", status)
    names = F.explode(F.array(*map(F.lit, ("all", *WEIGHTS)))).alias("category")
    every = findings.select("report_id").distinct().select("report_id", names)
    counts = rows.select("report_id", F.explode(F.array(F.lit("all"), F.col("category"))).alias("category")).groupBy("report_id", "category").agg(F.count("*").alias("n"))
    return every.join(counts, ["report_id", "category"], "left").fillna(0, ["n"])


def lane() -> Column:
    """Which part of the plan a finding belongs to."""
    p = F.col("priority")
    return F.when(p.isin("P0", "P1"), "urgent").when((p == "P2") & (F.col("effort") == "low"), "quick_wins").when(p == "P2", "planned").otherwise("watch")


def finding_order() -> list[Column]:
    """Priority, confidence, failures first, most URLs, most points, least effort; the rule's name last."""
    return [ordinal("priority"), ordinal("confidence"), F.when(F.col("status") == "failure", 0).otherwise(1), F.desc(F.size("urls")), F.desc("points"), ordinal("effort"), F.asc("rule_id")]


def recommendation_order() -> list[Column]:
    return [ordinal("priority"), ordinal("confidence"), F.desc(F.size("urls")), ordinal("effort"), F.asc("root_cause")]


def _rank_key() -> Column:
    """finding_order as one comparable value: the least is first."""
    return F.struct(ordinal("priority"), ordinal("confidence"), F.when(F.col("status") == "failure", 0).otherwise(1), -F.size("urls"), -F.col("points"), ordinal("effort"), F.col("rule_id"))


def root_causes(findings: DataFrame) -> DataFrame:
    """Actionable findings of each report by root cause: the first by finding_order stands for them; their URLs are joined. A hash aggregation, no window."""
    first = F.min_by(F.struct("rule_id", "category", "priority", "confidence", "effort"), _rank_key())
    grouped = actionable(findings).groupBy("report_id", "root_cause").agg(first.alias("first"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return grouped.select("report_id", "root_cause", "first.*", "n", "urls", "rules")


#: What a category of findings is to a recommendation.
RECOMMENDATION = {"discoverability": "access_indexing", "metadata": "content_intent", "content": "content_intent", "performance": "performance_resources", "links": "links_media_schema", "media": "links_media_schema"}
#: Where a rule is changed; the first pattern that fits.
LAYERS = (("transport|compression|cache", "web_server"), ("response", "routing"), ("robots", "web_server"), ("raw-render|crawler-access", "server_rendering"), ("visible-content|entity-signals|query-alignment", "page_content"),
          ("metadata|canonical|h1|language|json-ld|image|links|nofollow|resources|viewport|performance", "html_template"))


def _case(column: Column, pairs, otherwise: str) -> Column:
    found = None
    for test, value in pairs:
        found = F.when(test(column), value) if found is None else found.when(test(column), value)
    return found.otherwise(otherwise)


def layer(rule_id: Column) -> Column:
    return _case(rule_id, [((lambda col, p=p: col.rlike(p)), v) for p, v in LAYERS], "html_template")


def recommendations(findings: DataFrame) -> DataFrame:
    """One recommendation for each root cause, with its category and the layer to change. Order by recommendation_order()."""
    category = _case(F.col("category"), [((lambda col, k=k: col == k), v) for k, v in RECOMMENDATION.items()], "links_media_schema")
    return root_causes(findings).withColumns({"recommendation": category, "layer": layer(F.col("rule_id"))})


def tasks(findings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A task for each root cause; the ids, states and times of existing ones (report_id, root_cause, id, state, created_at) stay."""
    found = root_causes(findings).withColumn("title_suffix", F.when(F.col("n") > 1, F.col("n")))
    if existing is None:
        return found.withColumns({"id": F.sha2(F.concat_ws(":", "report_id", "root_cause"), 256), "state": F.lit("todo")})
    old = existing.select("report_id", "root_cause", F.col("id").alias("old_id"), F.col("state").alias("old_state"), "created_at")
    merged = found.join(old, ["report_id", "root_cause"], "left")
    return merged.withColumns({"id": F.coalesce("old_id", F.sha2(F.concat_ws(":", "report_id", "root_cause"), 256)), "state": F.coalesce("old_state", F.lit("todo"))}).drop("old_id", "old_state")


def baseline(findings: DataFrame) -> DataFrame:
    """The state of every rule of a report as one map."""
    entry = F.struct("rule_id", F.struct("status", "priority").alias("state"))
    return findings.groupBy("report_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("states"))


def baseline_statuses(findings: DataFrame) -> DataFrame:
    return findings.groupBy("report_id", "status").agg(F.count("*").alias("n"))


def baseline_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, rule_id, change): rules that were fixed, are new or changed between two sets of (key, rule_id, status). A rule that is gone or no longer applies counts as fixed."""
    b, a = before.select("key", "rule_id", F.col("status").alias("before")), after.select("key", "rule_id", F.col("status").alias("after"))
    both = b.join(a, ["key", "rule_id"], "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "fixed").when(F.col("before") == F.col("after"), F.lit(None)).when(F.col("after").isin("pass", "not_applicable"), "fixed").otherwise("changed")
    return both.withColumn("change", change).where("change is not null").select("key", "rule_id", "before", "after", "change")


def signal_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, signal, before, after) of page signals that differ, nulls included."""
    b, a = before.select("key", "signal", F.col("value").alias("before")), after.select("key", "signal", F.col("value").alias("after"))
    return b.join(a, ["key", "signal"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def resource_summary(resources: DataFrame) -> DataFrame:
    """Resources of each page (page, url, kind, blocking, inline, third_party, transfer_size) counted; sizes that aren't positive are unmeasured."""
    kind = lambda k: F.count_if((F.col("kind") == k) & F.col("blocking"))
    named = resources.where("not inline and url <> ''").groupBy("page", "url").agg(F.count("*").alias("n")).where("n > 1").groupBy("page").agg(F.count("*").alias("duplicate_urls"))
    sums = resources.groupBy("page").agg(
        F.count("*").alias("resources"), kind("script").alias("blocking_scripts"), kind("stylesheet").alias("blocking_stylesheets"), F.count_if("third_party").alias("third_party"),
        F.sum(F.when(F.col("transfer_size") > 0, F.col("transfer_size"))).alias("transfer_size"), F.count_if(~F.coalesce(F.col("transfer_size") > 0, F.lit(False)) & ~F.col("inline")).alias("unmeasured"),
    )
    risk = F.col("blocking_scripts") + F.col("duplicate_urls") + F.greatest(F.lit(0), F.col("blocking_stylesheets") - 4)
    return sums.join(named, "page", "left").fillna(0, ["duplicate_urls"]).withColumn("risk", risk)


def link_rels(links: Column, robots: Column) -> Column:
    """struct of a page's links by rel, without a shuffle."""
    from lodestream.operators.site import nofollow

    n = lambda test: F.size(F.filter(links, test))
    has = lambda a, r: F.array_contains(a["rel"], r)
    return F.struct(F.size(links).alias("total"), n(lambda a: a["internal"] & has(a, "nofollow")).alias("internal_nofollow"), n(lambda a: ~a["internal"] & has(a, "nofollow")).alias("external_nofollow"), n(lambda a: has(a, "ugc")).alias("ugc"), n(lambda a: has(a, "sponsored")).alias("sponsored"), nofollow(robots).alias("page_nofollow"))


def web_vitals(entries: DataFrame) -> DataFrame:
    """Vitals of each page from its performance entries (page, seq, kind, start, value, recent_input): last paint of the largest, shifts without input, slowest interaction, first paint, time to first byte."""
    of = lambda k: F.col("kind") == k
    return entries.groupBy("page").agg(
        F.max_by(F.when(of("largest"), F.col("start")), F.when(of("largest"), F.col("seq"))).alias("lcp"), F.sum(F.when(of("shift") & ~F.col("recent_input"), F.col("value"))).alias("cls"),
        F.max(F.when(of("interaction"), F.col("value"))).alias("inp"), F.min(F.when(of("paint"), F.col("start"))).alias("fcp"), F.max(F.when(of("navigation"), F.greatest(F.lit(0.0), F.col("value")))).alias("ttfb"),
    )


def resources_with_timings(resources: DataFrame, timings: DataFrame, most: int = 150) -> DataFrame:
    """Resources of each page with what was measured of their URL, then the measured URLs that no element names: ``most`` a page. Of several measurements the shortest counts, then the smallest."""
    from pyspark.sql import Window

    measured = timings.groupBy("page", "url").agg(F.min(F.struct("duration", "transfer_size")).alias("m")).select("page", "url", "m.duration", "m.transfer_size")
    named = resources.select("page", "url", "kind", "row_seq").join(measured, ["page", "url"], "left")
    bare = measured.join(resources.select("page", "url").distinct(), ["page", "url"], "left_anti").select("page", "url", F.lit("other").alias("kind"), F.lit(1 << 40).alias("row_seq"), "duration", "transfer_size")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("row_seq", "url"))
    return named.unionByName(bare).withColumn("place", rank).where(F.col("place") <= most)


def alt_risks(images: DataFrame) -> DataFrame:
    """Images of each page by what is wrong with their text."""
    return images.where("alt_risk is not null").groupBy("page", "alt_risk").agg(F.count("*").alias("n"))


#: What a repair of each category shows at once, may do for search, and doesn't promise.
EFFECTS = {
    "discoverability": ("the page answers and may be indexed", "it can be crawled and indexed", "indexing isn't certain"), "metadata": ("title and description say what the page is", "results may be shown better", "search may write its own"),
    "content": ("structure and language are clear", "the page is understood better", "rank isn't certain"), "links": ("links lead where they say", "crawlers find more pages", "rank isn't certain"),
    "media": ("media and data are readable", "rich results become possible", "they aren't certain"), "performance": ("the page is there sooner", "field data may improve", "one visit isn't field data"),
}
#: Code that shows the form of a repair, for rules that have one.
SNIPPETS = {
    "metadata.title": "<title>{{CORE_TOPIC}} - {{BRAND}}</title>", "metadata.description": '<meta name="description" content="{{PAGE_TASK}}">', "discoverability.canonical": '<link rel="canonical" href="{{PAGE_URL}}">',
    "content.language": '<html lang="{{BCP47_LANGUAGE}}">', "performance.viewport": '<meta name="viewport" content="width=device-width, initial-scale=1">', "media.loading-priority": '<img src="{{HERO_IMAGE}}" fetchpriority="high">',
}


def with_effects(found: DataFrame) -> DataFrame:
    """Recommendations with effects by category and code by rule: broadcast joins with tables of fixed size."""
    spark = found.sparkSession
    effects = spark.createDataFrame([(k, *v) for k, v in EFFECTS.items()], "category string, direct string, search string, limits string")
    snippets = spark.createDataFrame(list(SNIPPETS.items()), "rule_id string, code string")
    return found.join(F.broadcast(effects), "category", "left").join(F.broadcast(snippets), "rule_id", "left")


def filter_recommendations(found: DataFrame, category: str = "all") -> DataFrame:
    return found if category == "all" else found.where(F.col("recommendation") == category)
