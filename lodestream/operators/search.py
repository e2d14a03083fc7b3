"""Search performance: totals, page matrix, click-rate baselines by position, conflicts, period comparison, opportunities.

Rows have row_seq, date, query, page, impressions, clicks, position, branded. All groupings are one hash aggregation each, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.numbers import change, ratio_or_zero, search_sample_grade
from lodestream.functions.urls import search_page

#: Positions up to which a bucket reaches, and its name; the rest is 21+.
BUCKETS = ((3, "1-3"), (10, "4-10"), (20, "11-20"))


def position_bucket(position: Column) -> Column:
    """Bucket of a mean position; null and NaN: unknown."""
    bucket = F.when(position.isNull() | F.isnan(position.cast("double")), "unknown")
    for most, name in BUCKETS:
        bucket = bucket.when(position <= most, name)
    return bucket.otherwise("21+")


def _clamped(name: str) -> Column:
    return F.sum(F.greatest(F.lit(0.0), F.col(name)))


def clamped_totals() -> list[Column]:
    """Impressions and clicks, negative ones as 0, and their click rate."""
    return [_clamped("impressions").alias("impressions"), _clamped("clicks").alias("clicks"), ratio_or_zero(_clamped("clicks"), _clamped("impressions")).alias("ctr")]


def mean_position() -> Column:
    """Mean position weighted by impressions over rows with both; null without them."""
    weighed = F.col("position").isNotNull() & (F.col("impressions") > 0)
    weight = F.sum(F.when(weighed, F.col("impressions")))
    return F.try_divide(F.sum(F.when(weighed, F.col("position") * F.col("impressions"))), weight)


def totals(rows: DataFrame) -> DataFrame:
    """One row: unclamped totals, mean position, and the brand split."""
    of = lambda name, branded: F.coalesce(F.sum(F.when(F.col("branded") == branded, F.col(name))), F.lit(0.0))
    return rows.agg(
        F.coalesce(F.sum("impressions"), F.lit(0.0)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("clicks"),
        F.coalesce(ratio_or_zero(F.sum("clicks"), F.sum("impressions")), F.lit(0.0)).alias("ctr"),
        mean_position().alias("position"),
        of("impressions", True).alias("branded_impressions"),
        of("clicks", True).alias("branded_clicks"),
        of("impressions", False).alias("other_impressions"),
        of("clicks", False).alias("other_clicks"),
    )


def page_matrix(rows: DataFrame) -> DataFrame:
    """Each page: totals, mean position, distinct queries, and whether brand clicks are at least half (a tie is)."""
    branded = F.coalesce(F.sum(F.when(F.col("branded"), F.greatest(F.lit(0.0), F.col("impressions")))), F.lit(0.0))
    other = F.coalesce(F.sum(F.when(~F.col("branded"), F.greatest(F.lit(0.0), F.col("impressions")))), F.lit(0.0))
    distinct = F.count_distinct(F.nullif(F.trim("query"), F.lit("")))
    return rows.withColumn("page", search_page(F.col("page"))).groupBy("page").agg(*clamped_totals(), mean_position().alias("position"), distinct.alias("queries"), (branded >= other).alias("mostly_branded"))


def bucket_baselines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", position_bucket(F.col("position"))).groupBy("bucket").agg(*clamped_totals())


def _conflict_pages(rows: DataFrame) -> DataFrame:
    """One row for each query and page, with its impressions."""
    return rows.where(F.trim("query") != "").withColumn("page", search_page(F.col("page"))).groupBy("query", "page").agg(_clamped("impressions").alias("impressions"))


def _conflict_counts(pages: DataFrame, limit: int | None) -> DataFrame:
    found = pages.groupBy("query").agg(F.count("*").alias("n_pages"), F.sum("impressions").alias("impressions")).where("n_pages > 1")
    return found.orderBy(F.desc("impressions"), "query").limit(limit) if limit else found


def conflicts(rows: DataFrame, limit: int | None = 20) -> DataFrame:
    """Queries with several pages, by impressions: pages are listed for the queries of the answer alone."""
    pages = _conflict_pages(rows)
    found = _conflict_counts(pages, limit)
    lists = pages.join(found.select("query"), "query", "left_semi").groupBy("query").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    listed = found.join(lists, "query").select("query", "n_pages", "impressions", "pages")
    return listed.orderBy(F.desc("impressions"), "query") if limit else listed


def query_pages(rows: DataFrame) -> DataFrame:
    """Each query and page, both non-blank: totals and the first known position by row_seq."""
    first = F.min_by("position", F.when(F.col("position").isNotNull(), F.col("row_seq")))
    kept = rows.where((F.trim("query") != "") & (F.trim("page") != ""))
    return kept.withColumn("page", search_page(F.col("page"))).groupBy("query", "page").agg(*clamped_totals(), first.alias("position"))


def _priority() -> list[Column]:
    return [F.when(F.col("position") <= 10, "P1").otherwise("P2").alias("priority"), search_sample_grade(F.col("impressions"), F.col("clicks")).alias("confidence")]


def snippet_opportunities(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Query and page pairs whose click rate is under 0.7 of their bucket's: the buckets are five rows at most, so they are broadcast."""
    baselines = bucket_baselines(rows).select("bucket", F.col("ctr").alias("bucket_ctr"))
    found = query_pages(rows).where("impressions >= 50 and position <= 20").withColumn("bucket", position_bucket(F.col("position"))).join(F.broadcast(baselines), "bucket")
    found = found.where("bucket_ctr > 0 and ctr < 0.7 * bucket_ctr").orderBy(F.desc("impressions"), "query", "page").limit(limit)
    return found.select("query", "page", "impressions", "clicks", "ctr", "position", "bucket", "bucket_ctr", *_priority())


def near_wins(rows: DataFrame, limit: int = 10) -> DataFrame:
    found = query_pages(rows).where("impressions >= 50 and position between 4 and 20").orderBy(F.desc("impressions"), "query", "page").limit(limit)
    return found.select("query", "page", "impressions", "clicks", "ctr", "position", *_priority())


def conflict_opportunities(rows: DataFrame, limit: int = 10) -> DataFrame:
    found = _conflict_counts(_conflict_pages(rows), limit)
    return found.select("query", "n_pages", "impressions", F.when(F.col("impressions") >= 1000, "P1").otherwise("P2").alias("priority"), F.when(F.col("n_pages") > 2, "medium").otherwise("low").alias("confidence"))


def strict_periods(rows: DataFrame, as_of: str) -> DataFrame:
    """Two equal halves of all days compared, in all and by brand: one row each, none unless every row has a day, the days are at least four, even in
    number, without a gap, and end two days before ``as_of`` at the latest."""
    days = rows.agg(F.count_if(F.col("date").isNull()).alias("undated"), F.count_distinct("date").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    gate = days.where((F.col("undated") == 0) & (F.col("n") >= 4) & (F.col("n") % 2 == 0) & (F.datediff("last", "first") + 1 == F.col("n")) & (F.col("last") <= F.date_sub(F.to_date(F.lit(as_of)), 2)))
    gate = gate.select("first", "last", (F.col("n") / 2).cast("int").alias("days"))
    # the gate is one row or none; the rows are summed by half before they meet
    daily = rows.groupBy("date", "branded").agg(_clamped("impressions").alias("impressions"), _clamped("clicks").alias("clicks"))
    halves = daily.join(F.broadcast(gate)).withColumn("current", F.datediff("date", "first") >= F.col("days"))
    segments = halves.withColumn("segment", F.explode(F.array(F.lit("all"), F.when(F.col("branded"), "branded").otherwise("other"))))
    of = lambda name, current: F.coalesce(F.sum(F.when(F.col("current") == current, F.col(name))), F.lit(0.0))
    found = segments.groupBy("segment", "days", "first", "last").agg(*(of(n, c).alias(f"{'current' if c else 'previous'}_{n}") for n in ("impressions", "clicks") for c in (True, False)))
    return found.select(
        "segment", "days", F.col("first").alias("previous_start"), F.col("last").alias("current_end"), "current_impressions", "previous_impressions", "current_clicks", "previous_clicks",
        change(F.col("current_clicks"), F.col("previous_clicks")).alias("click_change"), change(F.col("current_impressions"), F.col("previous_impressions")).alias("impression_change"),
    )


def decline_opportunity(rows: DataFrame, as_of: str, pages: int = 10) -> DataFrame:
    """The pages to look at first if clicks fell by over a fifth: those with most impressions among pages with clicks."""
    fell = strict_periods(rows, as_of).where("segment = 'all' and click_change < -0.2").select("click_change")
    top = page_matrix(rows).where("clicks > 0").orderBy(F.desc("impressions"), "page").limit(pages)
    return top.select("page", "impressions", "clicks").join(F.broadcast(fell))


def lenient_periods(rows: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """One row: sums over the last half of the distinct days and the half before (an odd oldest day is dropped). Days are ranked, not rows."""
    daily = rows.where("date is not null").groupBy("date").agg(*(F.sum(m).alias(m) for m in measures), F.count("*").alias("rows"))
    count = daily.agg(F.floor(F.count("*") / 2).cast("int").alias("k"))
    ranked = daily.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("date")))).join(F.broadcast(count))
    half = F.when(F.col("rank") <= F.col("k"), "current").when(F.col("rank") <= 2 * F.col("k"), "previous")
    of = lambda m, h: F.coalesce(F.sum(F.when(F.col("half") == h, F.col(m))), F.lit(0.0)).alias(f"{h}_{m}")
    sums = [of(m, h) for m in measures for h in ("current", "previous")]
    dates = [f(F.when(F.col("half") == h, F.col("date"))).alias(f"{h}_{n}") for h in ("current", "previous") for f, n in ((F.min, "start"), (F.max, "end"))]
    return ranked.withColumn("half", half).agg(*sums, *dates)


def opportunities(rows: DataFrame, as_of: str) -> DataFrame:
    """All kinds of opportunity in one table: kind, query, page, impressions, priority, confidence."""
    null = F.lit(None).cast("string")
    pick = lambda df, kind, query, page: df.select(F.lit(kind).alias("kind"), query.alias("query"), page.alias("page"), "impressions", "priority", "confidence")
    fell = strict_periods(rows, as_of).where("segment = 'all' and click_change < -0.2")
    grade = search_sample_grade(F.col("current_impressions"), F.col("current_clicks"))
    decline = fell.select(F.lit("content").alias("kind"), null.alias("query"), null.alias("page"), F.col("current_impressions").alias("impressions"), F.lit("P1").alias("priority"), grade.alias("confidence"))
    found = pick(snippet_opportunities(rows), "snippet", F.col("query"), F.col("page")).unionByName(pick(near_wins(rows), "near_win", F.col("query"), F.col("page")))
    return found.unionByName(pick(conflict_opportunities(rows), "cannibalization", F.col("query"), null)).unionByName(decline)
