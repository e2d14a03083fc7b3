"""Sites: duplicate and near-duplicate pages, template clusters, topics, link opportunities, inventory and issues.

Pages have origin, row_seq, url, status, title, description, content_fingerprint, near_fp, robots (array), canonical, canonical_resolved, canonical_status,
canonical_indexable, text_length, in_sitemap, page_type, template_key, language and the delivery signals; links are (origin, src, dst), hreflangs (origin, url, lang, target).
Everything is keyed by origin, so that many sites are worked on at once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.hashes import VOTES, band_keys, hamming, simhash_of_votes, simhash_votes, tokens
from lodestream.functions.numbers import pages_grade
from lodestream.functions.text import terms
from lodestream.functions.urls import first_page, template_key
from lodestream.functions.vectorized import map_words
from lodestream.operators.store import cut

NEAR = 5


def _directive(robots: Column, between: str, *names: str) -> Column:
    return F.exists(robots, lambda r: F.arrays_overlap(F.split(F.lower(r), between), F.array(*map(F.lit, names))))


def noindex(robots: Column) -> Column:
    return _directive(robots, r"[,\s]+", "noindex", "none")


def nofollow(robots: Column) -> Column:
    return _directive(robots, r"[,;\s]+", "nofollow", "none")


def duplicate_groups(pages: DataFrame, column: str) -> DataFrame:
    """Values that several pages of an origin share: n and up to 100 URLs in order. Equal values are counted before any list is built."""
    named = pages.where(F.coalesce(F.col(column), F.lit("")) != "")
    counts = named.groupBy("origin", F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    ranked = named.select("origin", F.col(column).alias("value"), "url", "row_seq").withColumn("rank", F.row_number().over(Window.partitionBy("origin", "value").orderBy("row_seq"))).where("rank <= 100")
    lists = ranked.groupBy("origin", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("urls"))
    return counts.join(lists, ["origin", "value"])


def duplicate_pages(pages: DataFrame, column: str) -> DataFrame:
    """The pages whose value another page of the origin has."""
    shared = pages.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("origin", column).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return pages.join(shared, ["origin", column], "left_semi")


def _votes(words, start):
    return np.arange(len(start)), simhash_votes(words, start)


def simhashes(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, near_fp): 32-bit SimHash of each text's words by their counts; texts without words are left out. Each row votes in its task, and a key's rows are added up: no word is shuffled."""
    votes = map_words(texts, key, tokens(F.col(text)), ", ".join(f"{v} bigint" for v in VOTES), _votes)
    return votes.groupBy(*key).agg(*(F.sum(v).alias(v) for v in VOTES)).select(*key, simhash_of_votes().alias("near_fp"))


def _near_joined(pages: DataFrame, most: int, how: str) -> DataFrame:
    """Distinct fingerprints joined to those of the origin at most ``most`` bits away. Five differences leave three of eight bands untouched, so an equi-join on
    band_keys meets every pair; a key holds a 4096th of evenly spread fingerprints."""
    if most > NEAR:
        raise ValueError(f"at most {NEAR} bits")
    distinct = pages.where("near_fp is not null").select("origin", "near_fp").distinct()
    keyed = distinct.select("origin", "near_fp", F.explode(band_keys(F.col("near_fp"))).alias("band"))
    a, b = F.col("a.near_fp"), F.col("b.near_fp")
    other = a < b if how == "inner" else a != b
    return keyed.alias("a").join(keyed.alias("b"), (F.col("a.origin") == F.col("b.origin")) & (F.col("a.band") == F.col("b.band")) & other & (hamming(a, b) <= most), how)


def near_pairs(pages: DataFrame, most: int = NEAR) -> DataFrame:
    """(origin, fp_a, fp_b, distance) of distinct fingerprints at most ``most`` bits apart; equal fingerprints are one row before it."""
    apart = hamming(F.col("a.near_fp"), F.col("b.near_fp")).cast("int").alias("distance")
    return _near_joined(pages, most, "inner").select(F.col("a.origin").alias("origin"), F.col("a.near_fp").alias("fp_a"), F.col("b.near_fp").alias("fp_b"), apart).distinct()


def near_duplicates(pages: DataFrame, most: int = NEAR) -> DataFrame:
    """Pages with another page of the origin at most ``most`` bits away. A semi-join stops at the first witness, so no pairs are made."""
    ends = _near_joined(pages, most, "left_semi").select("origin", "near_fp")
    equal = pages.where("near_fp is not null").groupBy("origin", "near_fp").agg(F.count("*").alias("n")).where("n > 1").select("origin", "near_fp")
    return pages.join(ends.union(equal).distinct(), ["origin", "near_fp"], "left_semi")


def near_groups(pages: DataFrame, most: int = NEAR) -> DataFrame:
    """Greedy star groups in row order: (origin, group_no, url). A page not yet in a group opens one with all pages near it, which may be in others.

    A fingerprint opens if no earlier one near it does. Each round opens all whose earlier neighbours are decided and covers what is near them, so rounds are as
    many as the longest run of neighbours that wait for each other, and no site meets in one task; lineage is cut between rounds.
    """
    key = ["origin", "near_fp"]
    firsts = cut(pages.where("near_fp is not null").groupBy(*key).agg(F.min("row_seq").alias("first"), F.count("*").alias("n")))
    pairs = near_pairs(pages, most).select("origin", "fp_a", "fp_b")
    both = pairs.select("origin", F.col("fp_a").alias("near_fp"), F.col("fp_b").alias("other")).union(pairs.select("origin", "fp_b", "fp_a"))
    theirs = firsts.select("origin", F.col("near_fp").alias("other"), F.col("first").alias("other_first"))
    near = cut(both.join(firsts.select(*key, "first"), key).join(theirs, ["origin", "other"]))
    waits = near.where("struct(other_first, other) < struct(first, near_fp)").select("origin", "near_fp", "other")
    open_, undecided = None, near.select(*key, "first").distinct()
    while True:
        new = cut(undecided.join(waits.select(*key).distinct(), key, "left_anti"))
        if new.isEmpty():
            break
        open_ = new if open_ is None else cut(open_.unionByName(new))
        covered = waits.join(new.select("origin", F.col("near_fp").alias("other")), ["origin", "other"], "left_semi").select(*key)
        undecided = cut(undecided.join(new.select(*key).union(covered).distinct(), key, "left_anti"))
        left = undecided.select(*key)
        waits = cut(waits.join(left, key, "left_semi").join(left.withColumnRenamed("near_fp", "other"), ["origin", "other"], "left_semi"))
    alone = firsts.where("n > 1").join(near.select(*key).distinct(), key, "left_anti").select(*key, "first")
    centres = alone if open_ is None else alone.unionByName(open_)
    number = (F.row_number().over(Window.partitionBy("origin").orderBy("first", "near_fp")) - 1).cast("long")
    centres = centres.withColumn("group_no", number).select(*key, "group_no")
    around = near.select("origin", "near_fp", "other").join(centres, key).select("origin", F.col("other").alias("near_fp"), "group_no")
    return pages.join(centres.unionByName(around), key).select("origin", "group_no", "url")


def template_clusters(pages: DataFrame) -> DataFrame:
    """Each template of an origin: pages, first ten URLs, pages by status, pages with shared titles and contents, noindex and sitemap pages."""
    keyed = pages.withColumn("key", F.coalesce(F.nullif("template_key", F.lit("")), F.lit("other:unknown")))
    group = ["origin", "key"]

    def shared(column: str, name: str) -> DataFrame:
        counts = keyed.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*group, column).agg(F.count("*").alias("n")).where("n > 1")
        return counts.groupBy(*group).agg(F.sum("n").alias(name))

    base = keyed.groupBy(*group).agg(F.count("*").alias("n_pages"), F.count_if(noindex(F.col("robots"))).alias("n_noindex"), F.count_if("in_sitemap").alias("n_sitemap"))
    by_status = keyed.groupBy(*group, F.coalesce(F.col("status").cast("string"), F.lit("null")).alias("code")).agg(F.count("*").alias("n"))
    statuses = by_status.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("statuses"))
    first = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("row_seq"))).where("rank <= 10")
    urls = first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("urls"))
    found = base.join(statuses, group).join(urls, group)
    for column, name in (("title", "n_shared_titles"), ("content_fingerprint", "n_shared_contents")):
        found = found.join(shared(column, name), group, "left").fillna(0, [name])
    return found.withColumn("label", F.element_at(F.split("key", ":"), 1))


def overlapping_templates(pages: DataFrame) -> DataFrame:
    return template_clusters(pages).where("n_pages >= 2 and n_shared_titles >= 2")


def page_terms(texts: DataFrame, key: list[str], text: str = "text", most: int = 24) -> DataFrame:
    """(key, term, n): the commonest topics of each text, ties by first place. The texts of one key count as one.

    A text that is alone with its key is counted in its task, and only its topics leave it. Words are shuffled for keys that several texts have, which are looked for first.
    """

    def topics(words, start):
        coded = words.dictionary_encode()
        width, owner = len(coded.dictionary), np.repeat(np.arange(len(start)), np.diff(np.append(start, len(words))))
        pair, first, n = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
        order = np.lexsort((first, -n, pair // width))
        row = pair[order] // width
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        order, row, rank = order[rank <= most], row[rank <= most], rank[rank <= most]
        return row, [coded.dictionary.take(pa.array(pair[order] % width)), n[order].astype(np.int64), rank.astype(np.int32)]

    alone = map_words(texts, key, terms(F.col(text)), "term string, n bigint, rank int", topics)
    repeated = cut(texts.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in key)))
    if repeated.isEmpty():
        return alone
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    words = texts.join(repeated, same, "left_semi").select(*key, F.posexplode(terms(F.col(text))).alias("place", "term")).groupBy(*key, "term").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "place"))
    together = words.withColumn("rank", rank).where(F.col("rank") <= most).select(*key, "term", "n", "rank")
    return alone.join(repeated, same, "left_anti").unionByName(together)


def term_weights(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """(origin, term, df, idf) with idf = ln((N + 1) / (df + 0.5)) over the origin's N pages."""
    sizes = pages.groupBy("origin").agg(F.count("*").alias("pages"))
    counts = topics.select("origin", "url", "term").distinct().groupBy("origin", "term").agg(F.count("*").alias("df"))
    return counts.join(sizes, "origin").select("origin", "term", "df", F.log((F.col("pages") + 1) / (F.col("df") + 0.5)).alias("idf"))


#: A term is rare while it has at most so many sources; all pairs that share a rare term are scored.
RARE = 8
#: Sources of a class that are enough for any target: itself and the source of its one link may be left out, the next stands.
ENOUGH = 3


def _shared(ours: Column, theirs: Column) -> Column:
    """Terms of ``ours`` that ``theirs`` has too: within an origin a term has one weight, so whole structs are compared."""
    return F.array_intersect(ours, theirs)


def _weight(terms_: Column, part=lambda x: x) -> Column:
    return F.aggregate(terms_, F.lit(0.0), lambda s, t: s + part(t["idf"]))


def _scored(pairs: DataFrame, shared: Column) -> DataFrame:
    return pairs.withColumn("_shared", shared).withColumns({"relevance": _weight(F.col("_shared")), "shared": F.size("_shared").cast("long")}).drop("_shared")


def _by_rare_terms(targets: DataFrame, sources: DataFrame, rare: Column) -> DataFrame:
    """All pairs that share a term of few sources, scored by all the terms that they share."""
    wanted = targets.select("origin", "dst", F.explode(F.filter("terms", lambda t: rare(t))).alias("t")).select("origin", "dst", "t.term")
    offered = sources.select("origin", "src", F.explode(F.filter("terms", lambda t: rare(t))).alias("t")).select("origin", "src", "t.term")
    pairs = wanted.join(offered, ["origin", "term"]).where("src <> dst").select("origin", "src", "dst").distinct()
    pairs = pairs.join(targets.select("origin", "dst", F.col("terms").alias("ours")), ["origin", "dst"]).join(sources.select("origin", "src", "row_seq", F.col("terms").alias("theirs")), ["origin", "src"])
    return _scored(pairs, _shared(F.col("ours"), F.col("theirs"))).select("origin", "src", "dst", "row_seq", "relevance", "shared")


def _by_classes(open_: DataFrame, sources: DataFrame) -> DataFrame:
    """The ENOUGH best sources of each class of targets, a class being all that have the same common terms: of a class of sources, the first few stand for all.

    A term is looked up only while what it and the lighter ones weigh together can still reach the heaviest one alone, which more than ENOUGH sources have.
    """
    first = F.row_number().over(Window.partitionBy("origin", "common").orderBy("row_seq", "src"))
    offered = sources.where(F.size("common") > 0).select("origin", "common", "src", "row_seq").withColumn("_n", first).where(F.col("_n") <= ENOUGH).drop("_n")
    # a class is named by one of its pages, so that pairs of classes are short rows
    classes = cut(offered.groupBy("origin", F.col("common").alias("theirs")).agg(F.min("src").alias("source_class"), F.collect_list(F.struct("src", "row_seq")).alias("members")))
    targets = cut(open_.groupBy("origin", "common").agg(F.min("dst").alias("target_class")))
    falling = F.reverse(F.array_sort(F.transform("common", lambda t: F.struct(t["idf"].alias("idf"), t["term"].alias("term")))))
    least = F.col("falling")[0]["idf"] + _weight(F.col("falling"), lambda x: F.least(x, F.lit(0.0))) - 1e-8
    rest = lambda i: _weight(F.slice(F.col("falling"), i + 1, F.size("falling")), lambda x: F.greatest(x, F.lit(0.0)))
    wanted = targets.withColumn("falling", falling)
    wanted = wanted.select("origin", "target_class", F.explode(F.filter("falling", lambda t, i: rest(i) >= least)).alias("t")).select("origin", "target_class", "t.term")
    postings = classes.select("origin", "source_class", F.explode("theirs").alias("t")).select("origin", "source_class", "t.term")
    pairs = wanted.join(postings, ["origin", "term"]).select("origin", "target_class", "source_class").distinct()
    pairs = pairs.join(targets, ["origin", "target_class"]).join(classes, ["origin", "source_class"])
    pairs = _scored(pairs, _shared(F.col("common"), F.col("theirs"))).select("origin", "target_class", "relevance", "shared", F.explode("members").alias("m")).select("origin", "target_class", "relevance", "shared", "m.*")
    rank = F.row_number().over(Window.partitionBy("origin", "target_class").orderBy(F.desc(F.round("relevance", 9)), "row_seq", "src"))
    best = pairs.withColumn("_n", rank).where(F.col("_n") <= ENOUGH).drop("_n")
    return best.join(targets, ["origin", "target_class"]).select("origin", "common", "src", "row_seq", "relevance", "shared")


def link_opportunities(pages: DataFrame, links: DataFrame, topics: DataFrame, limit: int = 20, rare: int = RARE) -> DataFrame:
    """The best source for each page with at most one link to it, by the weights of shared topics; the best of an origin first. Topics are distinct (origin, url, term), some 24 a page.

    A search of the best one alone, exact and with no term too common. Pairs that share a term of at most ``rare`` sources are scored whole. A target whose further
    terms together weigh less than its best so far is done. The others meet classes of sources that have the same common terms, of which
    the first few stand for all, so a term on every page of a site makes one row a class and not one a page. Ties go to the smaller row_seq.
    """
    topics = cut(topics.select("origin", "url", "term"))  # read three times, and dear to make
    linked = cut(links.groupBy("origin", "src", "dst").agg(F.count("*").alias("n")))
    incoming = linked.groupBy("origin", F.col("dst").alias("url")).agg(F.sum("n").alias("incoming"))
    known = pages.join(incoming, ["origin", "url"], "left").fillna(0, ["incoming"]).where("status = 200")
    wanted = (~noindex(F.col("robots")) & (F.col("incoming") <= 1)).alias("wanted")
    supply = topics.join(known.select("origin", "url"), ["origin", "url"], "left_semi").groupBy("origin", "term").agg(F.count("*").alias("supply"))
    weights = term_weights(topics, pages).join(supply, ["origin", "term"]).select("origin", "term", "idf", (F.col("supply") > rare).alias("wide"))
    profiles = topics.join(weights, ["origin", "term"]).groupBy("origin", "url").agg(F.array_sort(F.collect_list(F.struct("term", "idf", "wide"))).alias("terms"))  # some 24 a page
    profiles = cut(profiles.join(known.select("origin", "url", "row_seq", "incoming", wanted), ["origin", "url"]).withColumn("common", F.filter("terms", lambda t: t["wide"])))
    targets, sources = profiles.where("wanted").withColumnRenamed("url", "dst"), profiles.withColumnRenamed("url", "src")
    better = F.struct(F.round("relevance", 9).alias("by"), (-F.col("row_seq")).alias("then"), "src", "relevance", "shared")
    near = _by_rare_terms(targets, sources, lambda t: ~t["wide"]).where("relevance > 0").join(linked, ["origin", "src", "dst"], "left_anti")
    best = cut(near.groupBy("origin", "dst").agg(F.max(better).alias("best")))
    hope = _weight(F.col("common"), lambda x: F.greatest(x, F.lit(0.0)))
    open_ = cut(targets.join(best, ["origin", "dst"], "left").where(F.size("common") > 0).where(hope >= F.coalesce("best.by", F.lit(0.0)) - 1e-8).select("origin", "dst", "common"))
    far = open_.join(_by_classes(open_, sources), ["origin", "common"]).where("src <> dst and relevance > 0").join(linked, ["origin", "src", "dst"], "left_anti")
    found = best.unionByName(far.groupBy("origin", "dst").agg(F.max(better).alias("best"))).groupBy("origin", "dst").agg(F.max("best").alias("best"))
    top = found.select("origin", "dst", "best.*").withColumn("place", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("by"), "dst"))).where(F.col("place") <= limit)
    sizes = pages.groupBy("origin").agg(F.when(F.count("*") >= 50, "medium").otherwise("low").alias("confidence"))
    top = top.join(targets.select("origin", "dst", "incoming"), ["origin", "dst"]).join(sizes, "origin")
    return top.select("origin", "src", "dst", F.round("relevance", 3).alias("relevance"), "shared", "incoming", "confidence")


def hreflang_problems(pages: DataFrame, hreflangs: DataFrame) -> DataFrame:
    """(origin, url, problem): missing self reference, target off the origin, no link back, target that can't be indexed. ``target`` is null off the origin."""
    edges = hreflangs.select("origin", "url", F.lower("lang").alias("lang"), "target")
    own = edges.where("target = url").select("origin", "url", "lang").distinct()
    speaking = pages.where("language <> ''").select("origin", "url", F.lower("language").alias("lang"))
    no_self = speaking.join(edges.select("origin", "url").distinct(), ["origin", "url"], "left_semi").join(own, ["origin", "url", "lang"], "left_anti").select("origin", "url", F.lit("self").alias("problem"))
    off = edges.where("target is null").select("origin", "url", F.lit("target").alias("problem"))
    inside = edges.where("target is not null").join(pages.select("origin", F.col("url").alias("target"), "status", "robots"), ["origin", "target"])
    back = edges.where("target is not null").select("origin", F.col("url").alias("target"), F.col("target").alias("url")).distinct()
    no_return = inside.join(back, ["origin", "target", "url"], "left_anti").select("origin", "url", F.lit("return").alias("problem"))
    dead = inside.where(F.col("status").isNull() | (F.col("status") >= 400) | noindex(F.col("robots"))).select("origin", "url", F.lit("indexable").alias("problem"))
    return no_self.union(off).union(no_return).union(dead).distinct()


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Sitemap pages, but the root, that no page of the sample links to."""
    linked = links.join(pages.select("origin", F.col("url").alias("src")), ["origin", "src"], "left_semi").select("origin", F.col("dst").alias("url")).distinct()
    return pages.where("in_sitemap and url <> concat(origin, '/')").join(linked, ["origin", "url"], "left_anti")


def stratified(urls: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` URLs (origin, row_seq, url) of each origin, one of each template a round, templates by first place."""
    keyed = urls.withColumn("key", template_key(F.col("url")))
    rounds = keyed.withColumn("round", F.row_number().over(Window.partitionBy("origin", "key").orderBy("row_seq"))).where(F.col("round") <= limit)
    first = F.min("row_seq").over(Window.partitionBy("origin", "key"))
    place = F.row_number().over(Window.partitionBy("origin").orderBy("round", "first"))
    return rounds.withColumn("first", first).withColumn("place", place).where(F.col("place") <= limit).select("origin", "place", "url", "key")


def _issue_rows(pages: DataFrame) -> DataFrame:
    """(origin, code, url, row_seq) of the issues that a page shows by itself: one pass, an array of codes, then explode."""
    c = F.col
    none, elsewhere = noindex(c("robots")), c("canonical_resolved").isNull() | (c("canonical_resolved") != c("url"))
    bad_target = c("canonical_status").isNull() | (c("canonical_status") >= 400) | (c("canonical_indexable") == F.lit(False))
    tests = {
        "site.response": c("error").isNotNull() | (c("status") >= 400),
        "site.compression": c("compression_status") == "attention",
        "site.cache": (c("cache_status") == "attention") | ((c("cache_status") == "confirm") & (c("cache_reason") != "insufficient")),
        "site.nofollow": (c("nofollow_internal") > 0) | nofollow(c("robots")),
        "site.robots-resources": c("blocked_resources") > 0,
        "site.sitemap-noindex": c("in_sitemap") & none,
        "site.canonical": (c("canonical") != "") & elsewhere,
        "site.canonical-target": c("canonical_resolved").isNotNull() & elsewhere & bad_target,
        "site.pagination-canonical": (c("page_type") == "pagination") & (c("canonical_resolved") == first_page(c("url"))),
        "site.search-indexable": (c("page_type") == "search") & ~none,
        "site.url-expansion": c("page_type").isin("filter", "tag", "search"),
        "site.empty-content": (c("status") < 400) & (c("text_length") < 80) & (c("page_type") != "search"),
        "site.schema-semantic": c("schema_issues") > 0,
    }
    codes = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))
    return pages.select("origin", F.explode(codes).alias("code"), "url", "row_seq")


#: Priority and confidence of each issue.
ISSUES = {
    "site.response": ("P1", "high"), "site.compression": ("P2", "high"), "site.cache": ("P2", "medium"), "site.nofollow": ("P2", "medium"), "site.robots-resources": ("P2", "high"), "site.sitemap-noindex": ("P1", "high"),
    "site.canonical": ("P2", "medium"), "site.canonical-target": ("P1", "high"), "site.pagination-canonical": ("P2", "medium"), "site.search-indexable": ("P2", "medium"), "site.url-expansion": ("P2", "medium"), "site.empty-content": ("P1", "medium"),
    "site.duplicate-title": ("P2", "medium"), "site.duplicate-description": ("P2", "medium"), "site.duplicate-contentFingerprint": ("P2", "medium"), "site.near-duplicate": ("P2", "low"), "site.template-overlap": ("P2", "medium"),
    "site.schema-semantic": ("P2", "medium"), "site.hreflang-reciprocal": ("P2", "low"), "site.orphan-candidate": ("P2", "low"), "site.robots-syntax": ("P2", "high"), "site.robots-directive": ("P3", "medium"),
    "site.entry": ("P2", "high"), "site.sitemap-missing": ("P2", "medium"), "site.sitemap-invalid": ("P2", "high"), "site.sitemap-lastmod": ("P2", "high"),
}


def issues(pages: DataFrame, links: DataFrame, hreflangs: DataFrame, site: DataFrame | None = None) -> DataFrame:
    """(origin, code, priority, confidence, n, urls): every issue of every origin with its first 100 URLs.

    ``site``: one row an origin with syntax_issues, unknown_directives, sitemap_discovered, sitemap_invalid, sitemap_bad_dates, entry (see delivery.entry_convergence).
    """
    pick = lambda rows, code: rows.select("origin", F.lit(code).alias("code"), "url", "row_seq")
    seq = pages.select("origin", "url", "row_seq")
    found = _issue_rows(pages)
    for column, name in (("title", "title"), ("description", "description"), ("content_fingerprint", "contentFingerprint")):
        found = found.unionByName(pick(duplicate_pages(pages, column), f"site.duplicate-{name}"))
    found = found.unionByName(pick(near_duplicates(pages), "site.near-duplicate"))
    templates = overlapping_templates(pages).select("origin", F.explode("urls").alias("url")).join(seq, ["origin", "url"])
    found = found.unionByName(pick(templates, "site.template-overlap"))
    reciprocal = hreflang_problems(pages, hreflangs).select("origin", "url").distinct().join(seq, ["origin", "url"])
    found = found.unionByName(pick(reciprocal, "site.hreflang-reciprocal")).unionByName(pick(orphans(pages, links), "site.orphan-candidate"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("origin", "code").orderBy("row_seq", "url"))).where("rank <= 100")
    first = ranked.groupBy("origin", "code").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("first"))
    counts = found.groupBy("origin", "code").agg(F.count("*").alias("n")).where((F.col("code") != "site.url-expansion") | (F.col("n") >= 3)).join(first, ["origin", "code"])
    counts = counts.select("origin", "code", "n", F.transform("first", lambda s: s["url"]).alias("urls"), F.lit(None).cast("string").alias("raised"))
    if site is not None:
        counts = counts.unionByName(site_level_issues(site))
    rank = F.create_map(*(F.lit(x) for k, v in ISSUES.items() for x in (k, v[0])))
    sure = F.create_map(*(F.lit(x) for k, v in ISSUES.items() for x in (k, v[1])))
    return counts.select("origin", "code", F.coalesce("raised", rank[F.col("code")]).alias("priority"), sure[F.col("code")].alias("confidence"), "n", "urls")


def site_level_issues(site: DataFrame) -> DataFrame:
    c = F.col
    tests = {
        "site.robots-syntax": (c("syntax_issues") > 0, c("syntax_issues"), None), "site.robots-directive": (c("unknown_directives") > 0, c("unknown_directives"), None),
        "site.entry": (~c("entry.stable"), F.lit(1), c("entry.priority")), "site.sitemap-missing": (~c("sitemap_discovered"), F.lit(1), None),
        "site.sitemap-invalid": (c("sitemap_invalid") > 0, c("sitemap_invalid"), None), "site.sitemap-lastmod": (c("sitemap_bad_dates") > 0, c("sitemap_bad_dates"), None),
    }
    none = F.lit(None).cast("string")
    made = [F.when(t, F.struct(F.lit(k).alias("code"), n.cast("long").alias("n"), (none if p is None else p).alias("raised"))) for k, (t, n, p) in tests.items()]
    return site.select("origin", F.explode(F.array_compact(F.array(*made))).alias("i")).select("origin", "i.code", "i.n", F.array().cast("array<string>").alias("urls"), "i.raised")


def inventory(pages: DataFrame, links: DataFrame, hreflangs: DataFrame) -> DataFrame:
    """One row for each origin: counts of what its sample holds."""
    kind = lambda t: F.count_if(F.col("page_type") == t)
    base = pages.groupBy("origin").agg(
        F.count("*").alias("sampled"), F.count_if(F.col("url").contains("?")).alias("with_query"), kind("search").alias("search"), kind("tag").alias("tag"), kind("filter").alias("filter"), kind("pagination").alias("pagination"),
        F.count_if((F.col("status") < 400) & (F.col("text_length") < 80)).alias("empty"),
    )
    parts = {"orphans": orphans(pages, links), "hreflang_issues": hreflang_problems(pages, hreflangs).select("origin", "url").distinct(), "near_duplicates": near_duplicates(pages)}
    for name, rows in parts.items():
        base = base.join(rows.groupBy("origin").agg(F.count("*").alias(name)), "origin", "left").fillna(0, [name])
    return base.withColumn("confidence", pages_grade(F.col("sampled")))


def seeds(roots: DataFrame, current: DataFrame, sitemap: DataFrame, limit: int) -> DataFrame:
    """Where a bounded crawl of each origin begins: root, current page, then a stratified choice of the sitemap, stratified again to the limit. Frames are (origin, row_seq, url)."""
    listed = stratified(sitemap, max(2 * limit, 40)).select("origin", (F.col("place") + 2).cast("long").alias("row_seq"), "url")
    first = roots.select("origin", F.lit(0).cast("long").alias("row_seq"), "url").unionByName(current.select("origin", F.lit(1).cast("long").alias("row_seq"), "url"))
    every = first.unionByName(listed).groupBy("origin", "url").agg(F.min("row_seq").alias("row_seq"))
    return stratified(every, limit).select("origin", F.col("place").alias("row_seq"), "url")
