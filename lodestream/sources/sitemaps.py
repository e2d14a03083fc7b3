"""Sitemaps: plain or gzipped files into page and child URLs, and the walk from an index to its children over captured files."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.vectorized import vectorized
from lodestream.functions.dates import is_sitemap_date
from lodestream.functions.urls import same_origin
from lodestream.operators.store import cut

CHILDREN = 10


@vectorized("binary")
def unpack(body: pd.Series, url: pd.Series, content_type: pd.Series) -> pd.Series:
    """The body, decompressed if it says by name or type that it is gzip; a body that isn't stays as it is."""

    def of(data: bytes | None, name: str | None, kind: str | None) -> bytes | None:
        packed = (name or "").lower().split("?")[0].endswith(".gz") or "gzip" in (kind or "").lower()
        if data is None or not packed:
            return data
        try:
            return gzip.decompress(data)
        except (OSError, EOFError):
            return data

    return pd.Series([of(*x) for x in zip(body, url, content_type, strict=True)], dtype=object)


@vectorized("struct<valid:boolean,entries:array<struct<loc:string,lastmod:string>>,children:array<struct<loc:string,lastmod:string>>>")
def entries(xml: pd.Series) -> pd.DataFrame:
    """Page and child entries of a sitemap, whatever its namespaces; a broken one isn't valid and has none."""

    def of(text: str | None) -> tuple:
        try:
            root = ET.fromstring((text or "").strip())
        except ET.ParseError:
            return False, [], []
        plain = lambda e: e.tag.rpartition("}")[2]

        def listed(kind: str) -> list[dict]:
            found = [{plain(x): (x.text or "").strip() for x in e} for e in root if plain(e) == kind]
            return [{"loc": e.get("loc", ""), "lastmod": e.get("lastmod", "")} for e in found]

        valid = plain(root) in ("urlset", "sitemapindex")
        return valid, listed("url") if plain(root) == "urlset" else [], listed("sitemap") if plain(root) == "sitemapindex" else []

    return pd.DataFrame([of(x) for x in xml], columns=["valid", "entries", "children"])


def walk(files: DataFrame, roots: DataFrame, most: int = CHILDREN) -> dict[str, DataFrame]:
    """Sitemaps of each origin from ``roots(origin, url)`` over captured ``files(url, status, body, content_type)``: at most ``most`` children an origin, at any depth of indexes.

    Gives urls (origin, url) and a summary an origin: discovered, children, invalid, bad_dates, compressed. A broken child doesn't stop the rest.
    """
    read = files.where("status between 200 and 299").select("url", unpack("body", "url", "content_type").alias("plain"), F.col("body").alias("packed"))
    read = read.select("url", entries(F.col("plain").cast("string")).alias("s"), (F.col("plain") != F.col("packed")).alias("compressed"))
    from pyspark.sql import Window

    level, seen = roots.select("origin", "url").distinct(), None
    while True:  # each round takes children, of which an origin has ``most``
        found = cut(level.join(read, "url"))
        seen = found if seen is None else cut(seen.unionByName(found))
        child = found.select("origin", F.posexplode("s.children").alias("place", "c")).select("origin", "place", same_origin(F.col("c.loc"), F.col("origin")).alias("url")).where("url is not null")
        fresh = child.join(seen.select("origin", "url"), ["origin", "url"], "left_anti").groupBy("origin", "url").agg(F.min("place").alias("place"))
        used = seen.groupBy("origin").agg(F.count("*").alias("used"))
        rank = F.row_number().over(Window.partitionBy("origin").orderBy("place", "url"))
        level = fresh.withColumn("rank", rank).join(used, "origin").where(F.col("rank") + F.col("used") - 1 <= most).select("origin", "url")
        if level.isEmpty():
            break
    pages = seen.select("origin", F.explode("s.entries").alias("e")).select("origin", same_origin(F.col("e.loc"), F.col("origin")).alias("url"), "e.loc", "e.lastmod")
    listed = seen.select("origin", F.explode(F.concat("s.entries", "s.children")).alias("e")).select("origin", F.col("e.lastmod").alias("lastmod"))
    bad = listed.groupBy("origin").agg(F.count_if(~F.coalesce(is_sitemap_date(F.col("lastmod")), F.lit(False))).alias("bad_dates"))
    off = pages.groupBy("origin").agg(F.count_if(F.col("url").isNull() & (F.col("loc") != "")).alias("off_origin"))
    files_ = seen.groupBy("origin").agg(F.bool_or("s.valid").alias("discovered"), (F.count("*") - 1).alias("children"), F.count_if(~F.col("s.valid")).alias("broken"), F.count_if("compressed").alias("compressed"))
    summary = roots.select("origin").distinct().join(files_, "origin", "left").join(bad, "origin", "left").join(off, "origin", "left")
    summary = summary.select("origin", F.coalesce("discovered", F.lit(False)).alias("discovered"), F.coalesce("children", F.lit(0)).alias("children"), (F.coalesce("broken", F.lit(0)) + F.coalesce("off_origin", F.lit(0))).alias("invalid"), F.coalesce("bad_dates", F.lit(0)).alias("bad_dates"), F.coalesce("compressed", F.lit(0)).alias("compressed"))
    return {"urls": pages.where("url is not null").select("origin", "url").distinct(), "summary": summary}
