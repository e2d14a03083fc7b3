"""Captured pages (page_id, url, html) into records of what their markup says: one pass of an HTML parser in each task, no network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lodestream.functions.text import alt_risk, is_language_tag
from lodestream.functions.urls import template_key
from lodestream.sources import jsonld

STRIPPED = frozenset(("script", "style", "noscript", "template"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RECORD = """page_id bigint, url string, title string, titles array<string>, description string, descriptions array<string>, robots array<string>, canonicals array<string>, canonical string, canonical_resolved string, html_lang string, viewport string,
 headings array<struct<level:int,text:string>>, h1 array<string>, text string, text_length bigint, main_count int, form_count int,
 links array<struct<href:string,raw_href:string,name:string,internal:boolean,fragment:boolean,fragment_exists:boolean,rel:array<string>,region:string>>, internal_links array<string>, nofollow_internal int, nofollow_external int,
 images array<struct<src:string,alt:string,sized:boolean,loading:string,in_link:boolean,role:string>>, videos array<struct<poster:string,fallback:boolean>>, hreflangs array<struct<lang:string,href:string>>,
 json_ld array<struct<valid:boolean,types:array<string>,issues:int>>, json_ld_issues array<string>, resources array<string>, author_present boolean, date_present boolean"""


def _plain(text: str) -> str:
    return " ".join(text.split())


class Extractor(HTMLParser):
    """Collects a page's elements; text inside stripped elements doesn't count, JSON-LD blocks are kept apart before they are stripped."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        parts = urlsplit(url)
        self.url, self.origin = url, f"{parts.scheme}://{parts.netloc}".lower()
        self.meta: dict[str, list[str]] = {}
        self.titles: list[str] = []
        self.headings: list[list] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.videos: list[dict] = []
        self.alternates: list[dict] = []
        self.canonicals: list[str] = []
        self.blocks: list[str] = []
        self.resources: list[str] = []
        self.text: list[str] = []
        self.ids: set[str] = set()
        self.lang = ""
        self.mains = self.forms = 0
        self.author = self.date = False
        self.open: list[str] = []
        self.stripped = self.anchor = self.video = None

    def resolve(self, href: str) -> str | None:
        """The link inside the page's origin without fragment, null outside."""
        try:
            parts = urlsplit(urljoin(self.url, href.strip()))
        except ValueError:
            return None
        if parts.scheme not in ("http", "https") or f"{parts.scheme}://{parts.netloc}".lower() != self.origin:
            return None
        return f"{self.origin}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")

    def region(self) -> str:
        return next((t for t in reversed(self.open) if t in ("nav", "header", "footer", "main", "aside", "article")), "body")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        rel = a.get("rel", "").lower().split()
        self.ids.update(x for x in (a.get("id"), a.get("name") if tag == "a" else None) if x)
        self.author |= "author" in rel or a.get("itemprop") == "author" or "author" in a.get("class", "").lower()
        self.date |= tag == "time" and "datetime" in a or a.get("itemprop") in ("datePublished", "dateModified")
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            self.meta.setdefault(a.get("name", "").lower(), []).append(_plain(a.get("content", "")))
        elif tag == "link":
            if "canonical" in rel:
                self.canonicals.append(a.get("href", ""))
            if "alternate" in rel and "hreflang" in a:
                self.alternates.append({"lang": a["hreflang"], "href": a.get("href", "")})
            if "stylesheet" in rel and a.get("href"):
                self.resources.append(a["href"])
        elif tag == "script":
            if a.get("src"):
                self.resources.append(a["src"])
            if a.get("type", "").strip().lower() == "application/ld+json":
                self.blocks.append("")
        elif tag == "img":
            self.images.append({"src": a.get("src", ""), "alt": a.get("alt") if "alt" in a else None, "sized": "width" in a and "height" in a, "loading": a.get("loading", ""), "in_link": self.anchor is not None, "role": a.get("role", "")})
            if a.get("src"):
                self.resources.append(a["src"])
        elif tag == "a" and "href" in a:
            href = a["href"]
            target = self.resolve(href)
            fragment = href.strip().startswith("#") and len(href.strip()) > 1
            self.anchor = {"href": target or urljoin(self.url, href) if ":" not in href[:12] or target else href, "raw_href": href, "name": a.get("aria-label", ""), "internal": target is not None, "fragment": fragment, "target": href.strip()[1:] if fragment else "", "rel": rel, "region": self.region()}
            self.links.append(self.anchor)
        elif tag == "video":
            self.video = {"poster": a.get("poster", ""), "fallback": False}
            self.videos.append(self.video)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.headings.append([int(tag[1]), ""])
        elif tag == "title" and "svg" not in self.open:
            self.titles.append("")
        self.mains += tag == "main" or a.get("role") == "main"
        self.forms += tag == "form"
        if tag not in VOID:
            self.open.append(tag)
            if tag in STRIPPED and self.stripped is None:
                self.stripped = tag
                self.ld = tag == "script" and a.get("type", "").strip().lower() == "application/ld+json"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag == self.stripped:
            self.stripped = None
        if tag == "a":
            self.anchor = None
        if tag == "video":
            self.video = None

    def handle_data(self, data: str) -> None:
        if self.stripped:
            if self.stripped == "script" and self.ld and self.blocks:
                self.blocks[-1] += data
            return
        if "title" in self.open and "svg" not in self.open:
            if self.titles:
                self.titles[-1] += data
            return
        if "head" in self.open:
            return
        self.text.append(data)
        if self.anchor is not None:
            self.anchor["name"] += data
        if self.video is not None and data.strip():
            self.video["fallback"] = True
        if self.headings and any(t == f"h{self.headings[-1][0]}" for t in self.open):
            self.headings[-1][1] += data


def extract(page_id: int | None, url: str | None, html: str | None) -> dict:
    """A page's record. Broken markup gives what was read of it."""
    e = Extractor(url or "")
    e.feed(html or "")
    e.close()
    body, titles = _plain("".join(e.text)), [_plain(t) for t in e.titles]
    title = titles[0] if titles else ""
    checked = [jsonld.parse(b, title, e.author, e.date) for b in e.blocks]
    links = [{k: v for k, v in (link | {"name": _plain(link["name"]), "fragment_exists": link["target"] in e.ids if link["fragment"] else False}).items() if k != "target"} for link in e.links]
    follow = lambda link: "nofollow" in link["rel"]
    first = lambda values: values[0] if values else ""
    outside = [link for link in links if not link["internal"] and re.match("https?:", link["href"], re.I)]
    canonical = first(e.canonicals)
    return {
        "page_id": page_id, "url": url, "title": title, "titles": titles, "description": first(e.meta.get("description", [])), "descriptions": e.meta.get("description", []), "robots": e.meta.get("robots", []) + e.meta.get("googlebot", []),
        "canonicals": e.canonicals, "canonical": canonical, "canonical_resolved": e.resolve(canonical) if canonical else None, "html_lang": e.lang, "viewport": first(e.meta.get("viewport", [])),
        "headings": [{"level": n, "text": _plain(t)} for n, t in e.headings], "h1": [_plain(t) for n, t in e.headings if n == 1 and t.strip()], "text": body, "text_length": len(body), "main_count": e.mains, "form_count": e.forms,
        "links": links, "internal_links": list(dict.fromkeys(link["href"] for link in links if link["internal"])), "nofollow_internal": sum(link["internal"] and follow(link) for link in links), "nofollow_external": sum(map(follow, outside)),
        "images": e.images, "videos": e.videos, "hreflangs": e.alternates, "json_ld": [{"valid": v, "types": n, "issues": len(i) + len(d)} for v, n, _, i, d in checked], "json_ld_issues": [c for *_, i, _ in checked for c, _ in i],
        "resources": list(dict.fromkeys(urljoin(e.url, r) for r in e.resources)), "author_present": bool(e.author), "date_present": bool(e.date),
    }


def records(pages: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """The record of each captured page, with the columns ``kept`` of its row; rows stay in their task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_parse_datatype_string(RECORD))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [extract(*row) for row in zip(*(c.to_pylist() for c in part.columns[:3]), strict=True)]
                yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_pylist(rows, schema=kind).columns, *part.columns[3:]], names=[*kind.names, *kept])

    chosen = pages.select(F.col("page_id").cast("long"), "url", "html", *kept)
    return chosen.mapInArrow(work, ", ".join([RECORD, *(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[3:])]))


def snapshots(found: DataFrame, expected: str | Column = "index", page_type: str | Column = "auto") -> DataFrame:
    """Records as rows that rules.evaluate takes. What markup alone doesn't show (answers, timings, places on the screen) is null or unknown, so its rules can't be measured."""
    from lodestream.operators.rules import SNAPSHOT

    col = lambda value: F.lit(value) if isinstance(value, str) else value
    alts = F.transform("images", lambda i: F.trim(i["alt"]))
    risk = lambda i: alt_risk(i["alt"], F.col("title"), i["in_link"], F.size(F.filter(alts, lambda t: t == F.trim(i["alt"]))))
    image = lambda i: F.struct(i["alt"].alias("alt"), i["sized"].alias("sized"), i["loading"].alias("loading"), F.lit(False).alias("in_viewport"), F.lit(0.0).alias("area"), i["in_link"].alias("in_link"), i["role"].alias("role"), risk(i).alias("alt_risk"))
    made = {
        "report_id": F.concat(F.lit("page"), F.col("page_id").cast("string")), "images": F.transform("images", image), "links": F.transform("links", lambda a: a.dropFields("region")),
        "hreflangs": F.transform("hreflangs", lambda h: F.struct(h["lang"].alias("lang"), (is_language_tag(h["lang"]) | (F.lower(h["lang"]) == "x-default")).alias("valid"))),
        "template_type": F.element_at(F.split(template_key(F.col("url")), ":"), 1), "raw_available": F.lit(False), "expected_index_state": col(expected), "page_type": col(page_type),
    }
    fields = _parse_datatype_string(SNAPSHOT).fields
    value = lambda f: made[f.name] if f.name in made else F.col(f.name) if f.name in found.columns else F.lit(None)
    return found.select(*(value(f).cast(f.dataType).alias(f.name) for f in fields))


def link_rows(found: DataFrame) -> DataFrame:
    """(origin, row_seq, src, dst) of the links inside each site."""
    origin = F.regexp_extract("url", r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    return found.select(origin.alias("origin"), F.col("url").alias("src"), F.posexplode("internal_links").alias("place", "dst"), "page_id").select("origin", F.shiftleft("page_id", 24).bitwiseOR(F.col("place").cast("long")).alias("row_seq"), "src", "dst")


def differing_fields(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """Fields in which a page as sent and as rendered differ."""
    fields = ("title", "description", "canonical", "h1", "robots", "internal_links", "json_ld")
    both = raw.select("url", *(F.col(f).alias(f"raw_{f}") for f in fields)).join(rendered.select("url", *fields), "url")
    return both.select("url", F.array_compact(F.array(*(F.when(~F.col(f"raw_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields))).alias("differ"))
