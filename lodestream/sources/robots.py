"""robots.txt: access by longest match, sitemaps, syntax, and the resources of a page that are blocked."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from lodestream.functions.vectorized import vectorized

#: Crawlers that are looked at, and directives that are known.
CRAWLERS = ("*", "Googlebot", "Bingbot", "Baiduspider")
DIRECTIVES = frozenset("allow clean-param crawl-delay disallow host noindex request-rate sitemap user-agent visit-time".split())
KINDS = (("script", r"\.m?js$"), ("stylesheet", r"\.css$"), ("image", r"\.(?:avif|gif|jpe?g|png|svg|webp)$"))


class Policy:
    """The groups of a robots.txt. An agent has the rules of all groups that name it, else those of *; the longest matching rule holds, allow before disallow."""

    def __init__(self, text: str):
        self.groups: dict[str, list[tuple[bool, str]]] = {}
        self.sitemaps: list[str] = []
        self.syntax: list[str] = []
        self.unknown: list[str] = []
        agents: list[str] = []
        ruled = named = False
        for number, raw in enumerate(text.splitlines(), 1):
            line = re.sub(r"\s*#.*$", "", raw.removeprefix("﻿")).strip()
            if not line:
                continue
            name, colon, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if not colon or not name:
                self.syntax.append(f"{number}:format")
                continue
            if name not in DIRECTIVES and name not in self.unknown:
                self.unknown.append(name)
            if name in ("user-agent", "sitemap") and not value:
                self.syntax.append(f"{number}:{name}")
            if name == "user-agent" and value:
                agents, named, ruled = ([] if ruled else agents) + [value.lower()], True, False
                for agent in agents:
                    self.groups.setdefault(agent, [])
            elif name in ("allow", "disallow"):
                ruled = True
                if not named:
                    self.syntax.append(f"{number}:group")
                for agent in agents:
                    if value:
                        self.groups[agent].append((name == "allow", value))
            elif name == "sitemap" and value and value not in self.sitemaps:
                self.sitemaps.append(value.split()[0])

    def allowed(self, url: str, agent: str) -> bool:
        parts = urlsplit(url)
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        best = (-1, True)
        for allow, pattern in self.groups.get(agent.lower(), self.groups.get("*", [])):
            shape = "".join(".*" if ch == "*" else re.escape(ch) for ch in pattern.removesuffix("$")) + ("$" if pattern.endswith("$") else "")
            if re.match(shape, path):
                best = max(best, (len(pattern), allow))
        return best[1]


def resource_kind(url: str) -> str:
    path = urlsplit(url).path.lower()
    return next((kind for kind, pattern in KINDS if re.search(pattern, path)), "other")


SCHEMA = "struct<allowed:boolean,sitemaps:array<string>,access:map<string,boolean>,syntax:array<string>,unknown:array<string>,blocked:array<struct<url:string,kind:string,agents:array<string>>>>"


@vectorized(SCHEMA)
def robots_policy(body: pd.Series, page_url: pd.Series, agent: pd.Series, resources: pd.Series) -> pd.DataFrame:
    """What a robots.txt says of a page for an agent and for the usual crawlers, and up to 200 of its resources that are blocked."""
    known: dict[str, Policy] = {}
    rows = []
    for text, url, name, urls in zip(body, page_url, agent, resources, strict=True):
        policy = known.setdefault(text or "", Policy(text or ""))
        blocked = []
        for r in list(dict.fromkeys([] if urls is None else urls))[:200]:
            agents = [c for c in CRAWLERS if not policy.allowed(r, c)]
            if agents:
                blocked.append({"url": r, "kind": resource_kind(r), "agents": agents})
        rows.append((policy.allowed(url, name), policy.sitemaps, {c: policy.allowed(url, c) for c in CRAWLERS}, list(dict.fromkeys(policy.syntax)), policy.unknown, blocked))
    return pd.DataFrame(rows, columns=["allowed", "sitemaps", "access", "syntax", "unknown", "blocked"])


def site_policies(files, pages, agent: str = "Googlebot"):
    """What each origin's robots file (origin, status, body) says of its pages (origin, url, resources): a missing file (404) allows everything, any other failure leaves access unknown."""
    from pyspark.sql import functions as F

    readable = F.when(F.col("status") == 404, F.lit("")).when(F.col("status").between(200, 299), F.coalesce("body", F.lit("")))
    known = files.select("origin", F.col("status").alias("robots_status"), readable.alias("robots_body"))
    joined = pages.join(known, "origin", "left")
    policy = robots_policy(F.coalesce("robots_body", F.lit("")), F.col("url"), F.lit(agent), F.col("resources"))
    return joined.withColumn("robots", F.when(F.col("robots_body").isNotNull(), policy)).drop("robots_body")
