"""Sitemaps and robots rules as tables."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions import urls
from pagelode.functions.shipping import ship_package
from pagelode.functions.text import or_null
from pagelode.functions.values import iso_time

_ENTRY = "array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"


def _tag(block: Column, name: str) -> Column:
    return or_null(F.trim(F.regexp_extract(block, rf"(?is)<{name}[^>]*>\s*(.*?)\s*</{name}>", 1)))


def sitemap_entries(xml: Column) -> Column:
    """Array of (loc, lastmod, changefreq, priority) of the url elements, else of the sitemap elements; empty for malformed XML."""
    kind = "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"
    site = kind.replace("url array", "sitemap array")
    of = lambda schema, tag: F.from_xml(xml, schema, {"rowTag": tag})
    found = F.coalesce(of(kind, "urlset")["url"], of(site, "sitemapindex")["sitemap"], F.array().cast(_ENTRY))
    cleaned = F.transform(found, lambda e: F.struct(F.trim(e["loc"]).alias("loc"), F.trim(e["lastmod"]).alias("lastmod"), e["changefreq"].alias("changefreq"), e["priority"].alias("priority")))
    return F.filter(cleaned, lambda e: F.coalesce(e["loc"] != "", F.lit(False)))


def is_index(entries: Column) -> Column:
    """Whether all entries are sitemaps without a time of their own."""
    return (F.size(entries) > 0) & F.forall(entries, lambda e: F.lower(e["loc"]).endswith(".xml") & e["lastmod"].isNull())


def job_urls(sites: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """site, loc, lastmod, lastmod_ts: for each site (netloc) the entries of the first of its well-known sitemaps that has some.

    sitemaps: url and xml. An index is followed one level down. Entries aren't made distinct."""
    parsed = sitemaps.select("url", sitemap_entries(F.col("xml")).alias("entries")).where(F.size("entries") > 0)
    rank = F.array_position(F.array(*map(F.lit, rules.SITEMAP_PATHS)), urls.path_of(F.col("url")))
    roots = parsed.withColumn("site", urls.netloc(F.col("url"))).withColumn("rank", rank).where("rank > 0").join(sites.select("site").distinct(), "site", "left_semi")
    first = roots.groupBy("site").agg(F.min_by("entries", "rank").alias("entries"))
    plain = first.where(~is_index(F.col("entries"))).select("site", F.inline("entries"))
    children = first.where(is_index(F.col("entries"))).select("site", F.explode("entries.loc").alias("url")).distinct()
    deep = children.join(parsed, "url").select("site", F.inline("entries"))
    return plain.unionByName(deep).withColumn("lastmod_ts", iso_time(F.col("lastmod")))


def allowed(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """pages (url) with robots_allowed; robots: netloc and body. Sites without rules, and other schemes, allow all.

    The rules of a site are joined to its pages, so a large site's pages stay spread; a worker parses each body once."""
    ship_package(pages.sparkSession)
    joined = pages.withColumn("netloc", urls.netloc(F.col("url"))).join(robots.select("netloc", F.col("body").alias("_body")), "netloc", "left")

    @F.pandas_udf("boolean")
    def check(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        kept: dict[str, RobotFileParser] = {}
        for body, url in parts:
            out = []
            for b, u in zip(body, url, strict=True):
                if b is None or not str(u).lower().startswith(("http://", "https://")):
                    out.append(True)
                    continue
                if b not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[b] = RobotFileParser()
                    kept[b].parse(b.splitlines())
                out.append(kept[b].can_fetch(agent, u))
            yield pd.Series(out, dtype=bool)

    return joined.withColumn("robots_allowed", check("_body", "url")).drop("_body", "netloc")
