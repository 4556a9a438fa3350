"""Which provider hosts a page, and whether a fetch met a bot challenge: first-match and best-match rule chains as CASE expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions import urls
from pagelode.functions.text import let, strip_tags

UNKNOWN = "unknown"


def provider_of_url(url: Column) -> Column:
    """The provider of the first URL rule that matches."""
    out = F.lit(UNKNOWN)
    for name, pattern, _ in reversed(rules.URL_RULES):
        out = F.when(url.rlike(pattern), name).otherwise(out)
    return out


def _cores(pattern: str) -> list[list[list[str]]]:
    """Of each choice of a pattern what a match has in it, in lower case: one literal of each list."""
    out = []
    for choice in re.split(r"\|(?![^(]*\))", pattern.removeprefix("(?i)")):
        plain = re.sub(r"\\\.", "\0", choice)
        groups = [g.split("|") for g in re.findall(r"\((?:\?:)?([^)]*)\)(?![*?])", plain)]
        parts = [[x] for x in re.split(r"\[[^\]]*\][*+?]?|\([^)]*\)[*+?]?|[.*+?^$]", plain) if x]
        out.append([[x.replace("\0", ".").lower() for x in one] for one in parts + groups])
    return out


def _near(low: Column, pattern: str) -> Column:
    either = lambda found: reduce(lambda a, b: a | b, found)
    return either([reduce(lambda a, b: a & b, [either([low.contains(x) for x in one]) for one in choice]) for choice in _cores(pattern)])


def _best_dom(html: Column, value: int) -> Column:
    """A column of the best DOM rule: of the highest confidence, the earliest rule that matches.

    A rule's pattern is tried only on pages that have its literals, which are looked for in one lower-case copy of the page."""
    ranked = sorted(range(len(rules.DOM_RULES)), key=lambda i: (-rules.DOM_RULES[i][2], i))

    def best(low: Column) -> Column:
        out = F.lit(UNKNOWN if value == 0 else 0.0)
        for i in reversed(ranked):
            rule = rules.DOM_RULES[i]
            out = F.when(_near(low, rule[1]) & html.rlike(rule[1]), rule[0] if value == 0 else rule[2]).otherwise(out)
        return out

    return let(F.lower(html), best)


def provider_of_dom(html: Column) -> Column:
    return _best_dom(html, 0)


def dom_confidence(html: Column) -> Column:
    return _best_dom(html, 2)


def with_detection(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with provider, confidence, api_url and detection_method; the HTML is asked only where the URL says nothing."""
    by_url = pages.withColumn("_u", provider_of_url(F.col(url)))
    by_dom = by_url.withColumn("_d", F.when(F.col("_u") == UNKNOWN, provider_of_dom(F.coalesce(html, F.lit("")))))
    seen = F.col("_u") != UNKNOWN
    found = F.coalesce(F.col("_d"), F.lit(UNKNOWN)) != UNKNOWN
    # The rule is known by its provider, whose confidence is a fixed value: the HTML isn't matched again.
    confidence = F.lit(0.0)
    for name, _, value in rules.DOM_RULES:
        confidence = F.when(F.col("_d") == name, value).otherwise(confidence)
    return (
        by_dom.withColumn("provider", F.when(seen, F.col("_u")).otherwise(F.col("_d")))
        .withColumn("confidence", F.when(seen, rules.URL_CONFIDENCE).otherwise(confidence))
        .withColumn("api_url", F.when(seen, urls.api_url(F.col(url), F.col("_u"))))
        .withColumn("detection_method", F.when(seen, "url_pattern").when(found, "dom_signature"))
        .drop("_u", "_d")
    )


def fingerprints(spark: SparkSession) -> DataFrame:
    """The rules as a dimension table: provider, kind, pattern, confidence."""
    rows = [(p, "url", r, rules.URL_CONFIDENCE) for p, r, _ in rules.URL_RULES] + [(p, "dom", r, c) for p, r, c in rules.DOM_RULES]
    return spark.createDataFrame(rows, "provider string, kind string, pattern string, confidence double")


def challenge_reason(status: Column, body: Column) -> Column:
    """Why a fetch needs a client that passes bot checks, or null."""
    low = F.lower(F.coalesce(body, F.lit("")))
    marked = F.lit(False)
    for mark in rules.CHALLENGE_MARKS:
        marked = marked | low.contains(mark)
    return F.when(status == 403, "http_403").when(marked, "cloudflare_challenge_body")


def browser_reason(status: Column, body: Column) -> Column:
    """Why a fetch needs a browser, or null: refused, a named challenge, or hardly any text."""
    low = F.lower(F.coalesce(body, F.lit("")))
    marked = F.lit(False)
    for mark in rules.CHALLENGE_MARKS:
        marked = marked | low.contains(mark)
    sparse = F.char_length(strip_tags(F.coalesce(body, F.lit("")), " ")) < rules.SPARSE_TEXT
    return (
        F.when(status == 403, rules.BROWSER_REFUSED).when(low.contains("cloudflare") & marked, rules.BROWSER_CHALLENGE).when((status == 200) & sparse, rules.BROWSER_EMPTY)
    )


def best_candidates(candidates: DataFrame, key: str, url: str = "url", rank: str = "rank", top: int = 3) -> DataFrame:
    """Of each key's first `top` candidates the URL of the best score, where that reaches the threshold; the earliest of equals."""
    from pyspark.sql import Window

    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where(F.col("_n") <= top)
    scored = first.withColumn("score", urls.url_score(F.col(url)))
    best = scored.groupBy(key).agg(F.max_by(F.struct(F.col(url).alias("url"), "score"), F.struct("score", -F.col("_n"))).alias("b"))
    return best.select(key, "b.url", "b.score").where(F.col("score") >= rules.LEAST_URL_SCORE)
