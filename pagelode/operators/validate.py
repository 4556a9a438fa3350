"""Whether a page is a careers page: a table of reasons in order, the first that holds decides."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions.shipping import ship_package
from pagelode.functions.text import strip_tags
from pagelode.functions.values import get, text

#: Graphs in JSON-LD are followed to this depth by the expression; deeper ones need json_ld_types_deep().
GRAPH_DEPTH = 3


def json_ld_bodies(html: Column) -> Column:
    """The JSON-LD values of a page (VARIANT)."""
    return F.transform(F.regexp_extract_all(html, F.lit(rules.JSON_LD), F.lit(1)), lambda x: F.try_parse_json(x))


def json_ld_types(html: Column, depth: int = GRAPH_DEPTH) -> Column:
    """The @type names of a page's JSON-LD in document order: an object's own before those of its graph."""

    def of(v: Column, left: int) -> Column:
        own = F.coalesce(get(v, "$['@type']", "array<string>"), F.array(text(get(v, "$['@type']"))))
        if not left:
            return own
        graph = get(v, "$['@graph']")
        return F.when(graph.isNull(), own).otherwise(F.concat(own, each(graph, left - 1)))

    def each(v: Column, left: int) -> Column:
        return F.flatten(F.transform(F.coalesce(get(v, "$", "array<variant>"), F.array(v)), lambda x: of(x, left)))

    return F.array_compact(F.flatten(F.transform(json_ld_bodies(html), lambda v: each(v, depth))))


def _deep(value) -> list[str]:
    if isinstance(value, list):
        return [t for x in value for t in _deep(x)]
    if not isinstance(value, dict):
        return []
    own = value.get("@type")
    names = [own] if isinstance(own, str) else [x for x in own if isinstance(x, str)] if isinstance(own, list) else []
    return names + _deep(value.get("@graph", []))


def json_ld_types_deep(html: Column) -> Column:
    """As json_ld_types(), with graphs of any depth."""
    ship_package()
    return F.pandas_udf(_types_of, "array<string>")(html)


def _types_of(html: pd.Series) -> pd.Series:
    pattern = re.compile(rules.JSON_LD)
    out = []
    for page in html:
        names: list[str] = []
        for body in pattern.findall(page or ""):
            try:
                names += _deep(json.loads(body))
            except (ValueError, RecursionError):
                continue
        out.append(names)
    return pd.Series(out, dtype=object)


def opengraph(html: Column) -> Column:
    """Map of a page's og: properties."""
    tag = r"(?i)<meta[^>]+property=[\"']og:([a-z_:]+)[\"'][^>]+content=[\"']([^\"']*)[\"']"
    keys = F.regexp_extract_all(html, F.lit(tag), F.lit(1))
    pairs = F.arrays_zip(keys.alias("key"), F.regexp_extract_all(html, F.lit(tag), F.lit(2)).alias("value"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_arrays(F.transform(first, lambda p: p["key"]), F.transform(first, lambda p: p["value"]))


def _either(html: Column, pattern: str) -> Column:
    """The first or second group of a pattern with two orders."""
    return F.coalesce(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")), F.regexp_extract(html, pattern, 2))


def with_validation(pages: DataFrame, url: str = "url", html: str = "html", provider: str = "provider") -> DataFrame:
    """pages with is_valid, confidence of the verdict, reason_code, suspect and signals.

    Only pages with more graphs than the expression follows leave the JVM, as a branch of their own."""
    deep = F.regexp_count(F.coalesce(F.col(html), F.lit("")), F.lit('"@graph"')) > GRAPH_DEPTH
    if pages.isStreaming:  # one source, read once
        return _judged(pages, F.when(deep, json_ld_types_deep(F.when(deep, F.col(html)))).otherwise(json_ld_types(F.col(html))), url, html, provider)
    plain = _judged(pages.where(~deep), json_ld_types(F.col(html)), url, html, provider)
    return plain.unionByName(_judged(pages.where(deep), json_ld_types_deep(F.col(html)), url, html, provider))


def _judged(pages: DataFrame, types: Column, url: str, html: str, provider: str) -> DataFrame:
    body = F.coalesce(F.col(html), F.lit(""))
    out = (
        pages.withColumn("_t", F.when(body.rlike("(?i)application/ld\\+json"), types).otherwise(F.array().cast("array<string>")))
        .withColumn("_og", (F.lower(_either(body, rules.OG_TYPE)) == "article") & body.rlike(rules.PUBLISHED_TIME))
        .withColumn("_no", body.rlike(rules.NOINDEX))
        .withColumn("_ca", _either(body, rules.CANONICAL).rlike(rules.CANONICAL_REJECT))
        .withColumn("_ats", F.coalesce(F.col(provider) != "unknown", F.lit(False)))
        .withColumn("_sp", F.char_length(strip_tags(body, " ")) < rules.SPARSE_TEXT)
        .withColumn("_u", F.coalesce(F.col(url).rlike(rules.URL_HINT), F.lit(False)))
        .withColumn("_h", F.left(body, F.lit(rules.TITLE_SCAN)).rlike(rules.TITLE_HINT))
    )
    c = F.col
    posting, other = F.array_contains(c("_t"), "JobPosting"), F.arrays_overlap(c("_t"), F.array(*map(F.lit, rules.NON_JOB_TYPES)))
    hint = c("_u") | c("_h")
    # condition, is_valid, confidence, reason, suspect
    table = [
        (posting, True, 0.95, "schema_job_posting", False),
        (other, False, 0.9, "schema_non_job", False),
        (c("_og"), False, 0.85, "og_article", False),
        (c("_no"), False, 0.9, "noindex_meta", False),
        (c("_ca"), False, 0.9, "canonical_non_job", False),
        (c("_ats"), True, 0.9, "ats_detected", False),
        (c("_sp") & hint, True, 0.4, "empty_page", True),
        (c("_sp"), False, 0.75, "empty_page", True),
        (c("_u") & c("_h"), True, 0.65, "url_pattern+title_match", False),
        (c("_u"), True, 0.5, "url_pattern", False),
        (c("_h"), True, 0.4, "title_match", False),
        (F.lit(True), False, 0.55, "no_signals", False),
    ]
    verdict = F.lit(None)
    for condition, valid, confidence, reason, suspect in reversed(table):
        row = F.struct(F.lit(valid).alias("is_valid"), F.lit(confidence).alias("verdict_confidence"), F.lit(reason).alias("reason_code"), F.lit(suspect).alias("suspect"))
        verdict = F.when(F.coalesce(condition, F.lit(False)), row).otherwise(verdict)
    one = lambda *parts: F.array(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    weak = F.array_compact(
        F.array(
            F.when(c("_u"), rules.URL_SIGNAL), F.when(c("_h"), rules.TITLE_SIGNAL), F.when(c("_sp"), rules.SPARSE_SIGNAL),
            F.when(~body.rlike(rules.LIST_SIGNAL), rules.NO_LIST_SIGNAL),
        )
    )
    # The signals seen up to the rule that decides.
    first = F.get(F.filter(c("_t"), lambda t: t.isin(rules.NON_JOB_TYPES)), F.lit(0))
    signals = (
        F.when(posting, one(rules.POSTING_SIGNAL)).when(other, one(rules.NON_JOB_SIGNAL, first)).when(c("_og"), one(rules.ARTICLE_SIGNAL)).when(c("_no"), one(rules.NOINDEX_SIGNAL))
        .when(c("_ca"), one(rules.CANONICAL_SIGNAL, _either(body, rules.CANONICAL))).when(c("_ats"), one(rules.ATS_SIGNAL, c(provider))).otherwise(weak)
    )
    out = out.withColumn("_v", verdict).withColumn("signals", signals)
    return out.withColumns({k: c("_v")[k] for k in ("is_valid", "verdict_confidence", "reason_code", "suspect")}).drop("_t", "_og", "_no", "_ca", "_ats", "_sp", "_u", "_h", "_v")
