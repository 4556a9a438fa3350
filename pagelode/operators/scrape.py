"""The outcome of a fetched page: exits in a fixed order as one CASE, and work shared by pages of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions.text import content_hash, strip_tags
from pagelode.functions import urls
from pagelode.operators.detect import UNKNOWN, browser_reason, challenge_reason, with_detection
from pagelode.operators.listings import LISTING, Parser, listings_by_provider
from pagelode.operators.validate import with_validation

#: Columns that may be missing from a fetches table, with their types.
OPTIONAL = {"status_code": "int", "content_type": "string", "error": "string", "etag": "string", "robots_allowed": "boolean", "api_content": "string", "ocr_text": "string", "rendered_html": "string", "elapsed_ms": "double"}


def fetch_ok(status: Column) -> Column:
    return F.coalesce((status >= 200) & (status < 400), F.lit(False))


def _same_base(a: Column, b: Column) -> Column:
    base = lambda u: F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), r"/+$", "")
    return base(a) == base(b)


def scrape(fetches: DataFrame, previous: DataFrame | None = None, fallback: Parser | None = None, only: list[str] | None = None) -> DataFrame:
    """One row for each fetch (url, content and the OPTIONAL columns): provider, verdict, error, fetch_ok, content_hash, changed, jobs.

    previous: url and content_hash of the last snapshot. fallback: the parser of pages without a provider of ours.
    only: the providers that may occur, where they are known.
    Exits, in order: robots, not modified, rejected page, failed fetch of a known provider, failed fetch without jobs, success."""
    rows = fetches
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    rows = with_detection(rows, "url", "content")
    # A provider's own API answers for the page where its address differs from the page's.
    redirect = c("provider").isin(rules.BYPASS_PROVIDERS) & c("api_url").isNotNull() & ~_same_base(c("api_url"), c("url")) & c("api_content").isNotNull()
    rows = with_validation(rows, "url", "content").withColumn("final_content", F.when(redirect, c("api_content")).otherwise(c("content")))
    ok = fetch_ok(c("status_code"))
    sparse = F.char_length(strip_tags(F.coalesce(c("content"), F.lit("")), " ")) < rules.SPARSE_TEXT
    rows = rows.withColumn("used_ocr", sparse & (c("provider") == UNKNOWN) & c("ocr_text").isNotNull())
    rows = rows.withColumn("_body", F.when(c("used_ocr"), c("ocr_text")).otherwise(c("final_content")))
    rows = listings_by_provider(rows, content="_body", fallback=fallback, only=only)
    if fallback is not None:
        # Pages of scripts: what a browser rendered replaces few or no jobs, if it yields any.
        again = F.when((c("provider") == UNKNOWN) & c("rendered_html").isNotNull() & (~ok | (F.trim(F.coalesce(c("content"), F.lit(""))) == "") | (F.size("jobs") < 5)), fallback(c("rendered_html"), c("url")))
        rows = rows.withColumn("jobs", F.when(F.size(again) > 0, again).otherwise(c("jobs")))
    known = c("provider") != UNKNOWN
    message = F.coalesce(c("error"), F.concat(F.lit("HTTP "), c("status_code")))
    refused = ~F.coalesce(c("robots_allowed"), F.lit(True)) & ~c("provider").isin(rules.BYPASS_PROVIDERS)
    exit_ = (
        F.when(refused, "robots").when(c("status_code") == 304, "not_modified").when(~c("is_valid"), "rejected").when(~ok & known, "fetch_failed")
        .when(~ok & (F.size("jobs") == 0), "fetch_failed").otherwise("success")
    )
    rows = rows.withColumn("exit", exit_)
    done = c("exit") == "success"
    rows = rows.withColumn("content_hash", F.when(done, content_hash(F.coalesce(c("final_content"), F.lit("")))))
    if previous is None:
        rows = rows.withColumn("_prev", F.lit(None).cast("string"))
    else:
        rows = rows.join(previous.select("url", c("content_hash").alias("_prev")), "url", "left")
    return rows.select(
        "url", "provider", "api_url", "is_valid", "reason_code", "suspect", "exit",
        F.when(c("exit") == "robots", "Blocked by robots.txt").when(c("exit") == "rejected", F.concat(F.lit("Page rejected by validator ["), c("reason_code"), F.lit("]"))).when(c("exit") == "fetch_failed", message).alias("error"),
        F.when(c("exit").isin("success", "not_modified"), True).when(c("exit") == "rejected", ok).otherwise(False).alias("fetch_ok"),
        "content_hash",
        F.when(c("exit") == "not_modified", False).when(done, c("_prev").isNull() | (c("_prev") != c("content_hash"))).alias("changed"),
        F.when(done, c("jobs")).otherwise(F.array().cast(f"array<{LISTING}>")).alias("jobs"),
    )


def with_fetch_tier(fetches: DataFrame) -> DataFrame:
    """fetches (status_code, content, and those of the attempts of the second and third tier: tier2_status, tier2_content, tier3_status,
    tier3_content, null where there was none) with fetch_tier, tier3_reason, and status_code and content of the tier that answers.

    The second tier stands in for a challenged first one if it succeeds; the third for what then still needs a browser, if it succeeds."""
    c = F.col
    second = challenge_reason(c("status_code"), c("content")).isNotNull() & fetch_ok(c("tier2_status"))
    rows = fetches.withColumn("_t2", second).withColumn("_s", F.when(second, c("tier2_status")).otherwise(c("status_code")))
    rows = rows.withColumn("_c", F.when(second, c("tier2_content")).otherwise(c("content"))).withColumn("tier3_reason", browser_reason(c("_s"), c("_c")))
    third = c("tier3_reason").isNotNull() & fetch_ok(c("tier3_status"))
    return (
        rows.withColumn("fetch_tier", F.when(third, 3).when(c("_t2"), 2).otherwise(1))
        .withColumn("status_code", F.when(third, c("tier3_status")).otherwise(c("_s"))).withColumn("content", F.when(third, c("tier3_content")).otherwise(c("_c")))
        .drop("_t2", "_s", "_c", "tier2_status", "tier2_content", "tier3_status", "tier3_content")
    )


def group_key(provider: Column, api: Column, url: Column) -> Column:
    """Pages of one provider API are one piece of work; other pages are by their URL."""
    return F.coalesce(F.concat(provider, F.lit("|"), api), F.concat(F.lit("url|"), url))


def batch_groups(inputs: DataFrame) -> DataFrame:
    """inputs (ord, url) with provider, api_url, the group's key, its representative (the first URL) and size.

    Only keys, one URL and a count of each group are shuffled; the members join back by key."""
    keyed = inputs.withColumn("provider", _by_url()).withColumn("api_url", urls.api_url(F.col("url"), F.col("provider")))
    keyed = keyed.withColumn("group_key", group_key(F.col("provider"), F.col("api_url"), F.col("url")))
    groups = keyed.groupBy("group_key").agg(F.min_by("url", "ord").alias("representative"), F.count("*").alias("members"))
    return keyed.join(groups, "group_key")


def _by_url() -> Column:
    from pagelode.operators.detect import provider_of_url

    return provider_of_url(F.col("url"))


def scrape_batch(inputs: DataFrame, fetches: DataFrame, previous: DataFrame | None = None, fallback: Parser | None = None, only: list[str] | None = None) -> DataFrame:
    """One outcome for each input row (ord, url): each group's representative is scraped, and its outcome fans out."""
    grouped = batch_groups(inputs)
    work = fetches.join(grouped.select(F.col("representative").alias("url")).distinct(), "url", "left_semi")
    found = scrape(work, previous, fallback, only).withColumnRenamed("url", "representative")
    return grouped.select("ord", "url", "group_key", "representative").join(found, "representative", "left")


def saved_fetches(grouped: DataFrame) -> DataFrame:
    """One row: URLs, groups, and fetches saved by grouping."""
    return grouped.agg(F.count("*").alias("urls"), F.countDistinct("group_key").alias("groups")).withColumn("saved", F.col("urls") - F.col("groups"))


def rate_schedule(requests: DataFrame, host: str = "host", order: str = "ord", per_second: float = 0.5) -> DataFrame:
    """requests, all arriving at once, with the second at which each may start: one by one for each host."""
    from pyspark.sql import Window

    interval = 1.0 / max(per_second, 0.01)
    return requests.withColumn("start_s", (F.row_number().over(Window.partitionBy(host).orderBy(order)) - 1) * interval)
