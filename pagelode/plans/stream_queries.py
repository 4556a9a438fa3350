"""Queries that run as streams over the tables, which are replayed in pieces, with the SQL that says the same of a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelode.operators import detect, validate
from pagelode.plans.registry import query, read
from pagelode.streaming import rates, replay, sinks, url_state

_EVENTS = """e AS (SELECT event_id, 's' || (user_id % 20) AS source, 'm' AS model, CAST(ts AS TIMESTAMP) AS ts,
 CASE event_type WHEN 'error' THEN 'salvaged' WHEN 'signup' THEN 'truncated' WHEN 'view' THEN 'failed' ELSE 'clean' END AS status FROM events)"""
RATED = f"""{_EVENTS}, r AS (SELECT event_id, source, status, count(*) OVER w AS n, avg(CASE WHEN status = 'salvaged' THEN 1.0 ELSE 0.0 END) OVER w AS rate FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM e)
 WINDOW w AS (PARTITION BY source, model ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))"""


def events(spark, sf_dir):
    """The parse events that the batch queries take."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "salvaged").when(F.col("event_type") == "signup", "truncated").when(F.col("event_type") == "view", "failed").otherwise("clean")
    return e.select("event_id", F.concat(F.lit("s"), F.col("user_id") % 20).alias("source"), F.lit("m").alias("model"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


def _answered(spark, sf_dir, build):
    """A stream over these events, closed by one a month later."""
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ts").alias("ts")).first()["ts"]
    return replay.answered(rows, "ts", build, {"event_id": F.lit(-1), "source": F.lit(""), "ts": F.lit(last) + F.expr("INTERVAL 30 DAYS")})


@query(f"WITH {RATED} SELECT event_id, source, status, n, rate FROM r")
def salvage_rate_stream(spark, sf_dir):
    """The salvage rate of a rolling day, event by event, from keyed state with timers."""
    return _answered(spark, sf_dir, rates.salvage_rate_stream).select("event_id", "source", "status", "n", "rate")


@query(f"WITH {RATED} SELECT event_id, source, n, rate FROM r WHERE status = 'salvaged' AND rate > 0.1")
def salvage_alert_stream(spark, sf_dir):
    return _answered(spark, sf_dir, lambda s: rates.alert_stream(rates.salvage_rate_stream(s))).select("event_id", "source", "n", "rate")


_DAY = 86_400_000_000
_FETCHES = """f AS (SELECT 'https://shop.example/' || o_custkey AS url, CAST(o_orderdate AS TIMESTAMP) + to_microseconds(o_orderkey) AS ts, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS etag,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS last_modified, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS lastmod, o_orderstatus || o_orderkey % 2 AS content FROM orders)"""


def _fetches(spark, sf_dir):
    """Orders as fetches of a page of their customer: priorities and statuses are its validators and times."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("https://shop.example/"), "o_custkey").alias("url"), F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k).alias("ts"),
        F.when(k % 3 > 0, F.col("o_orderpriority")).alias("etag"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("last_modified"),
        F.when(k % 4 > 0, F.col("o_orderstatus")).alias("lastmod"), F.concat("o_orderstatus", (k % 2).cast("string")).alias("content"),
    )


#: What each variable of a URL counts for in these queries.
LIVES = url_state.Lifetimes(content=400 * 86_400, validators=200 * 86_400, lastmod=300 * 86_400)

_RESULTS = f"""WITH {_FETCHES}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lag(etag) OVER w AS e, lag(last_modified) OVER w AS m, lag(lastmod) OVER w AS s FROM f WINDOW w AS (PARTITION BY url ORDER BY ts)),
h AS (SELECT *, coalesce(gap <= 200 * {_DAY}, false) AND coalesce(CASE WHEN etag IS NOT NULL THEN etag = e ELSE last_modified = m END, false) AS not_modified FROM g),
b AS (SELECT *, last_value(CASE WHEN NOT not_modified THEN content END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS body FROM h),
p AS (SELECT *, lag(body) OVER (PARTITION BY url ORDER BY ts) AS before FROM b)
SELECT url, ts, sha256(body) AS content_hash, body AS content, NOT coalesce(gap <= 400 * {_DAY} AND before = body, false) AS changed, not_modified,
 lastmod IS NULL OR NOT coalesce(gap <= 300 * {_DAY} AND s = lastmod, false) AS to_fetch, false AS stale FROM p"""


@query(_RESULTS.replace("SELECT url, ts, ", "SELECT url, CAST(epoch_us(ts) AS BIGINT) AS us, "))
def url_history(spark, sf_dir):
    """What is known of each URL at each fetch, over a whole table."""
    return url_state.history(_fetches(spark, sf_dir), LIVES).select("url", F.unix_micros("ts").alias("us"), "content_hash", "content", "changed", "not_modified", "to_fetch", "stale")


@query(_RESULTS.replace("SELECT url, ts, ", "SELECT url, CAST(epoch_us(ts) AS BIGINT) AS us, "))
def url_result_stream(spark, sf_dir):
    """The same from keyed state: fetches are answered from what the state holds of their URL."""
    found = replay.answered(_fetches(spark, sf_dir), "ts", lambda s: url_state.result_stream(s, LIVES))
    return found.select("url", F.unix_micros("ts").alias("us"), "content_hash", "content", "changed", "not_modified", "to_fetch", "stale")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'result' ELSE 'reject' END AS kind, CASE page_id % 3 WHEN 0 THEN 'schema_job_posting' WHEN 1 THEN 'noindex_meta' ELSE 'schema_non_job' END AS reason_code FROM pages""")
def audited_results(spark, sf_dir):
    """Validated pages as a stream into one sink of results and rejects, each batch in one commit."""
    k = F.col("page_id") % 3
    sign = F.when(k == 0, '<script type="application/ld+json">{"@type":"JobPosting"}</script>').when(k == 1, '<meta name="robots" content="noindex">').otherwise('<script type="application/ld+json">{"@type":"Article"}</script>')
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.concat(sign, "html").alias("html"), F.timestamp_seconds("page_id").alias("ts"))

    def judged(rows):
        return validate.with_validation(detect.with_detection(rows)).select("page_id", "is_valid", "reason_code")

    folder = f"{replay.shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    replay.replayed(pages, "ts", lambda s: sinks.audited(judged(s), folder), f"{folder}/checkpoint")
    whole = [sinks.read_audited(spark, folder, judged(pages).schema, results).select("page_id", F.lit(kind).alias("kind"), "reason_code") for results, kind in ((True, "result"), (False, "reject"))]
    return whole[0].union(whole[1])
