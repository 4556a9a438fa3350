"""Queries over histories: rates of sources of any size, intervals of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelode.operators import audit, history, incremental
from pagelode.plans.registry import query, read
from pagelode.plans.stream_queries import RATED, events


@query(f"WITH {RATED} SELECT event_id, source, status, n, rate FROM r")
def salvage_rate_split(spark, sf_dir):
    """The rates of a rolling day without a task for each source."""
    return audit.salvage_rates_split(events(spark, sf_dir)).select("event_id", "source", "status", "n", "rate")


_SNAPSHOTS = """s AS (SELECT DISTINCT o_orderpriority AS board, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS seen_at, o_custkey % 40 AS listing FROM orders),
t AS (SELECT board, seen_at, row_number() OVER w AS no, lead(seen_at) OVER w AS nxt FROM (SELECT DISTINCT board, seen_at FROM s) WINDOW w AS (PARTITION BY board ORDER BY seen_at)),
k AS (SELECT s.*, t.no, t.nxt, lag(t.no) OVER (PARTITION BY s.board, s.listing ORDER BY s.seen_at) AS prev FROM s JOIN t USING (board, seen_at)),
i AS (SELECT *, sum(CASE WHEN prev = no - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY board, listing ORDER BY seen_at) AS nth FROM k),
g AS (SELECT board, listing, nth, min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_max(no, seen_at) AS last_no, count(*) AS seen FROM i GROUP BY board, listing, nth),
c AS (SELECT g.*, t.seen_at AS closed_at FROM g LEFT JOIN t ON t.board = g.board AND t.no = g.last_no + 1)"""


@query(f"""WITH {_SNAPSHOTS} SELECT board, listing, CAST(nth AS INTEGER) AS nth, epoch(first_seen)::BIGINT AS first_seen, epoch(last_seen)::BIGINT AS last_seen, epoch(closed_at)::BIGINT AS closed_at, seen,
 CAST(epoch(first_seen) - lag(epoch(closed_at)) OVER (PARTITION BY board, listing ORDER BY first_seen) AS BIGINT) AS away FROM c""")
def listing_intervals(spark, sf_dir):
    """Months in which a priority has orders of a customer group, as a board's snapshots."""
    o = read(spark, sf_dir, "orders")
    snapshots = o.select(F.col("o_orderpriority").alias("board"), (F.col("o_custkey") % 40).alias("listing"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("at"))
    found = history.intervals(snapshots)
    return found.select("board", "listing", "nth", *(F.unix_seconds(c).alias(c) for c in ("first_seen", "last_seen", "closed_at")), "seen", "away")


@query("""WITH e AS (SELECT o_orderkey AS k, 'u' || (o_custkey % 50) AS url, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
s AS (SELECT url, ts, 'h' || max(k) AS content_hash FROM e WHERE k % 17 = 0 GROUP BY url, ts)
SELECT e.url, e.ts, e.k, s.ts AS prev_ts, s.content_hash AS prev_hash FROM e ASOF LEFT JOIN s ON e.url = s.url AND e.ts >= s.ts""")
def latest_scrape_split(spark, sf_dir):
    """The last scrape at or before each event, without a task for each URL's history."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("url"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    scrapes = o.where("k % 17 = 0").groupBy("url", "ts").agg(F.concat(F.lit("h"), F.max("k")).alias("content_hash"))
    return incremental.latest_before_split(o, scrapes, seconds=30 * 86_400).select("url", "ts", "k", "prev_ts", "prev_hash")
