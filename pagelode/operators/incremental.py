"""What changed since the last snapshot, by hash, by sitemap time and by HTTP validators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import content_hash


def changes(pages: DataFrame, previous: DataFrame, content: str = "html") -> DataFrame:
    """url, content_hash and changed (new, or another hash than before) of each page; previous: url, content_hash."""
    now = pages.select("url", content_hash(F.coalesce(content, F.lit(""))).alias("content_hash"))
    old = previous.select("url", F.col("content_hash").alias("_prev"))
    return now.join(old, "url", "left").select("url", "content_hash", (F.col("_prev").isNull() | (F.col("_prev") != F.col("content_hash"))).alias("changed"))


def to_fetch(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Sitemap entries (url, lastmod) that are new, of unknown time, or of another time than in state."""
    old = state.select("url", F.col("lastmod").alias("_prev"))
    return entries.join(old, "url", "left").where(F.col("_prev").isNull() | F.col("lastmod").isNull() | (F.col("_prev") != F.col("lastmod"))).drop("_prev")


def next_state(entries: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a pass: seen entries take their lastmod and leave if they have none; the others stay."""
    kept = state.join(entries.select("url"), "url", "left_anti").select("url", "lastmod")
    return kept.unionByName(entries.where(F.col("lastmod").isNotNull()).select("url", "lastmod"))


def conditional(fetches: DataFrame, state: DataFrame) -> DataFrame:
    """fetches (url, etag, content; last_modified where known) with not_modified and the content to use: an unchanged etag, or without one
    an unchanged last_modified, answers from the state's content."""
    dated = "last_modified" in fetches.columns and "last_modified" in state.columns
    old = state.select("url", F.col("etag").alias("_e"), F.col("content").alias("_c"), *([F.col("last_modified").alias("_l")] if dated else []))
    same = F.col("etag").isNotNull() & F.col("etag").eqNullSafe(F.col("_e"))
    if dated:
        same = same | (F.col("etag").isNull() & F.col("last_modified").isNotNull() & F.col("last_modified").eqNullSafe(F.col("_l")))
    return fetches.join(old, "url", "left").select("url", "etag", same.alias("not_modified"), F.when(same, F.col("_c")).otherwise(F.col("content")).alias("content"))


def latest_before(events: DataFrame, scrapes: DataFrame, key: str = "url") -> DataFrame:
    """events (key, ts) with prev_ts and prev_hash of the last scrape (key, ts, content_hash) at or before each: an as-of join by one
    sort of both sides within each key."""
    from pyspark.sql import Window

    keep = [c for c in events.columns if c not in (key, "ts")]
    left = events.select(key, "ts", F.lit(1).alias("_side"), F.struct(*keep).alias("_e") if keep else F.lit(True).alias("_e"), F.lit(None).cast("struct<ts:timestamp,content_hash:string>").alias("_s"))
    right = scrapes.select(key, "ts", F.lit(0).alias("_side"), F.lit(None).alias("_e"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "content_hash").alias("_s"))
    upto = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = left.unionByName(right).withColumn("_last", F.last("_s", ignorenulls=True).over(upto)).where("_side = 1")
    return joined.select(key, "ts", *([F.col("_e")[k].alias(k) for k in keep]), F.col("_last")["ts"].alias("prev_ts"), F.col("_last")["content_hash"].alias("prev_hash"))


def latest_before_split(events: DataFrame, scrapes: DataFrame, key: str = "url", seconds: int = 86_400) -> DataFrame:
    """As latest_before(), for keys of any history: no window holds more than one key's rows of one span of time.

    Within a span the last scrape is found by one sort; where a span has none before an event, the last one of the spans before it
    stands, from a window with a row for each span."""
    from pyspark.sql import Window

    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    near = latest_before(events.withColumn("_span", at).withColumn("_key", F.struct(key, "_span")), scrapes.select(F.struct(F.col(key), at.alias("_span")).alias("_key"), "ts", "content_hash"), "_key")
    last = scrapes.groupBy(F.col(key).alias("_k"), at.alias("_s")).agg(F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), "content_hash")).alias("_l"))
    spans = last.unionByName(events.select(F.col(key).alias("_k"), at.alias("_s")).distinct(), allowMissingColumns=True).groupBy("_k", "_s").agg(F.max("_l").alias("_l"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("_k", "_s", F.last("_l", ignorenulls=True).over(earlier).alias("_c"))
    rows = near.join(carried, near[key].eqNullSafe(carried["_k"]) & near["_span"].eqNullSafe(carried["_s"]), "left")
    keep = [c for c in events.columns if c not in (key, "ts")]
    found = F.when(F.col("prev_ts").isNotNull(), F.struct(F.col("prev_ts").alias("ts"), F.col("prev_hash").alias("content_hash"))).otherwise(F.col("_c"))
    return rows.withColumn("_f", found).select(near[key], near["ts"], *keep, F.col("_f")["ts"].alias("prev_ts"), F.col("_f")["content_hash"].alias("prev_hash"))
