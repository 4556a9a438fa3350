"""The stateful parts as streams: change by URL, salvage rate by window, caches with a lifetime."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelode.functions.shipping import ship_package
from pagelode.functions.text import content_hash


def change_stream(pages: DataFrame, content: str = "html") -> DataFrame:
    """A stream of pages as url, content_hash, changed: against the last hash of each URL, which is all the state there is."""
    ship_package(pages.sparkSession)
    hashed = pages.select("url", content_hash(F.coalesce(content, F.lit(""))).alias("content_hash"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            flags = []
            for h in part["content_hash"]:
                flags.append(last is None or h != last)
                last = h
            yield pd.DataFrame({"url": key[0], "content_hash": part["content_hash"].to_numpy(), "changed": flags})
        state.update((last,))

    return hashed.groupBy("url").applyInPandasWithState(update, "url string, content_hash string, changed boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def salvage_stream(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A stream of (source, model, ts, status) as salvaged share by sliding window; events later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rate = F.avg((F.col("status") == "salvaged").cast("double"))
    return timed.groupBy(F.window("ts", width, slide), "source", "model").agg(F.count("*").alias("n"), rate.alias("rate"))


def first_in_lifetime(events: DataFrame, key: str, lifetime: int = 3600, late: str = "1 hour") -> DataFrame:
    """Of a stream of (key, ts) those events that a cache of this lifetime, in seconds, doesn't answer: the first of a key, and the first
    after the kept one has expired. A key's state leaves when the watermark passes its end, so idle keys cost nothing."""
    ship_package(events.sparkSession)
    span = lifetime * 1_000_000
    timed = events.select(F.col(key).alias("_key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("_us", F.unix_micros("ts"))

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        filled = state.get[0] if state.exists else None
        missed = []
        for t in sorted(int(t) for part in parts for t in part["_us"]):
            if filled is None or t >= filled + span:
                missed.append(t)
                filled = t
        state.update((filled,))
        state.setTimeoutTimestamp(max((filled + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [keys[0]] * len(missed), "us": missed}).astype({"us": "int64"})

    kind = timed.schema["_key"].dataType.simpleString()
    found = timed.groupBy("_key").applyInPandasWithState(update, f"key {kind}, us long", "filled long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias("ts"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key's events with no longer gap than this."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
