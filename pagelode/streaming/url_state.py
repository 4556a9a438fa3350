"""What is known of each URL, as keyed state of a stream of fetches, and the stream of results that it answers.

Three variables with a lifetime of their own: the hash of the last content, the HTTP validators with the body that they stand for, and the
sitemap's time. A fetch whose validators are those of the state is answered from the state's body; the result says what the content
is, whether it changed, and whether the sitemap's time asks for a fetch. history() gives the same answers for a whole table.

Defined cases: fetches of one URL are taken in order of time (equal times by a hash of the row); a fetch older than the last one of its URL is
stale: it is passed on without answers and changes nothing. Fetches later than the watermark or without a time are dropped. A variable counts
up to its lifetime after the fetch that set it, and its room is given back when the watermark has passed that by an eighth of the shortest lifetime
at most; a URL of which nothing is left begins anew. A null URL is a URL of its own; null content is empty."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelode.functions.shipping import ship_package
from pagelode.functions.text import content_hash
from pagelode.streaming.rates import use_state_store

_RESULT = "url string, ts timestamp, content_hash string, content string, changed boolean, not_modified boolean, to_fetch boolean, stale boolean"
_COLUMNS = [c.split()[0] for c in _RESULT.split(", ")]

# Spark starts a process of its own beside the driver for processors, which knows only what is sent to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Lifetimes:
    """Seconds for which each variable counts."""

    content: int = 90 * 86_400
    validators: int = 7 * 86_400
    lastmod: int = 30 * 86_400


def _prepared(fetches: DataFrame) -> DataFrame:
    """url, ts, etag, last_modified, lastmod and content of fetches (absent columns are null), with the hash and the order of equal times."""
    given = {c: F.col(c).cast("string") if c in fetches.columns else F.lit(None).cast("string") for c in ("etag", "last_modified", "lastmod")}
    rows = fetches.select("url", F.col("ts").cast("timestamp").alias("ts"), *(v.alias(k) for k, v in given.items()), F.coalesce(F.col("content"), F.lit("")).alias("content"))
    return rows.withColumn("content_hash", content_hash(F.col("content"))).withColumn("tie", F.xxhash64("etag", "last_modified", "lastmod", "content")).withColumn("us", F.unix_micros("ts")).where("ts is not null")


class _UrlState(StatefulProcessor):
    """URLs in buckets: a call for each bucket of a batch, which reads and writes the short variables of all of its URLs at once, and the bodies URL by URL.

    In a batch's work a URL is [at, hash, whether validators are held, lastmod]: a fetch sets or clears all three variables, so they share its time."""

    def __init__(self, lives: Lifetimes) -> None:
        self.content, self.validators, self.lastmod = (x * 1_000_000 for x in (lives.content, lives.validators, lives.lastmod))
        self.step = max(1000, min(self.content, self.validators, self.lastmod) // 8000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("content", "url array<string>, at array<long>, hash array<string>, held array<boolean>")
        self.times = handle.getValueState("lastmod", "url array<string>, lastmod array<string>")
        self.bodies = handle.getMapState("validators", "url string", "etag string, last_modified string, body string")
        self.timer = handle.getValueState("timer", "at long")

    def _read(self) -> dict:
        held = self.known.get()
        known = {u: [at, digest, has, None] for u, at, digest, has in zip(*held, strict=True)} if held else {}
        times = self.times.get()
        for url, lastmod in zip(*times, strict=True) if times else ():
            known[url][3] = lastmod
        return known

    def _write(self, known: dict, timed: bool) -> None:
        """timed: whether sitemaps' times were held before."""
        if known:
            self.known.update((list(known), *(list(x) for x in list(zip(*known.values(), strict=True))[:3])))
        else:
            self.known.clear()
        times = [(u, v[3]) for u, v in known.items() if v[3] is not None]
        if times:
            self.times.update(tuple(list(x) for x in zip(*times, strict=True)))
        elif timed:
            self.times.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        got = pd.concat(parts).sort_values(["us", "tie"], kind="stable")
        text = got[["url", "etag", "last_modified", "lastmod", "content", "content_hash"]].astype(object)
        text = text.where(text.notna(), None)
        known = self._read()
        timed = any(v[3] is not None for v in known.values())
        read, bodies, touched, out = {}, {}, {}, []
        for at, url, etag, modified, lastmod, content, digest in zip(got["us"].tolist(), *(text[c].tolist() for c in text.columns), strict=True):
            old = known.get(url)
            if old is not None and at < old[0]:
                out.append((digest, content, None, None, None, True))
                continue
            gap = None if old is None else at - old[0]
            valid, same = etag is not None or modified is not None, False
            if valid and old is not None and old[2] and gap <= self.validators:
                if url not in bodies:
                    bodies[url] = read[url] = tuple(self.bodies.getValue((url,)))
                was = bodies[url]
                same = etag == was[0] if etag is not None else modified == was[1]
                if same:
                    content, digest = was[2], old[1]
            changed = old is None or gap > self.content or old[1] != digest
            fetch = lastmod is None or old is None or gap > self.lastmod or old[3] != lastmod
            out.append((digest, content, changed, same, fetch, False))
            touched.setdefault(url, old is not None and old[2])
            known[url] = [at, digest, valid, lastmod]
            bodies[url] = (etag, modified, content) if valid else None
        for url, before in touched.items():
            body = bodies[url]
            if body is None and before:
                self.bodies.removeKey((url,))
            elif body is not None and body != read.get(url):
                self.bodies.updateValue((url,), body)
        if touched:
            self._write(known, timed)
            self._wake(min(self._ends(known[url])[0] for url in touched), self.timer.get())
        yield pd.concat([got[["url", "ts"]].reset_index(drop=True), pd.DataFrame(out, columns=_COLUMNS[2:])], axis=1)

    def _ends(self, held: list) -> list[int]:
        """When the variables that are held end, in ms, the first one first: a timer's time is the first after the lifetime's last microsecond."""
        at, digest, has, lastmod = held
        lives = [(digest is not None, self.content), (has, self.validators), (lastmod is not None, self.lastmod)]
        return sorted((at + life) // 1000 + 1 for there, life in lives if there)

    def _wake(self, end: int, timer: tuple | None) -> None:
        """The bucket's one timer rings at the first whole step at or behind the end that comes first."""
        at = -(-end // self.step) * self.step
        if timer is not None:
            if timer[0] <= at:
                return
            self.handle.deleteTimer(timer[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        known, left, nearest = self._read(), {}, None
        timed = any(v[3] is not None for v in known.values())
        for url, held in known.items():
            at, digest, has, lastmod = held
            content, validators, sitemap = ((at + life) // 1000 + 1 > passed for life in (self.content, self.validators, self.lastmod))
            if has and not validators:
                self.bodies.removeKey((url,))
            has = has and validators
            # The hash is that of the validators' body too.
            held = [at, digest if content or has else None, has, lastmod if sitemap else None]
            ends = [e for e in self._ends(held) if e > passed]
            if ends:
                left[url] = held
                nearest = ends[0] if nearest is None else min(nearest, ends[0])
        self.timer.clear()
        self._write(left, timed)
        if nearest is not None:
            self._wake(nearest, None)
        yield from ()

    def close(self) -> None:
        pass


def result_stream(fetches: DataFrame, lives: Lifetimes = Lifetimes(), late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """A stream of fetches (url, ts, content; etag, last_modified and lastmod where known) as results, each answered from what is known of its URL.

    The state is keyed by URL within buckets of URLs by hash, since a call of Spark's for each URL costs more than the work on it. A task holds one
    bucket's rows of a batch; a stream keeps its number of buckets for good."""
    ship_package(fetches.sparkSession)
    use_state_store(fetches.sparkSession)
    rows = _prepared(fetches).withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(_UrlState(lives), _RESULT, "append", "eventTime")


def history(fetches: DataFrame, lives: Lifetimes = Lifetimes()) -> DataFrame:
    """The same results for a whole table of fetches, none of them stale: each is compared with the one before it of its URL."""
    order = Window.partitionBy("url").orderBy("ts", "tie")
    rows = _prepared(fetches)
    before = {c: F.lag(c).over(order).alias(f"_{c}") for c in ("etag", "last_modified", "lastmod")}
    rows = rows.select("*", *before.values(), (F.col("us") - F.lag("us").over(order)).alias("_gap"))

    def within(seconds: int) -> Column:
        return F.coalesce(F.col("_gap") <= seconds * 1_000_000, F.lit(False))

    equal = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("_etag")).otherwise(F.col("last_modified") == F.col("_last_modified"))
    rows = rows.withColumn("not_modified", within(lives.validators) & F.coalesce(equal, F.lit(False)))
    # The body that counts is that of the last fetch with one of its own.
    own = F.when(~F.col("not_modified"), F.struct("content", "content_hash"))
    rows = rows.withColumn("_body", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_prev", F.lag(F.col("_body")["content_hash"]).over(order))
    changed = ~within(lives.content) | F.col("_prev").isNull() | (F.col("_prev") != F.col("_body")["content_hash"])
    fetch = F.col("lastmod").isNull() | ~within(lives.lastmod) | F.col("_lastmod").isNull() | (F.col("_lastmod") != F.col("lastmod"))
    return rows.select(
        "url", "ts", F.col("_body")["content_hash"].alias("content_hash"), F.col("_body")["content"].alias("content"), changed.alias("changed"), "not_modified",
        fetch.alias("to_fetch"), F.lit(False).alias("stale"),
    )
