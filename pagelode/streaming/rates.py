"""The salvage rate of a rolling day as a stream: one row for each event, with the events and the salvaged share of the day up to it.

The state of a key (source, model) is a map of minutes, each with its seconds' counts, so it's bounded by the length of the day however many
events there are, and a list of events whose second may still grow. An event is answered by an event-time timer once the watermark has
passed its second: then no earlier event and no peer can come, and the answer is the one that the batch form gives.

Defined cases: events later than the watermark are dropped by Spark (and counted in numRowsDroppedByWatermark), so a replay equals the batch
form where none is later than `late`; peers of one second count for each other, as in the batch form; an event without a time is dropped; a null source,
model or status is a value of its own, and isn't salvaged. A key's state leaves when a day has passed since its last event. Events behind the
last watermark stay pending until later ones move it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

from pagelode import rules
from pagelode.functions.shipping import ship_package

_MINUTE = 60
_KEYS = ("source", "model")

# Spark starts a process of its own beside the driver for processors, which knows only what is sent to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store that Spark has for it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rolling(seconds: np.ndarray, counts: np.ndarray, salvaged: np.ndarray, asked: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct seconds with counts: all and salvaged events in [t - span, t] for each asked t."""
    n, s = (np.concatenate(([0], np.cumsum(x))) for x in (counts, salvaged))
    low, high = np.searchsorted(seconds, asked - span, "left"), np.searchsorted(seconds, asked, "right")
    return n[high] - n[low], s[high] - s[low]


class _Rates(StatefulProcessor):
    """Pending events, minutes of counted ones, and the one timer that is set."""

    def __init__(self, payload: StructType, span: int) -> None:
        self.payload, self.span = payload, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", StructType([StructField("second_", LongType()), StructField("salvaged_", BooleanType()), *self.payload.fields]))
        self.minutes = handle.getMapState("minutes", StructType([StructField("minute", LongType())]), "seconds array<int>, counts array<long>, salvaged array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer at a time: the earliest that is asked for."""
        if self.timer.exists():
            if self.timer.get()[0] <= at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            if len(part):
                self.pending.appendList(list(part[["second_", "salvaged_", *self.payload.names]].astype(object).where(part.notna(), None).itertuples(index=False, name=None)))
                least = int(part["second_"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake((first + 1) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() // 1000  # seconds before this one are whole
        rows = list(self.pending.get()) if self.pending.exists() else []
        due = sorted((r for r in rows if r[0] < passed), key=lambda r: r[0])
        rest = [r for r in rows if r[0] >= passed]
        held = {k[0]: v for k, v in self.minutes.iterator()}
        counted: dict[int, list[int]] = {m * _MINUTE + s: [n, x] for m, (secs, ns, xs) in held.items() for s, n, x in zip(secs, ns, xs, strict=True)}
        touched = set()
        for r in due:
            entry = counted.setdefault(r[0], [0, 0])
            entry[0] += 1
            entry[1] += bool(r[1])
            touched.add(r[0] // _MINUTE)
        seconds = np.array(sorted(counted), np.int64)
        if due:
            counts, salvaged = np.array([counted[s] for s in seconds.tolist()], np.int64).T
            asked = np.array([r[0] for r in due], np.int64)
            n, x = rolling(seconds, counts, salvaged, asked, self.span)
            out = pd.DataFrame([r[2:] for r in due], columns=self.payload.names)
            for i, name in enumerate(_KEYS):
                out[name] = key[i]
            yield out.assign(n=n, rate=x / n)[[*_KEYS, *self.payload.names, "n", "rate"]]
        # What no later event can ask for leaves: those are at or behind the first second that isn't whole.
        oldest = (min((r[0] for r in rest), default=passed)) - self.span
        keep = {m for m in {s // _MINUTE for s in seconds.tolist()} if m * _MINUTE + _MINUTE > oldest}
        for m in held.keys() - keep:
            self.minutes.removeKey((m,))
        for m in touched & keep:
            own = [s for s in range(m * _MINUTE, (m + 1) * _MINUTE) if s in counted]
            self.minutes.updateValue((m,), ([s - m * _MINUTE for s in own], [counted[s][0] for s in own], [counted[s][1] for s in own]))
        if due:
            self.pending.put(rest) if rest else self.pending.clear()
        if rest:
            self._wake((min(r[0] for r in rest) + 1) * 1000)
        elif keep:
            self._wake((max(keep) * _MINUTE + _MINUTE + self.span + 1) * 1000)

    def close(self) -> None:
        pass


def salvage_rate_stream(events: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """A stream of events (source, model, ts, status and any more) with n and rate, each event once its second is whole."""
    spark = events.sparkSession
    ship_package(spark)
    use_state_store(spark)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    names = [c for c in events.columns if c not in _KEYS]
    payload = StructType([timed.schema[c] if c != "ts" else StructField("ts", TimestampType()) for c in names])
    out = StructType([*(timed.schema[c] for c in _KEYS), *payload.fields, StructField("n", LongType()), StructField("rate", timed.select(F.lit(1.0).alias("rate")).schema["rate"].dataType)])
    marked = timed.where("ts is not null").withColumn("second_", F.unix_seconds("ts")).withColumn("salvaged_", F.coalesce(F.col("status") == rules.SALVAGED, F.lit(False)))
    return marked.groupBy(*_KEYS).transformWithStateInPandas(_Rates(payload, hours * 3600), out, "append", "eventTime")


def alert_stream(rated: DataFrame, above: float = rules.SALVAGE_ALERT) -> DataFrame:
    """Salvaged events of a stream of rates whose day is above the limit."""
    return rated.where((F.col("status") == rules.SALVAGED) & (F.col("rate") > above))
