"""Streams against their batch forms, over restarts, late rows and lifetimes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelode.operators import audit
from pagelode.streaming import rates, replay, sinks, url_state

START = dt.datetime(2024, 1, 1)


def fed(spark, tmp_path, pieces, schema, build):
    """Rows that a stream makes of pieces, each a batch of its own, and its state's progress after each."""
    states = []
    for k, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        made = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0])
    return spark.read.schema(made.schema).parquet(f"{tmp_path}/out"), states


EVENT = "event_id long, source string, model string, ts timestamp, status string"


def test_rates_by_event_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    events = [
        (i, rng.choice(["a", "b", None]), rng.choice(["m", None]), START + dt.timedelta(seconds=rng.randrange(3 * 86_400), milliseconds=rng.choice([0, 250, 900])), rng.choice(["salvaged", "clean", None]))
        for i in range(150)
    ]
    # Peers of one second, an event exactly a day later, and one a second beyond that.
    events += [(1000 + i, "a", "m", START + dt.timedelta(days=1, milliseconds=100 * i), "salvaged") for i in range(5)]
    events += [(2000, "a", "m", START + dt.timedelta(days=2), "clean"), (2001, "a", "m", START + dt.timedelta(days=2, seconds=1), "clean")]
    events.sort(key=lambda r: r[3])
    closing = [(-1, "z", "m", START + dt.timedelta(days=9), "clean")]
    got, states = fed(spark, tmp_path, [events[:70], events[70:], closing], EVENT, rates.salvage_rate_stream)
    want = audit.salvage_rates(spark.createDataFrame(events, EVENT))
    rows = lambda df: sorted(str((r["event_id"], r["source"], r["model"], r["ts"], r["status"], r["n"], round(r["rate"], 9))) for r in df.collect())
    assert rows(got) == rows(want)
    # Only the closing event's key is left (its event and its timer).
    assert states[-1]["numRowsTotal"] <= 3 < states[0]["numRowsTotal"]
    alerts = rates.alert_stream(got)
    assert {r["event_id"] for r in alerts.collect()} == {r["event_id"] for r in audit.salvage_alerts(want).collect()}


def test_late_and_timeless_events_are_dropped(spark, tmp_path):
    first = [(1, "a", "m", START + dt.timedelta(hours=30), "salvaged"), (2, "a", "m", None, "salvaged")]
    late = [(3, "a", "m", START, "clean"), (4, "a", "m", START + dt.timedelta(hours=29, minutes=30), "clean"), (5, "a", "m", START + dt.timedelta(days=9), "clean")]
    got, _ = fed(spark, tmp_path, [first, late], EVENT, rates.salvage_rate_stream)
    assert {(r["event_id"], r["n"]) for r in got.collect()} == {(1, 2), (4, 1)}


FETCH = "url string, ts timestamp, etag string, last_modified string, lastmod string, content string"


@pytest.mark.parametrize("seed", [1, 2])
def test_results_from_state_equal_the_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    fetches = [
        (rng.choice(["u", "v", None]), START + dt.timedelta(hours=rng.randrange(24 * 60)), rng.choice([None, "e1", "e2"]), rng.choice([None, "l1"]), rng.choice([None, "d1", "d2"]), rng.choice(["A", "B", None]))
        for _ in range(120)
    ]
    fetches.sort(key=lambda r: r[1])
    lives = url_state.Lifetimes(20 * 3600, 10 * 3600, 30 * 3600)
    closing = [("z", START + dt.timedelta(days=200), None, None, None, "x")]
    got, states = fed(spark, tmp_path, [fetches[:50], fetches[50:], closing], FETCH, lambda s: url_state.result_stream(s, lives))
    want = url_state.history(spark.createDataFrame(fetches, FETCH), lives)
    rows = lambda df: sorted(str(tuple(r)) for r in df.where("url is distinct from 'z'").collect())
    assert rows(got) == rows(want)
    assert states[-1]["numRowsTotal"] <= 3 < states[0]["numRowsTotal"]


def test_urls_share_the_state_of_their_bucket(spark, tmp_path):
    rng = random.Random(3)
    fetches = [
        (f"u{rng.randrange(60)}", START + dt.timedelta(minutes=rng.randrange(60 * 60)), rng.choice([None, "e1", "e2"]), rng.choice([None, "l1"]), rng.choice([None, "d1"]), rng.choice(["A", "B"]))
        for _ in range(900)
    ]
    fetches.sort(key=lambda r: r[1])
    # Variables that end in another order than above: a body outlives its content's time.
    lives = url_state.Lifetimes(3 * 3600, 9 * 3600, 5 * 3600)
    closing = [("z", START + dt.timedelta(days=200), None, None, None, "x")]
    pieces = [fetches[:300], fetches[300:301], fetches[301:600], fetches[600:], closing]
    got, states = fed(spark, tmp_path, pieces, FETCH, lambda s: url_state.result_stream(s, lives, buckets=2))
    want = url_state.history(spark.createDataFrame(fetches, FETCH), lives)
    rows = lambda df: sorted(str(tuple(r)) for r in df.where("url <> 'z'").collect())
    assert rows(got) == rows(want)
    # Two buckets with three rows each, and a row for each body; Spark is called for buckets, not for URLs.
    held = len({r[0] for r in fetches[:300]})
    assert states[0]["numRowsTotal"] <= 2 * 3 + held
    assert states[-1]["numRowsTotal"] <= 3


def test_a_fetch_older_than_the_last_one_is_stale(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    pieces = [[("u", at(10), "e", None, "d", "A")], [("u", at(9.5), "f", None, "d", "B")], [("u", at(11), "e", None, "d", "")]]
    got, _ = fed(spark, tmp_path, pieces, FETCH, url_state.result_stream)
    rows = [(r["content"], r["changed"], r["not_modified"], r["to_fetch"], r["stale"]) for r in got.orderBy("ts").collect()]
    assert rows == [("B", None, None, None, True), ("A", True, False, True, False), ("A", False, True, False, False)]


def test_a_killed_sink_leaves_no_row_twice_and_none_out(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), (F.col("id") % 3 == 0).alias("is_valid"), F.timestamp_seconds("id").alias("ts"))
    folder, fail = f"{tmp_path}/audit", [2]

    def dies(batch, batch_id, folder, accepted):
        """Writes rows of the third batch, and is killed before its marker."""
        if batch_id == fail[0]:
            fail[0] = None
            batch.withColumn("kind", F.lit("result")).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/rows/{batch_id}")
            raise RuntimeError("killed")
        sinks.write_batch(batch, batch_id, folder, accepted)

    write = lambda s: sinks.audited(s, folder, write=dies)
    with pytest.raises(Exception, match="killed"):
        replay.replayed(pages, "ts", write, f"{tmp_path}/checkpoint", n=4, folder=f"{tmp_path}/pieces")
    assert sinks.committed(spark, folder) == [0, 1]
    seen = sinks.read_audited(spark, folder, pages.schema).union(sinks.read_audited(spark, folder, pages.schema, False))
    assert seen.count() == 20
    # Started again: the third batch is taken anew.
    query = write(spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/pieces/*")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    results, rejects = (sinks.read_audited(spark, folder, pages.schema, r) for r in (True, False))
    assert sorted(r["page_id"] for r in results.collect()) == [i for i in range(30) if i % 3 == 0]
    assert sorted(r["page_id"] for r in rejects.collect()) == [i for i in range(30) if i % 3]
    assert sinks.read_audited(spark, f"{tmp_path}/none", pages.schema).count() == 0
