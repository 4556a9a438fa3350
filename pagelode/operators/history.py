"""Listings over many snapshots of their boards: when each one was open, as intervals.

A snapshot is what a board listed at one time. A listing is open from the first snapshot that has it to the first that doesn't; one that comes
back is opened again. Runs of consecutive snapshots are found by the difference of a snapshot's number on its board and the listing's own
(gaps and islands).

Defined cases: a listing that a snapshot names more than once counts once; a null board or listing is one of its own; rows without a time are
left out; a listing in the last snapshot of its board is still open (closed_at is null); a board that was seen once has open listings only;
a snapshot without any listing has no row here, so callers give it one with a null listing, which closes all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(snapshots: DataFrame) -> DataFrame:
    """board, listing, nth (1, 2, ...), first_seen, last_seen, closed_at, seen (snapshots) and away (since it was last closed) of (board, listing, at).

    Snapshots are numbered over the distinct times of a board; listings are dealt by board and listing."""
    rows = snapshots.where("at is not null").select("board", "listing", "at").distinct()
    times = rows.select("board", "at").distinct()
    by_board = Window.partitionBy("board").orderBy("at")
    numbered = times.withColumn("_no", F.row_number().over(by_board)).withColumn("_after", F.lead("at").over(by_board))
    numbered = numbered.withColumnRenamed("board", "_board").withColumnRenamed("at", "_at")
    placed = rows.join(numbered, F.col("board").eqNullSafe(F.col("_board")) & (F.col("at") == F.col("_at")))
    own = Window.partitionBy("board", "listing").orderBy("at")
    runs = placed.withColumn("_run", F.col("_no") - F.row_number().over(own)).groupBy("board", "listing", "_run").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("_after", "at").alias("closed_at"), F.count("*").alias("seen")
    )
    order = Window.partitionBy("board", "listing").orderBy("first_seen")
    return runs.select(
        "board", "listing", F.row_number().over(order).alias("nth"), "first_seen", "last_seen", "closed_at", "seen",
        (F.unix_seconds("first_seen") - F.unix_seconds(F.lag("closed_at").over(order))).alias("away"),
    )


def open_at(found: DataFrame, time) -> DataFrame:
    """The intervals that are open at a time."""
    return found.where((F.col("first_seen") <= time) & (F.col("closed_at").isNull() | (F.col("closed_at") > time)))
