"""Quality figures: reasons of rejection, salvage rates over a rolling day, parse statuses and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode import rules


def reject_rates(validated: DataFrame) -> DataFrame:
    """Pages, rejects and share of all pages for each reason code."""
    per = validated.groupBy("reason_code").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("is_valid"), 0).otherwise(1)).alias("rejected"))
    # One row for each reason: the total over them is a window of a dozen rows.
    return per.withColumn("share", F.col("pages") / F.sum("pages").over(Window.partitionBy()))


def salvage_rates(events: DataFrame, hours: int = 24) -> DataFrame:
    """events (source, model, ts, status) with n and rate: events and share of salvaged ones in the day up to each, its peers included.

    A range window would go through a whole day of a source for each event of it."""
    return salvage_rates_split(events, hours)


def salvage_rates_split(events: DataFrame, hours: int = 24) -> DataFrame:
    """As salvage_rates(), for sources of any size: no window holds more than two hours of one source, counted by second.

    A day up to t is the whole hours before t's own, and what t's hour has up to t, less what has left again: events of the hour a day before
    come into t's hour once more, a day later, as leaving. Hours as wholes are a window of a row for each hour. Events without a time count
    for each other."""
    hour, span = 3600, hours * 3600
    keyed = events.withColumn("_t", F.unix_seconds(F.col("ts").cast("timestamp")))
    of_seconds = (F.count("*").alias("n"), F.count_if(F.coalesce(F.col("status") == rules.SALVAGED, F.lit(False))).alias("s"))
    seconds = keyed.groupBy("source", "model", "_t").agg(*of_seconds).withColumn("_h", F.floor(F.col("_t") / hour))
    timed = seconds.where("_t is not null")
    per_hour = timed.groupBy("source", "model", "_h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # Each hour's totals stand for the hours after it, which may have no event of the hours before.
    before = Window.partitionBy("source", "model").orderBy("_h").rangeBetween(-hours, -1)
    totals = per_hour.select(
        F.col("source").alias("_source"), F.col("model").alias("_model"), F.col("_h").alias("_hour"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before")
    )
    moves = seconds.select("source", "model", "_h", "_t", "n", "s", F.lit(True).alias("_in")).unionByName(
        timed.select("source", "model", (F.col("_h") + hours).alias("_h"), (F.col("_t") + span).alias("_t"), "n", "s", F.lit(False).alias("_in"))
    )
    own = Window.partitionBy("source", "model", "_h").orderBy("_t")
    up_to, past = own.rangeBetween(Window.unboundedPreceding, 0), own.rangeBetween(Window.unboundedPreceding, -1)

    def within(c: str) -> Column:
        come, gone = F.sum(F.when(F.col("_in"), F.col(c))).over(up_to), F.sum(F.when(~F.col("_in"), F.col(c))).over(past)
        return F.coalesce(come, F.lit(0)) - F.coalesce(gone, F.lit(0))

    here = moves.withColumn("n_here", within("n")).withColumn("s_here", within("s")).where("_in")
    whole = here.join(totals, F.col("source").eqNullSafe(F.col("_source")) & F.col("model").eqNullSafe(F.col("_model")) & (F.col("_h") == F.col("_hour")), "left")
    n = F.coalesce("n_before", F.lit(0)) + F.col("n_here")
    salvaged = F.coalesce("s_before", F.lit(0)) + F.col("s_here")
    rated = whole.select(F.col("source").alias("_source"), F.col("model").alias("_model"), F.col("_t").alias("_second"), n.alias("n"), (salvaged / n).alias("rate"))
    found = keyed.join(rated, F.col("source").eqNullSafe(F.col("_source")) & F.col("model").eqNullSafe(F.col("_model")) & F.col("_t").eqNullSafe(F.col("_second")))
    return found.drop("_t", "_source", "_model", "_second")


def salvage_alerts(rated: DataFrame, above: float = rules.SALVAGE_ALERT) -> DataFrame:
    return rated.where((F.col("status") == "salvaged") & (F.col("rate") > above))


def status_counts(events: DataFrame) -> DataFrame:
    """For each source and model a column of each status, 0 where it has none."""
    return events.groupBy("source", "model").agg(*(F.count_if(F.col("status") == s).alias(s) for s in rules.STATUS_SEVERITY))


def completeness(parsed: DataFrame) -> DataFrame:
    """url, parsed and declared of pages whose listings are fewer than their envelope says."""
    return parsed.select("url", F.size("jobs").alias("parsed"), "declared").where(F.col("parsed") < F.col("declared"))


def outcome_tally(scraped: DataFrame) -> DataFrame:
    """One row: pages with jobs, without, and failed."""
    return scraped.agg(
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & (F.size("jobs") > 0)).alias("with_jobs"),
        F.count_if(F.col("error").isNull() & (F.size("jobs") == 0)).alias("without_jobs"),
    )


def status_rollup(events: DataFrame) -> DataFrame:
    """Events by source, model and status, with their totals (null where summed over)."""
    return events.rollup("source", "model", "status").agg(F.count("*").alias("events"))
