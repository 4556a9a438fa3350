"""A table replayed as a stream: it's dealt into consecutive pieces by time, which a stream then takes one after the other."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Pieces of a replayed table.
PIECES = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own in a local session and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_pagelode_replays", None) or tempfile.mkdtemp(prefix="pagelode-replay-")
        spark._pagelode_replays = folder
    return folder.rstrip("/")


def replayed(table: DataFrame, time: str, write: Callable[[DataFrame], DataStreamWriter], checkpoint: str, closing: dict[str, Column] | None = None, n: int = PIECES, folder: str | None = None) -> None:
    """Runs a stream over the table's rows, in n consecutive pieces of time (nulls first) of about equal span, each one batch.

    The stream is stopped after each piece and goes on from its checkpoint. closing: the columns of a last row that moves the watermark
    past all others; its time is to lie behind theirs. folder: where the pieces are put."""
    spark = table.sparkSession
    folder = folder or f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    span = table.agg(F.min(F.unix_micros(time)).alias("low"), F.max(F.unix_micros(time)).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    piece = F.coalesce(F.floor((F.unix_micros(time) - low) * n / (high - low + 1)).cast("int"), F.lit(0))
    parts = [table.where(piece == k) for k in range(n)]
    if closing is not None:
        parts.append(spark.range(1).select(*(closing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields)))
    # A stream keeps the number of its state's parts for good: in a local session one for each core, elsewhere the session's.
    key, context = "spark.sql.shuffle.partitions", spark.sparkContext
    before = spark.conf.get(key)
    if context.master.startswith("local"):
        spark.conf.set(key, str(min(int(before), context.defaultParallelism)))
    try:
        for k, part in enumerate(parts):
            part.write.parquet(f"{folder}/{k}")
            query = write(spark.readStream.schema(table.schema).parquet(f"{folder}/*")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(key, before)


def answered(table: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], closing: dict[str, Column] | None = None, n: int = PIECES) -> DataFrame:
    """All rows that an append stream makes of the replayed table, written to the shared folder and read from there."""
    spark = table.sparkSession
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    schemas = []

    def write(stream: DataFrame) -> DataStreamWriter:
        made = build(stream)
        schemas.append(made.schema)
        return made.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append")

    replayed(table, time, write, f"{folder}/checkpoint", closing, n)
    return spark.read.schema(schemas[-1]).parquet(f"{folder}/rows")
