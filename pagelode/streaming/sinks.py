"""A sink for results and rejects of a validated stream: both are written in one commit for each batch, so a stream that is killed and
started again from its checkpoint leaves no row twice and none out.

A batch's rows go to a folder of its id, results and rejects apart; a replayed batch writes its folder anew. Its marker is written last,
and readers take only batches that have one. Results and rejects of one batch are thus seen together or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

_KINDS = {True: "result", False: "reject"}


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The ids of batches whose rows are whole."""
    fs, where = _path(spark, f"{folder}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def write_batch(batch: DataFrame, batch_id: int, folder: str, accepted: str = "is_valid") -> None:
    """One batch's results and rejects, then its marker; a batch with a marker is left as it is."""
    spark = batch.sparkSession
    fs, marker = _path(spark, f"{folder}/commits/{batch_id}")
    if fs.exists(marker):
        return
    kind = F.when(F.coalesce(F.col(accepted), F.lit(False)), _KINDS[True]).otherwise(_KINDS[False])
    batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/rows/{batch_id}")
    fs.create(marker, True).close()


def audited(stream: DataFrame, folder: str, accepted: str = "is_valid", write: Callable[..., None] = write_batch) -> DataStreamWriter:
    """A writer of the stream; it needs a checkpoint in a folder that all share."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: write(batch, batch_id, folder, accepted)).outputMode("append")


def read_audited(spark: SparkSession, folder: str, schema: StructType, results: bool = True) -> DataFrame:
    """The results, or the rejects, of all whole batches, with batch_id."""
    paths = [f"{folder}/rows/{b}" for b in committed(spark, folder)]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long"))
    kind, batch = F.regexp_extract(F.input_file_name(), r"/kind=([a-z]+)/", 1), F.regexp_extract(F.input_file_name(), r"/rows/(\d+)/", 1).cast("long")
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
    return found.withColumn("batch_id", batch).withColumn("_kind", kind).where(F.col("_kind") == _KINDS[results]).drop("_kind")
