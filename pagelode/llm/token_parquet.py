"""Token ids as Parquet list columns that can be read in part.

Method: documents are range-partitioned by doc_id, sorted, encoded where they are, and written by Spark's Parquet writer: ids as a
dictionary-encoded list column (delta-packed pages once a dictionary is too large), row groups of bounded size, pages of few rows, and
the column and offset indexes that the writer adds. Selective reads follow: a range of doc_id reads only its pages, and the
metadata columns (doc_id, part, local_start, n_tokens) are read without any ids.

Each file holds one range of doc_id; `part` numbers the ranges in order, `local_start` counts the ids of the documents before in
the same part. A document's start is the sum of the lower parts (one number each) and local_start.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows of equal doc_id are in order of their
text; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.llm.recent import PretokenEncoder
from pagelode.llm.shared import prepare, string_column

END_ID = 2
#: Writer options: bytes of a row group and of a page, rows of a page, and the encodings of the second format version.
WRITER = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "200",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, part, local_start, n_tokens and ids, in ascending order of doc_id over ascending parts."""
    spark = docs.sparkSession
    prepare(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PretokenEncoder.of(vocabulary)
        kind = "<u2" if encoder.narrow else "<u4"
        end = np.array([end_id], kind).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            packed = [p + end for p in encoder.pack_texts(string_column(batch, "text").to_pylist())]
            n = np.array([len(p) for p in packed], np.int64) // np.dtype(kind).itemsize
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            ids = np.frombuffer(b"".join(packed), kind).astype(np.int32)
            yield pa.record_batch(
                {
                    "doc_id": string_column(batch, "doc_id"),
                    "part": pa.array(np.full(len(n), part, np.int32)),
                    "local_start": pa.array(start + ends[:-1]),
                    "n_tokens": pa.array(n),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                }
            )
            start += int(ends[-1])

    return ordered.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    encoded(docs, vocabulary, end_id).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids of a written folder."""
    rows = spark.read.schema("doc_id long, part int, local_start long, n_tokens long, ids array<int>").parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each part, as many as the write had tasks.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start"))
    return out.select("doc_id", "start", "n_tokens", *(["ids"] if ids else []))


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, of the ids as little-endian numbers of 32 bits."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = string_column(batch, "ids")
            values, at = column.values.to_numpy().astype("<i4"), column.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            held = batch.select(["doc_id", "start", "n_tokens"])
            yield held.append_column("ids_crc32", pa.array(crc, pa.int64()))

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
