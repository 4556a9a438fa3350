"""Helpers shared by the operators of this subpackage: Arrow text as numpy bytes, word spans and
hashes without a Python loop over words, bounded chunks, and tables in the shared folder."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.shipping import ship_package

#: Bytes of text handled at once by the vectorised operators; it bounds their memory.
CHUNK_BYTES = 1 << 18
#: Arrow records sent to a Python worker at once.
ARROW_ROWS = 1000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def prepare(spark: SparkSession) -> None:
    """Readies a session for the Python operators: the package on the executors, and small Arrow batches of long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own in a local session and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_pagelode_folder", None) or tempfile.mkdtemp(prefix="pagelode-")
        spark._pagelode_folder = folder
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs only a read.

    group: the rows of a row group, for tables of long rows: a task holds one group when it writes and when it reads."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group) if group else df.write).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._pagelode_path = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes saved() tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_pagelode_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def running(df: DataFrame, order: list[str], name: str, sums: list[str], keep: list[str] | None = None) -> DataFrame:
    """df in one global order: _at is a row's place from 0, _c the sum of column c up to and with the row, for each c of sums.

    Sums within ranges are written with the rows, then each range's offset is added: one row for each range goes to the driver."""
    cols = keep if keep is not None else df.columns
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    extra = ["_at", *(f"_{c}" for c in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, totals = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for batch in batches:
            out = {c: string_column(batch, c) for c in cols}
            out["_part"] = pa.array(np.full(len(batch), part, np.int32))
            out["_at"] = pa.array(np.arange(at, at + len(batch)))
            at += len(batch)
            for k, c in enumerate(sums):
                up_to = totals[k] + np.cumsum(string_column(batch, c).to_numpy(zero_copy_only=False))
                totals[k] = int(up_to[-1]) if len(up_to) else totals[k]
                out[f"_{c}"] = pa.array(up_to.astype(np.int64))
            yield pa.record_batch(out)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*dict.fromkeys([*cols, *sums]))
    local = saved(ranged.mapInArrow(run, f"{fields}, _part int, " + ", ".join(f"`{c}` long" for c in extra)), name)
    per = local.groupBy("_part").agg((F.max("_at") + 1).alias("_at"), *(F.max_by(f"_{c}", "_at").alias(f"_{c}") for c in sums)).orderBy("_part").collect()
    offsets, before = [], [0] * len(extra)
    for r in per:
        offsets.append((r["_part"], *before))
        before = [b + r[c] for b, c in zip(before, extra, strict=True)]
    known = df.sparkSession.createDataFrame(offsets, "_part int, " + ", ".join(f"`_o{c}` long" for c in extra))
    return local.join(F.broadcast(known), "_part").select(*cols, *((F.col(c) + F.col(f"_o{c}")).alias(c) for c in extra))


def in_one_task(rows: DataFrame, fit: Callable[[pa.Table], object]):
    """What fit makes of all rows (a bounded sample) in a task of their own; it comes back pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.record_batch({"made": pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())})

    made = rows.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(made[0]["made"]) if made else None


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets (from 0) of consecutive rows with at most so many bytes, or of one longer row.

    A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of True bytes; a run ends where its row does."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], False
    edge[1:n] = inside[1:] & ~inside[:-1]
    stop = np.empty(n + 1, bool)
    stop[0], stop[n] = False, inside[-1]
    stop[1:n] = ~inside[1:] & inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    edge[cuts] = True
    stop[cuts] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the words [^\\x20\\x09-\\x0D]+."""
    return runs(~_WHITE[data], offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits (wrapping)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over random byte values, by prefix sums."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_TABLE if lower else _TABLE)[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
