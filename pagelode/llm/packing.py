"""Packing by optimal length buckets.

Method: one aggregation makes the global histogram of lengths; dynamic programming over it places the bucket boundaries
that minimise padding (each row is padded to its bucket's longest). Inside a bucket, token-budget batches
hold budget // bucket length rows each.

The programme is exact for every number of distinct lengths: the cost of a bucket is linear in its upper length, so each
layer is a lower envelope of lines and takes linear time. Of equal costs, the lowest boundary wins.

Batches form in shards of about SHARD rows, dealt by doc_id, so that no bucket is one task's work; a
shard leaves at most one batch unfilled.

Defined cases: rows without a length count as 0; a row longer than the budget is a batch by itself; rows of
equal doc_id share a shard and are in order of length; those without a doc_id are dealt by a hash of their
strings and whole numbers; repeated rows are packed each; an empty table has no buckets and no rows. Columns that have a name of those added here
give way to them, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 8
BUDGET = 1 << 16
SHARD = 4096


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of the buckets, ascending; lengths ascending and distinct, counts positive."""
    n = len(lengths)
    k = min(buckets, n)
    if not k:
        return []
    held, total = [0], [0]
    for x, c in zip(lengths, counts, strict=True):
        held.append(held[-1] + c)
        total.append(total[-1] + x * c)
    best: list[int | None] = [0] + [None] * n
    froms = []
    for _ in range(k):
        new: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # slope -held[i], height best[i] + total[i], i
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-held[i], best[i] + total[i], i)
                while len(lines) - at >= 2 and _useless(lines[-2], lines[-1], line):
                    lines.pop()
                lines.append(line)
            x = lengths[j - 1]
            while len(lines) - at >= 2 and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            if len(lines) > at:
                slope, height, i = lines[at]
                new[j], came[j] = x * held[j] - total[j] + slope * x + height, i
        froms.append(came)
        best = new
    out, j = [], n
    for came in reversed(froms):
        out.append(lengths[j - 1])
        j = came[j]
    return out[::-1]


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether the middle of three lines of falling slope is nowhere below both others."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def _shard(shards: Column, columns: list[str]) -> Column:
    own = F.pmod(F.pmod(F.col("doc_id"), F.lit(1048573)) * 40503, F.lit(65537))
    return F.pmod(F.coalesce(own, F.pmod(F.xxhash64(*columns), F.lit(65537))), shards).cast("int")


def pack(rows: DataFrame, length: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """rows with bucket, bucket_length, shard, batch (of the shard) and slot (in the batch)."""
    rows = rows.drop("bucket", "bucket_length", "shard", "batch", "slot")
    size = F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long"))
    # One number for each distinct length: no more than the longest text has tokens.
    histogram = rows.select(size.alias("l")).groupBy("l").agg(F.count("*").alias("c")).orderBy("l").toArrow()
    lengths, counts = histogram["l"].to_pylist(), histogram["c"].to_pylist()
    uppers = boundaries(lengths, counts, buckets)
    held = [0] * len(uppers)
    k = 0
    for x, c in zip(lengths, counts, strict=True):
        while x > uppers[k]:
            k += 1
        held[k] += c
    table = [(k, u, max(1, budget // max(u, 1)), -(-h // shard)) for k, (u, h) in enumerate(zip(uppers, held, strict=True))] or [(0, 0, 1, 1)]
    columns = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint")]
    column = lambda i: F.array(*(F.lit(t[i]) for t in table))
    bucket = F.size(F.filter(column(1).cast("array<long>"), lambda u: u < size))
    placed = rows.withColumn("bucket", bucket)
    of = lambda i: F.get(column(i), F.col("bucket"))
    placed = placed.withColumn("bucket_length", of(1).cast("long")).withColumn("shard", _shard(of(3), columns))
    order = Window.partitionBy("bucket", "shard").orderBy(F.col("doc_id").asc_nulls_first(), size)
    place = F.row_number().over(order) - 1
    placed = placed.withColumn("_p", place)
    fit = of(2).cast("int")
    return placed.withColumn("batch", F.floor(F.col("_p") / fit).cast("long")).withColumn("slot", (F.col("_p") % fit).cast("int")).drop("_p")


def word_count(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, as its length where no tokenizer is asked for."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def oracle(words: str, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> str:
    """SQL of pack() over `documents` with the number of words as length, one layer of the programme after the other."""
    layers = []
    for k in range(1, buckets + 1):
        layers.append(
            f"d{k} AS (SELECT h.j, min(d.v + h.l * (h.held - g.held) - (h.total - g.total)) AS v, "
            f"arg_min(d.j, (d.v + h.l * (h.held - g.held) - (h.total - g.total)) * 1000000 + d.j) AS i "
            f"FROM h JOIN d{k - 1} d ON d.j < h.j JOIN h0 g ON g.j = d.j GROUP BY h.j)"
        )
    steps = [f"b{buckets} AS (SELECT (SELECT max(j) FROM h) AS j)"]
    for k in range(buckets - 1, 0, -1):
        steps.append(f"b{k} AS (SELECT d{k + 1}.i AS j FROM d{k + 1} JOIN b{k + 1} USING (j))")
    uppers = " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return f"""
WITH t AS (SELECT doc_id, len({words}) AS n_tokens FROM documents),
hist AS (SELECT n_tokens AS l, count(*) AS c FROM t GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY l) AS j, l, CAST(sum(c) OVER (ORDER BY l) AS BIGINT) AS held, CAST(sum(l * c) OVER (ORDER BY l) AS BIGINT) AS total FROM hist),
h0 AS (SELECT 0 AS j, 0 AS held, 0 AS total UNION ALL SELECT j, held, total FROM h),
d0 AS (SELECT 0 AS j, 0 AS v),
{", ".join(layers)}, {", ".join(steps)},
u AS (SELECT row_number() OVER (ORDER BY l) - 1 AS bucket, l AS bucket_length FROM h WHERE j IN ({uppers})),
p AS (SELECT t.doc_id, t.n_tokens, min(u.bucket_length) AS bucket_length FROM t JOIN u ON t.n_tokens <= u.bucket_length GROUP BY t.doc_id, t.n_tokens),
q AS (SELECT p.*, u.bucket, count(*) OVER (PARTITION BY u.bucket) AS held FROM p JOIN u USING (bucket_length)),
s AS (SELECT *, (((doc_id % 1048573) * 40503) % 65537) % ((held + {shard - 1}) // {shard}) AS shard FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id, n_tokens) - 1 AS place, greatest(1, {budget} // greatest(bucket_length, 1)) AS fit FROM s)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(bucket_length AS BIGINT) AS bucket_length, CAST(shard AS INTEGER) AS shard,
  CAST(place // fit AS BIGINT) AS batch, CAST(place % fit AS INTEGER) AS slot FROM r
"""
