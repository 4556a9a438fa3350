"""Ranked lexical search: the k documents of highest score for each item, by WAND over document shards.

Method: documents become shards, each an inverted index of its own (terms by 64-bit hash, documents and frequencies by term), written once.
A first pass over term lists sums document frequencies for the terms asked for; a second one runs WAND in each shard: lists are held in
order of their current document, the pivot is the first list at which the sum of the terms' highest impacts in this shard reaches the
heap's threshold, lists before it jump to the pivot's document, and only documents on which the lists meet are scored. A task carries
its heaps from shard to shard, so thresholds rise and whole shards fall away; the tasks' heaps are merged by a window that keeps the k best.

Weights: a term's w is floor(1000 ln((2N + 2) / (2 df + 1))), its impact w * ((10**9 tf) div (1000 tf + 8 m)) with
m = 25 + (75 n N) div L. N documents with a term, L their terms, n a document's terms. Equal scores are in order of doc_id.

Items are asked in blocks of at most BLOCK bytes of text, so that what a task is told stays bounded however many there are.

Defined cases: null or termless texts aren't counted and never found; repeated rows of documents are documents of their own; a null doc_id
comes last among equal scores; repeated rows of an item are one item, different texts of one item_id are ranked each by itself, a null
item_id is an item; items without a found term have no rows; other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.shared import chunks, prepare, runs, saved, string_column, word_hashes

#: Documents asked for.
TOP = 10
#: Terms, with repeats, from which on a shard is closed.
SHARD = 1 << 18
#: Shards held at once by a task that writes or reads them, whatever it has of them.
GROUP = 4
#: Bytes of items told to every task at once.
BLOCK = 1 << 23

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_INDEX = "n_docs long, n_terms long, doc_ids array<long>, lengths array<int>, terms array<long>, starts array<int>, docs array<int>, counts array<int>"


def terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of consecutive rows: the first one's place, the row of each term from there, and the terms' hashes."""
    for lo, _, data, offsets in chunks(texts):
        starts, ends, row = runs(_TERM[data], offsets)
        yield lo, row, word_hashes(data, starts, ends)


def _one(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _shard(ids: list, rows: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """The inverted index of documents that are numbered as `rows` has them."""
    row, h = np.concatenate(rows), np.concatenate(hashes)
    have, row = np.unique(row, return_inverse=True)  # documents without a term fall away
    by = np.lexsort((row, h))
    row, h = row[by], h[by]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    counts, docs, of = np.diff(np.append(new, len(h))), row[new], h[new]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return pa.record_batch(
        {
            "n_docs": pa.array([len(have)]), "n_terms": pa.array([len(h)]),
            "doc_ids": _one(pa.array([ids[i] for i in have.tolist()], pa.int64())), "lengths": _one(np.bincount(row, minlength=len(have)).astype(np.int32)),
            "terms": _one(of[first].view(np.int64)), "starts": _one(np.append(first, len(of)).astype(np.int32)),
            "docs": _one(docs.astype(np.int32)), "counts": _one(counts.astype(np.int32)),
        }
    )


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    ids: list = []
    rows: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    size = 0
    for batch in batches:
        base = len(ids)
        ids += string_column(batch, "doc_id").to_pylist()
        for lo, row, h in terms(string_column(batch, "text")):
            rows.append(row + base + lo)
            hashes.append(h)
            size += len(h)
        if size >= most:
            yield from _split(ids, rows, hashes, most)
            ids, rows, hashes, size = [], [], [], 0
    if size:
        yield from _split(ids, rows, hashes, most)


def _split(ids: list, rows: list[np.ndarray], hashes: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Shards of the gathered documents, each closed where it holds `most` terms; a longer document is a shard of its own."""
    row, h = np.concatenate(rows), np.concatenate(hashes)
    cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    at = 0
    while at < len(row):
        k = int(np.searchsorted(cut, at + most, "right")) - 1
        end = int(cut[k]) if cut[k] > at else (int(cut[k + 1]) if k + 1 < len(cut) else len(row))
        if at + most >= len(row):
            end = len(row)
        yield _shard(ids, [row[at:end]], [h[at:end]])
        at = end


def index(docs: DataFrame, most: int = SHARD) -> DataFrame:
    """The shards of documents (doc_id, text), one row each, written."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(slim.mapInArrow(lambda it: _shards(it, most), _INDEX), "shards", GROUP)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Query:
    """Items as counts of their terms, over one vocabulary of sorted hashes."""

    def __init__(self, items: pa.Table) -> None:
        texts = items["text"].combine_chunks()
        of: list[Counter] = [Counter() for _ in range(len(items))]
        for lo, row, h in terms(texts):
            for r, x in zip(row.tolist(), h.tolist(), strict=True):
                of[lo + r][x] += 1
        self.ids = items["item_id"].to_pylist()
        self.vocabulary = np.array(sorted(set().union(*of)), np.uint64)
        place = {x: i for i, x in enumerate(self.vocabulary.tolist())}
        self.items = [[(place[x], n) for x, n in c.items()] for c in of]
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.n_docs = self.n_terms = 0


def _found(vocabulary: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a vocabulary are among a shard's sorted terms, and where."""
    if not len(own) or not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, vocabulary), len(own) - 1)
    here = np.flatnonzero(own[at] == vocabulary)
    return here, at[here]


def _array(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for i in range(len(batch)):
            here, at = _found(vocabulary, _array(string_column(batch, "terms"), i).view(np.uint64))
            starts = _array(string_column(batch, "starts"), i)
            total[here] += starts[at + 1] - starts[at]
    some = np.flatnonzero(total)
    yield pa.record_batch({"term": pa.array(some), "df": pa.array(total[some])})


def wand(lists: list[list], end: int, ids: list, heap: list[tuple], k: int) -> None:
    """Puts the k best documents of a shard among those of a heap of (score, key, doc_id).

    lists: [current document, place, documents, impacts, highest impact] of each term; a list of documents ends with `end`. A document
    that reaches the heap's lowest score may still win by its doc_id, so the pivot is where that score is reached."""
    least = heap[0][0] if len(heap) == k else 1
    while True:
        lists.sort(key=_current)
        bound, pivot = 0, end
        for x in lists:
            bound += x[4]
            if bound >= least:
                pivot = x[0]
                break
        if pivot == end:
            return
        if lists[0][0] == pivot:
            score = 0
            for x in lists:
                if x[0] != pivot:
                    break
                at = x[1]
                score += x[3][at]
                x[1] = at = at + 1
                x[0] = x[2][at]
            if score >= least:
                doc = ids[pivot]
                entry = (score, -math.inf if doc is None else -doc, doc)
                if len(heap) < k:
                    heappush(heap, entry)
                    least = heap[0][0] if len(heap) == k else 1
                elif entry[:2] > heap[0][:2]:
                    heapreplace(heap, entry)
                    least = heap[0][0]
        else:
            for x in lists:
                if x[0] >= pivot:
                    break
                x[1] = at = bisect_left(x[2], pivot, x[1])
                x[0] = x[2][at]


def _current(x: list) -> int:
    return x[0]


def _search(batches: Iterator[pa.RecordBatch], query: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    asked: Query = query.value
    heaps: list[list[tuple]] = [[] for _ in asked.items]
    for batch in batches:
        for i in range(len(batch)):
            here, at = _found(asked.vocabulary, _array(string_column(batch, "terms"), i).view(np.uint64))
            if not len(here):
                continue
            starts, docs, counts = (_array(string_column(batch, c), i) for c in ("starts", "docs", "counts"))
            ids = string_column(batch, "doc_ids")[i].as_py()
            m = np.array([25 + 75 * n * asked.n_docs // asked.n_terms for n in _array(string_column(batch, "lengths"), i).tolist()], np.int64)
            held = {}
            for term, a, b in zip(here.tolist(), starts[at].tolist(), starts[at + 1].tolist(), strict=True):
                tf = counts[a:b].astype(np.int64)
                impacts = asked.weights[term] * ((10**9 * tf) // (1000 * tf + 8 * m[docs[a:b]]))
                held[term] = ([*docs[a:b].tolist(), len(ids)], impacts.tolist(), int(impacts.max()))
            for item, heap in zip(asked.items, heaps, strict=True):
                lists = []
                for term, n in item:
                    got = held.get(term)
                    if got is not None:
                        documents, impacts, highest = got
                        lists.append([documents[0], 0, documents, impacts if n == 1 else [n * x for x in impacts], n * highest])
                if lists:
                    wand(lists, len(ids), ids, heap, k)
    rows = [(q, asked.ids[q], doc, score) for q, heap in enumerate(heaps) for score, _, doc in heap if score > 0]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    yield pa.record_batch({name: pa.array(list(c), pa.int64()) for name, c in zip(("q", "item_id", "doc_id", "score"), columns, strict=True)})


def search(shards: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text)."""
    spark = shards.sparkSession
    prepare(spark)
    size = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    found = []
    for b in range(blocks):
        query = Query(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow())
        query.n_docs, query.n_terms = size["n"] or 0, size["l"] or 0
        words = query.vocabulary
        listed = shards.select("terms", "starts").mapInArrow(lambda it, words=words: _frequencies(it, words), "term long, df long")
        held = listed.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        for term, df in zip(held["term"].to_pylist(), held["df"].to_pylist(), strict=True):
            query.weights[term] = weight(query.n_docs, df)
        told = spark.sparkContext.broadcast(query)
        best = shards.mapInArrow(lambda it, told=told: _search(it, told, k), "q long, item_id long, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found.append(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found)


ORACLE = r"""
WITH words AS (SELECT item_id, doc_id, t FROM (
    SELECT NULL::BIGINT AS item_id, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT item_id, NULL, NULL, text FROM (SELECT DISTINCT item_id, text FROM benchmark)) x,
  LATERAL (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t)),
posting AS (SELECT doc_id, t, count(*) AS tf FROM words WHERE doc_id IS NOT NULL GROUP BY doc_id, t),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
term AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, whole GROUP BY t, n_docs),
asked AS (SELECT item_id, t, count(*) AS c FROM words WHERE item_id IS NOT NULL GROUP BY item_id, t),
scored AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN term USING (t) JOIN posting USING (t) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
