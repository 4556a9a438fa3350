"""Which provider's marks a page bears: a catalogue of patterns as a dimension table, and one pass over each page for all of them.

The literal parts of the catalogue's HTML patterns and globals make one automaton. It runs over many pages at once, each cut into lanes that
overlap by the longest literal, one byte of every lane at a step, in Arrow batches. Patterns that are more than their literal, and
names whose case counts, are then confirmed by an expression on the few pages that have the literal.

Defined cases: a null page or URL bears no marks; marks are found in any case, globals in their own; equal marks of several providers count
for each; the provider is that of the first pattern in the catalogue's order (URL before HTML before globals); a page may be of any length."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions.shipping import ship_package

#: Bytes of one lane, and bytes of pages that are run at once.
LANE, CHUNK = 4096, 1 << 23


def marks() -> list[tuple[int, str, str, str, float]]:
    """The catalogue, row by row: place in its order, provider, kind, pattern, confidence."""
    kinds = (("url", 1, rules.FINGERPRINT_URL), ("html", 2, rules.FINGERPRINT_HTML), ("global", 3, rules.FINGERPRINT_HTML))
    rows = [(f[0], kind, pattern, confidence) for kind, at, confidence in kinds for f in rules.FINGERPRINTS for pattern in f[at]]
    return [(i, *r) for i, r in enumerate(rows)]


def catalogue(spark: SparkSession) -> DataFrame:
    """The marks as a dimension: mark, provider, kind, pattern, confidence."""
    return spark.createDataFrame(marks(), "mark int, provider string, kind string, pattern string, confidence double")


def addresses(spark: SparkSession) -> DataFrame:
    """provider, api_hints: where its API is; {slug} stands for the board."""
    return spark.createDataFrame([(f[0], f[4]) for f in rules.FINGERPRINTS], "provider string, api_hints array<string>")


def literals(pattern: str) -> list[str]:
    """What a pattern's matches end with, one of these: its last group's choices, or what stands behind its last repetition."""
    last = re.search(r"\(([^()]*)\)$", pattern)
    parts = last[1].split("|") if last else [re.split(r"[*+]", pattern)[-1]]
    return [re.sub(r"\\(.)", r"\1", x) for x in parts]


def is_literal(pattern: str) -> bool:
    return not re.search(r"[\[\](){}*+?|^$]", pattern)


class Automaton:
    """Finds which of some literals stand in texts, in any case of ASCII letters. A state is a row of the table; each has the set of literals that end in it."""

    def __init__(self, words: list[str]) -> None:
        next_of: list[dict[int, int]] = [{}]
        ends: list[set[int]] = [set()]
        for i, word in enumerate(words):
            state = 0
            for byte in word.lower().encode():
                if byte not in next_of[state]:
                    next_of[state][byte] = len(next_of)
                    next_of.append({})
                    ends.append(set())
                state = next_of[state][byte]
            ends[state].add(i)
        table = np.zeros((len(next_of), 256), np.int32)
        fallback, waiting = [0] * len(next_of), deque([0])
        while waiting:
            state = waiting.popleft()
            if state:
                table[state] = table[fallback[state]]
                ends[state] |= ends[fallback[state]]  # nearer to the root, so it's whole by now
            for byte, to in next_of[state].items():
                fallback[to] = int(table[fallback[state], byte]) if state else 0
                table[state, byte] = to
                waiting.append(to)
        table[:, 65:91] = table[:, 97:123]
        self.words, self.table = words, table.ravel()
        self.hits = np.zeros((len(next_of), -(-len(words) // 64)), np.uint64)
        for state, found in enumerate(ends):
            for i in found:
                self.hits[state, i // 64] |= np.uint64(1 << (i % 64))
        self.marked = self.hits.any(1)
        self.overlap = max((len(w.encode()) for w in words), default=1) - 1

    def found(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text of the bytes between offsets the literals in it, as bits."""
        sizes = np.diff(offsets)
        lanes = np.maximum(-(-sizes // LANE), 1)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        low = offsets[owner] + np.maximum(piece * LANE - self.overlap, 0)
        high = np.minimum(offsets[owner] + (piece + 1) * LANE, offsets[owner + 1])
        order = np.argsort(low - high, kind="stable")  # the longest first: those that still run are the first ones
        low, owner = low[order], owner[order]
        length = high[order] - low
        running = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        state, bits = np.zeros(len(low), np.int32), np.zeros((len(low), self.hits.shape[1]), np.uint64)
        for step, n in enumerate(running.tolist()):
            now = self.table.take(state[:n] * 256 + data.take(low[:n] + step))
            state[:n] = now
            some = np.flatnonzero(self.marked.take(now))
            if len(some):
                bits[some] |= self.hits[now[some]]
        out = np.zeros((len(sizes), bits.shape[1]), np.uint64)
        np.bitwise_or.at(out, owner, bits)
        return out


def _literals_in(words: list[str]):
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(words)
        for part in pages:
            texts = pa.array(part, pa.large_string(), from_pandas=True).fill_null("")
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            out: list[list[int]] = []
            at = 0
            while at < len(texts):
                end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1), len(texts))
                bits = automaton.found(data, offsets[at : end + 1])
                named = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(words)]
                out += [np.flatnonzero(row).tolist() for row in named]
                at = end
            yield pd.Series(out, index=part.index, dtype=object)

    return run


def marks_of(url: Column, html: Column) -> Column:
    """The marks that a page bears, in the catalogue's order."""
    ship_package()
    rows = marks()
    words = sorted({w.lower() for _, _, kind, pattern, _ in rows if kind != "url" for w in literals(pattern)})
    place = {w: i for i, w in enumerate(words)}
    here = F.pandas_udf(_literals_in(words), "array<int>")(html)

    def confirmed(found: Column) -> Column:
        tests = []
        for mark, _, kind, pattern, _ in rows:
            if kind == "url":
                test = url.rlike(f"(?i){pattern}")
            else:
                own = [place[w.lower()] for w in literals(pattern)]
                test = F.array_contains(found, own[0]) if len(own) == 1 else F.arrays_overlap(found, F.array(*map(F.lit, own)))
                if kind == "global":
                    test = test & html.contains(literals(pattern)[0])
                elif not is_literal(pattern):
                    test = test & html.rlike(f"(?i){pattern}")
            tests.append(F.when(test, mark))
        return F.array_compact(F.array(*tests))

    return F.get(F.transform(F.array(here), confirmed), F.lit(0))


def with_fingerprint(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with marks (array of the catalogue's places), and of the first one fingerprint, fingerprint_kind, fingerprint_confidence and api_hints.

    The catalogue has some dozens of rows, so its joins are broadcasts of that size."""
    spark = pages.sparkSession
    marked = pages.withColumn("marks", marks_of(F.col(url), F.col(html))).withColumn("_first", F.get("marks", F.lit(0)))
    known = catalogue(spark).join(addresses(spark), "provider").select(
        F.col("mark").alias("_first"), F.col("provider").alias("fingerprint"), F.col("kind").alias("fingerprint_kind"), F.col("confidence").alias("fingerprint_confidence"), "api_hints"
    )
    return marked.join(F.broadcast(known), "_first", "left").drop("_first")


def evidence(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, provider, kind and pattern of every mark of every page."""
    borne = pages.select(key, F.explode(marks_of(F.col(url), F.col(html))).alias("mark"))
    return borne.join(F.broadcast(catalogue(pages.sparkSession)), "mark").select(key, "provider", "kind", "pattern")
