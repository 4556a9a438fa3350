"""N-gram Jaccard join: documents whose sets of word shingles (of WIDTH words) have a Jaccard similarity of at least 0.9;
callers may ask for another width or percentage.

Method: T-occurrence search with DivideSkip (merge the short inverted lists, binary-probe the long ones, keep documents that
reach the required overlap), run inside groups that an exact pigeonhole signature has brought together. The short lists are
merged by counting each record's occurrences in numpy; divide_skip() is the plain form with a heap, to which tests hold it.

1. Documents of equal sets form one class, known by a 64-bit hash of its set (node); one of its texts goes on.
2. A class emits signatures: its shingles are dealt by hash into k parts, and each part is one
   signature. Two sets of similarity t differ in at most (1-t)/(1+t) * (a+b) shingles, and k is above
   that number, so linked sets share a whole part. Signatures of unlike documents hardly ever meet,
   whatever lines, passages or words they share. Below BY_PARTS percent the parts would be of too few shingles; there the signatures
   are the shingles of the set's prefix, in an order that puts the frequent ones last: linked sets share one of these.
3. The classes of a signature meet at its smallest class, their lead; all that meet at one lead are a star. Linked classes are in
   a star together. A star that lies inside another one of a smaller lead is left out.
4. A star of more than NARROW blocks is signed anew: its sets' prefixes, rare shingles first, bring together only what may be linked.
   A star above the size of a block is dealt by hash into parts, and each two parts meet in one cell. DivideSkip finds all links of
   a cell. Classes that are in several stars together are compared at the smallest lead they share, so each link counts once.
5. A cell returns a row for each class: its links, weighted by the number of documents of the class at the other end, and the class
   that stands for its component within the cell. Components of these give the component of each class, and so of each document.

No pairs are listed, no group is collected into one task beyond two parts of a star, and nothing is dropped or capped; all links
of a group of n alike classes take n (n - 1) / 2 comparisons. Shingles are compared by 64-bit hash.

Links join two (document, set) pairs of different sets or documents: n_links of a row counts the others of its own class and those
of each class linked with it. It is null for a null doc_id; rows of one doc_id and one set are one document.

Defined cases: null, empty or wordless texts have an empty set and are linked with nothing; a null
doc_id is a document of its own id null; repeated rows keep one output row each, and rows of one doc_id with different sets are
documents of their own, which link by their sets alone; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import chunks, mixed, prepare, removed, saved, string_column, word_hashes, words

#: Links need 100 * intersection >= 90 * union.
PERCENT = 90
WIDTH = 3
#: Sizes in [CLASS**c, CLASS**(c+1)) share a number of parts.
CLASS = 1.5
#: Shingles in one part of a star, about.
BLOCK = 1 << 19
#: Stars of more parts than this are signed anew by rare shingles: a star of P parts sends each of its texts to P cells.
NARROW = 4
#: Sets that a task remembers as signed.
SEEN = 1 << 18
#: Percentages below this sign by prefix: the parts of their signatures would hold too few shingles to tell texts apart.
BY_PARTS = 88
#: Shingles looked at together for frequent ones, the sets that make one frequent there, and how many are told to every task (16
#: bytes each).
WINDOW, LOCAL, FREQUENT = 1 << 22, 3, 1 << 18
#: A prefix has one shingle more for so many of the set: linked sets then share as many more.
EXTRA = 16
#: Parts into which the rows of one join key are dealt where a key may hold a large share of them.
SALT = 8

#: Signatures of a set of shingle hashes.
Sign = Callable[[np.ndarray], np.ndarray]

_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in chunks(texts):
        starts, ends, row = words(data, offsets)
        h = word_hashes(data, starts, ends)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        joined = h * _A
        for i in range(1, width):
            shifted = np.zeros_like(h)
            shifted[:-i] = h[i:] if i < len(h) else 0
            joined = mixed(joined + _C) + shifted * _B
        joined = mixed(joined)
        for d in range(hi - lo):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    short = mixed(short * _A + h[i : i + 1] * _B)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def required(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap T of linked sets of these sizes: T >= p (a + b - T)."""
    return -(-percent * (a + b) // (100 + percent))


def _classes(size: int, percent: int) -> list[tuple[int, int]]:
    """(class, parts) under which a set of this size signs: its own, and the one below if a partner can be in it."""
    c = 0
    while round(CLASS ** (c + 1)) <= size:
        c += 1
    out = []
    for cls in (c, c - 1):
        if cls < 0:
            continue
        top = max(round(CLASS ** (cls + 1)), round(CLASS**cls) + 1) - 1  # the largest size of this class
        reach = top * 100 // percent  # the largest partner of that size
        if cls < c and size > reach:
            continue
        differing = (100 - percent) * (top + reach) // (100 + percent)
        out.append((cls, differing + 1))
    return out


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """One 64-bit signature for each part of the set, under each of its classes."""
    out = []
    for cls, parts in _classes(len(s), percent):
        part = (mixed(s ^ _C) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(s + _B)[order], dtype=np.uint64)))
        at = np.searchsorted(part[order], np.arange(parts + 1))
        out.append(mixed((sums[at[1:]] - sums[at[:-1]]) + np.arange(parts, dtype=np.uint64) * _A + np.full(1, cls + 1, np.uint64) * _C))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def prefix(s: np.ndarray, percent: int, often: Often) -> np.ndarray:
    """The first shingles of the set in one order over all sets, frequent ones last, marked with each of the set's classes.

    Linked sets a and b have met_by() of the smaller among these in common: where |a| - T + l of a and |b| - T + l of b are
    taken (T the required overlap, at least the percentage of either), l are shared."""
    keep = len(s) - -(-percent * len(s) // 100) + 1 + len(s) // EXTRA
    first = s if keep >= len(s) else s[np.lexsort((mixed(s), often.rank(s)))[:keep]]
    return np.concatenate([mixed(first + np.full(1, cls + 1, np.uint64) * _B) for cls, _ in _classes(len(s), percent)])


def met_by(size: Column, percent: int) -> Column:
    """How many prefix shingles at least a set of this size shares with any set that it is linked with."""
    return 1 + F.floor(F.ceil(size * percent / 100) / EXTRA)


class Often:
    """Frequent shingles with their place in the order of frequency; any others come before them."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        by = np.argsort(shingles)
        self.shingles, self.counts = shingles[by], counts[by]

    def rank(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.counts[at], 0)


def _frequent(batches: Iterator[pa.RecordBatch], width: int, window: int) -> Iterator[pa.RecordBatch]:
    """Shingles that are in LOCAL or more different sets among those of about `window` shingles, with their number of sets."""
    held: dict[int, np.ndarray] = {}
    size = 0

    def found() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= LOCAL
        return pa.record_batch({"shingle": pa.array(values[often].view(np.int64)), "n": pa.array(counts[often].astype(np.int64))})

    for batch in batches:
        for s in shingle_sets(string_column(batch, "text"), width):
            key = hash(s.tobytes())
            if len(s) and key not in held:
                held[key] = s
                size += len(s)
            if size >= window:
                yield found()
                held.clear()
                size = 0
    yield found()


def often_in(docs: DataFrame, width: int, most: int = FREQUENT, window: int = WINDOW) -> Often:
    """The shingles that windows of all texts name most often. They decide an order, which is exact whatever it names."""
    named = docs.select("text").mapInArrow(lambda it: _frequent(it, width, window), "shingle long, n long")
    named = saved(named.groupBy("shingle").agg(F.sum("n").alias("n")), "often")
    # One row for each frequency; the least one from which on no more than `most` shingles are named.
    held = sorted(named.groupBy("n").agg(F.count("*").alias("c")).toArrow().to_pylist(), key=lambda r: -r["n"])
    least, total = None, 0
    for r in held:
        total += r["c"]
        if total > most:
            break
        least = r["n"]
    rows = named.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    removed(named)
    return Often(rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def divide_skip(index: dict[int, list[int]], query: list[int], least: int, mu: float = 0.0085) -> dict[int, int]:
    """Records that are on at least `least` of the query's inverted lists, with their number of occurrences.

    The L longest lists are set apart; the others are heap-merged with a threshold of least - L, and
    each record that reaches it is probed in the long lists by binary search."""
    lists = sorted((index[x] for x in query if x in index), key=len, reverse=True)
    if least < 1:
        least = 1
    if len(lists) < least:
        return {}
    longest = len(lists[0])
    n_long = min(least - 1, int(least / (mu * np.log2(max(longest, 2)) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    need = least - n_long
    found: dict[int, int] = {}
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    place = [0] * len(short)
    while len(heap) >= need:
        record = heap[0][0]
        popped = []
        while heap and heap[0][0] == record:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            count = len(popped)
            for k, x in enumerate(long):
                j = bisect_left(x, record)
                if j < len(x) and x[j] == record:
                    count += 1
                elif count + n_long - k - 1 < least:
                    break
            if count >= least:
                found[record] = count
            for i in popped:
                place[i] += 1
                if place[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][place[i]], i))
        else:
            # No record below the need-th smallest head can reach the need: skip to it in each list.
            while len(popped) < need - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = heap[0][0]
            for i in popped:
                place[i] = bisect_left(short[i], goal, place[i] if short[i][place[i]] < goal else place[i])
                if place[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][place[i]], i))
    return found


class Lists:
    """Inverted lists over records in order of size: `owner` holds them one after the other, each ascending."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.own = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(self.n), self.sizes)[by]
        values, first = np.unique(flat[by], return_index=True)
        code = np.repeat(np.arange(len(values)), np.diff(np.append(first, len(flat))))
        #: Where each shingle of each record lies in `owner`, and where its list begins.
        self.place = np.empty(len(flat), np.int64)
        self.place[by] = np.arange(len(flat))
        self.start = np.empty(len(flat), np.int64)
        self.start[by] = first[code] if len(flat) else 0
        #: (list, record) as one sorted number for binary probes.
        self.keys = code * max(self.n, 1) + self.owner
        self.code = np.empty(len(flat), np.int64)
        self.code[by] = code

    def before(self, i: int, lo: int, least: int, mu: float = 0.0085) -> tuple[np.ndarray, np.ndarray]:
        """The records in [lo, i) on at least `least` of record i's lists, with their number of occurrences."""
        none = np.zeros(0, np.int64)
        a, b = self.own[i], self.own[i + 1]
        length = self.place[a:b] - self.start[a:b]  # of each list, up to record i
        on = np.flatnonzero(length)
        least = max(least, 1)
        if len(on) < least:
            return none, none
        on = on[np.argsort(-length[on], kind="stable")]
        n_long = min(least - 1, int(least / (mu * np.log2(max(int(length[on[0]]), 2)) + 1)))
        long, short = a + on[:n_long], a + on[n_long:]
        sizes = self.place[short] - self.start[short]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.start[short] - (ends - sizes), sizes)
        count = np.bincount(self.owner[at], minlength=i)
        found = np.flatnonzero(count >= least - n_long)
        found = found[found >= lo]
        count = count[found]
        for k in range(0, n_long, 16):
            if not len(found):
                return none, none
            goal = self.code[long[k : k + 16], None] * self.n + found
            hit = np.minimum(np.searchsorted(self.keys, goal), len(self.keys) - 1)
            count = count + (self.keys[hit] == goal).sum(0)
            alive = count + max(n_long - k - 16, 0) >= least
            found, count = found[alive], count[alive]
        return found, count


def cell_links(
    sets: list[np.ndarray], copies: list[int], parts: list[int], leads: list[list[int]], lead: int, across: bool, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """For each record of a cell the copies of the records linked with it, and a record of its component within the cell.

    Records that share a lead below this one are compared there. across: only records of different parts are compared here."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lists = Lists([sets[i] for i in order])
    weight, part = np.array(copies, np.int64)[order], np.array(parts, np.int64)[order]
    below = [[m for m in leads[i] if m < lead] for i in order]
    at: dict[int, list[int]] = {}
    for i, lower in enumerate(below):
        for m in lower:
            at.setdefault(m, []).append(i)
    elsewhere = {m: np.array(x) for m, x in at.items() if len(x) > 1}
    total, label = np.zeros(len(order), np.int64), np.arange(len(order))
    for i, size in enumerate(lists.sizes.tolist()):
        lo = int(np.searchsorted(lists.sizes[:i], -(-percent * size // 100)))
        if lo == i:
            continue
        found, count = lists.before(i, lo, required(size, int(lists.sizes[lo]), percent))
        both = size + lists.sizes[found]
        found = found[count * (100 + percent) >= percent * both]
        if across:
            found = found[part[found] != part[i]]
        lower = [elsewhere[m] for m in below[i] if m in elsewhere]
        if lower and len(found):
            found = found[~np.isin(found, np.concatenate(lower))]
        if len(found):
            total[i] += weight[found].sum()
            total[found] += weight[i]
            if (label[found] != label[i]).any():
                label[np.isin(label, np.append(label[found], label[i]))] = label[i]
    links, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    links[order], first[order] = total, np.array(order, np.int64)[label]
    return links, first


def _facts(batches: Iterator[pa.RecordBatch], width: int, sign: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Size, fingerprints and signatures of each row's set; a task signs equal sets once (again after SEEN other ones)."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        sizes, first, second, signs = [], [], [], []
        for s in shingle_sets(string_column(batch, "text"), width):
            sizes.append(len(s))
            first.append(int(np.sum(mixed(s + _A), dtype=np.uint64).view(np.int64)))
            second.append(int(np.sum(mixed(s ^ _C) * (s | np.uint64(1)), dtype=np.uint64).view(np.int64)))
            known = (first[-1], second[-1])
            if known in seen:
                signs.append(np.zeros(0, np.int64))
            else:
                signs.append(sign(s).view(np.int64))
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(known)
        at = np.concatenate(([0], np.cumsum([len(x) for x in signs]))).astype(np.int32)
        flat = np.concatenate(signs) if signs else np.zeros(0, np.int64)
        yield pa.record_batch(
            {
                "doc_id": string_column(batch, "doc_id"),
                "hash": string_column(batch, "hash"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "fp1": pa.array(first, pa.int64()),
                "fp2": pa.array(second, pa.int64()),
                "sigs": pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
            }
        )


def _dealt_join(many: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """many joined with few (one row for each key); a key's rows in many are dealt by `by` into SALT parts, and few is repeated."""
    salted = many.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    repeated = few.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(repeated, [key, "_s"], how).drop("_s")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of the edges with the smallest node that it is joined with.

    Rounds of hooking every node to the smallest label around it and then following labels of labels;
    the number of rounds grows with the logarithm of a component's width. Only counts reach the driver, and each
    round's table replaces the one before."""
    both = saved(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges"
    )
    label = saved(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("component")), "labels")
    while True:
        near = _dealt_join(both, label.select(F.col("node").alias("y"), "component"), "y", "x")
        around = near.groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        hooked = label.join(around, "node").select("node", "component", F.least("component", "near").alias("best"))
        # the old label's own node learns the better one, too: whole trees move at once
        moved = (
            hooked.select(F.col("component").alias("node"), "best")
            .union(hooked.select("node", "best"))
            .groupBy("node")
            .agg(F.min("best").alias("best"))
        )
        jump = moved.where("node <> best").select(F.col("node").alias("best"), F.col("best").alias("further"))
        new = _dealt_join(moved, jump, "best", "node", "left").select("node", F.coalesce("further", "best").alias("component"))
        new = saved(new, "labels")
        old = label.withColumnRenamed("component", "was")
        settled = new.join(old, "node").where(F.col("component") != F.col("was")).isEmpty()
        removed(label)
        label = new
        if settled:
            removed(both)
            return label


def _cells(percent: int, width: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, low, high = (x.as_py() for x in key)
        rows: dict[str, list] = {"node": [], "rep": [], "copies": [], "part": [], "leads": []}
        sets: list[np.ndarray] = []
        for batch in batches:
            for name, held in rows.items():
                held += string_column(batch, name).to_pylist()
            sets += shingle_sets(string_column(batch, "text"), width)
        links, first = cell_links(sets, rows["copies"], rows["part"], rows["leads"], lead, low != high, percent)
        yield pa.record_batch(
            {
                "node": pa.array(rows["node"], pa.int64()), "rep": pa.array(rows["rep"], pa.int64()), "links": pa.array(links),
                "to_node": pa.array([rows["node"][i] for i in first.tolist()], pa.int64()),
                "to_rep": pa.array([rows["rep"][i] for i in first.tolist()], pa.int64()),
            }
        )

    return run


def jaccard_components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, width: int = WIDTH, sign: Sign | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs."""
    return jaccard_links(docs, percent, block, width, sign).drop("n_links")


def jaccard_links(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, width: int = WIDTH, sign: Sign | None = None) -> DataFrame:
    """As jaccard_components(), with n_links: to how many other documents each row is linked."""
    owned = F.col("doc_id").isNotNull()
    return jaccard_groups(docs, percent, block, width, sign).select(
        "doc_id", "n_shingles", F.when(owned, F.coalesce("component", "doc_id")).alias("component_id"), F.when(owned, F.coalesce("links", F.lit(0))).alias("n_links")
    )


def _stars(signs: DataFrame) -> DataFrame:
    """lead, node and how often they met, of (node, sig): the nodes of a signature meet at its smallest one."""
    dealt = signs.repartition("sig")  # once, for both the leads and those that meet them
    lead = dealt.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("sig", "lead")
    return saved(dealt.join(lead.hint("shuffle_merge"), "sig").groupBy("lead", "node").agg(F.count("*").alias("met")), "stars")


def _met_enough(stars: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Stars by prefix without the sets that share too few shingles with all others together: they are linked with none."""
    enough = stars.groupBy("node").agg(F.sum("met").alias("met")).join(reps, "node").where(F.col("met") >= met_by(F.col("n_shingles"), percent))
    met = stars.join(enough.select("node"), "node", "left_semi")
    several = met.groupBy("lead").agg(F.count("*").alias("c")).where("c > 1").select("lead")
    kept = saved(met.join(several, "lead", "left_semi"), "stars")
    removed(stars)
    return kept


def _outermost(stars: DataFrame) -> DataFrame:
    """lead and node of the stars that aren't inside another one: the smallest other star that a lead is in has all of it, or it stays."""
    outer = stars.where("lead < node").groupBy(F.col("node").alias("lead")).agg(F.min("lead").alias("outer"))
    inside = stars.join(outer, "lead").join(stars.select(F.col("lead").alias("outer"), "node"), ["outer", "node"], "left_semi").groupBy("lead").agg(F.count("*").alias("inside"))
    whole = stars.groupBy("lead").agg(F.count("*").alias("c")).join(inside, "lead").where("inside = c").select("lead")
    return stars.join(whole, "lead", "left_anti").select("lead", "node")


def _parts(placed: DataFrame, block: int) -> DataFrame:
    """lead and parts of stars, by the shingles of their nodes."""
    return placed.groupBy("lead").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("parts"))


def _narrowed(slim: DataFrame, stars: DataFrame, reps: DataFrame, percent: int, width: int, block: int, narrow: int) -> DataFrame:
    """Stars of which those of more than `narrow` parts are signed anew, by their sets' rare shingles.

    Sets that are alike but not linked share signatures by chance of what they have in common; of their prefixes, frequent shingles last,
    linked sets share shingles, and alike ones don't. Only sets of wide stars are read again."""
    broad = saved(_parts(stars.join(reps.select("node", "n_shingles"), "node"), block).where(F.col("parts") > narrow), "broad")
    if broad.isEmpty():
        removed(broad)
        return stars
    crowd = reps.join(stars.join(broad, "lead", "left_semi").select("node").distinct(), "node", "left_semi")
    texts = slim.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("hash"), "text").where("rep is not null").dropDuplicates(["rep", "hash"])
    read = saved(crowd.select("node", "rep", "hash").hint("shuffle_merge").join(texts, ["rep", "hash"]).select("node", "text"), "crowd")
    often = slim.sparkSession.sparkContext.broadcast(often_in(read, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [prefix(s, percent, often.value).view(np.int64) for s in shingle_sets(string_column(batch, "text"), width)]
            at = np.concatenate(([0], np.cumsum([len(x) for x in signs]))).astype(np.int32)
            yield pa.record_batch({"node": string_column(batch, "node"), "sigs": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*signs, np.zeros(0, np.int64)])))})

    rare = _met_enough(_stars(read.mapInArrow(sign, "node long, sigs array<long>").select("node", F.explode("sigs").alias("sig"))), reps, percent)
    kept = stars.join(broad, "lead", "left_anti")
    both = saved(_outermost(saved(kept.unionByName(rare.select("lead", "node")).distinct(), "both")), "outermost")
    removed(broad, read, rare, stars)
    return both


def jaccard_groups(
    docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, width: int = WIDTH, sign: Sign | None = None, narrow: int = NARROW
) -> DataFrame:
    """doc_id, hash (xxhash64 of the text), n_shingles, component, links and first of every row of docs.

    sign: the signatures of a set, of which linked sets share one; without it they are exact ones of this module.
    first: the row's document is the one that stands for its component, which is that of the smallest doc_id (then of the
    smallest hash of the set, then of the text). Null for an empty set or a null doc_id."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_prefix = sign is None and percent < BY_PARTS
    if by_prefix:
        often = docs.sparkSession.sparkContext.broadcast(often_in(slim, width))
        sign = lambda s: prefix(s, percent, often.value)
    elif sign is None:
        sign = lambda s: signatures(s, percent)
    facts = slim.withColumn("hash", F.xxhash64("text")).mapInArrow(
        lambda it: _facts(it, width, sign), "doc_id long, hash long, n_shingles long, fp1 long, fp2 long, sigs array<long>"
    )
    facts = saved(facts.withColumn("node", F.xxhash64("fp1", "fp2", "n_shingles")).drop("fp1", "fp2"), "facts")
    # One class for each distinct set; the smallest doc_id stands for it, with one of its texts.
    owned = facts.where("n_shingles > 0 and doc_id is not null")
    one = owned.groupBy("doc_id", "node", "n_shingles").agg(F.min("hash").alias("hash"))
    reps = one.groupBy("node", "n_shingles").agg(F.min(F.struct("doc_id", "hash")).alias("r"), F.count("*").alias("copies"))
    reps = saved(reps.select("node", "n_shingles", F.col("r.doc_id").alias("rep"), F.col("r.hash").alias("hash"), "copies"), "reps")
    stars = _stars(facts.where("n_shingles > 0").select("node", F.explode("sigs").alias("sig")))
    if by_prefix:
        stars = _met_enough(stars, reps, percent)
    outermost = saved(_outermost(stars), "outermost")
    removed(stars)
    if not by_prefix:
        outermost = _narrowed(slim, outermost, reps, percent, width, block, narrow)
    members = saved(outermost.groupBy("node").agg(F.sort_array(F.collect_set("lead")).alias("leads")).join(reps, "node"), "members")
    removed(outermost)
    wide = saved(_parts(members.select("node", "n_shingles", F.explode("leads").alias("lead")), block).where("parts > 1"), "wide")

    # Every text is dealt once, at any size of the input; equal rows of one doc_id are one text.
    texts = slim.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("hash"), "text").where("rep is not null").dropDuplicates(["rep", "hash"])
    rows = members.select("node", "rep", "hash", "copies", "leads").hint("shuffle_merge").join(texts, ["rep", "hash"])
    rows = rows.select("node", "rep", "copies", "text", "leads", F.explode("leads").alias("lead"))
    rows = rows.join(F.broadcast(wide), "lead", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("node", "rep", "copies", "text", "leads", "part", "lead", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    cells = rows.groupBy("lead", "low", "high").applyInArrow(_cells(percent, width), "node long, rep long, links long, to_node long, to_rep long")
    found = saved(cells.where("links > 0"), "links")
    removed(members, wide)

    # Classes are ordered by (rep, node): two sets of one doc_id stay two classes, and the least one has the smallest doc_id.
    ends = found.where("node <> to_node").select(F.struct("rep", "node").alias("a"), F.struct(F.col("to_rep").alias("rep"), F.col("to_node").alias("node")).alias("b"))
    joined = components(ends, "a", "b").select(F.col("node.node").alias("node"), F.col("component.rep").alias("component"), F.col("component.node").alias("first"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.join(joined, "node", "left").join(counted, "node", "left").select(
        "node", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.when(F.coalesce("first", F.col("node")) == F.col("node"), F.struct("rep", "hash")).alias("best"),
    )
    rows = _dealt_join(facts.select("doc_id", "n_shingles", "node", "hash"), known, "node", "doc_id", "left")
    here = F.struct(F.col("doc_id").alias("rep"), "hash")
    first = F.when(F.col("doc_id").isNotNull() & F.col("component").isNotNull(), F.coalesce(F.col("best") == here, F.lit(False)))
    return rows.select("doc_id", "hash", "n_shingles", "component", "links", first.alias("first"))
