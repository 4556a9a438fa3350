"""Prefix trie of conversations: one row for each distinct sequence of first turns, with its members, children, leaves and what a cache of
prefixes would save below it.

Method: preorder-interval encoding. Distinct nodes are ranked lexicographically (siblings by the hash of their path), a subtree is the
interval from a node's place to the place of its last leaf, and leaves and savings of a subtree are differences of prefix sums over
that order, taken by all tasks in two passes (sums within ranges, then offsets of the ranges).

1. Turns move as (conversation, turn, digest, bytes), dealt by range and sorted; no text moves. Blocks of them are written with the
   bounded state that a block starts from: the first HEAD turns of the conversation at hand and of its donor, a count, and a path hash.
   With the states of the ranges before it each block gives its visits of nodes: a path hash is a polynomial of the digests, so it is
   carried over blocks and shifted where turns of another conversation go in front. A conversation may be longer than any task's memory.
2. Visits are summed up by node. A node whose parent has several children is a fork. The path of a leaf is told by its forks alone:
   a path with B forks needs B other conversations of 1 to B turns beside it, so B is below the root of twice the number of turns.
   Leaves are ranked by these keys.
3. The smallest and the largest leaf below a node make its interval; nodes are in preorder by (smallest leaf, depth).
4. Conversations that end in a node are hashed in order by range; a node that lies in several ranges is put together from pieces of digits.

Paths are compared by two 64-bit polynomials over 128-bit digests of (role, text).

Defined cases: turns are ordered by turn (null first), equal ones by digest; null role or text is empty; repeated rows are turns of their
own. Rows without a conv_id belong to no conversation and are left out. The donor of a negative conv_id is the next multiple of the
group below it. Other columns are ignored, whatever their names. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import prepare, removed, running, saved

#: A conversation takes its first turns, fewer than HEADS of them, from the one whose id is the next multiple of GROUP below its own.
GROUP, HEADS = 5, 9
HEAD = HEADS - 1
#: Turns of one block.
BLOCK = 1 << 12
#: Digits of ids put together in one row.
PIECE = 1 << 14
#: Parts into which the rows of one node or conversation are dealt in a join.
SALT = 16

_X = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_X_INVERSE = tuple(np.uint64(pow(int(x), -1, 1 << 64)) for x in _X)
_MASK = (1 << 64) - 1


def _power(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2**64, by squares."""
    n = n.astype(np.uint64)
    out, square = np.ones(len(n), np.uint64), np.full(1, base, np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * square, out)
        square = square * square
        n = n >> np.uint64(1)
    return out


def taken(conv: int, heads: int = HEADS) -> int:
    """How many first turns a conversation takes from its donor."""
    return zlib.crc32(str(conv).encode()) % heads


def donor(conv: int, group: int = GROUP) -> int:
    return conv - conv % group


@dataclass(frozen=True)
class State:
    """What is known before a row: the conversation at hand, its rows so far, their path hashes and first turns, and the donor's first turns."""

    conv: int | None = None
    count: int = 0
    path: tuple[int, int] = (0, 0)
    head: tuple[tuple[int, int, int], ...] = ()
    group: int | None = None
    given: tuple[tuple[int, int, int], ...] = field(default=())

    def then(self, more: State) -> State:
        """The state after both, where `more` began from nothing."""
        if more.conv is None:
            return self
        given = ((self.given if self.group == more.group else ()) + more.given)[:HEAD]
        if more.conv != self.conv:
            return replace(more, given=given)
        shift = [pow(int(x), self.count, 1 << 64) for x in _X]
        path = tuple((a + s * b) & _MASK for a, s, b in zip(self.path, shift, more.path, strict=True))
        return State(self.conv, self.count + more.count, path, (self.head + more.head)[:HEAD], self.group, given)


def hashed(turns: tuple[tuple[int, int, int], ...]) -> list[tuple[int, int]]:
    """The path hash of each prefix of a few turns, the empty one first."""
    out = [(0, 0)]
    for i, (a, b, _) in enumerate(turns):
        out.append(tuple((out[-1][j] + d * pow(int(_X[j]), i + 1, 1 << 64)) & _MASK for j, d in enumerate((a, b))))
    return out


class Block:
    """Consecutive sorted turns: conversation, two halves of the digest, bytes of the text."""

    def __init__(self, conv: np.ndarray, digest: np.ndarray, size: np.ndarray) -> None:
        self.conv, self.size = conv, size
        self.digest = np.frombuffer(digest.tobytes(), np.uint64).reshape(-1, 2)
        self.starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        self.ends = np.append(self.starts[1:], len(conv))

    def first(self, k: int) -> tuple[tuple[int, int, int], ...]:
        """The first turns of the k-th conversation in this block."""
        a, b = self.starts[k], min(self.ends[k], self.starts[k] + HEAD)
        return tuple(zip(*self.digest[a:b].T.tolist(), self.size[a:b].tolist(), strict=True))

    def paths(self, before: np.ndarray) -> list[np.ndarray]:
        """Both path hashes of each row within its conversation, `before` rows of which lie in front of its first row here."""
        where, length = np.arange(len(self.conv)), self.ends - self.starts
        out = []
        for j, (x, inverse) in enumerate(zip(_X, _X_INVERSE, strict=True)):
            sums = np.cumsum(self.digest[:, j] * _power(x, where), dtype=np.uint64)
            base = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
            # Row s of the block is turn before + 1 of its conversation.
            shift = _power(inverse, self.starts) * _power(x, before + 1)
            out.append((sums - np.repeat(base, length)) * np.repeat(shift, length))
        return out

    def state(self, group: int) -> State:
        last = len(self.starts) - 1
        conv, zeros = int(self.conv[-1]), np.zeros(len(self.starts), np.int64)
        paths = self.paths(zeros)
        at = int(np.searchsorted(self.conv[self.starts], donor(conv, group)))
        found = at <= last and int(self.conv[self.starts[at]]) == donor(conv, group)
        return State(
            conv, int(self.ends[last] - self.starts[last]), (int(paths[0][-1]), int(paths[1][-1])), self.first(last),
            donor(conv, group), self.first(at) if found else (),
        )


def _blocks(batches: Iterator[pa.RecordBatch], group: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one range's sorted rows, each with the state before it within the range; `next` is the conversation of the row behind it."""
    part, seq, state = TaskContext.get().partitionId(), 0, State()
    held: list[pa.RecordBatch] = []

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seq, state, held
        table = pa.Table.from_batches(held).combine_chunks()
        n, at = len(table), 0
        while n - at > block or (final and at < n):
            piece = table.slice(at, block)
            conv = piece["conv_id"].to_numpy()
            digest = np.frombuffer(b"".join(piece["digest"].to_pylist()), np.uint8)
            made = Block(conv, digest, piece["size"].to_numpy())
            at += len(piece)
            lists = {k: pa.ListArray.from_arrays(pa.array([0, len(conv)], pa.int32()), pa.array(v)) for k, v in (("conv", conv), ("size", made.size))}
            after = int(table["conv_id"][at].as_py()) if at < n else None
            before, state = state, state.then(made.state(group))
            yield pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "next": pa.array([after], pa.int64()), "digest": pa.array([digest.tobytes()], pa.binary()),
                    "before": pa.array([pickle.dumps(before)], pa.binary()), "after": pa.array([pickle.dumps(state) if after is None else None], pa.binary()),
                    "first": pa.array([int(conv[0])], pa.int64()), **lists,
                }
            )
            seq += 1
        held = table.slice(at).to_batches()

    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size > 4 * block:
            yield from flush(False)
            size = sum(len(b) for b in held)
    if held:
        yield from flush(True)


_BLOCKS = "part int, seq long, next long, digest binary, before binary, after binary, first long, conv array<long>, size array<long>"
_VISITS = "is_end boolean, conv_id long, depth long, n1 long, n2 long, p1 long, p2 long, size long"


def visits_of(block: Block, state: State, following: int | None, group: int, heads: int) -> dict[str, np.ndarray]:
    """The nodes that a block's turns reach, root and borrowed turns of conversations that begin in it included, and the ends of those that end in it."""
    convs = block.conv[block.starts].tolist()
    n = len(convs)
    goes_on = n > 0 and convs[0] == state.conv
    before = np.zeros(n, np.int64)
    before[0] = state.count if goes_on else 0
    paths = block.paths(before)
    if goes_on:
        end = block.ends[0]
        for j in range(2):
            paths[j][:end] += np.uint64(state.path[j])
    pos = np.arange(len(block.conv)) - np.repeat(block.starts - before, block.ends - block.starts) + 1
    given_by, given = state.group, state.given
    skip, borrowed = np.zeros(n, np.int64), np.zeros(n, np.int64)
    front, left_out = np.zeros((n, 2), np.uint64), np.zeros((n, 2), np.uint64)
    rows: list[tuple] = []
    for k, conv in enumerate(convs):
        of = donor(conv, group)
        if given_by != of:
            given_by, given = of, ()
        own = ((state.head if goes_on and k == 0 else ()) + block.first(k))[:HEAD]
        if conv == of:  # the donor itself: its own turns, all of them
            given, h = own, 0
        else:
            h = taken(conv, heads)
        head = given[:h] if conv != of else ()
        at = hashed(head)
        skip[k], borrowed[k], front[k] = h, len(head), at[-1]
        left_out[k] = hashed(own[:h])[-1]
        if not (goes_on and k == 0):
            rows.append((False, conv, 0, 0, 0, 0, 0, 0))
            rows += [(False, conv, d + 1, *at[d + 1], *at[d], head[d][2]) for d in range(len(head))]
    length = block.ends - block.starts
    own = pos > np.repeat(skip, length)
    depth = pos + np.repeat(borrowed - skip, length)
    ids, parents = [], []
    for j, (x, inverse) in enumerate(zip(_X, _X_INVERSE, strict=True)):
        # The turns behind those left out, moved to their new depth.
        shift = _power(x, borrowed) * _power(inverse, skip)
        here = np.repeat(front[:, j], length) + np.repeat(shift, length) * (paths[j] - np.repeat(left_out[:, j], length))
        ids.append(here)
        parents.append(here - block.digest[:, j] * _power(x, np.maximum(depth, 0)))
    # A conversation ends with its last own turn, or where nothing is left of it with the last one borrowed.
    ending = np.array([k for k in range(n) if k + 1 < n or following != convs[k]], np.int64)
    last = block.ends[ending] - 1
    done = [np.where(own[last], ids[j][last], front[ending, j]) for j in range(2)]
    some = np.array(rows, dtype=object).reshape(-1, 8)
    zeros = np.zeros(len(ending), np.int64)

    def column(i: int, tail: np.ndarray, ends: np.ndarray, kind: type) -> np.ndarray:
        out = np.concatenate((some[:, i].astype(kind), tail, ends))
        return out.view(np.int64) if kind is np.uint64 else out

    return {
        "is_end": column(0, np.zeros(int(own.sum()), bool), np.ones(len(ending), bool), bool),
        "conv_id": column(1, block.conv[own], np.array(convs, np.int64)[ending], np.int64),
        "depth": column(2, depth[own], zeros, np.int64),
        "n1": column(3, ids[0][own], done[0], np.uint64), "n2": column(4, ids[1][own], done[1], np.uint64),
        "p1": column(5, parents[0][own], zeros.view(np.uint64), np.uint64), "p2": column(6, parents[1][own], zeros.view(np.uint64), np.uint64),
        "size": column(7, block.size[own], zeros, np.int64),
    }


def visits(turns: DataFrame, group: int = GROUP, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """Each rebuilt conversation's nodes (is_end false; the root at depth 0), and one row with is_end for the node in which it ends; written."""
    spark = turns.sparkSession
    prepare(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    blocks = saved(ranged.mapInArrow(lambda it: _blocks(it, group, block), _BLOCKS), "turns")

    # One row for each range: its first conversation and its state. The state before a range is that of all ranges before it.
    ranges = blocks.groupBy("part").agg(F.min_by("first", "seq").alias("first"), F.max("after").alias("after")).orderBy("part").collect()
    before: dict[int, State] = {}
    state = State()
    for r in ranges:
        before[r["part"]] = state
        state = state.then(pickle.loads(r["after"]))
    follows = {a["part"]: b["first"] for a, b in zip(ranges, ranges[1:], strict=False)}
    known = spark.sparkContext.broadcast((before, follows))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, firsts = known.value
        for batch in batches:
            for row in batch.to_pylist():
                made = Block(np.array(row["conv"], np.int64), np.frombuffer(row["digest"], np.uint8), np.array(row["size"], np.int64))
                at = states[row["part"]].then(pickle.loads(row["before"]))
                behind = row["next"] if row["after"] is None else firsts.get(row["part"])
                yield pa.record_batch({k: pa.array(v) for k, v in visits_of(made, at, behind, group, heads).items()})

    found = saved(blocks.mapInArrow(emit, _VISITS), "visits")
    removed(blocks)
    return found


def _dealt(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """many joined with few (one row for each key); a key's rows in many are dealt by `by` into SALT parts, and few is repeated."""
    salted = many.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    repeated = few.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.hint("shuffle_merge").join(repeated, [*keys, "_s"]).drop("_s")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (n1, n2, conv_id): the digest of each node that lies within this range, and pieces of the first and the last one."""
    out: dict[str, list] = {"n1": [], "n2": [], "from": [], "piece": [], "digest": []}

    def add(node: tuple[int, int], begins: int, piece: bytes | None, digest: str | None) -> None:
        for name, v in zip(out, (*node, begins, piece, digest), strict=True):
            out[name].append(v)

    def batch_of() -> pa.RecordBatch:
        made = pa.record_batch({"n1": pa.array(out["n1"], pa.int64()), "n2": pa.array(out["n2"], pa.int64()), "from": pa.array(out["from"], pa.int64()), "piece": pa.array(out["piece"], pa.binary()), "digest": pa.array(out["digest"], pa.string())})
        for v in out.values():
            v.clear()
        return made

    node, held, begins, size, first = None, [], 0, 0, True
    state = hashlib.sha256()
    for batch in batches:
        n1, n2, convs = (batch.column(i).to_pylist() for i in range(3))
        for a, b, c in zip(n1, n2, convs, strict=True):
            if (a, b) != node:
                if node is not None:
                    if first:  # may have begun in the range before
                        add(node, begins, ",".join(held).encode(), None)
                    else:
                        state.update(",".join(held).encode())
                        add(node, begins, None, state.hexdigest())
                    first = False
                node, held, begins, size = (a, b), [], c, 0
                state = hashlib.sha256()
                kept: list[tuple[int, bytes]] = []
            elif size >= PIECE:
                text = ",".join(held)
                if first:
                    add(node, begins, text.encode(), None)
                else:
                    # May be the last node of the range: its pieces are kept as well, up to where it is known to end here.
                    kept.append((begins, text.encode()))
                    if len(kept) >= 64:
                        first = True
                        for at, piece in kept:
                            add(node, at, piece, None)
                        kept = []
                    else:
                        state.update(text.encode() + b",")
                held, begins, size = [], c, 0
            held.append(str(c))
            size += 21
        yield batch_of()
    if node is not None:
        if not first:
            for at, piece in kept:
                add(node, at, piece, None)
        add(node, begins, ",".join(held).encode(), None)
        yield batch_of()


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of nodes from their pieces in order, one piece at a time."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for a, b, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, b) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(piece)
        yield pa.record_batch({"n1": pa.array([x[0] for x in done], pa.int64()), "n2": pa.array([x[1] for x in done], pa.int64()), "digest": pa.array([x[2] for x in done], pa.string())})
    if node is not None:
        yield pa.record_batch({"n1": pa.array([node[0]], pa.int64()), "n2": pa.array([node[1]], pa.int64()), "digest": pa.array([state.hexdigest()])})


def end_digests(ends: DataFrame) -> DataFrame:
    """n1, n2, ends_sha256 of the ascending conversations that end in a node; a node may have any share of them."""
    ranged = ends.select("n1", "n2", "conv_id").repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id")
    found = saved(ranged.mapInArrow(_digests, "n1 long, n2 long, from long, piece binary, digest string"), "digests")
    pieces = found.where("digest is null").repartition("n1", "n2").sortWithinPartitions("n1", "n2", "from").select("n1", "n2", "piece")
    whole = found.where("digest is not null").select("n1", "n2", "digest")
    return whole.union(pieces.mapInArrow(_joined_digests, "n1 long, n2 long, digest string")).withColumnRenamed("digest", "ends_sha256")


def trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    node = ["n1", "n2"]
    seen = visits(turns, group, heads, block)
    passing = seen.where("not is_end")
    nodes = seen.groupBy(*node).agg(
        F.count_if(~F.col("is_end")).alias("n_convs"), F.min(F.when(~F.col("is_end"), F.col("conv_id"))).alias("conv_id"), F.max("depth").alias("depth"), F.max("size").alias("size"),
        F.max(F.when(F.col("depth") > 0, F.struct("p1", "p2"))).alias("p"),
    )
    nodes = saved(nodes.select(*node, "n_convs", "conv_id", "depth", "size", "p.p1", "p.p2"), "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("_1"), F.col("p2").alias("_2")).agg(F.count("*").alias("n_children"), F.min(F.struct(*node)).alias("one"))
    below = saved(below, "children")
    single = below.where("n_children = 1").select(F.col("one.n1").alias("n1"), F.col("one.n2").alias("n2"), F.lit(True).alias("single"))
    counts = below.select(F.col("_1").alias("n1"), F.col("_2").alias("n2"), "n_children")
    facts = nodes.join(counts, node, "left").join(single, node, "left")
    facts = saved(facts.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("fork", (F.col("depth") > 0) & F.col("single").isNull()).drop("single"), "facts")
    removed(nodes, below)

    # Only children look their parent up one to one; of a node's many children each one has a share of it.
    parents = facts.where("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    forked = _dealt(facts.where("fork"), parents.where("_n > 1"), ["p1", "p2"], "n1").drop("_n")
    single = facts.where("not fork and depth > 0").join(parents.where("_n = 1"), ["p1", "p2"]).drop("_n")
    root = facts.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = [*node, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "size"]
    named = forked.select(*columns).union(single.select(*columns)).union(root.select(*columns))

    # The path of each leaf by its forks; the smallest member of a leaf stands for it.
    forks = _dealt(passing.select("conv_id", "depth", *node), facts.where("fork").select(*node), node, "conv_id")
    keys = forks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", *node))).alias("key")).select("conv_id", F.transform("key", lambda x: F.struct(x["n1"], x["n2"])).alias("key"))
    leaves = facts.where("n_children = 0").select("conv_id").join(keys, "conv_id", "left")
    leaves = leaves.withColumn("key", F.coalesce("key", F.array().cast(keys.schema["key"].dataType)))
    ranked = running(leaves, ["key"], "leaves", [], ["conv_id"]).withColumnRenamed("_at", "leaf")

    # The interval of leaves below each node, then preorder.
    spans = _dealt(passing.select("conv_id", "depth", *node), ranked, ["conv_id"], "depth").groupBy(*node).agg(F.min("leaf").alias("first"), F.max("leaf").alias("last"))
    placed = named.join(spans, node).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    order = saved(running(placed, ["first", "depth"], "preorder", ["saved", "leaves"]), "order")
    closing = order.where("n_children = 0").select(F.col("first").alias("last"), F.col("_saved").alias("saved_end"), F.col("_leaves").alias("leaves_end"))
    tree = _dealt(order, closing, ["last"], "n1").select(
        *node, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_end") - F.col("_saved") + F.col("saved")).alias("saved_tokens"),
    )
    nothing = F.lit(hashlib.sha256().hexdigest())
    whole = tree.join(end_digests(seen.where("is_end")), node, "left").drop(*node)
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)

ORACLE = f"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, w, {_CRC} % 9 AS h FROM own),
built AS (SELECT h.c, list_concat(coalesce(d.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN own d ON d.c = h.c - h.c % 5),
visits AS (SELECT c, w[1:d] AS p, d, len(w) = d AS ends FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM built)),
nodes AS (
  SELECT md5(CAST(p AS VARCHAR)) AS id, any_value(md5(CAST(p[1:d - 1] AS VARCHAR))) AS up, d, any_value(p) AS p, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM visits GROUP BY p, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
facts AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(p[d].t)) END AS own FROM nodes n LEFT JOIN kids k ON k.up = n.id),
below AS (SELECT md5(CAST(p[1:top] AS VARCHAR)) AS id, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT p, n_children, own, unnest(range(0, d + 1)) AS top FROM facts) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, CASE WHEN f.d > 0 THEN u.conv_id END AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN below b USING (id) LEFT JOIN nodes u ON f.d > 0 AND u.id = f.up
"""
