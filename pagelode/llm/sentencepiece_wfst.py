"""SentencePiece encoding and decoding by a weighted transducer.

Method: the model file compiles into three machines.
Normaliser (`Rewriter`): a trie over bytes whose arcs end in replacements; from each place the longest one is
taken, else the character is copied. Blanks then become U+2581, one in front.
Pieces (`PieceTransducer.trie`): a trie over characters whose final states emit a piece.
Fallback (`PieceTransducer.fallback`): emits the bytes of a character that isn't a piece, or the unknown piece.
Composing the last two with a normalised part gives a lattice over its characters, whose arcs are made when a
place is settled (`_arcs`). The path of least weight in the tropical semiring (min, +) is found by relaxing them.

For a unigram model an arc weighs minus the piece's score; places are settled from left to right, which any sign allows.
For a BPE model the weight depends on the piece before, too: 0 if merging the two pieces' characters by the model's
rules gives the two pieces again, infinite otherwise. Exactly one path of finite weight leads to each place, because a
merge across a border inside the whole would happen inside the two pieces alone, too; so one piece before is kept for each
place, and the path to the end is the result of the merges. There an arc's weight is found only when the arc is the least in
the queue (0 bounds it from below), of equals the one that ends last, until the end is settled.

User-defined pieces aren't rewritten. In a unigram model they're arcs of the library's own weight, in a BPE model
no merge crosses them, so the parts between them are composed apart.
Inputs are cut where no piece can reach across (before a blank that follows another character; around a line feed),
so each distinct part is composed once while it stays in a cache of bounded size.

Defined cases: a null or empty text has no ids; text that isn't in any piece becomes byte pieces (or the unknown piece in
a model without them); ids outside the vocabulary can't be decoded (ValueError); invalid byte sequences decode to U+FFFD
for each byte. Repeated rows are each encoded, rows with a null doc_id too; columns other than doc_id and the text are
dropped, so their names don't matter. Refused: BPE models with unused pieces, with characters that aren't pieces, and user-defined
pieces that hold blanks.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelode.llm.recent import Recent
from pagelode.llm.shared import prepare, string_column

BLANK = "▁"
#: Entries of the caches of parts and of pairs of pieces.
PARTS = 400_000
PAIRS = 1_000_000
#: What an unknown character costs beyond the worst piece of a unigram model.
UNKNOWN_COST = 10.0

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + size]
            i += size


class Rewriter:
    """The normaliser's machine: the model file's table of rewrites, and user-defined pieces that stay as they are.

    The table is a double array of 32-bit units (arcs by byte; a state's output is the place of its replacement, which ends
    with a zero byte) in front of the replacements."""

    def __init__(self, table: bytes, kept: list[str]) -> None:
        size = struct.unpack_from("<I", table)[0] if table else 0
        self.units = np.frombuffer(table, "<u4", size // 4, 4).tolist() if table else []
        self.replacements = table[4 + size :]
        self.kept = any_of(kept)
        self._known: dict[int, bytes] = {}

    def _replacement(self, place: int) -> bytes:
        if place not in self._known:
            self._known[place] = self.replacements[place : self.replacements.index(0, place)]
        return self._known[place]

    def _longest(self, data: bytes, i: int) -> tuple[int, bytes]:
        """End and replacement of the longest rewrite at i; the end is i if there's none."""
        units, end, place = self.units, i, 0
        state = _first_arc(units[0])
        for j in range(i, len(data)):
            state ^= data[j]
            unit = units[state]
            if unit & 0x800000FF != data[j]:
                break
            state ^= _first_arc(unit)
            if unit >> 8 & 1:
                end, place = j + 1, units[state] & 0x7FFFFFFF
        return end, self._replacement(place) if end > i else b""

    def _rewritten(self, text: str) -> str:
        if not self.units:
            return text
        data, out, i = text.encode(), [], 0
        while i < len(data):
            end, new = self._longest(data, i)
            if end == i:
                b = data[i]
                end = i + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
                new = data[i:end]
            out.append(new)
            i = end
        return b"".join(out).decode()

    def __call__(self, text: str) -> str:
        if self.kept is None:
            return self._rewritten(text)
        return "".join(x if k % 2 else self._rewritten(x) for k, x in enumerate(self.kept.split(text)))


def _first_arc(unit: int) -> int:
    """Where a state's arcs begin, relative to it."""
    return unit >> 10 << ((unit & 0x200) >> 6)


def any_of(texts: list[str]) -> re.Pattern | None:
    """A pattern, as a group, of the longest of some texts."""
    return re.compile("(" + "|".join(map(re.escape, sorted(texts, key=len, reverse=True))) + ")") if texts else None


class PieceTransducer:
    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True, squeeze: bool = False, rewrites: bytes = b"") -> None:
        self.pieces, self.bpe, self.dummy_prefix, self.squeeze = pieces, bpe, dummy_prefix, squeeze
        user = [p[0] for p in pieces if p[2] == USER]
        if any(" " in x or BLANK in x for x in user):
            raise ValueError("user-defined pieces with blanks aren't supported")
        self.rewriter = Rewriter(rewrites, user) if rewrites or user else None
        self.user = any_of(user) if bpe else None
        self.user_ids = {p[0]: i for i, p in enumerate(pieces) if p[2] == USER}
        self.weights = [-p[1] for p in pieces]
        self.trie: dict = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        normal = [p for p in pieces if p[2] == NORMAL]
        best = max((p[1] for p in normal), default=0.0)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == NORMAL or (kind == USER and not bpe):
                node = self.trie
                for ch in text:
                    node = node.setdefault(ch, {})
                node[""] = i
                if kind == NORMAL:
                    self.ids[text] = i
                else:
                    self.weights[i] = 0.1 - len(text.encode()) * best
            elif kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind == UNUSED and bpe:
                raise ValueError("a merge model with unused pieces isn't supported")
        self.worst = min((p[1] for p in normal), default=0.0)
        lone = {ch for p in pieces if p[2] == NORMAL for ch in p[0]} - self.ids.keys()
        if bpe and lone:
            raise ValueError("a merge model whose characters aren't all pieces isn't supported")
        inner = "".join(sorted({p[0] for p in pieces if p[2] in (NORMAL, USER) and len(p[0]) > 1}))
        # Parts end before a blank only if no piece holds one behind another character.
        self.cut_blank = not any(re.search(f"[^{BLANK}]{BLANK}", p[0]) for p in pieces if p[2] == NORMAL)
        self.cut_feed = "\n" not in inner
        self._part = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if self.cut_feed else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._pairs: dict[int, bool] = {}
        self._inner = Recent(PARTS)
        self._first = Recent(PARTS)
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str) -> PieceTransducer:
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, rules = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        return cls(pieces, trainer.get(3, 1) == 2, bool(rules.get(3, 1)), bool(rules.get(4, 1)), rules.get(2, b""))

    # composition and shortest path

    def merged(self, s: str) -> list[str]:
        """The characters of s after the model's merges: best piece first, leftmost of equals."""
        symbols = list(s)
        while len(symbols) > 1:
            best, where = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.pieces[i][1] > best):
                    best, where = self.pieces[i][1], k
            if where < 0:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def fallback(self, ch: str) -> list[int]:
        """What the fallback machine emits for a character."""
        return [self.byte_ids[b] for b in ch.encode()] if self.byte_ids else [self.unknown]

    def _arcs(self, s: str, i: int) -> list[tuple[int, int]]:
        """End and piece of the arcs from place i, shortest first; the fallback's arc has piece -1.

        A BPE model's characters are all pieces, so the fallback's arc is there only without another."""
        out, node, j, n = [], self.trie.get(s[i]), i, len(s)
        while node is not None:
            j += 1
            if "" in node:
                out.append((j, node[""]))
            node = node.get(s[j]) if j < n else None
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, -1))
        return out

    def shortest(self, s: str) -> list[int]:
        """Ids along the path of least weight through the lattice of a normalised part; -1 - k for the k-th character as unknown."""
        last, came = self._relaxed_bpe(s) if self.bpe else self._relaxed_unigram(s)
        out, j = [], len(s)
        while j:
            i = came[j]
            out.append(last[j] if last[j] >= 0 else -1 - i)
            j = i
        return out[::-1]

    def _relaxed_bpe(self, s: str) -> tuple[dict[int, int], dict[int, int]]:
        """The last piece of the best path to each settled place, and where it begins: the least arc first, until the end is settled."""
        n, pairs = len(s), self._pairs
        last: dict[int, int] = {0: -1}
        came: dict[int, int] = {}
        queue: list[tuple[int, int, int]] = []
        # Finite weights are all 0, so the queue orders arcs by their end alone: the last place first.
        i = 0
        while i < n:
            for j, piece in self._arcs(s, i):
                if j not in last:
                    heapq.heappush(queue, (-j, i, piece))
            while True:
                j, i, piece = heapq.heappop(queue)
                j = -j
                if j in last:
                    continue
                before = last[i]
                key = before << 20 | piece if before >= 0 else -1 - piece
                finite = piece < 0 or pairs.get(key)
                if finite is None:
                    finite = self._allowed(before, piece, key)
                if finite:
                    break
            last[j], came[j] = piece, i
            i = j
        return last, came

    def _allowed(self, before: int, piece: int, key: int) -> bool:
        """Whether the merges keep the border between two pieces, or (before < 0) make up the piece."""
        y = self.pieces[piece][0]
        known = self.merged(y) == [y] if before < 0 else self.merged(self.pieces[before][0] + y) == [self.pieces[before][0], y]
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[key] = known
        return known

    def _relaxed_unigram(self, s: str) -> tuple[list[int], list[int]]:
        """The last piece of the best path to each place, and where it begins."""
        n, weights, unknown = len(s), self.weights, UNKNOWN_COST - self.worst
        cost = [0.0] + [float("inf")] * n
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            for j, piece in self._arcs(s, i):
                weight = cost[i] + (weights[piece] if piece >= 0 else unknown)
                if weight < cost[j]:
                    cost[j], last[j], came[j] = weight, piece, i
        return last, came

    def _ids(self, part: str) -> list[int]:
        if self.user is not None:
            pieces = self.user.split(part)
            return [x for k, p in enumerate(pieces) for x in ([self.user_ids[p]] if k % 2 else self._plain_ids(p))]
        return self._plain_ids(part)

    def _plain_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for x in self.shortest(part):
            if x >= 0:
                out.append(x)
            else:
                new = self.fallback(part[-1 - x])
                if self.byte_ids or out[-1:] != new:
                    out += new
        return out

    def _packed(self, part: str, cache: Recent, key: str) -> bytes:
        ids = self._ids(part)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        cache.put(key, packed)
        return packed

    # whole texts

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian numbers of 32 bits."""
        if not text:
            return b""
        if self.rewriter is not None:
            text = self.rewriter(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x).rstrip(" " + BLANK)
        if not text:
            return b""
        plain = BLANK not in text
        if not self.cut_blank:
            return self._packed((BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK), Recent(PARTS), "")
        out: list[bytes] = []
        inner, first = self._inner, self._first
        lines = text.split("\n") if self.cut_feed else [text]
        for k, line in enumerate(lines):
            lead = k == 0 and self.dummy_prefix
            if k:
                out.append(first.get("\n") or self._packed("\n", first, "\n"))
            if plain and "  " not in line and line[:1] != " " and line[-1:] != " ":
                words = line.split(" ")
                w = words[0]
                if lead or w:
                    held = inner if lead else first
                    out.append(held.get(w) or self._packed((BLANK if lead else "") + w, held, w))
                held = inner.new
                for w in words[1:]:
                    out.append(held.get(w) or inner.get(w) or self._packed(BLANK + w, inner, w))
            else:
                s = (BLANK if lead else "") + line.replace(" ", BLANK)
                for part in self._part.findall(s):
                    out.append(first.get(part) or self._packed(part, first, part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def _output(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, and each piece's place and length in them."""
        if self._flat is None:
            raw = [
                bytes([int(t[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else t.replace(BLANK, " ").encode()
                for t, _, kind in self.pieces
            ]
            sizes = np.array([len(x) for x in raw])
            self._flat = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes
        return self._flat

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What the pieces say, before bytes become characters."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        if ids.min() < 0 or ids.max() >= len(self.pieces):
            raise ValueError("an id outside the vocabulary")
        flat, place, size = self._output()
        n = size[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(place[ids] - (ends - n), n)
        out = flat[at].tobytes()
        return out[1:] if self.dummy_prefix and self.pieces[ids[0]][0][:1] == BLANK else out

    def decode(self, ids) -> str:
        """The text of ids; each byte of an invalid sequence becomes U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "pagelode_each")


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


def _register() -> None:
    import codecs

    codecs.register_error("pagelode_each", _each_byte)


_register()

_loaded: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """The transducer of a model file, compiled once in each process."""
    if path not in _loaded:
        _loaded[path] = PieceTransducer.load(path)
    return _loaded[path]


def with_ids(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            packed = [machine.encode_packed(x) for x in string_column(batch, text).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
            yield pa.record_batch({"doc_id": string_column(batch, "doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, ids array<int>")


def with_text(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [machine.decode(x.values.to_numpy() if x.is_valid else []) for x in string_column(batch, "ids")]
            yield pa.record_batch({"doc_id": string_column(batch, "doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Per text: n_bytes, n_ids, n_byte_ids (pieces of the fallback), ids_crc32 (of the ids as little-endian numbers of 32
    bits) and decoded_same (the ids decode to the text)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        is_byte = np.zeros(len(machine.pieces), bool)
        is_byte[list(machine.byte_ids.values())] = True
        for batch in batches:
            rows = []
            for x in string_column(batch, text):
                t = x.as_py() or ""
                raw = t.encode()
                packed = machine.encode_packed(t)
                ids = np.frombuffer(packed, "<u4")
                rows.append((len(raw), len(ids), int(is_byte[ids].sum()), zlib.crc32(packed), machine.decode_bytes(ids) == raw))
            n_bytes, n_ids, n_byte, crc, same = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
            yield pa.record_batch({"doc_id": string_column(batch, "doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_ids": pa.array(n_ids, pa.int64()), "n_byte_ids": pa.array(n_byte, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "decoded_same": pa.array(same, pa.bool_())})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_bytes long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_same boolean"
    )
