"""TIFF: encode 8-bit rows of samples, and decode files into one row per page.

Decoding walks the image directories (either byte order, with a guard against loops), decodes strips or tiles
(no compression, PackBits, LZW, deflate), undoes the horizontal predictor, and emits one row per page.

Defined cases: a null or empty file has no page; a broken file or directory yields one row with `error` set
and no samples for that page; a directory reached twice ends the walk; samples are 8 or 16 bits, of any number for
a pixel, chunky or planar. Extra columns of the input are kept by read_pages, except its own output names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelode.llm.shared import prepare, string_column

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of samples in a strip.
STRIP = 1 << 16
#: Width in samples of the pages made of a byte payload.
WIDTH = 64
LEVEL = 1

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n, plain = bytearray(), 0, len(data), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush()
            out.append(257 - (j - i))
            out.append(data[i])
        else:
            plain += data[i:j]
        i = j
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a code grows one entry before its table is full."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(base)
    out: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond its table")
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def fresh() -> dict[bytes, int]:
        return {bytes([i]): i for i in range(256)}

    put(256, 9)
    table, width, size, current = fresh(), 9, 258, b""
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if longer in table:
            current = longer
            continue
        put(table[current], width)
        table[longer] = size
        size += 1
        if size + 1 > 4095:
            put(256, width)
            table, width, size = fresh(), 9, 258
        elif size >= 1 << width:
            width += 1
        current = data[i : i + 1]
    if current:
        put(table[current], width)
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _compressed(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, LEVEL)
    return lzw_encode(data) if how == LZW else packbits_encode(data)


def _expanded(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how == LZW:
        return lzw_decode(data)
    if how == PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"compression {how} isn't supported")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, note: str = "") -> bytes:
    """A little-endian TIFF of 8-bit grey pages (height, width), in strips or in tiles of (height, width)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4  # where the next directory's place goes
    for page in pages:
        height, width = page.shape
        if tile:
            rows, columns = tile
        else:
            rows, columns = max(1, min(height, STRIP // max(width, 1))), width
        places, lengths = [], []
        for y in range(0, height, rows):
            for x in range(0, width, columns):
                part = page[y : y + rows, x : x + columns]
                if tile and part.shape != (rows, columns):
                    part = np.pad(part, ((0, rows - part.shape[0]), (0, columns - part.shape[1])), mode="edge")
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1), np.uint8))
                data = _compressed(np.ascontiguousarray(part).tobytes(), compression)
                places.append(len(out))
                lengths.append(len(data))
                out += data
        tags: list[tuple[int, int, list[int] | bytes]] = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1])]
        if note:
            tags.append((270, 2, note.encode() + b"\0"))
        tags += [(277, 3, [1])] + ([] if tile else [(273, 4, places), (278, 4, [rows]), (279, 4, lengths)]) + [(317, 3, [predictor])]
        tags += [(322, 4, [columns]), (323, 4, [rows]), (324, 4, places), (325, 4, lengths)] if tile else []
        values = []
        for tag, kind, value in sorted(tags):
            raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{_CODES[kind]}", *value)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                where = struct.pack("<I", len(out))
                out += raw
            else:
                where = raw.ljust(4, b"\0")
            values.append(struct.pack("<HHI", tag, kind, len(value)) + where)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(values)) + b"".join(values)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    index: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    samples: bytes | None
    note: str | None
    error: str | None


def decode(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    if not data:
        return
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield Page(0, 0, 0, 0, 0, 0, None, None, "not a TIFF")
        return
    at, seen, index = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        tags: dict[int, tuple] = {}
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                size = _SIZES.get(kind, 0) * count
                place = at + 10 + 12 * i
                if size > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                if place + size > len(data):
                    raise ValueError("a value beyond the file's end")
                tags[tag] = (bytes(data[place : place + size]),) if kind in (2, 7) else struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place) if kind in _CODES else ()
            (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except (struct.error, ValueError) as e:
            yield Page(index, 0, 0, 0, 0, 0, None, None, f"broken directory: {e}")
            return
        yield _page(data, order, tags, index)
        at, index = following, index + 1


def _page(data: bytes, order: str, tags: dict[int, tuple], index: int) -> Page:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    width, height, channels = one(256, 0), one(257, 0), one(277, 1)
    how, bits, predictor, planar = one(259, NONE), one(258, 1), one(317, 1), one(284, 1)
    note = tags[270][0].rstrip(b"\0").decode("utf-8", "replace") if 270 in tags else None
    try:
        if bits not in (8, 16) or len(set(tags.get(258, (bits,)))) > 1:
            raise ValueError(f"{bits} bits for a sample aren't supported")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        planes, deep = (channels, 1) if planar == 2 else (1, channels)
        out = np.zeros((planes, height, width, deep), kind)
        tiled = 324 in tags
        rows, columns = (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height) or height, width)
        places, lengths = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        k = 0
        for plane in range(planes):
            for y in range(0, height, rows or 1):
                for x in range(0, width, columns or 1):
                    tall = rows if tiled else min(rows, height - y)
                    if places[k] + lengths[k] > len(data):
                        raise ValueError("a strip or tile beyond the file's end")
                    raw = _expanded(bytes(data[places[k] : places[k] + lengths[k]]), how)
                    part = np.frombuffer(raw, kind, tall * columns * deep).reshape(tall, columns, deep)
                    if predictor == 2:
                        part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if deep else part
                    elif predictor != 1:
                        raise ValueError(f"predictor {predictor} isn't supported")
                    out[plane, y : y + rows, x : x + columns] = part[: height - y, : width - x]
                    k += 1
        samples = out[0] if planes == 1 else np.moveaxis(out[..., 0], 0, -1)
        return Page(index, width, height, channels, bits, how, np.ascontiguousarray(samples).astype(kind.newbyteorder("<")).tobytes(), note, None)
    except (ValueError, KeyError, IndexError, zlib.error) as e:
        return Page(index, width, height, channels, bits, how, None, note, str(e))


#: Columns that read_pages adds.
PAGE_FIELDS = "page int, width int, height int, channels int, bits int, compression int, samples binary, note string, error string"


def read_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of the TIFF files in column `media`, with that row's other columns."""
    prepare(files.sparkSession)
    added = [x.split()[0] for x in PAGE_FIELDS.split(", ")]
    kept = files.drop(*[c for c in added if c != media])
    others = [f for f in kept.schema.fields if f.name != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pages = [], []
            for i, blob in enumerate(string_column(batch, media)):
                for page in decode(blob.as_py() or b""):
                    rows.append(i)
                    pages.append(page)
            held = batch.select([f.name for f in others]).take(pa.array(rows, pa.int64()))
            columns = dict(zip(held.schema.names, held.columns, strict=True))
            kinds = (pa.int32(),) * 6 + (pa.binary(), pa.string(), pa.string())
            names = ("index", "width", "height", "channels", "bits", "compression", "samples", "note", "error")
            columns |= {c: pa.array([getattr(p, a) for p in pages], k) for c, a, k in zip(added, names, kinds, strict=True)}
            yield pa.record_batch(columns)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return kept.mapInArrow(run, fields + PAGE_FIELDS)


def payload_page(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Bytes, filled up with 0 to a positive multiple of width, as one grey page."""
    size = max(1, -(-len(text) // width)) * width
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, width)


def feature(samples: bytes, width: int = WIDTH) -> str:
    """A hash of the picture's look: the means of 8 x 8 cells of the page against their median, as 16 hex digits."""
    page = np.frombuffer(samples, np.uint8).reshape(-1, width)
    cuts = np.linspace(0, len(page), 9).astype(int)
    sums = np.concatenate((np.zeros((1, width), np.int64), np.cumsum(page, 0, dtype=np.int64)))
    cells = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(8, 8, -1).sum(2) / np.maximum(np.diff(cuts), 1)[:, None]
    bits = (cells > np.median(cells)).ravel()
    return np.packbits(bits).tobytes().hex()


def text_pictures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes as a one-page TIFF, whose note holds n_bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() or b"" for x in string_column(batch, text).cast(pa.binary())]
            yield pa.record_batch(
                {
                    "doc_id": string_column(batch, "doc_id"),
                    "media": pa.array([encode([payload_page(b)], note=str(len(b))) for b in raw], pa.binary()),
                }
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, media binary")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, error string"


def _digest(media: bytes | None) -> tuple:
    """The columns behind doc_id of one stored file; of one that is absent or broken only its size, hash, pages and error are known."""
    stored = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
    if media is None:
        return (None, None, None, None, *stored, None, None, "no file")
    pages = list(decode(media))
    error = next((p.error for p in pages if p.error), None) or (None if pages else "no page")
    if error:
        return (None, None, None, None, *stored, None, len(pages), error)
    payload = b"".join(p.samples for p in pages)
    size = int(pages[0].note) if (pages[0].note or "").isdigit() else None
    look = feature(payload) if len(payload) % WIDTH == 0 and payload else None
    return (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, look, len(pages), None)


def payload_digests(pictures: DataFrame) -> DataFrame:
    """What the stored pictures hold, one row per picture (doc_id, media): its pages are decoded where they're digested.

    A null file, one that is no TIFF and one with a page that can't be decoded give a row with null digests and the error; a picture
    without a note has no n_bytes, and one whose rows aren't as wide as text_pictures() makes them no feature."""
    prepare(pictures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
        for batch in batches:
            rows = [(doc, *_digest(blob.as_py())) for doc, blob in zip(string_column(batch, "doc_id").to_pylist(), string_column(batch, "media"), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch({n: pa.array(list(c), t) for n, c, t in zip(names, columns, kinds, strict=True)})

    return pictures.select("doc_id", "media").mapInArrow(run, _DIGESTS)
