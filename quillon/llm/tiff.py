"""TIFF: a reader that gives one row per page, and a writer for tests and for storing bytes as samples.

Reader: either byte order; walks the chain of image directories (a loop or an offset outside the file ends
it with an error), collects strips or tiles, decodes each (none, PackBits, LZW, deflate), undoes the horizontal
predictor, crops tiles, and joins separate planes. Samples have 8 or 16 bits.

A malformed file, or a page that can't be decoded, is one row with `error` and no pixels; it doesn't end the job.
A row of pixels has to fit a row of Spark and a worker's memory, so the samples of a page, and of its strips or tiles
as decoded, are at most `most_samples` (parameter, 2**28); a page beyond that is a row with `error`. No more is
decoded than a page's size asks for, directories may not overlap, and the strips of all pages together may not be
more than `SHARED` times the file: so a hostile file costs time and memory in proportion to its size and this bound.

Storing bytes: a payload of n bytes, padded with zeros to a positive multiple of 64, becomes gray rows of 64 samples.
Pages hold `PAGE_ROWS` rows; codec and layout follow from the page's own bytes, so equal texts give equal files.

Defined results: null and empty texts are one row of zeros; their file has one page. Rows repeated, or without
doc_id, are stored each for itself. An empty table gives no rows.
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
from pyspark.sql import functions as F

from quillon.llm.common import by_batch, pieces, written

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
# Tags and the sizes of field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
ROW = 64
PAGE_ROWS = 4096
MOST_SAMPLES = 1 << 28
#: How often the bytes of a file may be used by strips or tiles on average.
SHARED = 16
USED = frozenset(
    (
        WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH,
        TILE_OFFSETS, TILE_COUNTS
    )
)


class TiffError(ValueError):
    """What a file has wrong."""


# --- codecs -------------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while made < size:
        if at >= len(data):
            raise TiffError("PackBits data end early")
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + 2 + n]
            if len(piece) <= n:
                raise TiffError("PackBits data end early")
            at += 2 + n
        elif n > 128:
            piece = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(piece)
        made += len(piece)
    return b"".join(out)[:size]


def packbits_encode(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    a = np.frombuffer(data, np.uint8)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [n]]) if n else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(cut) >= 3)
    for s, e in [*((int(cut[k]), int(cut[k + 1])) for k in long), (n, n)]:
        for k in range(at, s, 128):  # literals up to the run
            piece = data[k : min(s, k + 128)]
            out.append(bytes([len(piece) - 1]) + piece)
        for k in range(s, e, 128):
            m = min(128, e - k)
            out.append(bytes([257 - m if m > 1 else 0]) + data[k : k + 1])
        at = e
    return b"".join(out)


CLEAR, END = 256, 257
SINGLE = [bytes([b]) for b in range(256)]


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code grows one early, as the format has it."""
    table: list[bytes] = [*SINGLE, b"", b""]
    out: list[bytes] = []
    made, bits, held, width, at, before = 0, 0, 0, 9, 0, b""
    n = len(data)
    while made < size:
        while bits < width:
            if at >= n:
                raise TiffError("LZW data end early")
            held = (held << 8 | data[at]) & 0xFFFFFF
            bits += 8
            at += 1
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == CLEAR:
            table, width, before = [*SINGLE, b"", b""], 9, b""
            continue
        if code == END:
            raise TiffError("LZW data end early")
        if not before:
            if code > 255:
                raise TiffError("LZW data begin with no byte")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise TiffError("LZW code out of the table")
            if len(table) < 4096:
                table.append(before + entry[:1])
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        out.append(entry)
        made += len(entry)
        before = entry
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(CLEAR, 9)]
    table, free, width, w = {}, 258, 9, -1
    for c in data:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        code = table.get(key)
        if code is not None:
            w = code
            continue
        codes.append((w, width))
        table[key] = free
        free += 1
        width = 12 if free >= 2048 else 11 if free >= 1024 else 10 if free >= 512 else 9
        if free >= 4094:
            codes.append((CLEAR, width))
            table, free, width = {}, 258, 9
        w = c
    if w >= 0:
        codes.append((w, width))
        free += 1
        width = 12 if free >= 2048 else 11 if free >= 1024 else 10 if free >= 512 else 9
    codes.append((END, width))
    value, size = 0, 0
    out = bytearray()
    for code, width in codes:
        value = value << width | code
        size += width
        while size >= 8:
            size -= 8
            out.append(value >> size)
            value &= (1 << size) - 1
    if size:
        out.append(value << 8 - size & 0xFF)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    try:
        out = zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None
    if len(out) < size:
        raise TiffError("deflate data end early")
    return out


def decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        if len(data) < size:
            raise TiffError("data end early")
        return data[:size]
    decoders = {PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}
    if kind not in decoders:
        raise TiffError(f"compression {kind} is not supported")
    return decoders[kind](data, size)


def encode(kind: int, data: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[kind](data)


# --- directories --------------------------------------------------------------------------------------------------


@dataclass
class Page:
    """One image directory: its fields, and how to read its pixels."""

    data: bytes
    order: str
    fields: dict[int, tuple]

    def one(self, tag: int, default: int | None = None) -> int:
        v = self.fields.get(tag)
        if v:
            return int(v[0])
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    def stored(self) -> int:
        """Bytes of the page's strips or tiles, as the directory has it."""
        return sum(self.fields.get(TILE_COUNTS if TILE_OFFSETS in self.fields else STRIP_COUNTS, ()))

    def pixels(self, most_samples: int = MOST_SAMPLES) -> np.ndarray:
        """Height x width x samples."""
        w, h, n = self.one(WIDTH), self.one(HEIGHT), self.one(SAMPLES, 1)
        bits = set(self.fields.get(BITS, (1,)))
        if len(bits) != 1 or not bits <= {8, 16}:
            raise TiffError(f"{sorted(bits)} bits a sample are not supported")
        if not 0 < w * h * n <= most_samples:
            raise TiffError(f"no samples, or more than {most_samples}")
        deep = bits.pop() == 16
        kind, planes = self.one(COMPRESSION, NONE), self.one(PLANAR, 1) == 2
        each = 1 if planes else n
        tiled = TILE_OFFSETS in self.fields
        tw, th = (self.one(TILE_WIDTH), self.one(TILE_LENGTH)) if tiled else (w, min(h, self.one(ROWS_PER_STRIP, h)))
        if tw < 1 or th < 1:
            raise TiffError("empty strips or tiles")
        offsets, counts = (self.fields.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
        across, down = -(-w // tw), -(-h // th)
        if across * down * tw * th * n > max(4 * w * h * n, 1 << 22) and tiled or across * down * tw * th * n > 2 * most_samples:
            raise TiffError("tiles are too large for the page")
        if len(offsets) != len(counts) or len(offsets) != across * down * (n if planes else 1):
            raise TiffError("wrong number of strips or tiles")
        out = np.zeros((h, w, n), np.uint16 if deep else np.uint8)
        for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
            plane, place = divmod(k, across * down)
            y, x = place // across * th, place % across * tw
            rows = th if tiled else min(th, h - y)
            if at + size > len(self.data):
                raise TiffError("a strip or tile lies outside the file")
            raw = decode(kind, self.data[at : at + size], rows * tw * each * (2 if deep else 1))
            block = np.frombuffer(raw, f"{self.order}u{2 if deep else 1}").reshape(rows, tw, each).astype(out.dtype)
            if self.one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            elif self.one(PREDICTOR, 1) != 1:
                raise TiffError("this predictor is not supported")
            part = out[y : y + rows, x : x + tw]
            part[..., slice(plane, plane + 1) if planes else slice(None)] = block[: part.shape[0], : part.shape[1]]
        return out


def pages(data: bytes) -> Iterator[Page]:
    """The directories of a file, in their order."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    entries = strips = 0
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("the chain of directories loops or leaves the file")
        seen.add(at)
        n = struct.unpack_from(f"{order}H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise TiffError("a directory leaves the file")
        entries += n
        if 12 * entries > len(data):
            raise TiffError("directories overlap")
        fields: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZES.get(kind, 0) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
            if where + size > len(data):
                raise TiffError(f"tag {tag} lies outside the file")
            if kind in (1, 3, 4) and tag in USED and tag not in fields:
                fields[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
        page = Page(data, order, fields)
        strips += page.stored()
        if strips > SHARED * len(data):
            raise TiffError("strips or tiles overlap")
        yield page
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def write(images: list[tuple[np.ndarray, dict]], order: str = "<") -> bytes:
    """A file of 8- or 16-bit images (height x width x samples), each with options codec, predictor (1, 2), rows (of a strip) or tile (width, height), planar (1, 2)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for image, how in images:
        h, w, n = image.shape
        codec, predictor, planar = how.get("codec", NONE), how.get("predictor", 1), how.get("planar", 1)
        tile, rows = how.get("tile"), how.get("rows", h)
        tw, th = tile or (w, rows)
        offsets, counts = [], []
        for plane in range(n if planar == 2 else 1):
            samples = image[..., plane : plane + 1] if planar == 2 else image
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = samples[y : y + th, x : x + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], 1)
                    coded = encode(codec, block.astype(f"{order}u{block.dtype.itemsize}").tobytes())
                    offsets.append(len(out))
                    counts.append(len(coded))
                    out += coded
        fields = {
            WIDTH: [w], HEIGHT: [h], BITS: [8 * image.dtype.itemsize] * n, COMPRESSION: [codec], PHOTOMETRIC: [1], SAMPLES: [n], PLANAR: [planar],
            PREDICTOR: [predictor]
        }
        fields |= {
            TILE_WIDTH: [tw], TILE_LENGTH: [th], TILE_OFFSETS: offsets, TILE_COUNTS: counts
        } if tile else {ROWS_PER_STRIP: [th], STRIP_OFFSETS: offsets, STRIP_COUNTS: counts}
        entries = []
        for tag, values in sorted(fields.items()):
            wide = tag in (STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS, WIDTH, HEIGHT, ROWS_PER_STRIP)
            body = struct.pack(f"{order}{len(values)}{'I' if wide else 'H'}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                where = struct.pack(f"{order}I", len(out))
                out += body
            else:
                where = body.ljust(4, b"\0")
            entries.append(struct.pack(f"{order}HHI", tag, 4 if wide else 3, len(values)) + where)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- operators ----------------------------------------------------------------------------------------------------

PAGE_DDL = "page int, width int, height int, samples int, bits int, compression int, tiled boolean, pixels binary, error string"


#: What reading bytes that aren't what they claim to be may end in.
FAULTS = (ValueError, OverflowError, MemoryError, struct.error)


def page_rows(data: bytes | None, most_samples: int = MOST_SAMPLES) -> Iterator[tuple]:
    """A row for each page, and one with the error where the file or a page is malformed."""
    number = 0
    try:
        for p in pages(data or b""):
            try:
                a = p.pixels(most_samples)
                yield number, a.shape[1], a.shape[0], a.shape[2], 8 * a.dtype.itemsize, p.one(COMPRESSION, NONE), TILE_OFFSETS in p.fields, a.tobytes(), None
            except FAULTS as e:
                yield number, None, None, None, None, None, None, None, str(e) or type(e).__name__
            number += 1
    except FAULTS as e:
        yield number, None, None, None, None, None, None, None, str(e) or type(e).__name__


def decode_pages(files: DataFrame, key: str, content: str, most_samples: int = MOST_SAMPLES) -> DataFrame:
    """(key, page, width, height, samples, bits, compression, tiled, pixels, error): one row per page of each file in a binary column."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows in pieces(batch, 16):
                found = [
                    (k, *r) for k,
                    d in zip(rows.column("key").to_pylist(), rows.column("content").to_pylist(), strict=True) for r in page_rows(d, most_samples)
                ]
                columns = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 10
                kinds = [rows.schema.field("key").type, *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["key", "page", "width", "height", "samples", "bits", "compression", "tiled", "pixels", "error"]
                )

    made = files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(run, f"key {kind}, {PAGE_DDL}")
    return made.withColumnRenamed("key", key)


def stored(payload: bytes) -> bytes:
    """The payload's file: pages of gray rows of 64 bytes, with codec and layout by the page's checksum."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1)
    images = []
    for at in range(0, len(samples), PAGE_ROWS):
        page = samples[at : at + PAGE_ROWS]
        kind = zlib.crc32(page.tobytes()) % 4
        images.append(
            (
                page,
                [
                    {"codec": DEFLATE, "predictor": 2, "rows": 256}, {"codec": PACKBITS, "rows": 128}, {"codec": DEFLATE, "tile": (32, 64)},
                    {"codec": LZW, "rows": 512}
                ][kind]
            )
        )
    return write(images)


def features(pages_read: list[np.ndarray], codecs: list[int]) -> str:
    """Number of pages, codecs, mean and deviation of the samples, and the share of zeros."""
    a = np.concatenate([p.reshape(-1) for p in pages_read]).astype(np.float64)
    return f"pages={len(pages_read)};codecs={','.join(map(str, codecs))};mean={a.mean():.6f};sd={a.std():.6f};zeros={float((a == 0).mean()):.6f}"


def payload_of(text: bytes) -> bytes:
    """text and zeros up to a positive multiple of 64 bytes."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0")


def _media(rows: pa.RecordBatch) -> dict:
    texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
    return {"doc_id": rows.column("doc_id"), "n_bytes": [len(t) for t in texts], "media": [stored(payload_of(t)) for t in texts]}


def media_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes and the media column with its file, as a table in the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(by_batch(_media, schema, 64), "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def _read_back(rows: pa.RecordBatch) -> dict:
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out: dict[str, list] = {n: [] for n in names}
    for media in rows.column("media").to_pylist():
        read = [(p.pixels(), p.one(COMPRESSION)) for p in pages(media)]
        payload = b"".join(a.tobytes() for a, _ in read)
        values = (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(),
            features([a for a, _ in read], [c for _, c in read])
        )
        for n, v in zip(names, values, strict=True):
            out[n].append(v)
    return out | {"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes")}


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, sizes and digests of its payload and file as read back from the media table, and a feature."""
    longs, texts = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes"), ("payload_sha256", "media_sha256", "feature")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in longs), *((n, pa.string()) for n in texts)])
    ddl = "doc_id long, " + ", ".join([f"{n} long" for n in longs] + [f"{n} string" for n in texts])
    return media_of(docs, doc_id, text).mapInArrow(by_batch(_read_back, schema, 64), ddl)


def text_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per page of each document's file: doc_id, page, width, height, samples, bits, compression, tiled, error and the pixels' sha256."""
    read = decode_pages(media_of(docs, doc_id, text), "doc_id", "media")
    return read.withColumn("pixels_sha256", F.sha2("pixels", 256)).drop("pixels")
