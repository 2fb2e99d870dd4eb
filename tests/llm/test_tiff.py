"""The TIFF reader against images written in many layouts, a vector of the format's text, and malformed files."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import tiff as T

CODECS = (T.NONE, T.PACKBITS, T.LZW, T.DEFLATE)


def test_lzw_vector():
    """Codes Clear 7 258 8 8 258 6 6 End of nine bits each for 7 7 7 8 8 7 7 6 6."""
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    data = (bits << (-9 * len(codes)) % 8).to_bytes(-(-9 * len(codes) // 8), "big")
    want = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert T.lzw_decode(data, 9) == want and T.lzw_encode(want) == data


def test_packbits_vector():
    data = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    want = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + " AA" * 10)
    assert T.packbits_decode(data, len(want)) == want and T.packbits_decode(b"\x80" + data, len(want)) == want


@pytest.mark.parametrize("codec", CODECS)
def test_codecs_round_trip(codec):
    rng = np.random.default_rng(1)
    for n in [*range(40), 500, 5000, 70_000]:
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(0, 3, n, dtype=np.uint8).tobytes(), b"ab" * (n // 2), b"z" * n):
            assert T.decode(codec, T.encode(codec, data), len(data)) == data


def test_layouts():
    rng, r = np.random.default_rng(2), random.Random(2)
    for trial in range(80):
        h, w, s = rng.integers(1, 70), rng.integers(1, 70), rng.integers(1, 4)
        img = rng.integers(0, 6, (h, w, s)).astype(np.uint8 if trial % 2 else np.uint16)
        how = {"codec": r.choice(CODECS), "predictor": r.choice([1, 2]), "planar": r.choice([1, 2])} | ({"tile": (16, 32)} if trial % 3 == 0 else {"rows": int(rng.integers(1, h + 1))})
        for order in "<>":
            a, b = T.pages(T.write([(img, how), (img[::-1].copy(), {})], order))
            assert (a.pixels() == img).all() and (b.pixels() == img[::-1]).all()


def test_a_row_per_page(spark):
    img = np.arange(60, dtype=np.uint8).reshape(6, 10, 1)
    good = T.write([(img, {"codec": T.LZW, "predictor": 2}), (img, {"tile": (16, 16)})])
    loop = bytearray(T.write([(img, {})]))
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", loop, 4)[0])
    broken = bytearray(T.write([(img, {"codec": T.DEFLATE})]))
    broken[8:14] = b"\xff" * 6
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no image")), (3, loop), (4, broken), (5, None), (6, bytearray(good[:60])), (7, bytearray())], "id long, content binary")
    files = files.withColumns({"page": F.lit("clash"), "key": F.lit("clash"), "error": F.lit("clash")})
    rows = T.decode_pages(files, "id", "content").collect()
    assert {(r.id, r.page, r.error is None) for r in rows} == {(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, True), (3, 1, False), (4, 0, False), (5, 0, False), (6, 0, False), (7, 0, False)}
    assert {bytes(r.pixels) for r in rows if r.id == 1} == {img.tobytes()} and {r.tiled for r in rows if r.id == 1} == {True, False}
    assert T.decode_pages(files.where("false"), "id", "content").count() == 0


def test_stored_texts(spark):
    texts = [(1, "abc"), (2, ""), (3, None), (4, "é" * 32), (5, "é" * 32), (6, "word " * 120_000), (None, "x"), (6, "y" * 64), (7, "ab" * 9000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"feature": F.lit(1), "payload_bytes": F.lit(2)})
    rows = T.store_texts(docs).collect()
    assert len(rows) == len(texts)
    by_text = {t or "": None for _, t in texts}
    for t in by_text:
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        same = [r for r in rows if r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == len(raw)]
        assert len(same) == sum((x or "") == t for _, x in texts)
        assert {(r.payload_bytes, r.tail_crc32) for r in same} == {(len(payload), zlib.crc32(payload[-64:]))} and len({(r.media_sha256, r.media_bytes, r.feature) for r in same}) == 1
    assert T.store_texts(docs.where("false")).count() == 0


def directory(fields, data=b"", order="<"):
    """A file of one directory with these (tag, value) longs, and data before it."""
    at = 8 + len(data)
    entries = b"".join(struct.pack(f"{order}HHII", tag, 4, 1, v) for tag, v in fields)
    return b"II*\0" + struct.pack(f"{order}I", at) + data + struct.pack(f"{order}H", len(fields)) + entries + b"\0\0\0\0"


GRAY = [(T.BITS, 8), (T.SAMPLES, 1)]


@pytest.mark.parametrize("fields", [
    [(T.WIDTH, 1), (T.HEIGHT, 1), *GRAY, (T.COMPRESSION, T.DEFLATE), (T.TILE_WIDTH, 0xFFFFFFFF), (T.TILE_LENGTH, 0xFFFFFFFF), (T.TILE_OFFSETS, 8), (T.TILE_COUNTS, 4)],
    [(T.WIDTH, 1), (T.HEIGHT, 1), *GRAY, (T.COMPRESSION, T.DEFLATE), (T.TILE_WIDTH, 1 << 14), (T.TILE_LENGTH, 1 << 14), (T.TILE_OFFSETS, 8), (T.TILE_COUNTS, 4)],
    [(T.WIDTH, 0xFFFFFFFF), (T.HEIGHT, 0xFFFFFFFF), *GRAY, (T.COMPRESSION, T.DEFLATE), (T.STRIP_OFFSETS, 8), (T.STRIP_COUNTS, 4)],
    [(T.WIDTH, 0), (T.HEIGHT, 5), *GRAY, (T.STRIP_OFFSETS, 8), (T.STRIP_COUNTS, 4)],
    [(T.WIDTH, 1), (T.HEIGHT, 1 << 20), *GRAY, (T.ROWS_PER_STRIP, 1), (T.STRIP_OFFSETS, 8), (T.STRIP_COUNTS, 4)],
    [(T.WIDTH, 5), (T.HEIGHT, 5), *GRAY, (T.COMPRESSION, 99), (T.STRIP_OFFSETS, 8), (T.STRIP_COUNTS, 4)],
    [(T.WIDTH, 5), (T.HEIGHT, 5), *GRAY, (T.STRIP_OFFSETS, 8), (T.STRIP_COUNTS, 0xFFFFFFFF)],
])
def test_hostile_pages_are_errors(fields):
    (row,) = T.page_rows(directory(fields, b"\x78\x9c\x03\0"))
    assert row[0] == 0 and row[-1] and row[-2] is None


def test_bombs_and_loops_are_bounded():
    bomb = zlib.compress(b"\0" * (1 << 24))
    (row,) = T.page_rows(directory([(T.WIDTH, 8), (T.HEIGHT, 8), *GRAY, (T.COMPRESSION, T.DEFLATE), (T.STRIP_OFFSETS, 8), (T.STRIP_COUNTS, len(bomb))], bomb))
    assert row[-1] is None and row[-2] == b"\0" * 64
    over = T.write([(np.zeros((40, 40, 1), np.uint8), {})])
    assert [r[-1] is None for r in T.page_rows(over, 1600)] == [True] and [r[-1] is None for r in T.page_rows(over, 1599)] == [False]
    # directories that overlap, each a byte further on
    n = 200
    overlapping = b"II*\0\x08\0\0\0" + b"\x01\0" * 4000
    assert sum(1 for _ in T.page_rows(overlapping)) <= n
    rng = random.Random(1)
    good = T.write([(np.arange(600, dtype=np.uint8).reshape(20, 30, 1), {"codec": c, "predictor": 2}) for c in CODECS])
    for _ in range(3000):  # any bytes changed: rows or errors, no exception
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.choice([0, 255, rng.randrange(256)])
        list(T.page_rows(bytes(bad), 1 << 20))


def test_pages_of_texts(spark):
    texts = [(1, "abc"), (2, None), (3, "word " * 120_000)]
    rows = T.text_pages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for i, t in texts:
        payload = T.payload_of((t or "").encode())
        pages = [payload[k : k + 64 * T.PAGE_ROWS] for k in range(0, len(payload), 64 * T.PAGE_ROWS)]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.page)
        assert [(r.page, r.width, r.height, r.bits, r.pixels_sha256, r.error) for r in mine] == [(k, 64, len(p) // 64, 8, hashlib.sha256(p).hexdigest(), None) for k, p in enumerate(pages)]
