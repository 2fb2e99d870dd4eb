"""Best-fit packing of documents into sequences of a fixed number of tokens, by sum of squares.

Each document's ids and an end id are cut, only if longer than a sequence, into full pieces with
the shorter one in front. Pieces are dealt by hash to shards of about `shard_pieces` pieces, whose
number follows the number of all pieces; each shard packs by itself, so a task's memory is bounded
and what the last open bins of a shard waste is small against it. A shard places its pieces from
long to short, each where the sum over residual gaps g of (open bins with gap g)**2 becomes
smallest; that keeps many different gaps open, and so exact fits likely. A tie goes to the
smaller gap. On long-to-short input this leaves about 1.6 % more sequences than tokens need, so the
pieces of the sequences with room left are then placed anew, each where least room stays: 0.2 %.

Defined results: a null text is the empty text, a piece with the end id alone. Rows repeated under
one doc_id, and rows without one, are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import encoders
from quillon.llm.common import by_batch, texts_of, written

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of n ids: only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def _cut(tokenizer: str, end_id: int, capacity: int) -> Callable[[pa.RecordBatch], dict]:
    def f(rows: pa.RecordBatch) -> dict:
        encode, end = encoders.byte_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        out = []
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts_of(rows), strict=True):
            ids = encode(text) + end
            out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(cuts(len(ids) // 4, capacity))]
        return dict(zip(PIECES.names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in PIECES.names}

    return f


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            # half of what a bin's move from gap g to g - s adds to the sum of squares, for g = s ...
            had = count[s:capacity]
            change = 2 * (count[: capacity - s] - had) + 2
            change[0] = 1 - 2 * had[0]
            change[had == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if change[k] <= 2 * count[capacity - s] + 1:
                gap = s + k
                b = open_bins[gap].pop()
                count[gap] -= 1
                bins[i], offsets[i] = b, capacity - gap
                if k:
                    open_bins[k].append(b)
                    count[k] += 1
                continue
            open_bins[capacity - s].append(made)
            count[capacity - s] += 1
        bins[i], offsets[i] = made, 0
        made += 1
    return bins, offsets


def tightest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, each in the open bin with the least room that suffices."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[tuple[int, int]] = []
    made = 0
    for i, s in enumerate(lengths.tolist()):
        k = bisect_left(room, (s, -1))
        gap, b = room.pop(k) if k < len(room) else (capacity, made)
        made += b == made
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            insort(room, (gap - s, b))
    return bins, offsets


def place_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """place(), whose bins with room left are then dissolved and filled by tightest(), if that saves bins."""
    bins, offsets = place(lengths, capacity)
    if not len(lengths):
        return bins, offsets
    fill = np.bincount(bins, lengths).astype(np.int64)
    loose = fill[bins] < capacity
    again, at = tightest(lengths[loose], capacity)
    if again.size and again.max() + 1 < (fill < capacity).sum():
        full = np.cumsum(fill == capacity) - 1
        bins = full[bins]
        bins[loose], offsets[loose] = again + full[-1] + 1, at
    return bins, offsets


def _pack(capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def f(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = place_all(t.column("length").to_numpy(), capacity)
        return t.select(PIECES.names).append_column("sequence_id", pa.array((np.int64(key[0].as_py()) << 32) + bins)).append_column("offset", pa.array(offsets))

    return f


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, shard_pieces: int = 50_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(by_batch(_cut(tokenizer, end_id, capacity), PIECES, 64), "doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = written(made.withColumn("place", F.monotonically_increasing_id()), "pieces")  # equal pieces have places of their own
    shards = max(1, -(-cut.count() // shard_pieces))
    return cut.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards))).groupBy("shard").applyInArrow(_pack(capacity), PACKED)
