"""Ranked lexical search: an index of compressed postings by shard, and document-at-a-time ranking of stated items against all of it.

Index: a task inverts its documents shard by shard (at most `SHARD_BYTES` of text in memory). In a shard documents are numbered in
order of doc_id, and a row holds a term's postings, gaps of numbers and counts as bytes of seven bits each. One more row of
the shard, with the empty term, has its doc_ids and lengths. All terms of all documents are indexed.

Search: postings of the items' terms go to their shard. There each item merges the postings of its terms by a heap of
cursors, one document at a time; the best k are held in a heap keyed by score, then doc_id, which goes on from shard to shard of a task.
Terms whose greatest scores together stay below the k-th best so far open no document of their own; they are
looked up for the documents that others open, so nothing is lost. The tasks' best are merged by a window whose limit Spark applies before its shuffle.

Items are taken in blocks of at most `ITEM_BYTES` of text, so what is broadcast, and what the driver holds, is bounded however many items
there are; an index is read once for each block.

Scores are whole numbers, as the contract of the query gives them (weights floor(1000 ln((2N+2)/(2df+1))), lengths against the mean).

Defined results: null texts and texts without terms are no documents of the counts and match nothing; items without terms
have no rows. Each row of documents counts as a document and each row of items as an item, also where ids repeat; a null doc_id comes after
all others. Empty tables give no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import pieces, written

#: Bytes of text of a shard, and of items that are searched at once.
SHARD_BYTES, ITEM_BYTES = 16 << 20, 8 << 20
#: Fixed values of the score: percent of a length that counts, and the scale of a document's share.
LENGTH_SHARE, UNIT, PER_COUNT, PER_LENGTH = 90, 1_000_000_000, 1000, 8
#: Stands for a null doc_id, after all others.
NO_ID = 2**63 - 1
#: ASCII that is no letter or digit becomes a blank, A-Z become small; all other bytes stay.
FOLDED = bytes(b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256)).lower()
INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("tokens", pa.int64()), ("postings", pa.binary()), ("ids", pa.binary())])
INDEX_SQL = "shard long, term string, df long, tokens long, postings binary, ids binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value begins): groups of seven bits, low ones first, the last below 128."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        part = (v[on] >> np.uint64(7 * k)) & np.uint64(127)
        out[starts[:-1][on] + k] = part | np.where(size[on] > k + 1, np.uint64(128), np.uint64(0))
    return out, starts


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = b < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.concatenate([first, [len(b)]])))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


class Inverter:
    """The documents of one shard as they come."""

    def __init__(self):
        self.terms: dict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids: list[int] = []
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if terms:
            self.found.append(np.fromiter(map(self.terms.__getitem__, terms), np.int32, len(terms)))
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.held += len(text)

    def batch(self, shard: int) -> pa.RecordBatch:
        """Rows of INDEX."""
        ids, lengths = np.array(self.ids, np.int64), np.array([len(f) for f in self.found], np.int64)
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        both = np.concatenate(self.found, dtype=np.int64)
        self.found = []
        both <<= 32
        both |= np.repeat(number, lengths)
        both.sort()
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        count = np.diff(np.concatenate([new, [len(both)]]))
        both = both[new]
        term, doc = both >> 32, both & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        data, starts = packed(np.stack([gap, count], 1).ravel())
        bounds = np.concatenate([starts[2 * first], [len(data)]]).astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
        names = [t.decode() for t in self.terms]  # in order of their numbers, each of which has postings
        df = np.diff(np.concatenate([first, [len(term)]]))
        columns = {"shard": np.full(len(first), shard), "term": names, "df": df, "tokens": np.add.reduceat(count, first), "postings": postings, "ids": pa.nulls(len(first), pa.binary())}
        own = {"shard": [shard], "term": [""], "df": [len(ids)], "tokens": [int(lengths.sum())], "postings": [packed(lengths[order])[0].tobytes()], "ids": [ids[order].tobytes()]}
        rows = [pa.RecordBatch.from_arrays([c[f.name] if isinstance(c[f.name], pa.Array) else pa.array(c[f.name], f.type) for f in INDEX], schema=INDEX) for c in (own, columns)]
        return pa.concat_batches(rows)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of all documents: shard, term, df, tokens, postings, ids. The empty term has a shard's own row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = Inverter(), None
        for batch in (part for whole in batches for part in pieces(whole)):
            where = batch.column("where").to_pylist()
            for at, i, t in zip(where, batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                shard = at if shard is None else shard  # named by the first row: rows are numbered within their task
                held.add(i, t or b"")
                if held.held >= shard_bytes:
                    yield held.batch(shard)
                    held, shard = Inverter(), None
        if held.ids:
            yield held.batch(shard)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("where"))
    return written(rows.mapInArrow(f, INDEX_SQL), "lexical_index")


class Postings:
    """A term's documents in a shard, their scores for this term, and the greatest of these."""

    def __init__(self, data: bytes, weight: int, short: np.ndarray):
        """short: PER_LENGTH times the measure of each of the shard's documents."""
        pairs = unpacked(data).reshape(-1, 2)
        docs, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
        score = weight * ((UNIT * tf) // (PER_COUNT * tf + short[docs]))
        self.docs, self.score, self.most = docs.tolist(), score.tolist(), int(score.max(initial=0))


def best(lists: list[Postings], ids: list[int], held: list[tuple[int, int]], k: int) -> None:
    """Adds a shard's documents to `held`, a heap of the k best (score, -doc_id); document at a time."""
    lists = sorted((p for p in lists if p.most > 0), key=lambda p: p.most)
    below, total = [], 0  # what the lists up to each one can give together
    for p in lists:
        total += p.most
        below.append(total)
    worst = held[0] if len(held) == k else (0, -NO_ID - 1)
    opening = 0  # lists from here on open documents
    while opening < len(lists) and below[opening] < worst[0]:
        opening += 1
    at = [0] * len(lists)
    cursors = [(p.docs[0], n) for n, p in enumerate(lists) if n >= opening]
    heapify(cursors)
    while cursors:
        doc = cursors[0][0]
        score = 0
        while cursors and cursors[0][0] == doc:
            n = cursors[0][1]
            p = lists[n]
            i = at[n]
            score += p.score[i]
            at[n] = i = i + 1
            if i < len(p.docs):
                heapreplace(cursors, (p.docs[i], n))
            else:
                heappop(cursors)
        for n in range(opening - 1, -1, -1):
            if score + below[n] < worst[0]:
                break
            p = lists[n]
            i = at[n] = bisect_left(p.docs, doc, at[n])
            if i < len(p.docs) and p.docs[i] == doc:
                score += p.score[i]
        else:
            one = (score, -ids[doc])
            if score > 0 and one > worst:
                if len(held) < k:
                    heappush(held, one)
                else:
                    heapreplace(held, one)
                if len(held) == k:
                    worst = held[0]
                    before = opening
                    while opening < len(lists) and below[opening] < worst[0]:
                        opening += 1
                    if opening > before:  # lists that no longer open documents leave the heap
                        cursors = [c for c in cursors if c[1] >= opening]
                        heapify(cursors)


def search(found: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents of each item by a written index: item_id, rank, doc_id, score. Rows of items are told apart, though their ids may repeat."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = written(asked.withColumn("_row", F.monotonically_increasing_id()), "items")
    blocks = -(-size // item_bytes) or 1
    n, tokens = found.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = [_block(found, asked.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b), n, tokens, k) for b in range(blocks)] if n else []
    parts = [p for p in parts if p is not None]
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    if not parts:
        return asked.sparkSession.createDataFrame([], schema)
    ranked = parts[0]
    for p in parts[1:]:
        ranked = ranked.unionAll(p)
    named = ranked.join(asked.select("_row", "item_id"), "_row")
    return named.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def _block(found: DataFrame, asked: DataFrame, n: int, tokens: int, k: int) -> DataFrame | None:
    """(_row, rank, doc_id, score) of a bounded block of items; None where they have no terms."""
    spark = found.sparkSession
    wanted = {r._row: sorted({t.decode() for t in terms_of((r.text or "").encode())}) for r in asked.select("_row", "text").toLocalIterator()}
    terms = sorted({t for w in wanted.values() for t in w})
    if not terms:
        return None
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    hits = found.join(F.broadcast(vocabulary), "term")  # bounded by the block's text
    df = {r.term: r.df for r in hits.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    held = spark.sparkContext.broadcast((weight, wanted))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = held.value
        heaps: dict[int, list[tuple[int, int]]] = {row: [] for row in wanted}
        for ids, short, postings in shards(batches, weight, n, tokens):
            for row, names in wanted.items():
                lists = [postings[t] for t in names if t in postings]
                if lists:
                    best(lists, ids, heaps[row], k)
        rows = [(row, -i, s) for row, h in heaps.items() for s, i in h]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["_row", "doc_id", "score"])

    own = found.where("term = ''")
    rows = hits.select(*found.columns).unionAll(own).repartition("shard").sortWithinPartitions("shard", "term")
    tops = rows.mapInArrow(f, "_row long, doc_id long, score long")
    order = Window.partitionBy("_row").orderBy(F.desc("score"), "doc_id")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("_row", "rank", "doc_id", "score")


def shards(batches: Iterator[pa.RecordBatch], weight: dict[str, int], n: int, tokens: int) -> Iterator[tuple[list[int], np.ndarray, dict[str, Postings]]]:
    """(doc_ids, measures, postings by term) of each shard of rows sorted by shard and term: the shard's own row is its first."""
    held: tuple | None = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["term"] == "":
                if held:
                    yield held
                lengths = unpacked(r["postings"])
                measure = 100 - LENGTH_SHARE + np.array([LENGTH_SHARE * int(x) * n // tokens for x in lengths], np.int64)
                held = (np.frombuffer(r["ids"], np.int64).tolist(), PER_LENGTH * measure, {})
            else:
                held[2][r["term"]] = Postings(r["postings"], weight[r["term"]], held[1])
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best of all documents for each item."""
    return search(index(docs), items, k)
