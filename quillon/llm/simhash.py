"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints: lower-cased A-Z, words between ASCII white space, shingles of `words` words with repeats, XXH64
with seed 42 of each; a bit is set if more than half of the shingles have it set.

Candidates: the 64 bits are cut into b blocks, b > most; two fingerprints with at most `most` differing bits agree
in b - most of them at least. Every distinct fingerprint is dealt once for each choice of b - most blocks, by
their bits. b is the least number whose keys are long enough for the number n of fingerprints: about
n / 2**(bits of a key) <= `bucket` of unrelated fingerprints share a key, so the work grows with n and not with its square (five
tables of 12 bits up to 8 * 10**6 fingerprints, 15 of 20 bits up to 2 * 10**9, 35 of 27 bits up to 2 * 10**11). A key that has more than
`chunk` fingerprints is dealt as all pairs of its chunks, so that a task's memory is bounded and no pair is lost.

Index: the fingerprints of a key, sorted by Gray rank, are the leaves of a tree. Runs of leaves form
nodes, runs of nodes form the next level. A node has the bits that all its leaves share, as a mask and a
value; what its parent has already is left out of it. A search goes down with all queries at once, adds the
differing bits of each node's own mask, and gives up a whole node as soon as the sum exceeds `most`. A node
is also skipped if all its leaves are known to be in the query's component, so a group of many
near copies costs about its size and not its square. Only a spanning forest of the links leaves a task.

Components of fingerprints then come from alternating stars over these edges (components.py), and
documents take their fingerprint's component.

Defined results: null and empty texts have fingerprint 0 and are linked like any other. component_id
is the smallest doc_id reachable; rows without doc_id take it from the others, or null if there are none.
Repeated rows are in one component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import by_batch, looked_up, written
from quillon.llm.components import components

U = np.uint64
FAN = 8
#: Pairs of query and leaf that may be looked at together.
AT_ONCE = 1 << 20
#: Keys, of 24 bytes, that may be broadcast.
MOST_LARGE = 1 << 19


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of a text in UTF-8."""
    found = text.lower().split()
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return hashed(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.fromiter([hashed(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], U)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def f(rows: pa.RecordBatch) -> dict:
        prints = [fingerprint(t or b"", words) for t in rows.column("text").cast(pa.binary()).to_pylist()]
        return {"doc_id": rows.column("doc_id"), "fp": np.array(prints, U).view(np.int64)}

    return f


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


def _runs(key: np.ndarray, size: int) -> np.ndarray:
    """Where runs of at most `size` equal neighbouring keys start."""
    if not len(key):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
    return np.flatnonzero(place % size == 0)


class GrayIndex:
    """A forest over the fingerprints of many keys, sorted by key and Gray rank; one tree for each key."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        self.key, self.fp = key, fp
        self.levels: list[dict[str, np.ndarray]] = []  # from leaves to roots: all-ones, all-zeros, first child, children
        ones, zeros, keys = fp, ~fp, key
        self.levels.append({"shared": np.full(len(fp), U(2**64 - 1)), "value": fp})
        while len(keys) and (len(self.levels) == 1 or (keys[1:] == keys[:-1]).any()):
            first = _runs(keys, FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            number = np.diff(np.concatenate([first, [len(keys)]]))
            below = self.levels[-1]
            below["own"] = below["shared"] & ~np.repeat(ones | zeros, number)
            self.levels.append({"shared": ones | zeros, "value": ones, "first": first, "number": number})
            keys = keys[first]
        self.levels[-1]["own"] = self.levels[-1]["shared"]
        self.root = np.searchsorted(keys, key)
        self.size = np.bincount(self.root)[self.root] if len(key) else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, most: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of other labels and at most `most` differing bits, of the query's own key."""
        low, high = [label], [label]
        for level in self.levels[1:]:
            low.append(np.minimum.reduceat(low[-1], level["first"]))
            high.append(np.maximum.reduceat(high[-1], level["first"]))
        q, node, differ = queries, self.root[queries], np.zeros(len(queries), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            differ = differ + np.bitwise_count((self.fp[q] ^ level["value"][node]) & level["own"][node])
            go = (differ <= most) & ~((low[k][node] == label[q]) & (high[k][node] == label[q]))
            q, node, differ = q[go], node[go], differ[go]
            if k:
                n = level["number"][node]
                child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(level["first"][node], n)
                q, node, differ = np.repeat(q, n), child, np.repeat(differ, n)
        return q, node

    def blocks(self) -> Iterator[np.ndarray]:
        """Queries, so many at a time that AT_ONCE leaves are theirs at most (or one query)."""
        at, total = 0, np.cumsum(self.size)
        while at < len(total):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            yield np.arange(at, end)
            at = end

    def forest(self, most: int) -> np.ndarray:
        """The least leaf of each leaf's component, among the leaves of its key."""
        label = np.arange(len(self.fp))
        for queries in self.blocks():
            a, b = self.search(queries, most, label)
            while len(a):
                ra, rb = label[a], label[b]
                np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
        return label


def _links(most: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def f(key: tuple, table: pa.Table) -> pa.Table:
        keys, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(U)
        order = np.lexsort((gray_rank(fp), keys))
        keys, fp = keys[order], fp[order]
        label = GrayIndex(keys, fp).forest(most)
        linked = label != np.arange(len(fp))
        return pa.Table.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], schema=schema)

    return f


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of so many blocks of 64 bits."""
    return [(64 * i // blocks, 64 * (i + 1) // blocks - 64 * i // blocks) for i in range(blocks)]


def part_bounds(most: int) -> list[tuple[int, int]]:
    """The fewest blocks of which one is equal in fingerprints that differ in `most` bits."""
    return block_bounds(most + 1)


def blocks_for(n: int, most: int, bucket: int) -> int:
    """The least number of blocks whose keys hold `bucket` of n random fingerprints at most."""
    b = most + 1
    while b < 4 * (most + 1) and n >> sum(sorted(bits for _, bits in block_bounds(b))[: b - most]) > bucket:
        b += 1
    return b


def links(prints: DataFrame, most: int = 4, chunk: int = 20_000, shard_rows: int = 100_000, bucket: int = 2048) -> DataFrame:
    """Distinct fingerprints `fp` -> edges (u, v) whose components are those of all pairs that differ in `most` bits at most."""
    n = prints.count()
    blocks = blocks_for(n, most, bucket)
    parts, tables = block_bounds(blocks), []
    for chosen in combinations(parts, blocks - most):
        mask = sum(((1 << bits) - 1) << at for at, bits in chosen)
        tables.append(F.struct(F.lit(len(tables)).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("bits")))
    keyed = prints.select("fp", F.explode(F.array(*tables)).alias("part"))
    counts = keyed.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(
        F.col("part").alias("large"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks")
    )
    # keys of more than a chunk: len(tables) * n / chunk at most; where that is too many to broadcast, Spark joins them as it finds best
    if len(tables) * n // chunk <= MOST_LARGE:
        counts = F.broadcast(counts)
    keyed = keyed.join(counts, F.col("part") == F.col("large"), "left").select("fp", "part", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.least("mine", "other").cast("long") * F.col("chunks") + F.greatest("mine", "other")
    dealt = dealt.select("fp", F.xxhash64("part", pair).alias("key"))
    shards = max(1, -(-n * len(tables) // shard_rows))
    return dealt.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(_links(most), "u long, v long")


def near_groups(docs: DataFrame, words: int = 4, most: int = 4, chunk: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    prints = written(rows.mapInArrow(by_batch(_fingerprints(words), schema), "doc_id long, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    sums = distinct.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    stars = components(links(distinct.select("fp"), most, chunk))
    rooted = distinct.join(stars, distinct.fp == stars.u, "left").select("fp", "least", "n", F.coalesce("v", "fp").alias("root"))
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "roots")
    found = written(looked_up(rooted.select("fp", "n", "root"), ids, "root", "size", sums.prints).select("fp", "n", "component_id"), "components")
    return looked_up(prints, found, "fp", "n", sums.rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 4, most: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns: of each component the rows with its smallest doc_id, or all rows if none has an id.

    Where one doc_id has rows of several components, these are told apart by their fingerprints.
    """
    groups = near_groups(docs, words, most, doc_id=doc_id, text=text).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")))
    by_print = groups.groupBy("doc_id", "fingerprint").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    by_print = written(by_print.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))), "near_groups")
    ids = written(by_print.groupBy("__id").agg(F.min("stays").alias("__all"), F.max("stays").alias("__any"), F.sum("n").alias("__rows")), "near_ids")
    total, mixed = ids.agg(F.coalesce(F.sum("__rows"), F.lit(0)), F.count_if(F.col("__any") & ~F.col("__all"))).first()
    rows = docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("none")))
    marked = looked_up(rows, ids, "__id", "__rows", total)
    if not mixed:
        return marked.where("__all").select(*docs.columns)

    @F.pandas_udf("long")
    def print_of(texts):
        return pd.Series(np.array([fingerprint((t or "").encode(), words) for t in texts], U).view(np.int64))

    # ids with rows in several components
    some = marked.where("__any AND NOT __all").drop("__all", "__any")
    some = some.withColumn("__own", F.concat_ws(":", "__id", F.lpad(F.lower(F.hex(print_of(F.col(text)))), 16, "0")))
    known = by_print.where("stays").select(F.concat_ws(":", "__id", "fingerprint").alias("__own"), F.lit(True).alias("__stays"), F.col("n").alias("__rows"))
    kept = looked_up(some, written(known, "near_prints"), "__own", "__rows", total).where("__stays")
    return marked.where("__all").select(*docs.columns).unionAll(kept.select(*docs.columns))
