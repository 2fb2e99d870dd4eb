"""Removal of repeated passages by fixed-block anchors.

A passage of `window` words is repeated if its word sequence also starts in a document with a smaller
doc_id. Any window holds, at one of its first `block` offsets, a whole block of the non-overlapping
partition of *its own* document into blocks of `block` = (window + 1) // 2 words. So:

1. Each group of documents fingerprints all its rolling `block`-word windows and marks those that are
   blocks of the partition. The distinct fingerprints go, sorted and packed, to fingerprint buckets.
2. A bucket merges what groups sent it. A fingerprint is an *anchor* if it is a block in some document
   and a rolling window in another; each group gets back those it has.
3. Each group extends its anchors: windows of `window` words that hold an anchor go, as 128-bit identities
   of their words with the smallest doc_id of the group, to identity buckets, and the smallest doc_id of
   each comes back where it matters. Runs of such windows are the maximal exact repeats;
   the words they cover in documents with a larger doc_id are removed.

Identity. Words of a group are told apart by their bytes (an Arrow dictionary). Each distinct word gets 128 bits
by BLAKE2b under a key drawn anew for each call, which no text can have been made for; a window's identity adds,
in two halves of 64 bits, a bijective mix of each of its words' bits with a constant of the place. Take two
different windows and a word that stands in one at a place where the other has another word: given all other
words' bits, the sums agree for about one value in 2**128 of that word's bits. So, of n different windows, the chance that
any two are taken for one is about n**2 / 2**129: 1e-14 for the 10**12 words of 6 TB. The words themselves do not travel.

Size. Groups are dealt by a hash of doc_id, length and input partition, so rows that repeat are spread; their number is the bytes of all texts over the bytes of a
group, which beyond 100 groups grow with the root of the corpus up to three times `group_bytes`: what a task
holds is bounded, and what groups send is in proportion to the corpus up to 900 times `group_bytes`. Buckets are about as many as groups; beyond, a group still sends each bucket at most one row. Fingerprints have so many bits that a block
meets a chance equal once in 2**8 windows at any size; these false anchors cost an identity each and are no error.
Documents are shuffled once and that exchange is read three times. A passage or document that a third of all rows
share costs each group one fingerprint, and no pair of documents is ever formed.

Defined results: a null text has no words. A null doc_id counts as larger than any other; rows of one
doc_id, and rows without one, do not remove each other's words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: An odd multiplier for each place of a block, and a constant for each place of a window.
STEP, PLACE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bits of a fingerprint beyond those that number all words.
SPARE_BITS = 8
#: Groups of a task at most, on average.
TASK_GROUPS = 8
NO_ID = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): where words start and end in the bytes of all texts, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Group:
    """The documents of one group: ids, texts, words and 128 bits for each distinct word."""

    def __init__(self, table: pa.Table, key: bytes):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
        self.null = table.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        text = table.column("text").cast(pa.large_binary()).fill_null(b"")
        parts = [c for c in text.chunks if len(c)]
        self.data = np.concatenate([self._bytes(c) for c in parts]) if parts else np.zeros(0, np.uint8)
        sizes = np.concatenate([np.diff(self._offsets(c)) for c in parts]) if parts else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.starts, self.ends, self.first = words_of(self.data, self.offsets)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.word, self.halves = self._words(key)

    def _words(self, key: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of each word among the distinct ones, and two halves of 64 bits of each of these."""
        sizes = self.ends - self.starts
        solid = np.zeros(len(self.data) + 1, np.int8)
        solid[self.starts] += 1
        solid[self.ends] -= 1
        packed = self.data[np.cumsum(solid[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = pc.dictionary_encode(words)
        bits = b"".join([hashlib.blake2b(w, digest_size=16, key=key).digest() for w in coded.dictionary.to_pylist()])
        both = np.frombuffer(bits, "<u8").reshape(-1, 2)
        return coded.indices.to_numpy(), [np.ascontiguousarray(both[:, i]) for i in (0, 1)]

    @staticmethod
    def _offsets(c: pa.Array) -> np.ndarray:
        return np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]

    def _bytes(self, c: pa.Array) -> np.ndarray:
        at = self._offsets(c)
        return np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]] if c.buffers()[2] else np.zeros(0, np.uint8)

    def inside(self, k: int) -> np.ndarray:
        """Do the k words from each place on belong to one document?"""
        n = max(0, len(self.doc) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]

    def fingerprints(self, k: int, bits: int) -> np.ndarray:
        """That many bits of each k consecutive words: a filter, not an identity."""
        n = max(0, len(self.word) - k + 1)
        total, step = np.zeros(n, U), 1
        for j in range(k):
            step = step * STEP % 2**64
            total += (self.halves[0] * U(step))[self.word[j : j + n]]
        return mixed(total) >> U(64 - bits)

    def identity(self, k: int, half: int, places: np.ndarray) -> np.ndarray:
        """A half of the identity of the k words from each place on."""
        total = np.zeros(len(places), U)
        for j in range(k):
            total += mixed(self.halves[half] + U(PLACE * (j + 1) % 2**64))[self.word[places + j]]
        return total


def _split(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of equal buckets."""
    if len(bucket):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        yield from zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("flags", pa.binary())])
SENT_DDL = "bucket int, g int, n int, high binary, low binary, flags binary"
BACK = pa.schema([("g", pa.int32()), ("payload", pa.binary())])
BACK_DDL = "g int, payload binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _packed(values: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Sorted values below 2**bits: the low bytes of each, and how many have each of the values above these, in unary."""
    low = 8
    while bits - low > 0 and 1 << bits - low > 4 * len(values):
        low += 8
    high = (values >> U(low)).astype(np.int64)
    unary = np.zeros(len(values) + (1 << max(0, bits - low)), bool)
    unary[high + np.arange(len(values))] = True
    return np.packbits(unary).tobytes(), _planes(values & U((1 << low) - 1), low // 8)


def _unpacked(high: bytes, low: bytes, n: int) -> np.ndarray:
    width = len(low) // n if n else 1
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n] - np.arange(n)
    return upper.astype(U) << U(8 * width) | _from_planes(low, width)


def _bits_of(flags: np.ndarray) -> bytes:
    """Two bits of each number, all lower ones first."""
    return np.packbits(np.stack([flags & 1, flags >> 1 & 1])).tobytes()


def _from_bits(data: bytes, n: int) -> np.ndarray:
    low, high = np.unpackbits(np.frombuffer(data, np.uint8))[: 2 * n].reshape(2, n)
    return low | high << 1


def _send(block: int, bits: int, bucket_bits: int, key: bytes):
    """A group's distinct rolling fingerprints: bit 0 of a flag if one is a block, bit 1 if two documents have it."""
    rest = bits - bucket_bits

    def f(of: tuple, table: pa.Table) -> pa.Table:
        g = Group(table, key)
        inside = g.inside(block)
        h, doc = g.fingerprints(block, bits)[inside], g.doc[: len(inside)][inside]
        aligned = ((np.arange(len(inside))[inside] - g.first[doc]) % block) == 0
        order = np.argsort(h, kind="stable")
        h, doc, aligned = h[order], doc[order], aligned[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        flags = np.zeros(0, np.uint8)
        if len(h):
            flags = np.logical_or.reduceat(aligned, new).astype(np.uint8)
            # within a run documents ascend, so two differ exactly if the first and the last do
            flags |= (doc[new] != doc[np.concatenate([new[1:], [len(h)]]) - 1]).astype(np.uint8) << 1
        h = h[new]
        bucket, h = (h >> U(rest)).astype(np.int64), h & U((1 << rest) - 1)
        rows = [(b, of[0].as_py(), j - i, *_packed(h[i:j], rest), _bits_of(flags[i:j])) for b, i, j in _split(bucket)]
        return _table(rows, SENT)

    return f


def _anchors(bits: int, bucket_bits: int):
    rest = bits - bucket_bits

    def f(key: tuple, table: pa.Table) -> pa.Table:
        groups, sizes = table.column("g").to_numpy(), table.column("n").to_pylist()
        parts = [_unpacked(a, b, n) for a, b, n in zip(table.column("high").to_pylist(), table.column("low").to_pylist(), sizes, strict=True)]
        h, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        flags = np.concatenate([_from_bits(x, n) for x, n in zip(table.column("flags").to_pylist(), sizes, strict=True)])
        order = np.argsort(h, kind="stable")
        h, of, flags = h[order], of[order], flags[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([new, [len(h)]]))
        any_flag = np.bitwise_or.reduceat(flags, new)
        good = np.repeat((any_flag & 1).astype(bool) & ((n > 1) | (any_flag > 1)), n)
        h, of = h[good] | U(key[0].as_py() << rest), of[good]
        order = np.argsort(of, kind="stable")
        width = bits + 7 >> 3
        rows = [(int(groups[k]), np.uint8(width).tobytes() + _planes(h[order][i:j], width)) for k, i, j in _split(of[order])]
        return _table(rows, BACK)

    return f


def _anchors_of(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, U), *(_from_planes(x[1:], x[0]) for x in table.column("payload").to_pylist())])


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, all lowest ones first: of sorted numbers the upper planes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    full = np.zeros((len(data) // n, 8), np.uint8)
    full[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return full.view("<u8")[:, 0]


def _packed_items(a: np.ndarray, b: np.ndarray, ids: np.ndarray, several: np.ndarray) -> bytes:
    """Identities (two halves) in order of the first, doc_ids in as many bytes as their range needs, and one bit for each."""
    low = int(ids.min())
    width = max(1, (int(ids.max()) - low).bit_length() + 7 >> 3)
    head = np.array([len(a), low, width], "<i8").tobytes()
    return head + _planes(a, 8) + _planes(b, 8) + _planes(ids.astype(U) - U(low % 2**64), width) + np.packbits(several).tobytes()


def _unpacked_items(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(first halves, second halves, doc_ids, bits, number of the blob) of the items of all blobs."""
    out: list[list[np.ndarray]] = [[np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]]
    for k, blob in enumerate(blobs):
        n, low, width = np.frombuffer(blob, "<i8", 3).tolist()
        ends = 24 + n * np.array([8, 16, 16 + width])
        out[0].append(_from_planes(blob[24 : ends[0]], 8))
        out[1].append(_from_planes(blob[ends[0] : ends[1]], 8))
        out[2].append((_from_planes(blob[ends[1] : ends[2]], width) + U(low % 2**64)).view(np.int64))
        out[3].append(np.unpackbits(np.frombuffer(blob[ends[2] :], np.uint8))[:n].astype(bool))
        out[4].append(np.full(n, k))
    return tuple(map(np.concatenate, out))


EXT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("payload", pa.binary())])
EXT_DDL = "bucket int, g int, payload binary"


def _candidates(g: Group, anchors: np.ndarray, window: int, block: int, bits: int) -> np.ndarray:
    """Places of windows, whole in one document, that hold an anchor."""
    h = g.fingerprints(block, bits)
    anchors = np.sort(anchors)
    at = np.searchsorted(anchors, h)
    hit = (np.concatenate([anchors, [U(2**64 - 1)]])[at] == h) & g.inside(block)
    before = np.concatenate([[0], np.cumsum(hit)])
    inside = g.inside(window)
    n = len(inside)
    return np.flatnonzero((before[window - block + 1 :][:n] > before[:n]) & inside)


def _extend(window: int, block: int, bits: int, bucket_bits: int, key: bytes):
    def f(of: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not back.num_rows:
            return _table([], EXT)
        g = Group(docs, key)
        places = _candidates(g, _anchors_of(back), window, block, bits)
        if not len(places):
            return _table([], EXT)
        a, b = (g.identity(window, half, places) for half in (0, 1))
        ids = g.ids[g.doc[places]]
        order = np.lexsort((ids, b, a))
        a, b, ids = a[order], b[order], ids[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        several = ids[new] < ids[np.concatenate([new[1:], [len(ids)]]) - 1]
        a, b, ids = a[new], b[new], ids[new]
        bucket = (a >> U(64 - bucket_bits)).astype(np.int64)
        return _table([(k, of[0].as_py(), _packed_items(a[i:j], b[i:j], ids[i:j], several[i:j])) for k, i, j in _split(bucket)], EXT)

    return f


def _least(key: tuple, table: pa.Table) -> pa.Table:
    """The smallest doc_id of each identity goes to the groups that have it in a document with a larger one."""
    groups = table.column("g").to_numpy()
    a, b, ids, several, of = _unpacked_items(table.column("payload").to_pylist())
    order = np.lexsort((ids, b, a))
    a, b, ids, several, of = (x[order] for x in (a, b, ids, several, of))
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    least = np.repeat(ids[new], np.diff(np.concatenate([new, [len(a)]])))
    good = (least < ids) | several
    a, b, least, of = a[good], b[good], least[good], of[good]
    order = np.argsort(of, kind="stable")
    a, b, least, of = a[order], b[order], least[order], of[order]
    return _table([(int(groups[k]), _packed_items(a[i:j], b[i:j], least[i:j], np.zeros(0, bool))) for k, i, j in _split(of)], BACK)


def _repeated(g: Group, back: pa.Table, window: int) -> np.ndarray:
    """Places of windows that a document with a smaller doc_id has."""
    places = np.flatnonzero(g.inside(window))
    found = _unpacked_items(back.column("payload").to_pylist())
    order = np.lexsort(found[1::-1])
    fa, fb, least = (x[order] for x in found[:3])
    a = g.identity(window, 0, places)
    at = np.searchsorted(fa, a)
    rows = np.flatnonzero(at < len(fa))
    rows = rows[fa[at[rows]] == a[rows]]
    a, at, places = a[rows], at[rows], places[rows]
    b, hit, rows = g.identity(window, 1, places), np.zeros(len(places), bool), np.arange(len(places))
    while len(rows):  # once more only for equal first halves
        same = fb[at[rows]] == b[rows]
        hit[rows[same]] = least[at[rows[same]]] < g.ids[g.doc[places[rows[same]]]]
        rows = rows[~same]
        at[rows] += 1
        rows = rows[at[rows] < len(fa)]
        rows = rows[fa[at[rows]] == a[rows]]
    return places[hit]


def _remove(window: int, digest: bool, key: bytes):
    def f(of: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        g = Group(docs, key)
        edge = np.zeros(len(g.doc) + 1, np.int64)
        if back.num_rows:
            hit = _repeated(g, back, window)
            edge[hit] += 1
            edge[hit + window] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        out = []
        data = g.data.tobytes()
        for k in range(len(g.ids)):
            a, b = g.first[k], g.first[k + 1]
            stay = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([data[s:e] for s, e in zip(g.starts[stay].tolist(), g.ends[stay].tolist(), strict=True)])
            out.append(
                (None if g.null[k] else int(g.ids[k]), int(b - a), int(b - a - len(stay)), hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            )
        return _table(out, pa.schema([*OUT, ("kept_sha256" if digest else "kept_text", pa.string())]))

    return f


def grown(size: int, group_bytes: int, alone: int = 100, most: int = 3) -> int:
    """Bytes of a group: beyond `alone` groups they grow with the root of the corpus, up to `most` times, which memory has to hold."""
    return int(group_bytes * min(most, max(1.0, (size / (alone * group_bytes)) ** 0.5)))


def remove_repeats(
    docs: DataFrame, window: int = 13, digest: bool = False, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 10 << 20
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and kept_text or, with digest, kept_sha256."""
    block, key = (window + 1) // 2, secrets.token_bytes(32)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-size // grown(size, group_bytes)))
    bucket_bits = max(4, min(24, (groups - 1).bit_length()))
    bits = max(bucket_bits + 8, min(60, (size // 2).bit_length() + SPARE_BITS))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.length("text"), F.spark_partition_id()), F.lit(groups)).cast("int"))
    # a task goes through its groups one by one; beyond TASK_GROUPS of them there are more tasks than the setting has
    dealt = dealt.repartition(groups // TASK_GROUPS, "g") if groups > TASK_GROUPS * parts else dealt.repartition("g")
    anchors = dealt.groupBy("g").applyInArrow(
        _send(block, bits, bucket_bits, key), SENT_DDL
    ).groupBy("bucket").applyInArrow(_anchors(bits, bucket_bits), BACK_DDL)
    items = dealt.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(_extend(window, block, bits, bucket_bits, key), EXT_DDL)
    found = items.groupBy("bucket").applyInArrow(_least, BACK_DDL)
    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(
        _remove(window, digest, key), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string"
    )
