"""Blocks of an index, and bounds and scores of a chunk of queries against them, as numpy matrices inside tasks (operators.batch_search).

Of a slice of groups or blocks all bounds are one matrix of queries and blocks; of an opened block all scores are one matrix of its queries and rows. Sets are
0/1 matrices over the values of the slice, so their common values are a product. Matrices have single precision and only choose pairs; the
chosen ones are scored in doubles, with terms added as search.rank() adds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A score may be less than another by rounding: scores have eight places. Single precision: so much, and so much of the value.
SLACK, ROUGH, SHARE = 1e-7, 1e-5, 1e-6
#: Queries and blocks of one matrix of bounds, queries of one of scores, rows found that a task holds before it drops those beyond the k best.
QUERIES, BLOCKS, SCORED, HELD = 2048, 256, 256, 1 << 20
#: Blocks of a group, whose bound comes before theirs.
GROUP = 16
#: Stands for a null id, which comes first.
NO_ID = -(1 << 63)
#: A row whose score is unknown comes after all others; one that is no result. Finite, so that margins can be added.
UNKNOWN, NOT = -1e30, np.float32(-3e38)

LISTS = (*[f"{f}_{o}" for f in ("genres", "tags") for o in ("all_of", "any_of", "none_of")], "of_formats", "of_statuses", "ref_genres", "ref_tags", "wish_genres", "wish_tags")
RANGES = ("year", "episodes")


def _flat(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists at these starts: the owner of each value and the value's place."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class _Sets:
    """Lists of texts as codes; a text without a code (of no query) has -1."""

    def __init__(self, lists: pa.Array, codes: dict, grow: bool = False):
        self.lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        known = [codes.setdefault(v, len(codes)) if grow else codes.get(v, -1) for v in coded.dictionary.to_pylist()]
        self.code = np.array(known, np.int32)[coded.indices.to_numpy(zero_copy_only=False)] if known else np.zeros(0, np.int32)
        self.n, self.start = len(lists), np.concatenate([[0], np.cumsum(self.lengths)])
        self.null = np.zeros(self.n, bool)
        self.null[np.repeat(np.arange(self.n), self.lengths)[self.code == codes[None]]] = True

    def sizes(self) -> np.ndarray:
        """The number of different codes of each row."""
        owner = np.repeat(np.arange(self.n), self.lengths)
        pairs = np.unique(np.stack([owner, self.code]), axis=1)
        return np.bincount(pairs[0], minlength=self.n)

    def dense(self, places: np.ndarray, local: np.ndarray, width: int) -> np.ndarray:
        """These rows as 0/1 over local codes."""
        owner, at = _flat(self.start[places], self.lengths[places])
        at = local[self.code[at]]
        out = np.zeros((len(places), width), np.float32)
        out[owner[at >= 0], at[at >= 0]] = 1
        return out


def _numbers(column: pa.Array) -> np.ndarray:
    """As doubles, null as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _jaccard(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    union = a + b - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


# --- cutting ------------------------------------------------------------------------------------------------------


def _same_as_before(lists: pa.Array) -> np.ndarray:
    """Is a list the same as the one before it?"""
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    code = lists.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    same = np.zeros(len(lists), bool)
    same[1:] = lengths[1:] == lengths[:-1]
    asked = np.flatnonzero(same)
    owner, at = _flat(start[asked], lengths[asked])
    differs = code[at] != code[at - lengths[asked][owner]]
    same[asked[owner[differs]]] = False
    return same


def _listed(blocks: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    counts = np.bincount(blocks, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _united(lists: pa.Array, block: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each block the values that any and that all of its rows have."""
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    width = max(len(coded.dictionary), 1)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, counts = np.unique(np.repeat(block, np.diff(lists.offsets.to_numpy())) * width + code, return_counts=True)
    every = counts == sizes[pairs // width]
    return tuple(_listed(p // width, coded.dictionary.take(pa.array(p % width)), len(sizes)) for p in (pairs, pairs[every]))


def cut(batches: Iterator[pa.RecordBatch], block: int, first: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks of one set of genres and at most so many rows, numbered from `first`."""
    number = first
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([batch]).take(pa.array(np.arange(batch.num_rows))).combine_chunks().to_batches()[0]  # offsets from 0
        row = dict(zip(batch.schema.names, batch.columns, strict=True))
        run = np.maximum.accumulate(np.where(_same_as_before(row["genres"]), 0, np.arange(batch.num_rows)))
        starts = np.flatnonzero((np.arange(batch.num_rows) - run) % block == 0)
        sizes, n = np.diff(np.append(starts, batch.num_rows)), len(starts)
        of = np.repeat(np.arange(n), sizes)
        numbers = np.arange(number, number + n)
        out = {"group": pa.array(numbers // GROUP), "block": pa.array(numbers), "genres": row["genres"].take(pa.array(starts))}
        out["tags"], out["every_tags"] = _united(row["strong"], of, sizes)
        lengths = np.diff(row["strong"].offsets.to_numpy()).astype(np.int64)
        out["least_tags"], out["most_tags"] = pa.array(np.minimum.reduceat(lengths, starts)), pa.array(np.maximum.reduceat(lengths, starts))
        # nulls are left out, and are the result where there is nothing else
        number_of = lambda f, c: pa.array(f.reduceat(_numbers(row[c]), starts), from_pandas=True)
        out["bound"] = number_of(np.fmax, "static")
        for c in RANGES:
            out[f"min_{c}"], out[f"max_{c}"] = number_of(np.fmin, c), number_of(np.fmax, c)
        for c, name in (("format", "formats"), ("status", "statuses")):
            there = np.flatnonzero(row[c].is_valid().to_numpy(zero_copy_only=False))
            out[name] = _united(pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1), pa.int32()), row[c].take(pa.array(there))), of[there], sizes)[0]
        names = [c for c in batch.schema.names if c not in ("genres", "static")]
        out["rows"] = _listed(of, pa.StructArray.from_arrays([row[c] for c in names], names), n)
        number += n
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


# --- searching ----------------------------------------------------------------------------------------------------


class Asked:
    """A chunk of prepared queries; takes of each some number of rows, so it is bounded and sent once."""

    def __init__(self, table: pa.Table):
        self.codes: dict = {None: 0}
        self.number = _one(table, "number").to_numpy()
        self.sets = {c: _Sets(_one(table, c), self.codes, grow=True) for c in LISTS}
        self.size = {c: s.sizes().astype(np.float32) for c, s in self.sets.items()}
        self.bounds = {c: _numbers(_one(table, c)) for f in RANGES for c in (f"min_of_{f}", f"max_of_{f}")}
        self.refs = _one(table, "refs").to_numpy() > 0
        #: The score that a row has to reach, and the groups that were opened before, of each query.
        self.least = np.full(len(self.number), -np.inf)
        self.given: dict[int, np.ndarray] = {}

    def reach(self, number: np.ndarray, least: np.ndarray) -> None:
        self.least[self._places(number)] = least

    def give(self, number: np.ndarray, group: np.ndarray) -> None:
        places, order = self._places(number), np.argsort(group, kind="stable")
        groups, first = np.unique(group[order], return_index=True)
        self.given = dict(zip(groups.tolist(), map(np.sort, np.split(places[order], first[1:])), strict=True)) if len(groups) else {}

    def _places(self, number: np.ndarray) -> np.ndarray:
        order = np.argsort(self.number)
        return order[np.searchsorted(self.number, number, sorter=order)]

    def local(self, *codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Places of these codes."""
        seen = np.unique(np.concatenate(codes))
        seen = seen[seen >= 0]
        local = np.full(len(self.codes) + 1, -1)  # the last for code -1
        local[seen] = np.arange(len(seen))
        return local, len(seen)


class _Mine:
    """Some of the queries against some things (rows, blocks or groups)."""

    def __init__(self, asked: Asked, places: np.ndarray):
        self.q, self.places = asked, places

    def size(self, c: str) -> np.ndarray:
        return self.q.size[c][self.places, None]

    def asks(self, *names: str) -> bool:
        return any(self.q.size[c][self.places].any() for c in names)

    def wanted(self, c: str, things: np.ndarray, local: np.ndarray) -> np.ndarray:
        """How many values of the queries' set c each thing (a 0/1 row) has."""
        return self.q.sets[c].dense(self.places, local, things.shape[1]) @ things.T

    def has_all(self, c: str, things: np.ndarray, local: np.ndarray) -> np.ndarray | bool:
        return self.wanted(c, things, local) == self.size(c) if self.asks(c) else True

    def has_any(self, c: str, things: np.ndarray, local: np.ndarray) -> np.ndarray | bool:
        """No value wanted, or one there; null is like no value."""
        return (self.size(c) == 0) | (self.wanted(c, things, _without_null(local)) > 0) if self.asks(c) else True

    def has_none(self, c: str, things: np.ndarray, local: np.ndarray, null: np.ndarray, empty: np.ndarray) -> np.ndarray | bool:
        """No unwanted value there; where either has a null that is not known."""
        if not self.asks(c):
            return True
        unsure = (self.size(c) > 0) & ~empty & (self.q.sets[c].null[self.places, None] | null)
        return (self.wanted(c, things, _without_null(local)) == 0) & ~unsure

    def within(self, f: str, least: np.ndarray, most: np.ndarray) -> np.ndarray | bool:
        """May a value between these meet the range? Unknown ones don't."""
        ok: np.ndarray | bool = True
        for c, meets in ((f"min_of_{f}", lambda a: most >= a), (f"max_of_{f}", lambda b: least <= b)):
            bound = self.q.bounds[c][self.places, None]
            if not np.isnan(bound).all():
                ok = ok & (np.isnan(bound) | meets(bound))
        return ok


def _without_null(local: np.ndarray) -> np.ndarray:
    out = local.copy()
    out[0] = -1
    return out


class _View:
    """Sets of things: the values that any and that all of a thing's rows have, and how many a row has."""

    def __init__(self, some: np.ndarray, every: np.ndarray, known: np.ndarray, least: np.ndarray, most: np.ndarray, null: np.ndarray, local: np.ndarray):
        #: known: how many values every row has, also those of no query.
        self.some, self.every, self.known, self.least, self.most, self.null, self.local = some, every, known, least, most, null, local

    def common(self, mine: _Mine, c: str) -> tuple[np.ndarray, np.ndarray]:
        """Of the queries' set c: how many values a row has at most, and how many other values each row has at least."""
        some = mine.wanted(c, self.some, self.local)
        others = self.known - (some if self.every is self.some else mine.wanted(c, self.every, self.local))
        return np.minimum(some, self.most - others), others

    def alike(self, mine: _Mine, c: str) -> np.ndarray:
        """What the Jaccard similarity with the set c is at most: it grows with the common values and falls with a row's size."""
        common, others = self.common(mine, c)
        return common / np.maximum(mine.size(c) + np.maximum(self.least, common + others) - common, 1)

    def joined(self, starts: np.ndarray) -> _View:
        """Of runs of these things."""
        every = np.minimum.reduceat(self.every, starts, axis=0)
        least, most = np.minimum.reduceat(self.least, starts), np.maximum.reduceat(self.most, starts)
        return _View(np.maximum.reduceat(self.some, starts, axis=0), every, every.sum(axis=1), least, most, np.logical_and.reduceat(self.null, starts), self.local)


class Things:
    """Facts of blocks or groups: what their rows can give a query."""

    def __init__(self, asked: Asked, sets: dict, ranges: dict, bound: np.ndarray):
        self.q, self.sets, self.range, self.bound = asked, sets, ranges, bound

    @staticmethod
    def read(batch: pa.RecordBatch, asked: Asked) -> Things:
        column = {n: batch.column(n) for n in batch.schema.names}
        sets = {}
        for f in ("genres", "tags", "formats", "statuses"):
            some = _Sets(column[f], asked.codes)
            every = _Sets(column[f"every_{f}"], asked.codes) if f"every_{f}" in column else some
            local, width = asked.local(some.code)
            s = some.dense(np.arange(some.n), local, width)
            e = s if every is some else every.dense(np.arange(some.n), local, width)
            single = lambda n: column[n].to_numpy().astype(np.float32) if n in column else some.lengths.astype(np.float32)  # noqa: B023, E731
            sets[f] = _View(s, e, every.lengths.astype(np.float32), single(f"least_{f}"), single(f"most_{f}"), every.null, local)
        bound = _numbers(column["bound"])
        ranges = {f: (_numbers(column[f"min_{f}"]), _numbers(column[f"max_{f}"])) for f in RANGES}
        return Things(asked, sets, ranges, np.where(np.isnan(bound), UNKNOWN, bound).astype(np.float32))

    def part(self, things: slice) -> Things:
        cut = lambda v: _View(s := v.some[things], s if v.every is v.some else v.every[things], v.known[things], v.least[things], v.most[things], v.null[things], v.local)
        return Things(self.q, {f: cut(v) for f, v in self.sets.items()}, {f: (a[things], b[things]) for f, (a, b) in self.range.items()}, self.bound[things])

    def joined(self, starts: np.ndarray) -> Things:
        ranges = {f: (np.fmin.reduceat(a, starts), np.fmax.reduceat(b, starts)) for f, (a, b) in self.range.items()}
        return Things(self.q, {f: v.joined(starts) for f, v in self.sets.items()}, ranges, np.maximum.reduceat(self.bound, starts))

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """What these queries score at most in each thing, NaN where no row can meet them; of a block, genres are tested for good."""
        mine, genres, tags = _Mine(self.q, places), self.sets["genres"], self.sets["tags"]
        ok = np.ones((len(places), len(self.bound)), bool)
        for f, v in (("genres", genres), ("tags", tags)):
            ok &= mine.has_all(f"{f}_all_of", v.some, v.local)
            ok &= mine.has_any(f"{f}_any_of", v.some, v.local)
        ok &= mine.has_none("genres_none_of", genres.every, genres.local, genres.null, genres.known == 0)
        for c, f in (("of_formats", "formats"), ("of_statuses", "statuses")):
            ok &= mine.has_any(c, self.sets[f].some, self.sets[f].local)
        for f in RANGES:
            ok &= mine.within(f, *self.range[f])
        most = np.tile(self.bound, (len(places), 1))
        for c, v in (("genres", genres), ("tags", tags)):
            if mine.asks(f"wish_{c}"):
                most += np.float32(0.2) * v.common(mine, f"wish_{c}")[0]
            if mine.asks(f"ref_{c}"):
                most += np.where(self.q.refs[places, None], v.alike(mine, f"ref_{c}"), np.float32(0))
        return np.where(ok, _above(most), np.float32(np.nan))


def _above(x: np.ndarray) -> np.ndarray:
    return x + (np.abs(x) * np.float32(SHARE) + np.float32(ROUGH))


class Rows:
    """The rows of a slice of blocks."""

    def __init__(self, lists: pa.Array, asked: Asked):
        self.q, part = asked, lists.flatten()
        column = dict(zip([f.name for f in part.type], part.flatten(), strict=True))
        self.start = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        self.id = column["id"]
        self.strong, self.present = (_Sets(column[c], asked.codes) for c in ("strong", "present"))
        one = lambda c: _Sets(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1), pa.int32()), column[c]), asked.codes)
        self.single = {"of_formats": one("format"), "of_statuses": one("status")}
        self.popular, self.liked = _numbers(column["popular"]), _numbers(column["liked"])
        static = self.popular + self.liked
        self.static = np.where(np.isnan(static), UNKNOWN, static).astype(np.float32)
        self.ranges = {f: _numbers(column[f]) for f in RANGES}

    def scores(self, at: int, things: Things, places: np.ndarray, k: int | None, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, rows, raw scores (NaN where unknown) of the rows of block `at` that meet queries: without k all, else at least those of the k best that reach `least`, which rises to the k-th of the block.

        `things` are the facts of this block alone.
        """
        q, span = self.q, np.arange(self.start[at], self.start[at + 1])
        genres, n = things.sets["genres"], len(span)
        sets = {c: v for c, v in (("strong", self.strong), ("present", self.present))}
        local, width = q.local(*[v.code[v.start[span[0]] : v.start[span[-1] + 1]] for v in sets.values()])
        s, p = (v.dense(span, local, width) for v in sets.values())
        strong_size, static = self.strong.lengths[span].astype(np.float32), self.static[span]
        for low in range(0, len(places), SCORED):
            some = places[low : low + SCORED]
            mine = _Mine(q, some)
            ok = np.ones((len(some), n), bool)
            ok &= mine.has_all("tags_all_of", s, local)
            ok &= mine.has_any("tags_any_of", s, local)
            ok &= mine.has_none("tags_none_of", p, local, self.present.null[span], self.present.lengths[span] == 0)
            for c, v in self.single.items():
                if mine.asks(c):
                    one, wide = q.local(v.code[span])
                    ok &= mine.has_any(c, v.dense(span, one, wide), one)
            for f in RANGES:
                ok &= mine.within(f, self.ranges[f][span], self.ranges[f][span])
            same = mine.wanted("wish_genres", genres.some, genres.local)
            genres_common = mine.wanted("ref_genres", genres.some, genres.local)[:, 0].astype(np.float64)
            genres_alike = np.where(q.refs[some], _jaccard(genres_common, q.size["ref_genres"][some].astype(np.float64), float(genres.known[0])), 0.0)
            wished = mine.wanted("wish_tags", s, local) if mine.asks("wish_tags") else np.zeros(ok.shape, np.float32)
            common = mine.wanted("ref_tags", s, local) if mine.asks("ref_tags") else np.zeros(ok.shape, np.float32)
            size = mine.size("ref_tags")
            if k is None:
                i, j = np.nonzero(ok)
            else:
                # a reference without tags and a row without tags: no common value, so 0 of at least 1
                alike = common / np.maximum(size + strong_size - common, np.float32(1))
                rough = wished * np.float32(0.2) + np.where(q.refs[some, None], alike, np.float32(0)) + static
                rough += (same[:, 0] * 0.2 + genres_alike).astype(np.float32)[:, None]
                rough[~ok] = NOT
                if n >= k:
                    kth = np.partition(rough, n - k, axis=1)[:, n - k]
                    kth = np.where(kth > UNKNOWN / 2, kth - (np.abs(kth) * SHARE + ROUGH), -np.inf)
                    least[some] = np.maximum(least[some], kth)
                i, j = np.nonzero(ok & (_above(rough) >= least[some].astype(np.float32)[:, None]))
            both = common[i, j].astype(np.float64)
            similar = np.where(q.refs[some[i]], genres_alike[i] + _jaccard(both, size[i, 0].astype(np.float64), strong_size[j].astype(np.float64)), 0.0)
            raw = same[i, 0].astype(np.float64) * 0.2 + wished[i, j].astype(np.float64) * 0.2 + similar + self.popular[span[j]] + self.liked[span[j]]
            yield some[i], span[j], raw


class _Best:
    """Rows found so far; of each query no more than the k best and their equals."""

    def __init__(self, asked: Asked, k: int | None):
        self.q, self.k, self.least = asked, k, asked.least.copy()
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = self.kept = 0

    def add(self, places: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> None:
        if len(places):
            self.found.append((places, ids, raw))
            self.held += len(places)
            if self.k is not None and self.held > HELD + 2 * self.kept:
                self._keep(*self._all())

    def _all(self) -> tuple[np.ndarray, ...]:
        return tuple(map(np.concatenate, zip(*self.found, strict=True)))

    def _keep(self, places: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> None:
        value = np.where(np.isnan(raw), UNKNOWN, raw)
        order = np.lexsort((ids, -value, places))
        places, ids, raw, value = places[order], ids[order], raw[order], value[order]
        start = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        count = np.diff(np.append(start, len(places)))
        segment = np.repeat(np.arange(len(start)), count)
        rank = np.arange(len(places)) - start[segment]
        full = count >= self.k
        kth = np.where(full, value[start + np.minimum(self.k, count) - 1], -np.inf)
        known = full & (kth > UNKNOWN / 2)
        self.least[places[start[known]]] = np.maximum(self.least[places[start[known]]], kth[known] - SLACK)
        # an equal of the k-th goes if k rows come before it for certain: equals of lesser ids, and those greater by more than rounding
        unsure = np.bincount(segment, (value > kth[segment]) & (value <= kth[segment] + SLACK), len(start))[segment]
        keep = (rank < self.k) | (value >= kth[segment] - SLACK) & ~((value == kth[segment]) & (rank - unsure >= self.k))
        self.found = [(places[keep], ids[keep], raw[keep])]
        self.held = self.kept = int(keep.sum())

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        if self.k is not None:
            self._keep(*self._all())
        for places, ids, raw in self.found:
            reached = np.isnan(raw) | (raw >= self.least[places] - SLACK) if self.k is not None else np.ones(len(places), bool)
            yield pa.RecordBatch.from_arrays([pa.array(self.q.number[places[reached]]), pa.array(ids[reached], mask=ids[reached] == NO_ID), pa.array(raw[reached], from_pandas=True)], ["number", "id", "raw"])
        self.found, self.held = [], 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCKS):
            # a copy of the slice alone: offsets of a slice don't start at 0
            yield pa.Table.from_batches([batch]).take(pa.array(np.arange(at, min(at + BLOCKS, batch.num_rows)))).combine_chunks().to_batches()[0]


def _ranges(asked: Asked) -> Iterator[np.ndarray]:
    for low in range(0, len(asked.number), QUERIES):
        yield np.arange(low, min(low + QUERIES, len(asked.number)))


def best_groups(batches: Iterator[pa.RecordBatch], asked: Asked, first: int) -> Iterator[pa.RecordBatch]:
    """number, group, most: of each slice the groups of the greatest bounds of each query."""
    for batch in _slices(batches):
        groups, number = Things.read(batch, asked), batch.column("group").to_numpy()
        for places in _ranges(asked):
            most = groups.bounds(places)
            order = np.argsort(np.where(np.isnan(most), np.inf, -most), axis=1, kind="stable")[:, :first]
            got = np.take_along_axis(most, order, axis=1)
            i, j = np.nonzero(~np.isnan(got))
            yield pa.RecordBatch.from_arrays([pa.array(asked.number[places[i]]), pa.array(number[order[i, j]]), pa.array(got[i, j].astype(np.float64))], ["number", "group", "most"])


def _opened(batch: pa.RecordBatch, asked: Asked, given: bool, least: np.ndarray) -> Iterator[tuple[int, Things, np.ndarray]]:
    """Blocks, one after the other, with the places of the queries whose bound reaches `least`: of the groups that queries were given, or of the others."""
    things, group = Things.read(batch, asked), batch.column("group").to_numpy()
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    none = np.zeros(0, np.int64)
    if given:
        mine = [asked.given.get(g, none) for g in group[starts].tolist()]
    else:
        groups, found = things.joined(starts), [[] for _ in starts]
        for places in _ranges(asked):
            reached = (groups.bounds(places) >= least[places, None].astype(np.float32)).T
            for f, r in zip(found, reached, strict=True):
                f.append(places[r])
        mine = [np.setdiff1d(np.concatenate(f) if f else none, asked.given.get(g, none), assume_unique=True) for f, g in zip(found, group[starts].tolist(), strict=True)]
    for places, low, high in zip(mine, starts, np.append(starts[1:], len(group)), strict=True):
        if not len(places):
            continue
        most = np.concatenate([things.part(slice(low, high)).bounds(places[at : at + QUERIES]) for at in range(0, len(places), QUERIES)])
        for at in np.argsort(-things.bound[low:high], kind="stable"):  # the best first: scores raise `least`
            b = low + at
            reached = places[most[:, at] >= least[places].astype(np.float32)]
            if len(reached):
                yield b, things.part(slice(b, b + 1)), reached


def found(batches: Iterator[pa.RecordBatch], asked: Asked, k: int | None, given: bool, pairs: bool = False) -> Iterator[pa.RecordBatch]:
    """number, id, raw score of the best rows of the blocks that are opened, by the task's own k best so far; or (pairs) number, block of what is opened."""
    best = _Best(asked, k)
    for batch in _slices(batches):
        rows = Rows(batch.column("rows"), asked)
        ids, block = rows.id.fill_null(NO_ID).to_numpy(), batch.column("block").to_numpy()
        for b, things, places in _opened(batch, asked, given, best.least):
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(asked.number[places]), pa.array(np.full(len(places), block[b]))], ["number", "block"])
            for some, at, raw in rows.scores(b, things, places, k, best.least):
                best.add(some, ids[at], raw)
        if k is None:
            yield from best.batches()
    if not pairs:
        yield from best.batches()
