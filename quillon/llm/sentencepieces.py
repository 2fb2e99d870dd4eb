"""Encoding and decoding with SentencePiece vocabularies of the merge type.

Encoding: a text's characters are the first symbols, and all adjacent pairs that form a piece wait in an agenda (a heap) ordered
by the piece's score, the greater first, then by place. The best pair is merged, and the pairs that it makes with its new
neighbours are added; a pair one side of which has changed since is passed over. Symbols that are no piece give the
pieces of their bytes.

Two characters that stand side by side in no piece are never merged across, so a text may be cut between them and each
part has an agenda of its own: words with the blanks before them where no piece has a blank after another character, and the marks after a
word where no piece has them after a letter. Parts are remembered in a bounded memo. Short parts that it misses are merged side by
side: the agendas of all of them lie in one array, and a step takes the best pair of each.

Decoding: pieces give their text with blanks for their marks, runs of byte pieces are read as UTF-8 (each byte that
belongs to no character gives U+FFFD), control pieces give nothing, and the first piece that is shown loses
the blank that encoding has put before it.

Every Arrow batch is held against the sentencepiece library, whole texts, ids and decoded text; a difference stops the job
(`verify=False` leaves this out).

Defined results: a null text is the empty text; empty texts have the begin and end ids alone. Rows repeated, or without
doc_id, are encoded each for itself. An empty table gives no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto

from quillon.llm.common import Memo, by_batch, texts_of

PIECE_BPE = "piece_bpe_32k.model"
#: The mark that pieces have for a blank, and what a byte that is no part of a character gives.
MARK, NO_CHARACTER = "▁", "�"
#: Bits of a place in a text.
PLACE = 40
#: Characters of a part up to which its agenda is a plain list or a row of an array, and the rank of pairs that are no piece.
SHORT, NEVER = 48, 1 << 80
#: The same rank in an array, with room for a place; characters of the texts that are cut together, and parts that are merged together.
NEVER_HERE, AT_ONCE, MANY = 1 << 62, 1 << 20, 1 << 16
BYTES = re.compile("<0x([0-9A-F]{2})>").fullmatch


class Pieces:
    """A vocabulary: ids and scores of pieces, which characters may be merged, the text of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = proto.ModelProto.FromString(f.read())
        kind, norm = proto.ModelProto.SentencePiece, spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path} is no merge-type vocabulary for texts as they are")
        if any(p.type in (kind.UNUSED, kind.USER_DEFINED) for p in spec.pieces):
            raise ValueError(f"{path} has unused or user-defined pieces")
        self.library = SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.prefix = " " * norm.add_dummy_prefix
        normal = [(i, p) for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL]
        self.id_of = {p.piece.replace(MARK, " "): i for i, p in normal}
        order = {score: k for k, score in enumerate(sorted({-p.score for _, p in normal}))}
        #: The place of a piece's score among all, above room for a place in a text.
        self.rank = {p.piece.replace(MARK, " "): order[-p.score] << PLACE for _, p in normal}
        self.byte_ids = {int(m[1], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE and (m := BYTES(p.piece))}
        self.unknown = self.library.unk_id()
        self.pairs = {a + b for piece in self.id_of for a, b in zip(piece, piece[1:], strict=False)}
        self._cuts()
        self.parts = Memo(self._part, 800_000)
        self._number()
        #: Of each id: its bytes, and whether they are to be read as UTF-8 with those around it.
        self.shown = [b""] * len(spec.pieces)
        for i, p in normal:
            self.shown[i] = p.piece.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.shown[i] = bytes([b])
        self.shown[self.unknown] = spec.trainer_spec.unk_surface.encode()
        self.is_byte = np.zeros(len(spec.pieces), bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.column = pa.array(self.shown, pa.large_binary())

    def _number(self) -> None:
        """Numbers of symbols: ids of pieces; the byte's id of one-byte characters that are no piece; above `ids` other characters of pieces, last all else."""
        self.ids = self.library.get_piece_size()
        number = dict(self.id_of)
        for c in map(chr, range(128)):
            if c not in number and ord(c) in self.byte_ids:
                number[c] = self.byte_ids[ord(c)]
        others = sorted(set("".join(self.id_of)).difference(number))
        number.update(zip(others, range(self.ids, self.ids + len(others)), strict=True))
        self.none = self.ids + len(others)
        self.number_of = np.full(0x110000, self.none, np.int64)
        for c, n in number.items():
            if len(c) == 1:
                self.number_of[ord(c)] = n
        self.rank_of = np.full(self.none + 1, NEVER_HERE, np.int64)
        for piece, r in self.rank.items():
            self.rank_of[number[piece]] = r
        halves = {
            number[a] * (self.none + 1) + number[b]: i
            for piece, i in self.id_of.items() for a, b in ((piece[:k], piece[k:]) for k in range(1, len(piece))) if a in number and b in number
        }
        self.halves = np.array([*sorted(halves), NEVER_HERE], np.int64)
        self.wholes = np.array([*map(halves.__getitem__, self.halves[:-1].tolist()), self.none], np.int64)

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text, with the begin and end ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """`encode` of each of these texts."""
        out, at = [], 0
        while at < len(texts):
            end, room = at + 1, AT_ONCE - len(texts[at])
            while end < len(texts) and (room := room - len(texts[end])) >= 0:
                end += 1
            out += self._encoded(texts[at:end])
            at = end
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        # the mark in a text is a blank to the library
        blocks = [(self.prefix + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        data, starts = b"".join(blocks), np.cumsum([0, *map(len, blocks)])
        edges = self._edges(np.frombuffer(data, np.uint8), starts)
        parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [ids for at in range(0, len(names), MANY) for ids in self._known(names[at : at + MANY])]
        ids, ends = joined(pa.array(known, pa.large_binary()).take(parts.indices))
        bounds = np.append(0, ends)[np.searchsorted(edges, starts)].tolist()
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        return [b"".join([begin, ids[a:b], end]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def _edges(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the parts of texts in UTF-8 begin, and the end: at texts, blanks after another character, marks after Latin letters."""
        cut = np.zeros(len(data) + 1, bool)
        if self.by_words and len(data):
            blank = data == ord(" ")
            cut[1:-1] = blank[1:] & ~blank[:-1] | self.is_mark[data[1:]] & self.is_letter[data[:-1]]
        cut[starts] = True
        return np.flatnonzero(cut)

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of these parts, which are different ones. Short ones that the memo misses are merged together, but for those with characters of several byte pieces."""
        memo = self.parts
        known = dict(zip(parts, map(memo.get, parts), strict=True))
        new = [x for x, ids in known.items() if ids is None]
        short = [x for x in new if len(x) <= SHORT]
        if len(memo) + len(short) > memo.limit:
            memo.clear()
        for names, symbols, size in self._side_by_side(short):
            end = np.cumsum(size)
            whole = np.maximum.reduceat(symbols, end - size) < self.ids
            ids = symbols.astype("<u4").tobytes()
            for name, a, b, ok in zip(names.tolist(), (4 * (end - size)).tolist(), (4 * end).tolist(), whole.tolist(), strict=True):
                if ok:
                    memo[name] = known[name] = ids[a:b]
        for x in new:
            if known[x] is None:
                known[x] = memo[x]
        return list(known.values())

    def _side_by_side(self, parts: list[str]):
        """Merges many parts: one step takes the best pair of each, of equal ones the first. Gives those whose agendas are empty: parts, numbers of symbols, how many each has."""
        names, size = np.array(parts, object), np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = self.number_of[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        whole = np.full(len(symbols), self.none)  # what each symbol makes with the next one of its part
        if len(symbols):
            whole[:-1] = self._wholes(symbols[:-1], symbols[1:])
            whole[np.cumsum(size) - 1] = self.none
        while len(size):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(self.rank_of[whole] | np.arange(len(whole)), start)
            i, live = (best & (1 << PLACE) - 1) - start, best < NEVER_HERE
            if not live.all():
                of_live = np.repeat(live, size)
                yield names[~live], symbols[~of_live], size[~live]
                names, size, i, symbols, whole = names[live], size[live], i[live], symbols[of_live], whole[of_live]
                start = np.cumsum(size) - size
            i += start
            symbols[i] = whole[i]
            stays = np.ones(len(symbols), bool)
            stays[i + 1] = False
            symbols, whole = symbols[stays], whole[stays]
            k = np.arange(len(size))  # so many symbols before are gone
            i, start, size = i - k, start - k, size - 1
            last = i == start + size - 1
            whole[i[last]] = self.none
            j = i[~last]
            whole[j] = self._wholes(symbols[j], symbols[j + 1])
            j = i[i > start]
            whole[j - 1] = self._wholes(symbols[j - 1], symbols[j])

    def _wholes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that symbols make with others, or `none`."""
        pair = a * (self.none + 1) + b
        at = np.searchsorted(self.halves, pair)
        return np.where(self.halves[at] == pair, self.wholes[at], self.none)

    def _cuts(self) -> None:
        """The bytes between which a text is cut, as no two characters of `pairs` meet there: before blanks, and between Latin letters and marks after them.

        Where some piece has a blank after another character the text is one part, which is cut by `pairs` alone.
        """
        self.by_words = not any(a != " " and b == " " for a, b in self.pairs)
        letters = {c for c in map(chr, range(128)) if c.isalpha()}
        after_letters = {b for a, b in self.pairs if a in letters}
        self.is_letter, self.is_mark = (np.array([chr(c) in those for c in range(256)]) for those in (letters, set(map(chr, range(128))) - letters - after_letters))

    def _part(self, part: str) -> bytes:
        cuts = [k for k, pair in enumerate(map(add, part, part[1:]), 1) if pair not in self.pairs]
        if not cuts:
            return self._ids(part)
        return b"".join([self.parts[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)])

    def _ids(self, part: str) -> bytes:
        symbols, known = self.merged(part), self.id_of
        ids = list(map(known.get, symbols))
        if None in ids:  # a character that is no piece
            ids = [i for s in symbols for i in ([known[s]] if s in known else map(self.byte_ids.get, s.encode()) if self.byte_ids else [self.unknown])]
        return array("I", ids).tobytes()

    def merged(self, part: str) -> list[str]:
        """The symbols of a part once its agenda is empty: a list whose least is taken, or for long parts a heap."""
        if len(part) > SHORT:
            return self._heaped(part)
        rank, symbols = self.rank.get, list(part)
        agenda = [rank(p, NEVER) for p in map(add, part, part[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)  # of equal ones the first
            whole = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(whole + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + whole, NEVER)
        return symbols

    def _heaped(self, part: str) -> list[str]:
        rank, symbols, n = self.rank.get, list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the neighbours of each symbol
        agenda = [r | i for i, r in enumerate(map(rank, map(add, part, part[1:]))) if r is not None]
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            i = best & (1 << PLACE) - 1
            j = after[i]
            if j == n or not symbols[i] or rank(whole := symbols[i] + symbols[j]) != best - i:
                continue
            symbols[i], symbols[j] = whole, ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = rank(whole + symbols[k])
                if r is not None:
                    heappush(agenda, r | i)
            if h >= 0:
                r = rank(symbols[h] + whole)
                if r is not None:
                    heappush(agenda, r | h)
        return [s for s in symbols if s]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8."""
        if not len(ids):
            return b""
        shown, byte = self.shown, self.is_byte[ids]
        text, ends = joined(self.column.take(pa.array(ids)))
        if byte.any() and not readable(text):
            edges = np.flatnonzero(np.diff(byte)) + 1  # runs of byte pieces and of others take turns
            found, at, is_byte = [], 0, bool(byte[0])
            for end in ends[[*(edges - 1), -1]].tolist():
                run = text[at:end]
                found.append(characters(run) if is_byte else run)
                at, is_byte = end, not is_byte
            text = b"".join(found)
        first = next((i for i in ids if shown[i]), self.unknown)
        return text[1:] if self.prefix and first != self.unknown and not self.is_byte[first] and text[:1] == b" " else text


def joined(column: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """The values of a new column one after another, and where each ends."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column), 8) if len(column) else np.zeros(0, np.int64)
    return data.to_pybytes()[: ends[-1]] if len(ends) and ends[-1] else b"", ends


def readable(run: bytes) -> bool:
    """Whether bytes are UTF-8. Pieces that are no bytes begin and end with whole characters, so a text is if its runs of byte pieces are."""
    try:
        run.decode()
        return True
    except UnicodeDecodeError:
        return False


def characters(run: bytes) -> bytes:
    """UTF-8 of a run of bytes: each byte that belongs to no character is U+FFFD."""
    if readable(run):
        return run
    out, at = [], 0
    while at < len(run):
        size = 1 if run[at] < 0x80 else 2 if run[at] < 0xE0 else 3 if run[at] < 0xF0 else 4
        if readable(run[at : at + size]):
            out.append(run[at : at + size])
            at += size
        else:
            out.append(NO_CHARACTER.encode())
            at += 1
    return b"".join(out)


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Differs(ValueError):
    """The library gives other ids or another text."""


def check(p: Pieces, texts: list[str], ids: list[bytes], decoded: list[bytes]) -> None:
    """Holds a batch against the library."""
    for t, mine, text, theirs in zip(texts, ids, decoded, p.library.encode(texts, add_bos=True, add_eos=True, num_threads=1), strict=True):
        if array("I", theirs).tobytes() != mine or p.library.decode(theirs).encode() != text:
            raise Differs(f"a text of {len(t)} characters differs from the library: {t[:80]!r}")


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", verify: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens (with begin and end), ids_sha256, decoded_sha256."""

    def f(rows: pa.RecordBatch) -> dict:
        p, texts = pieces_of(model), texts_of(rows)
        ids = p.encode_all(texts)
        decoded = [p.decode(np.frombuffer(i, np.uint32)) for i in ids]
        if verify:
            check(p, texts, ids, decoded)
        return {
            "doc_id": rows.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(by_batch(f, schema, rows=64), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, model: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, begin and end included, as array<int> in the column `to`."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        return pd.Series([np.frombuffer(i, np.int32) for i in pieces_of(model).encode_all([t or "" for t in texts])])

    return docs.withColumn(to, ids(F.col(text)))


def decode_column(docs: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """docs with the text of the ids of each row in the column `to`; null ids give the empty text, ids outside the vocabulary an error."""

    @F.pandas_udf("string")
    def text(lists):
        return lists.map(lambda x: pieces_of(model).decode(np.asarray([] if x is None else x, np.int64)).decode())

    return docs.withColumn(to, text(F.col(ids)))
