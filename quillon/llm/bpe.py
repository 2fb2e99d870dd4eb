"""Byte-pair encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoding. Let last[i] be the last token of the encoding of the first i bytes. A token t may end
there exactly if it is the first token, or if last[i - len(t)] and t are *compatible*: their bytes
together encode to just these two tokens. So the transducer reads a byte, finds the one token that
may end at it, and keeps last[] for a window only. All encodings of longer inputs run through one of
the last `longest` positions (`longest`: the bytes of the longest token), so what the chains from
these positions share cannot change any more: it is *stable*, is emitted and forgotten.

How far behind the reading head a token is stable at the latest follows from the merge list. A
byte read can undo a merge on its left only if a merge of earlier rank takes that merge's right part,
which in turn frees its left part, and so on, each time with a later rank. `lookahead` is the
longest such chain in bytes plus `longest`; a pass over the merges from last to first finds it. The
pending bytes are examined whenever they exceed twice that, so memory stays constant however
long the input. In natural text pieces are short, so this bound is rarely met.

Pieces (what the file's pre-tokenizer cuts) are remembered in a bounded memo. Texts are cut into pieces block by block, at blanks
that always begin one, so what is held beside the text is a block (a text of other scripts without such a blank is one block).

Decoding. `Utf8` takes the bytes of tokens as they come and gives text as soon as a character is whole;
it holds three bytes at most. Bytes that are no UTF-8 become U+FFFD as in the tokenizers library.

Defined results: a null text is the empty text and has no tokens; ids_sha256 is then that of the empty
string. Rows repeated, or without doc_id, are encoded each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import encoders
from quillon.llm.common import Memo, by_batch, texts_of

NEVER = 1 << 30
#: Bytes at the start of a piece for which results are remembered.
SHORT = 32
#: Characters of text that are encoded, hashed and decoded at a time.
BLOCK = 1 << 16
LONE_BLANK = re.compile(r"(?<=[^\W_]) (?=[^\W_])").search


class Merges:
    """The merge list of a byte-level file: tokens by id, ranks of pairs, and what follows from them."""

    def __init__(self, path: str):
        spec, alphabet = encoders.specification(path), encoders.byte_alphabet()
        raw = {t: bytes(map(alphabet.__getitem__, t)) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = dict.fromkeys(self.id_of.values(), -1)
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.id_of[raw[x]] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = n
            if made not in self.parts:
                self.parts[made], self.born[made] = (a, b), n
        self.longest = max(map(len, self.id_of))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """The bytes that lie at most between the reading head and the last stable token boundary."""
        reach: dict[int, int] = {}  # right part -> how far left a later merge that has it can be undone from there
        most = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: -x[1]):
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            far = len(self.bytes_of[a]) + max(reach.get(a, 0), reach.get(made, 0))
            reach[b] = max(reach.get(b, 0), far)
            most = max(most, far)
        return most + self.longest

    def compatible(self, a: int, b: int) -> bool:
        """Do the bytes of a and b, put together, encode to just (a, b)?

        The pieces that met at their boundary are gone through from the last pair back to the two
        bytes; a merge of such a pair would have come first if its rank is below that at which
        a side was consumed (on equal ranks the pair further left is first).
        """
        end_a = end_b = NEVER
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < end_a and r <= end_b:
                return False
            if self.born[a] > self.born[b]:
                end_a, a = self.born[a], self.parts[a][1]
            elif self.born[b] >= 0:
                end_b, b = self.born[b], self.parts[b][0]
            else:
                return True


class Transducer:
    """Encodes the bytes of one piece: feed() gives the ids that are stable so far, finish() the rest."""

    def __init__(self, merges: Merges):
        self.m = merges
        #: Memos: whether a pair is compatible, and the last token of a beginning of a piece.
        self.pairs: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}
        self._begin()

    def _begin(self) -> None:
        self.buffer, self.last, self.before = bytearray(), [-1], -1

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        step = self.m.lookahead
        for at in range(0, len(more), step):
            self._read(more[at : at + step])
            if len(self.buffer) > 2 * step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        ids = self._chain(len(self.buffer))
        self._begin()
        return ids

    def _read(self, more: bytes) -> None:
        at = len(self.buffer)
        self.buffer += more
        buffer, last, known = bytes(self.buffer), self.last, self.known
        for i in range(at + 1, len(buffer) + 1):
            if self.before < 0 and i <= SHORT:  # the first bytes of a piece: many pieces begin alike
                head = buffer[:i]
                t = known.get(head)
                if t is None:
                    if len(known) > 400_000:
                        known.clear()
                    t = known[head] = self._ends(buffer, i)
            else:
                t = self._ends(buffer, i)
            last.append(t)

    def _ends(self, buffer: bytes, i: int) -> int:
        """The last token of the encoding of all that was read up to buffer[:i]."""
        last, pairs, heads, longest = self.last, self.pairs, self.m.id_of, self.m.longest
        for start in range(i - 1, max(0, i - longest) - 1, -1):
            t = heads.get(buffer[start:i])
            if t is None:
                continue
            p = last[start] if start else self.before
            if p < 0:
                return t
            fits = pairs.get(p << 32 | t)
            if fits is None:
                if len(pairs) > 400_000:
                    pairs.clear()
                fits = pairs[p << 32 | t] = self.m.compatible(p, t)
            if fits:
                return t
        raise AssertionError("a byte is a token, so some token ends everywhere")

    def _chain(self, i: int) -> list[int]:
        ids = []
        while i:
            ids.append(self.last[i])
            i -= len(self.m.bytes_of[self.last[i]])
        return ids[::-1]

    def _stable(self) -> list[int]:
        """Takes off the tokens that the chains of the last positions share."""
        end = len(self.buffer)
        on = set(range(max(0, end - self.m.longest + 1), end + 1))
        while len(on) > 1:  # the furthest goes back a token until all are one
            i = max(on)
            on.remove(i)
            on.add(i - len(self.m.bytes_of[self.last[i]]))
        cut = on.pop()
        ids = self._chain(cut)
        if ids:
            del self.buffer[:cut]
            self.before, self.last = ids[-1], self.last[cut:]
        return ids


class Utf8:
    """Text of bytes as they come: a machine whose state is the bytes, three at most, of a character begun."""

    def __init__(self):
        self.held = b""

    def feed(self, more: bytes) -> str:
        data = self.held + more
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # leads a character of 2, 3 or 4 bytes
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
            if not 0x80 <= b < 0xC0:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


class Codec:
    """Encodes and decodes streams of text by one file."""

    def __init__(self, path: str):
        self.m = Merges(path)
        self.library = encoders.library(path)
        self.transducer = Transducer(self.m)
        self.pieces = Memo(self._piece)
        self.words, self.first = Memo(lambda w: self._cut(f" {w}")), Memo(self._cut)
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.m.specials)) + ")").split if self.m.specials else lambda t: [t]
        self.bytes_of = [self.m.bytes_of.get(i, b"") for i in range(max(self.m.bytes_of) + 1)]
        self.decimal = [b"%d" % i for i in range(len(self.bytes_of))]

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.feed(piece.encode())
        return array("I", ids + self.transducer.finish()).tobytes()

    def _cut(self, text: str) -> bytes:
        body = text.rstrip(".,")
        if body[1:].isalpha() and (body[0] == " " or body[0].isalpha()):
            return self._piece(body) if len(body) == len(text) else self._piece(body) + self.pieces[text[len(body) :]]
        return b"".join([self.pieces[p] for c in encoders.CHUNKS(text) for p in encoders.BYTE_PIECES(c)])

    def _odd(self, text: str) -> bytes:
        """Text with characters outside the plain ones: the file's own pre-tokenizer cuts it."""
        alphabet = encoders.byte_alphabet()
        return b"".join([self.pieces[bytes(map(alphabet.__getitem__, p)).decode()] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def _parts(self, text: str) -> Iterator[str]:
        """text in parts of about BLOCK characters: a lone blank between two letters or digits always begins a piece."""
        at = 0
        while at < len(text):
            m = LONE_BLANK(text, at + BLOCK)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of little-endian uint32 ids."""
        for k, part in enumerate(self.split_specials(text)):
            if k % 2:
                yield array("I", [self.m.specials[part]]).tobytes()
            elif not encoders.PLAIN_TEXT(part):
                yield from map(self._odd, self._parts(part))
            elif not part or part[0] == " " or part[-1] == " " or encoders.UNEVEN(part):
                yield from map(self._cut, self._parts(part)) if part else ()
            else:
                at = 0
                while at < len(part):  # blocks begin at a lone blank
                    end = part.find(" ", at + BLOCK)
                    first, *words = part[at + (at > 0) : end if end > 0 else len(part)].split(" ")
                    yield (self.words if at else self.first)[first] + b"".join(map(self.words.__getitem__, words))
                    at = end if end > 0 else len(part)

    def decode(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        machine = Utf8()
        for ids in blocks:
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))
        yield machine.finish()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def digests(c: Codec, text: str) -> tuple[int, str, str]:
    """(tokens, sha256 of the ids in decimal, sha256 of the decoded text), block by block."""
    n, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), Utf8()
    for block in c.encode(text):
        ids = np.frombuffer(block, np.uint32).tolist()
        if ids:
            of_ids.update(b"," * (n > 0) + b",".join(map(c.decimal.__getitem__, ids)))
            n += len(ids)
            of_text.update(machine.feed(b"".join(map(c.bytes_of.__getitem__, ids))).encode())
    of_text.update(machine.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _digested(path: str) -> Callable[[pa.RecordBatch], dict]:
    def f(rows: pa.RecordBatch) -> dict:
        c = codec(path)
        n, ids, text = zip(*(digests(c, t) for t in texts_of(rows)), strict=True) if rows.num_rows else ((), (), ())
        return {"doc_id": rows.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text}

    return f


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(by_batch(_digested(tokenizer), schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, tokenizer: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as array<int> in the column `to`."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(tokenizer)
        return texts.map(lambda t: np.frombuffer(b"".join(c.encode(t or "")), np.int32))

    return docs.withColumn(to, ids(F.col(text)))


def decode_column(docs: DataFrame, tokenizer: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """docs with the text of the ids of each row in the column `to`; null ids give the empty text."""

    @F.pandas_udf("string")
    def text(lists):
        c = codec(tokenizer)
        return lists.map(lambda x: "".join(c.decode([np.asarray([] if x is None else x, np.int64)])))

    return docs.withColumn(to, text(F.col(ids)))
