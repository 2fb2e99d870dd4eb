"""Token ids of whole texts with the public tokenizers' files, word by word with a bounded memo.

Both encoders give exactly what the tokenizers library gives with add_special_tokens=False. Plain
words (ASCII and Latin-1 letters) are encoded once and remembered; their pieces are cut by a pattern
that equals the file's own on these characters and merged by tiktoken. Any other character sends the
word, or for the byte-level file the whole text, to the tokenizers library itself.

The paths are parameters; each Python worker loads a file once.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from quillon.llm.common import Memo

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Characters whose class, case and normal form are the same in every Unicode version.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_TEXT = re.compile(f"[\t-\r -~{LETTERS}]*").fullmatch
#: White space kept with what follows it as the byte-level pattern does: a run's last blank goes to the next word.
CHUNKS = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]").findall
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[\t-\r ]+").findall
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+").findall
#: A blank beside other white space.
UNEVEN = re.compile(r"[\t-\r ] | [\t-\r]").search


def path_of(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level files: itself where printable, else from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def specification(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(4)
def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _le(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteIds:
    """Little-endian uint32 ids of a text by a byte-level BPE file."""

    def __init__(self, path: str):
        spec, alphabet = specification(path), byte_alphabet()
        self.whole = library(path)
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.core = tiktoken.Encoding("bytes", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.first, self.later = Memo(self._cut), Memo(lambda word: self._cut(f" {word}"))

    def _cut(self, text: str) -> bytes:
        """Ids of plain text, cut at white space and then by the file's pattern."""
        merge, body = self.core.encode_single_piece, text.rstrip(".,")
        if body[1:].isalpha() and (body[0] == " " or body[0].isalpha()):  # one piece, and one of marks
            return _le(merge(text.encode())) if len(body) == len(text) else _le(merge(body.encode()) + merge(text[len(body) :].encode()))
        return self._cut_slowly(text)

    def _cut_slowly(self, text: str) -> bytes:
        return _le([i for c in CHUNKS(text) for p in BYTE_PIECES(c) for i in self.core.encode_single_piece(p.encode())])

    def __call__(self, text: str) -> bytes:
        if not PLAIN_TEXT(text) or any(s in text for s in self.specials):
            return _le(self.whole.encode(text, add_special_tokens=False).ids)
        if not text or text[0] == " " or text[-1] == " " or UNEVEN(text):
            return self._cut_slowly(text)
        # a lone blank between two words always begins a piece
        first, *later = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, later))


class WordIds:
    """Little-endian uint32 ids of a text by a lower-casing BPE file with word ends, which drops white space."""

    def __init__(self, path: str):
        spec, alphabet = specification(path), byte_alphabet()
        self.whole = library(path)
        end = spec["model"]["end_of_word_suffix"]
        # byte 0xFF, which no UTF-8 text has, stands for the end of a word; a last letter takes it first
        ranks, last = {}, []
        for t, i in spec["model"]["vocab"].items():
            if t in {a["content"] for a in spec["added_tokens"]}:
                continue
            body = t.removesuffix(end) if t.endswith(end) and t != end else t
            ranks[bytes(map(alphabet.__getitem__, body)) + b"\xff" * (body != t)] = i
        lone, ends = {k: i for k, i in ranks.items() if len(k) == 1}, {k: i for k, i in ranks.items() if len(k) == 2 and k[1] == 255}
        order = [*sorted(lone, key=lone.get), *([b"\xff"] if b"\xff" not in lone else []), *sorted(ends, key=ends.get)]
        order += sorted(ranks.keys() - lone.keys() - ends.keys(), key=ranks.get)
        self.ids = [ranks.get(k, -1) for k in order]
        self.core = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks={k: i for i, k in enumerate(order)}, special_tokens={})._core_bpe
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.memo = Memo(self._word)

    def _word(self, word: str) -> bytes:
        low, merge, ids = word.lower(), self.core.encode_single_piece, self.ids
        body = low.rstrip(".,")
        cut = WORD_PIECES(low) if not body.isalpha() else [low] if len(body) == len(low) else [body, low[len(body) :]]
        return _le([ids[i] for p in cut for i in merge(p.encode() + b"\xff")])

    def __call__(self, text: str) -> bytes:
        if not PLAIN_TEXT(text) or any(s in text for s in self.specials):
            return _le(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.memo.__getitem__, text.split()))


@lru_cache(2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
