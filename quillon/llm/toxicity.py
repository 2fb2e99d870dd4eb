"""Toxicity of whole documents: a subsequence string kernel, Nyström landmarks and a support vector machine.

Kernel: the features of a piece of a sentence are its subsequences of four characters within `SPAN` places, each occurrence
weighted by DECAY ** (places spanned), and divided by the norm that a piece of this length has if no
subsequence comes twice, or, beyond `LONG` characters, by its own norm. A gap or an inserted character thus only dampens a match. Letters are lower-cased,
letters outside a-z share a few codes, the blanks around a piece are its first and last character, digits and "@" stand for the letters they imitate, and other marks
inside a word ("i.d-i*o.t") are left out.

Pieces of a sentence are its words, and what neighbouring words give if the blanks between them are taken for gaps too:
runs of words of one letter ("i d i o t") or of one or two ("i di ot"), and two neighbours of which one has at most `SHORT` letters ("id iot").

Landmarks: words of a bounded sample of labelled training documents, the more telling first, and others
as background. The kernel of words with the landmarks, whitened by the inverse root of the landmarks'
own kernel matrix, is the Nyström feature map; a linear machine (squared hinge loss, Newton steps) is
trained on it. Sentences carry their document's label, but only one of them needs to be toxic, so the witness of
a toxic document is its best word so far; the pieces of clean documents, the hardest added in each round, are the
other class.

Scoring: the machine is linear in the kernel, so landmarks, whitening and weights fold into one weight for each
subsequence. A sentence scores as its best piece and a document as its best sentence; a logistic fit on
the training documents makes that a probability. Every word of every text is scored, alone or as part of a piece. What no piece
shows is not seen: an insult of several words each of which is harmless. Letters of other scripts than Latin are too
few codes to tell words apart, so such texts score as "no evidence".

Defined results: null and empty texts, as texts without pieces of three letters, have the score of "no
evidence". With no labelled documents, or of one class only, that is 0 for all. Rows repeated, or without
doc_id, are scored each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import by_batch, fold
from quillon.llm.learning import labelled_sample

LENGTH, SPAN, DECAY = 4, 6, 0.6
CODES = 32
#: The white space before and after a word counts as its first and last character.
START = 31
#: Letters of a word that its neighbour is joined to, and of a piece so joined.
SHORT, JOINED = 4, 12
#: Characters of a piece beyond which its norm counts repeated subsequences.
LONG = 24
#: (offsets of the second to the fourth character, weight) of each way to choose them.
WAYS = [(c, DECAY ** (c[-1] + 1)) for c in combinations(range(1, SPAN), LENGTH - 1)]
#: Bytes of text scored at a time.
AT_ONCE = 1 << 18
#: Bytes of a part of a long text that the next part has again.
AGAIN = 256
NOTHING = -4.0
BLANK = re.compile(rb"[\t-\r ]").finditer


def _alphabet() -> np.ndarray:
    """The code of each byte: 31 white space, 255 left out, 1..26 letters, 27..30 parts of other letters."""
    code = np.full(256, 255, np.uint8)
    code[[9, 10, 11, 12, 13, 32]] = START
    for i in range(26):
        code[[97 + i, 65 + i]] = i + 1
    for digit, letter in zip(b"013457@", b"oieasta", strict=True):
        code[digit] = code[letter]
    for b in range(0x80, 0xC0):  # the second byte of a letter, regardless of case as UTF-8 has it in Latin-1
        code[b] = 27 + (b & 0x1F) % 4
    return code


ALPHABET = _alphabet()


class Words:
    """The characters of all words of a text and, with joined, of the pieces that neighbouring words make; and the subsequences that begin at each character.

    starts: the bytes at which documents begin, if the text is several; words of two are not joined.
    """

    def __init__(self, text: bytes, joined: bool = False, starts: np.ndarray | None = None):
        codes = ALPHABET[np.frombuffer(b" " + text, np.uint8)]
        solid = np.flatnonzero(codes < 255)
        blank = codes[solid] == START
        solid = solid[~(blank & np.concatenate([blank[1:], [True]]))]  # white space that no word follows
        self._hold(codes[solid].astype(np.int32), solid)
        if joined and len(self) > 1:
            parts = [(self.c, self.at), *(self._joined(w) for w in self._seams(starts))]
            at = np.concatenate([p[1] for p in parts])
            self._hold(np.concatenate([p[0] for p in parts]), None)
            self.at = at

    def _hold(self, c: np.ndarray, solid: np.ndarray | None) -> None:
        self.c = c
        self.first = np.flatnonzero(c == START)
        self.at = solid[self.first] if solid is not None else None  # the byte before the word
        self.size = np.diff(np.concatenate([self.first, [len(c)]]))
        self.left = np.repeat(self.first + self.size, self.size) - np.arange(len(c)) + 1  # characters from here to the word's end and the blank after it

    def _seams(self, starts: np.ndarray | None) -> list[np.ndarray]:
        """For each way of joining: is the blank before a word dropped? Runs of letters; runs of the shortest words; every second word with the one before; the others with the one before."""
        letters = self.size - 1
        doc = np.searchsorted(starts, self.at, "right") if starts is not None else np.zeros(len(self), np.int64)
        same = np.concatenate([[False], doc[1:] == doc[:-1]])
        before = np.concatenate([[0], letters[:-1]])
        runs = same & (letters <= 2) & (before <= 2)
        pairs = same & ~runs & (np.minimum(letters, before) <= SHORT) & (letters + before <= JOINED)
        odd = np.arange(len(self)) % 2 == 1
        return [runs & (letters == 1) & (before == 1), runs, pairs & odd, pairs & ~odd]

    def _joined(self, seam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and places of the pieces that a way of joining makes."""
        used = seam | np.concatenate([seam[1:], [False]])
        keep = np.repeat(used, self.size)
        keep[self.first[seam]] = False
        return self.c[keep], self.at[used & ~seam]

    def __len__(self) -> int:
        return len(self.first)

    def strings(self) -> list[str]:
        shown = "".join(chr(96 + x) for x in self.c.tolist())
        return [shown[a + 1 : a + n] for a, n in zip(self.first.tolist(), self.size.tolist(), strict=True)]

    def string(self, k: int) -> str:
        a = self.first[k]
        return "".join(chr(96 + x) for x in self.c[a + 1 : a + self.size[k]].tolist())

    def occurrences(self):
        """(places, features, weight) of each way."""
        c = np.concatenate([self.c, np.full(SPAN, START, np.int32)])
        n = len(self.c)
        for offsets, weight in WAYS:
            at = np.flatnonzero(self.left > offsets[-1])
            f = self.c[at]
            for o in offsets:
                f = f * CODES + c[o:][:n][at]
            yield at, f, weight

    def norms(self) -> np.ndarray:
        """The norm of a word of each length whose subsequences are all different."""
        square = np.zeros(len(self))
        for offsets, weight in WAYS:
            square += np.maximum(self.size + 1 - offsets[-1], 0) * weight**2
        return np.sqrt(np.maximum(square, 1e-12))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """The sum of each word's weighted features, normalised."""
        if not len(self):
            return np.zeros(0)
        total = np.zeros(len(self.c), np.float32)
        for at, f, weight in self.occurrences():
            total[at] += np.float32(weight) * table[f]
        raw, norms = np.add.reduceat(total, self.first), self.norms()
        for k in np.flatnonzero((self.size > LONG) & (raw > 0)):
            norms[k] = self._own_norm(k)
        return raw / norms

    def _own_norm(self, k: int) -> float:
        """The norm of one piece with its repeated subsequences: long ones may repeat a few for ever ("ar ar ar ...")."""
        c = np.append(self.c[self.first[k] : self.first[k] + self.size[k]].astype(np.int64), START)
        found, weights = [], []
        for offsets, weight in WAYS:
            n = max(0, len(c) - offsets[-1])
            f = c[:n]
            for o in offsets:
                f = f * CODES + c[o : o + n]
            found.append(f)
            weights.append(np.full(n, weight))
        _, which = np.unique(np.concatenate(found), return_inverse=True)
        return float(np.sqrt((np.bincount(which, np.concatenate(weights)) ** 2).sum()))


def features(words: list[str]) -> list[dict[int, float]]:
    """The normalised subsequence features of each word."""
    out = []
    for w in words:
        c = [START, *(ord(x) - 96 for x in w), START]
        got: dict[int, float] = {}
        square = 0.0
        for offsets, weight in WAYS:
            for i in range(len(c) - offsets[-1]):
                f = c[i]
                for o in offsets:
                    f = f * CODES + c[i + o]
                got[f] = got.get(f, 0.0) + weight
                square += weight**2
        norm = max(square, 1e-12) ** 0.5
        out.append({f: v / norm for f, v in got.items()})
    return out


def parts(text: bytes) -> Iterator[bytes]:
    """text in parts of at most AT_ONCE bytes, each of which begins with what the part before has last: AGAIN bytes or less.

    Parts begin and end at white space where their last AGAIN bytes have some; runs of more bytes without any are cut
    anywhere. Each part begins at least AT_ONCE - AGAIN bytes after the one before.
    """
    at = 0
    while len(text) - at > AT_ONCE:
        blanks = [m.start() for m in BLANK(text, at + AT_ONCE - AGAIN, at + AT_ONCE)]
        yield text[at : blanks[-1] if blanks else at + AT_ONCE]
        at = blanks[0] if blanks else at + AT_ONCE - AGAIN
    yield text[at:]


class Machine:
    """One weight for each subsequence (float32, 4 MB), the bias, and the logistic fit."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, level: float):
        self.table, self.bias, self.slope, self.level = table.astype(np.float32), bias, slope, level

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """The margin of the best piece of each text."""
        out = np.full(len(texts), NOTHING)
        for k, text in enumerate(texts):
            for part in parts(text):
                words = Words(part, joined=True)
                if (words.size >= LENGTH).any():
                    out[k] = max(out[k], float(words.scores(self.table)[words.size >= LENGTH].max()) + self.bias)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Many short texts are looked at together."""
        z = np.full(len(texts), NOTHING)
        short = [k for k, t in enumerate(texts) if len(t) <= AT_ONCE]
        batch: list[int] = []
        held = 0
        for k in [*short, None]:
            if k is None or held + len(texts[k]) > AT_ONCE:
                if batch:
                    z[batch] = self._together([texts[b] for b in batch])
                batch, held = [], 0
            if k is not None:
                batch.append(k)
                held += len(texts[k]) + 1
        for k in set(range(len(texts))) - set(short):
            z[k] = self.evidence([texts[k]])[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.level, -30, 30)))

    def _together(self, texts: list[bytes]) -> np.ndarray:
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        words = Words(b" ".join(texts), True, starts)
        s = np.where(words.size >= LENGTH, words.scores(self.table) + self.bias, NOTHING)
        out = np.full(len(texts), NOTHING)
        np.maximum.at(out, np.searchsorted(starts, words.at, "right") - 1, s)
        return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 15) -> np.ndarray:
    """A linear machine with squared hinge loss; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        on = (y * (x @ w) < 1) * weight
        w_new = np.linalg.solve(np.eye(len(w)) + c * (x * on[:, None]).T @ x, c * x.T @ (on * y))
        if np.allclose(w, w_new, atol=1e-6):
            break
        w = w_new
    return w


def train(texts: list[bytes], labels: list[int], landmarks: int = 240, rounds: int = 3, most_words: int = 6000) -> Machine | None:
    """A machine for P(label = 1), or None if a class is missing."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    one: dict[str, str] = {}  # one object for each word, however many documents have it
    bags = [sorted({one.setdefault(w, w) for w in Words(t).strings() if len(w) >= LENGTH - 1}) for t in texts]
    seen = [Counter(w for b, k in zip(bags, y, strict=True) if k == c for w in b) for c in (0, 1)]
    n = [int((y == 0).sum()), int((y == 1).sum())]
    telling = {w: np.log((k + 0.1) / n[1]) - np.log((seen[0][w] + 0.1) / n[0]) for w, k in seen[1].items()}
    ranked = sorted(telling, key=lambda w: (-telling[w] * np.log1p(seen[1][w]), w))
    background = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))]
    marks = ranked[: landmarks * 3 // 4] + background[:: max(1, len(background) // (landmarks // 4))][: landmarks // 4]
    marks = list(dict.fromkeys(marks))
    mark_features = features(marks)
    index: dict[int, list[tuple[int, float]]] = {}
    for j, g in enumerate(mark_features):
        for f, v in g.items():
            index.setdefault(f, []).append((j, v))

    def kernel(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(marks)))
        for i, g in enumerate(features(words)):
            for f, v in g.items():
                for j, u in index.get(f, ()):
                    out[i, j] += v * u
        return out

    values, vectors = np.linalg.eigh(kernel(marks))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    bad_words = set(ranked[: max(20, len(ranked) // 500)])
    witness = [next((w for w in sorted(b, key=lambda w: (-telling[w] * np.log1p(seen[1][w]), w))), None) if k else None for b, k in zip(bags, y, strict=True)]
    sure = Counter({w: min(k, 20) for w, k in seen[1].items() if k >= 3 and w not in seen[0] and telling[w] > 3})
    positive = Counter(w for w in witness if w and w in bad_words) | sure
    negative = Counter(dict.fromkeys(background[:: max(1, len(background) // most_words)], 1))
    table, bias = np.zeros(CODES**LENGTH), -1.0
    clean = [t for t, k in zip(texts, y, strict=True) if not k]
    for _ in range(rounds):
        for w in list(positive):
            for v in _disguises(w):
                positive.setdefault(v, max(1, positive[w] // 4))
        words = [*positive, *negative]
        x = np.hstack([kernel(words) @ whiten, np.ones((len(words), 1))])
        target = np.array([1] * len(positive) + [-1] * len(negative))
        weight = np.array([*positive.values(), *negative.values()], float)
        weight[: len(positive)] *= len(negative) / max(1, weight[: len(positive)].sum())
        w = _newton(x, target, weight / len(negative) * 100)
        alpha, bias = whiten @ w[:-1], float(w[-1])
        table = np.zeros(CODES**LENGTH)
        for a, g in zip(alpha, mark_features, strict=True):
            for f, v in g.items():
                table[f] += a * v
        # hard words of clean documents, and each toxic document's best word
        hard: Counter[str] = Counter()
        for t in clean:
            own = Words(t, joined=True)
            s = np.where(own.size >= LENGTH, own.scores(table) + bias, NOTHING)
            for k in np.argsort(-s)[:3]:
                hard[own.string(k)] = s[k]
        negative |= Counter(w for w, _ in hard.most_common(2000))
        positive = Counter(sure)
        for t, k in zip(texts, y, strict=True):
            if k and len(own := Words(t)):
                s = np.where(own.size >= LENGTH, own.scores(table) + bias, NOTHING)
                if s.max() > -0.5:
                    best = own.string(int(s.argmax()))
                    if best not in seen[0]:
                        positive[best] += 1
        if not positive:
            break
    machine = Machine(table, bias, 1.0, 0.0)
    machine.slope, machine.level = _logistic(machine.evidence(texts), y)
    return machine


def _disguises(word: str) -> list[str]:
    """The word with a letter put in at two places inside; which, follows from the word."""
    c = zlib.crc32(word.encode())
    return [word[:k] + chr(97 + (c >> 8 * i) % 26) + word[k:] for i, k in enumerate({2 + c % max(1, len(word) - 3), 2 + (c >> 16) % max(1, len(word) - 3)})]


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of P(y = 1), by Newton steps with a little damping."""
    x, w = np.stack([z, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (y - p) - 0.01 * w)
    return float(max(w[0], 1e-3)), float(w[1])


def trained(docs: DataFrame, labels: DataFrame, rows: int = 4000, folds: int = 5, held_out: int = 0) -> Machine | None:
    """A machine of at most `rows` labelled documents outside the held-out fold."""
    texts, known = labelled_sample(docs, labels, "toxic", folds, held_out, rows)
    return train([t.encode() for t in texts], known)


def score(docs: DataFrame, machine: Machine | None, threshold: float = 0.5, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def f(rows: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
        s = model.value.score(texts) if model.value else np.zeros(len(texts))
        return {"doc_id": rows.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(by_batch(f, schema), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
