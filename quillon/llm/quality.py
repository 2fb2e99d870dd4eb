"""Quality of whole documents by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters over
`WIDTH` bytes (an embedding of bytes and a matrix; for scoring both are folded into one table of 256
rows for each place) slide over a chunk. A chunk is described by each filter's maximum, mean and
squared mean; the last tells a text that repeats itself from one that doesn't. A hidden layer sees these,
its units are pooled over the document's chunks by maximum and by mean, and a logistic unit combines
them. Training is backpropagation with Adam on a bounded sample of labelled documents.

The last place of a short text may reach into the padding of its chunk, so that no byte is left unread.

Defined results: null and empty texts are one chunk of padding and get a score as any other. With no
labelled documents every score is 1. Rows repeated, or without doc_id, are scored each for itself. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import by_batch, fold
from quillon.llm.learning import labelled_sample

CHUNK, OVERLAP, WIDTH, STRIDE = 192, 32, 6, 2
EMBEDDED, FILTERS, HIDDEN = 8, 16, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that are convolved at a time.
AT_ONCE = 160


def places(size: int) -> int:
    """Places of the filters that it takes to read the first `size` bytes of a chunk, the last byte included."""
    return max(1, -(-(size - WIDTH) // STRIDE) + 1)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each chunk, places of each chunk that lie in its text, document of each chunk)."""
    rows, valid, doc = [], [], []
    for i, t in enumerate(texts):
        last = max(0, len(t) - CHUNK)
        for at in [*range(0, last, CHUNK - OVERLAP), last]:
            piece = t[at : at + CHUNK]
            rows.append(piece.ljust(CHUNK, b"\0"))
            valid.append(places(len(piece)))
            doc.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, CHUNK), np.array(valid, np.int64), np.array(doc, np.int64)


def _taps(data: np.ndarray) -> list[np.ndarray]:
    return [data[:, k : k + STRIDE * (PLACES - 1) + 1 : STRIDE] for k in range(WIDTH)]


def _described(act: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum, mean and squared mean of each filter over a chunk's own places."""
    if (valid < PLACES).any():
        act *= (np.arange(PLACES) < valid[:, None])[:, :, None]
    mean = act.sum(1) / valid[:, None].astype(np.float32)
    return np.concatenate([act.max(1), mean, 4 * mean * mean], 1), mean


class Network:
    """Parameters by name, and scoring; plain arrays, so that it can be sent to the executors (about 100 KB)."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.tables = np.einsum("be,kef->kbf", p["embed"], p["filter"].reshape(WIDTH, EMBEDDED, FILTERS)).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of quality for each text."""
        if not texts:
            return np.zeros(0)
        data, valid, doc = chunks(texts)
        hidden = np.empty((len(data), HIDDEN), np.float32)
        for at in range(0, len(data), AT_ONCE):
            part = data[at : at + AT_ONCE]
            act = np.broadcast_to(self.p["filter_b"].astype(np.float32), (len(part), PLACES, FILTERS)).copy()
            for table, tap in zip(self.tables, _taps(part), strict=True):
                act += table[tap]
            np.maximum(act, 0, out=act)
            described, _ = _described(act, valid[at : at + AT_ONCE])
            hidden[at : at + AT_ONCE] = np.tanh(((described - self.p["mu"]) / self.p["sd"]) @ self.p["dense"] + self.p["dense_b"])
        first = np.searchsorted(doc, np.arange(len(texts)))
        n = np.diff(np.concatenate([first, [len(doc)]]))
        pooled = np.concatenate([np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / n[:, None]], 1)
        z = np.clip(pooled @ self.p["out"] + self.p["out_b"], -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def train(texts: list[bytes], labels: list[int], steps: int = 1100, most_chunks: int = 24, seed: int = 7) -> Network | None:
    """A network for P(label = 1); in `steps` steps of 16 documents; in each epoch a long text gives `most_chunks` of its chunks, drawn anew."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    weight = np.where(y > 0, 1.0, min(2.0, max(1.0, (y > 0).sum() / max(1, (y == 0).sum())))).astype(np.float32)
    f = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    p = {
        "embed": rng.normal(0, 1, (256, EMBEDDED)).astype(np.float32), "filter": f(WIDTH * EMBEDDED, FILTERS), "filter_b": np.zeros(FILTERS, np.float32),
        "dense": f(3 * FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32), "out": f(2 * HIDDEN), "out_b": np.zeros((), np.float32),
        "mu": np.zeros(3 * FILTERS, np.float32), "sd": np.ones(3 * FILTERS, np.float32),
    }
    learned = [k for k in p if k not in ("mu", "sd")]
    m, v, t = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}, 0
    data, valid, doc = chunks(texts)
    of_doc = np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1)
    epochs = -(-steps * 16 // len(texts))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 16):
            ids = order[at : at + 16]
            rows = [c if len(c) <= most_chunks else np.sort(rng.choice(c, most_chunks, False)) for c in (of_doc[i] for i in ids)]
            n = np.array([len(r) for r in rows])
            taken, whole = data[np.concatenate(rows)], valid[np.concatenate(rows)]
            short = np.flatnonzero((y[ids] > 0) & (rng.random(len(ids)) < 0.25))
            if len(short):  # some good documents as if they were short: else brevity looks like repetition
                taken, whole, n = _cropped(taken, whole, n, short, rng)
            g = _gradients(p, taken, whole, n, y[ids], weight[ids], epoch == 0)
            t += 1
            rate = 0.004 * (1 - epoch / epochs) + 0.0004
            for k in learned:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(p)


def _cropped(data: np.ndarray, valid: np.ndarray, n: np.ndarray, short: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch with each document of `short` reduced to 15 to 120 bytes of its first chunk here."""
    first = np.cumsum(n) - n
    keep = np.ones(len(data), bool)
    data, valid, n = data.copy(), valid.copy(), n.copy()
    for i in short:
        size = int(rng.integers(15, 121))
        at = int(rng.integers(0, CHUNK - size))
        row = np.zeros(CHUNK, np.uint8)
        row[:size] = data[first[i], at : at + size]
        if not row.any():
            continue
        data[first[i]], valid[first[i]] = row, places(int(np.flatnonzero(row)[-1]) + 1)
        keep[first[i] + 1 : first[i] + n[i]] = False
        n[i] = 1
    return data[keep], valid[keep], n


def _gradients(p: dict, data: np.ndarray, valid: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, adapt: bool) -> dict:
    c = len(data)
    taps = np.stack(_taps(data), 2)
    x = p["embed"][taps].reshape(c * PLACES, WIDTH * EMBEDDED)
    act = np.maximum(x @ p["filter"] + p["filter_b"], 0).reshape(c, PLACES, FILTERS)
    d, mean = _described(act, valid)
    if adapt:  # running scale of the description
        p["mu"] = (0.95 * p["mu"] + 0.05 * d.mean(0)).astype(np.float32)
        p["sd"] = (0.95 * p["sd"] + 0.05 * (d.std(0) + 0.05)).astype(np.float32)
    z = (d - p["mu"]) / p["sd"]
    h = np.tanh(z @ p["dense"] + p["dense_b"])
    first = np.cumsum(n) - n
    top = np.maximum.reduceat(h, first)
    pooled = np.concatenate([top, np.add.reduceat(h, first) / n[:, None]], 1)
    score = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["out_b"], -30, 30)))
    e = ((score - y) * weight / len(y)).astype(np.float32)
    dp = e[:, None] * p["out"]
    dh = np.repeat(dp[:, :HIDDEN], n, 0) * (h == np.repeat(top, n, 0)) + np.repeat(dp[:, HIDDEN:] / n[:, None], n, 0)
    dz = dh * (1 - h * h)
    dd = (dz @ p["dense"].T) / p["sd"]
    dmean = (dd[:, FILTERS : 2 * FILTERS] + 8 * mean * dd[:, 2 * FILTERS :]) / valid[:, None]
    da = np.broadcast_to(dmean[:, None, :], act.shape) * (act > 0)
    best = act.argmax(1)
    i, j = np.meshgrid(np.arange(c), np.arange(FILTERS), indexing="ij")
    da[i, best, j] += dd[:, :FILTERS] * (act[i, best, j] > 0)
    da = da.reshape(c * PLACES, FILTERS)
    dx = (da @ p["filter"].T).reshape(-1, EMBEDDED)
    flat = taps.reshape(-1)
    embed = np.stack([np.bincount(flat, dx[:, k], 256) for k in range(EMBEDDED)], 1)
    decay = {k: 1e-4 * p[k] for k in ("filter", "dense", "out")}
    return {
        "embed": embed.astype(np.float32), "filter": x.T @ da + decay["filter"], "filter_b": da.sum(0), "dense": z.T @ dz + decay["dense"],
        "dense_b": dz.sum(0), "out": pooled.T @ e + decay["out"], "out_b": e.sum(),
    }


def trained(docs: DataFrame, labels: DataFrame, rows: int = 3000, folds: int = 4, held_out: int = 2) -> Network | None:
    """A network of at most `rows` labelled documents outside the held-out fold."""
    texts, known = labelled_sample(docs, labels, "quality", folds, held_out, rows)
    return train([t.encode() for t in texts], known)


def scorer(net: Network | None) -> Callable[[pa.Array], np.ndarray]:
    def f(column: pa.Array) -> np.ndarray:
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        return net.score(texts) if net else np.ones(len(texts))

    return f


def score(docs: DataFrame, net: Network | None, threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    of = scorer(net)

    def f(rows: pa.RecordBatch) -> dict:
        s = of(rows.column("text"))
        return {"doc_id": rows.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(by_batch(f, schema, 64), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, net: Network | None, threshold: float = 0.7) -> DataFrame:
    """docs, all columns, of a score of at least threshold."""
    of = scorer(net)

    @F.pandas_udf("boolean")
    def good(texts):
        return pd.Series(np.concatenate([of(pa.array(texts[i : i + 256], pa.string())) >= threshold for i in range(0, len(texts), 256)]))

    return docs.where(good(F.col("text")))
