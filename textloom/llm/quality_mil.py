"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded by one layer over its byte and hashed
byte-pair frequencies and the variety of its four-byte strings; gated attention weights, learned from document labels alone, sum the passages to one vector,
which a logistic unit scores. Training runs on the driver over a bounded sample of labelled rows (`train_docs`, the
smallest by a hash of the id) and of their passages (`train_passages` of a document, evenly spread over its whole text):
at most train_docs * train_passages * FEATURES * 2 bytes, 0.5 GB with the parameters given here. Scoring is one pass over
the documents without a shuffle and reads all passages.

Cases: null and empty texts are one empty passage and are scored as such; long texts are scored whole, some passages
at a time; without usable labels the score is 0.5, and with labels of one class that class's share after smoothing;
several labels of one id count by their mean, null labels not at all; of several texts of one id that with the smallest
hash is learned from; repeated rows give repeated results; other columns are not read. A passage's bytes may cut a code point; features are counts of bytes and are not hurt by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 512
PAIRS = 256
VARIETY = 512
#: Byte and byte-pair frequencies, how many of VARIETY hashes of four bytes occur, and how far the passage is filled.
FEATURES = 256 + PAIRS + 2
#: A passage of so many bytes counts half: frequencies over few bytes say little.
HALF = 64
#: Passages whose features are held at a time.
BLOCK = 2048


def split_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, passage counts): each text padded to whole passages by nothing; counts are at least 1."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.maximum(1, -(-sizes // PASSAGE))


def passage_features(text: bytes | np.ndarray) -> np.ndarray:
    """Float32 matrix, a row per passage of this text: square roots of byte and byte-pair frequencies."""
    data = np.frombuffer(text, dtype=np.uint8) if isinstance(text, bytes) else text
    n = max(1, -(-len(data) // PASSAGE))
    return _features(data, np.arange(len(data)) // PASSAGE, n)


def spread_features(text: bytes, most: int) -> np.ndarray:
    """The features of at most `most` passages, evenly spread over the text from its first passage to its last."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    if n <= most:
        return passage_features(data)
    own = np.linspace(0, n - 1, most).astype(np.int64)
    return np.concatenate([passage_features(data[i * PASSAGE : (i + 1) * PASSAGE]) for i in own])


def _features(data: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    kinds = 256 + PAIRS
    base = passage.astype(np.int64) * kinds
    wide = data.astype(np.int64)
    counts = np.bincount(base + wide, minlength=n * kinds)
    if len(data) > 1:
        same = passage[1:] == passage[:-1]
        pair = ((wide[:-1] * 40503 + wide[1:] * 2654435761) >> 7) % PAIRS + 256
        counts += np.bincount((base[1:] + pair)[same], minlength=n * kinds)
    x = counts.reshape(n, kinds).astype(np.float32)
    sizes = x[:, :256].sum(axis=1)
    out = np.empty((n, FEATURES), dtype=np.float32)
    out[:, :kinds] = np.sqrt(x / np.maximum(1.0, sizes)[:, None])
    seen = np.zeros(n * VARIETY, dtype=bool)
    if len(data) > 3:
        same = passage[3:] == passage[:-3]
        four = ((wide[:-3] * 73856093 ^ wide[1:-2] * 19349663 ^ wide[2:-1] * 83492791 ^ wide[3:] * 2654435761) >> 5) % VARIETY
        seen[(passage[3:].astype(np.int64) * VARIETY + four)[same]] = True
    out[:, -2] = seen.reshape(n, VARIETY).sum(axis=1) / np.maximum(1.0, sizes - 3)
    out[:, -1] = sizes / (sizes + HALF)
    return out


@dataclass
class Attention:
    """mean, scale: of the features; w, b: the encoder; v, u, a: gated attention; c, c0: the logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(encodings, attention logits) of passages."""
        h = np.tanh(standard(x, self.mean, self.scale) @ self.w + self.b)
        gate = np.tanh(h @ self.v) * _sigmoid(h @ self.u)
        return h, gate @ self.a

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One score a text. Passages of many texts are encoded together, BLOCK at a time; per text only its running maximum, weight and weighted sum are kept."""
        data, counts = split_texts(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])  # of each text's passages
        starts = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = starts[owner] + (np.arange(len(owner)) - first[owner]) * PASSAGE
        end = np.minimum(begin + PASSAGE, starts[owner + 1])
        top = np.full(len(texts), -np.inf)
        weight = np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.c)))
        for at in range(0, len(owner), BLOCK):
            own, p, q = (z[at : at + BLOCK] for z in (owner, begin, end))
            part = data[p[0] : q[-1]]
            h, s = self.encode(_features(part, np.repeat(np.arange(len(own)), q - p), len(own)))
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            who = own[cut]
            new = np.maximum(top[who], np.maximum.reduceat(s, cut))
            e = np.exp(s - np.repeat(new, np.diff(np.append(cut, len(own)))))
            old = np.exp(top[who] - new)
            weight[who] = weight[who] * old + np.add.reduceat(e, cut)
            total[who] = total[who] * old[:, None] + np.add.reduceat(h * e[:, None], cut)
            top[who] = new
        return _sigmoid(total / weight[:, None] @ self.c + self.c0[0]) if len(texts) else np.zeros(0)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features with mean 0 and deviation 1, those of short passages nearer to 0."""
    return (x - mean) * scale * x[:, -1:]


@dataclass
class Constant:
    """What is known without labels of both classes."""

    score: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.score)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, *, hidden: int = 32, gates: int = 16, epochs: int = 20, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Attention | Constant:
    """Adam on the logistic loss of documents. bags: each document's passage features."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Constant(float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate([x.astype(np.float32) for x in bags])
    mean = every.mean(axis=0)
    scale = 1 / np.maximum(np.sqrt(np.maximum(np.einsum("ij,ij->j", every, every) / len(every) - mean * mean, 0)), 0.01)
    for i in range(0, len(every), BLOCK):  # in place: the sample is held once
        every[i : i + BLOCK] = standard(every[i : i + BLOCK], mean, scale)
    bags = np.split(every, np.cumsum([len(x) for x in bags])[:-1])
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"w": draw(every.shape[1], hidden), "b": np.zeros(hidden, np.float32), "v": draw(hidden, gates), "u": draw(hidden, gates), "a": draw(gates), "c": draw(hidden), "c0": np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)}
    m1, m2, step = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
    m1, m2 = m1
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            g = _gradient(p, [bags[i] for i in own], y[own])
            step += 1
            now = rate * (0.5 if epoch >= epochs // 2 else 1.0) * (0.3 if epoch >= epochs * 5 // 6 else 1.0)
            for k in p:
                d = g[k] + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = (p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Attention(mean, scale, **p)


def _gradient(p: dict[str, np.ndarray], bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    counts = np.array([len(x) for x in bags])
    cut = np.concatenate([[0], np.cumsum(counts)[:-1]])
    spread = lambda z: np.repeat(z, counts, axis=0)
    x = np.concatenate(bags)
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    logit = (t * s) @ p["a"]
    e = np.exp(logit - spread(np.maximum.reduceat(logit, cut)))
    alpha = e / spread(np.add.reduceat(e, cut))
    z = np.add.reduceat(h * alpha[:, None], cut)
    off = (_sigmoid(z @ p["c"] + p["c0"][0]) - y) / len(y)
    dz = spread(off[:, None] * p["c"])
    dalpha = (dz * h).sum(axis=1)
    dlogit = alpha * (dalpha - spread(np.add.reduceat(alpha * dalpha, cut)))
    dt = dlogit[:, None] * p["a"] * s * (1 - t * t)
    ds = dlogit[:, None] * p["a"] * t * s * (1 - s)
    dh = alpha[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T
    dx = dh * (1 - h * h)
    return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ dlogit, "c": z.T @ off, "c0": np.array([off.sum()])}


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 4000, train_passages: int = 128, seed: int = 7) -> Attention | Constant:
    """A model from the labelled rows of docs; at most train_docs of them, those with the smallest hash of the id, and at
    most train_passages of each, evenly spread."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    own = own.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(train_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                yield pd.DataFrame({"y": part["y"], "x": [spread_features(to_bytes(t), train_passages).astype(np.float16).tobytes() for t in part["text"]]})

    # train_docs bounds the broadcast side; a document that stands in several rows is taken once.
    known = rows.join(F.broadcast(own), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = known.mapInPandas(run, "y double, x binary").toPandas()
    got = got.sort_values(["y", "x"])  # whatever the order of rows
    bags, y = [np.frombuffer(x, dtype=np.float16).reshape(-1, FEATURES) for x in got["x"]], got["y"].to_numpy()
    del got
    return fit(bags, y, seed=seed)


def score(docs: DataFrame, model: Attention | Constant, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the model's score of each row's text."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = [model.scores([to_bytes(t) for t in b.iloc[i : i + 512]]) for i in range(0, len(b), 512)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(score_col, of(F.col(text_col)))


def held_out(doc_id) -> object:
    """Rows that no label is learned from: crc32 of the id as text has remainder 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def quality_report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    model = train(docs, labels.where(~held_out("doc_id")), **kw)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
