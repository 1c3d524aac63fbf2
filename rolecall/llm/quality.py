"""Quality by attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.labelled import HELD_OUT, training_rows
from rolecall.llm.words import chunks, utf8
from rolecall.staging import stage_table

#: Labelled documents of each class that the model is trained on, at most.
SAMPLE = 2000
PASSAGE = 1024  # bytes
#: Score from which a document is kept.
THRESHOLD = 0.3

_KINDS = 16
_WORDS = 12
N_FEATURES = _KINDS * _KINDS + _WORDS + 1
_KIND = np.full(256, 15, dtype=np.uint8)  # bytes of characters outside ASCII
_KIND[:128] = 14
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
for _k, _signs in enumerate((" ", "\n\r", ".", ",;:", "!?", "|\t", "%", "#", "$", "&*", "'\"-"), start=3):
    _KIND[[ord(c) for c in _signs]] = _k


class Model(NamedTuple):
    """Passage encoder, gated attention and the document's classifier."""

    mean: np.ndarray
    spread: np.ndarray
    encode: np.ndarray  # features and 1 to hidden
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    out: np.ndarray  # hidden and 1


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of each text's first passage (and the end).

    A text is cut every ``PASSAGE`` bytes; an empty text is one empty passage. Features:
    square roots of the shares of pairs of neighbouring kinds of characters and of
    word lengths, and the passage's size.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    kinds = _KIND[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    offset = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offset[1:])
    doc = np.repeat(np.arange(len(texts)), sizes)
    where = first[doc] + (np.arange(len(kinds)) - offset[doc]) // PASSAGE
    n = int(first[-1])
    pairs = np.zeros((n, _KINDS * _KINDS))
    words = np.zeros((n, _WORDS))
    if len(kinds) > 1:
        inner = where[1:] == where[:-1]
        code = kinds[:-1].astype(np.int64) * _KINDS + kinds[1:]
        pairs = np.bincount((where[1:] * _KINDS * _KINDS + code)[inner], minlength=n * _KINDS * _KINDS).reshape(n, -1).astype(float)
        letter = (kinds <= 2) | (kinds == 15)
        edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
        start, length = edge[0::2], edge[1::2] - edge[0::2]
        words = np.bincount(where[start] * _WORDS + np.minimum(length, _WORDS) - 1, minlength=n * _WORDS).reshape(n, -1).astype(float)
    size = np.bincount(where, minlength=n)[:, None]
    share = np.sqrt(np.concatenate([pairs / np.maximum(1, size), words / np.maximum(1, words.sum(1, keepdims=True))], axis=1))
    return np.concatenate([share, np.log1p(size) / 7], axis=1), first


def _forward(m: Model, x: np.ndarray, first: np.ndarray) -> tuple:
    """Document scores and what training needs of the way there."""
    x = np.concatenate([(x - m.mean) / m.spread, np.ones((len(x), 1))], axis=1)
    h = np.tanh(x @ m.encode)
    v, u = np.tanh(h @ m.gate_v), 1 / (1 + np.exp(-np.clip(h @ m.gate_u, -30, 30)))
    e = (v * u) @ m.gate_w
    counts = np.diff(first)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), counts))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), counts)
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    p = 1 / (1 + np.exp(-np.clip(z @ m.out[:-1] + m.out[-1], -30, 30)))
    return p, x, h, v, u, a, z


def predict(m: Model, texts: list[bytes]) -> np.ndarray:
    scores = [_forward(m, *passages(texts[a:b]))[0] for a, b in chunks(texts)]
    return np.concatenate(scores) if scores else np.zeros(0)


def _gradient(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    p, x, h, v, u, a, z = _forward(m, x, first)
    counts = np.diff(first)
    d = weight * (p - y) / len(y)
    g_out = np.append(z.T @ d, d.sum())
    dz = np.repeat(d[:, None] * m.out[:-1], counts, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), counts))
    dv, du = de[:, None] * m.gate_w * u * (1 - v * v), de[:, None] * m.gate_w * v * u * (1 - u)
    dh = (a[:, None] * dz + dv @ m.gate_v.T + du @ m.gate_u.T) * (1 - h * h)
    return x.T @ dh, h.T @ dv, h.T @ du, (v * u).T @ de, g_out


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits encoder, attention and classifier together to the documents' labels, by Adam. Both classes weigh the same."""
    rng = np.random.default_rng(seed)
    spread = np.maximum(x.std(0), 0.02)
    made = [rng.normal(0, s, size) for s, size in ((0.05, (x.shape[1] + 1, hidden)), (0.2, (hidden, gate)), (0.2, (hidden, gate)), (0.2, gate), (0.2, hidden + 1))]
    model = Model(x.mean(0), spread, *made)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    steps = [(np.zeros_like(w), np.zeros_like(w)) for w in made]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // batch)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            own = np.concatenate([[0], np.cumsum(first[part + 1] - first[part])])
            t += 1
            for w, g, (m1, m2) in zip(made, _gradient(model, x[rows], own, y[part], weight[part]), steps, strict=True):
                g = g + decay * w
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = utf8(batch.column(0)), batch.column(1)
        for a, b in chunks(texts):
            x, first = passages(texts[a:b])
            blobs = [x[first[i] : first[i + 1]].astype("<f4").tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([labels.slice(a, b - a), pa.array(blobs, pa.binary())], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Trains on ``sample`` documents of each class at most, outside the held-out fifth; whole texts.

    Without labels of both classes there is no model.
    """
    rows = stage_table(training_rows(docs, labels, "quality", sample)).repartition(16).mapInArrow(_features, "label int, x binary").collect()
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    order = sorted(range(len(rows)), key=lambda i: (y[i], bytes(rows[i]["x"])))  # whatever order they came in
    bags = [np.frombuffer(rows[i]["x"], "<f4").reshape(-1, N_FEATURES) for i in order]
    return train(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y[order])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every whole text.

    Without a model every score is 0.5. Null and empty texts are one empty passage.
    Repeated rows are scored each; an empty table gives no rows; other columns are not read.
    A text takes about 40 bytes a byte while it is scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else predict(model, utf8(texts))


def kept(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted"))
