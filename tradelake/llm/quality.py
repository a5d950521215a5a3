"""Quality by logistic regression over hashed word n-grams, learned with follow-the-regularised-leader updates.

Features are words, pairs of neighbouring words, and single and paired word shapes (case, first and last
character, length), hashed to SIZE weights and counted, divided by the square root of their sum of
squares' bound. A bounded labelled sample (SAMPLE rows of each class, of texts up to 64 KB) is dealt to a few groups; each runs per-coordinate FTRL over
its rows and the groups' weights are averaged. A text's score is a sparse dot product over all its words.

Results for unusual input: null and blank texts have the bias alone. Without both labels to learn from,
every text scores the share of good rows (0 if there are none). Rows are scored each alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import labelled, textops as t

#: Most labelled rows of each class that are learned from, and the groups they are dealt to.
SAMPLE, GROUPS = 3000, 4
SIZE = 1 << 18
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 4
THRESHOLD = 0.3
U = np.uint64


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts of a slice, and the text each belongs to (4 for a word, 2 for its pair)."""
    starts, ends, bounds = t.word_bounds(buf, offs)
    words = t.word_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    if not len(words):
        return words.astype(np.int64), row
    kind = np.zeros(256, np.int64)
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 3
    last = buf[ends - 1].astype(np.int64)
    letter = kind[last] > 0
    length = np.minimum(ends - starts, 24) // 3
    shape = (((kind[buf[starts]] * 4 + kind[buf[np.minimum(starts + 1, ends - 1)]]) * 257 + np.where(letter, 256, last)) * 257 + np.where(letter, kind[last], buf[np.maximum(ends - 2, starts)])) * 9 + length
    shape = t.mix(shape.astype(U))
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = t.mix(words[pair] + words[pair + 1] * U(3))
    shapes = t.mix(shape[pair] * U(5) + shape[pair + 1] + U(11))
    hashes = np.concatenate([words, t.mix(shape + U(7)), two, shapes])
    return (hashes & U(SIZE - 1)).astype(np.int64), np.concatenate([row, row, row[pair], row[pair]])


def train(texts: list[bytes], y: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over the texts."""
    rows = []
    for x in texts:
        at, _ = features(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        index, count = np.unique(at, return_counts=True)
        rows.append((index, count / max(1, count.sum()) * 16))
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    bias = 0.0
    bias_n = 0.0
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, x = rows[i]
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            g = (p - y[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_n += (p - y[i]) ** 2
            bias -= 0.3 / (1 + np.sqrt(bias_n)) * (p - y[i])
    return _weights(z, n), bias


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float, rate: float):
        self.weights = None if weights is None else weights.astype(np.float32)
        self.bias, self.rate = bias, rate

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.rate)
        parts = [np.zeros(0)]
        for first, last, buf, offs in t.slices(column):
            at, row = features(buf, offs)
            total = np.bincount(row, self.weights[at], last - first)
            parts.append(total / np.maximum(1, np.bincount(row, minlength=last - first)) * 16)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts) + self.bias, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows, rates = labelled.sample(docs, labels, "quality", 5, 0, most)
    counts = {r.y: r.n for r in rates.collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    if min(counts.get(0, 0), counts.get(1, 0)) < 4:
        return Model(None, 0.0, rate)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        weights, bias = train([x.encode() for x in part["text"]], part["y"].tolist())
        at = np.flatnonzero(weights)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(weights[at], bias)})

    fitted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))).groupBy("part").applyInPandas(fit, "at long, w double")
    # at most SIZE + 1 rows whatever the corpus
    found = fitted.groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    found["w"] /= max(1, found.loc[found["at"] < 0, "n"].sum())  # groups with rows: each has a bias
    weights = np.zeros(SIZE)
    inside = found["at"].to_numpy() >= 0
    weights[found["at"].to_numpy()[inside]] = found["w"].to_numpy()[inside]
    taken = {y: min(counts[y], most) for y in (0, 1)}
    shift = np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0])
    return Model(weights, float(found["w"].to_numpy()[~inside].sum() + shift), rate)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats, 1 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text")).mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
