"""Scores on held-out rows by measures that no constant reaches, and against slow versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tradelake.llm import quality, textops as t, toxicity


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    for value in np.unique(score):  # equal scores share their mean rank
        same = np.flatnonzero(score == value)
        rank[same] = np.searchsorted(score[order], value) + (len(same) + 1) / 2
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / max(1, (y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.8), (quality, "quality", 0.85)])
def test_held_out_rows(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    found = operator.digest(docs, labels).where("held_out").join(labels, "doc_id").select(label, "score", "predicted").toPandas()
    y, score, said = found[label].to_numpy(), found["score"].to_numpy(), found["predicted"].to_numpy()
    assert auc(y, score) > least
    assert auc(y, np.full(len(y), 0.3)) == 0.5
    # of each class more than a constant answer could give both
    assert (said[y == 1] == 1).mean() > 0.5 and (said[y == 0] == 0).mean() > 0.5


def model_of(words):
    weights = np.random.default_rng(1).normal(size=quality.SIZE)
    return quality.Model(weights, 0.1, 0.5), pa.array(words, pa.binary())


def test_quality_is_a_sparse_dot_product():
    texts = [b"one two three", b"", b"one  one!", "été 12 — x".encode(), b"a " * 400]
    model, column = model_of(texts)
    for text, score in zip(texts, model.score(column), strict=True):
        at, _ = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        total = sum(float(model.weights[i]) for i in at.tolist())
        want = 1 / (1 + np.exp(-(total / max(1, len(at)) * 16 + 0.1)))
        assert abs(score - want) < 1e-6


def test_toxicity_measures_each_window_alone():
    model = toxicity.Model(b"calm words of plain talk", b"vile foul words", [0.1] * 9, 0.2)
    texts = [b"vile foul words and more vile words of all kinds here", b"", b"calm words " * 60, b"x"]
    every = model.features(pa.array(texts, pa.binary()))
    for text, row in zip(texts, every, strict=True):
        assert np.allclose(row, model.features(pa.array([text], pa.binary()))[0])
        pieces, _ = toxicity.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        sizes = [len(toxicity._compressor(model.ordinary).compress(x)) - len(toxicity._compressor(model.toxic).compress(x)) for x in pieces]
        if sizes:
            assert np.isclose(row[0], np.mean(sizes)) and row[1] == min(max(sizes), 12)
            assert np.allclose(row[2:], [np.mean(np.array(sizes) >= k) for k in (2, 3, 5)])
