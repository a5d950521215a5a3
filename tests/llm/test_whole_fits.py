"""What is fitted on a corpus is fitted on all of it, against slow versions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelake.llm import decontamination, labelled, toxicity


def test_basis_is_fitted_on_all_passages(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SAMPLE", 20, raising=False)  # a bound, if there were one
    random = np.random.default_rng(5)
    vocabulary = ["".join(random.choice(list("abcdefgh"), 4)) for _ in range(150)]
    texts = [" ".join(random.choice(vocabulary, n)) for n in random.integers(1, 130, 120)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None, "", " "])], "doc_id long, text string").repartition(3)
    found = decontamination.terms(docs)
    idf = decontamination.inverse_frequencies(found)
    got = decontamination.basis(found, idf)
    sketch = np.random.default_rng(3).standard_normal((decontamination.TERMS, decontamination.RANK)).astype(np.float32) * idf[:, None].astype(np.float32)
    product = np.zeros((decontamination.TERMS, decontamination.RANK))
    for x in texts:
        raw = x.encode()
        at, _ = decontamination._terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for k in range(0, len(at), decontamination.WINDOW):
            vector = sketch[at[k : k + decontamination.WINDOW]].sum(0)
            np.add.at(product, at[k : k + decontamination.WINDOW], vector / np.linalg.norm(vector))
    left, size, _ = np.linalg.svd(product * idf[:, None], full_matrices=False)
    want = left / np.sqrt(size) * idf[:, None]
    used = np.flatnonzero(product.any(1))
    assert len(used) > decontamination.RANK
    # signs of directions are open, products of terms are not
    had, should = (x[used] @ x[used].T for x in (got.astype(float), want))
    assert np.abs(had - should).max() < 1e-3 * np.abs(should).max()


def corpus(spark, n, words, insult):
    """n texts of so many words, of which each other one is toxic and holds insult(doc_id) several times."""
    random = np.random.default_rng(6)
    vocabulary = np.array(["".join(random.choice(list("abcdefgh"), 5)) for _ in range(400)], object)
    rows = []
    for i in range(n):
        text = random.choice(vocabulary, words)
        if i % 2:
            text[1::3] = insult(i)
        rows.append((i, " ".join(text), i % 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


@pytest.mark.parametrize("part", [None, 20_000])
def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch, part):
    if part:  # dictionaries of dictionaries
        monkeypatch.setattr(toxicity, "PART_BYTES", part)
    # an insult that only rows past the first 1500 toxic ones of one order hold
    ids = spark.range(6000).where(F.col("id") % 2 == 1).where(~labelled.held_out(F.col("id"), 4, 2)).orderBy(F.xxhash64("id", F.lit(7)), "id")
    late = {r.id for r in ids.collect()[1500:]}
    docs, labels = corpus(spark, 6000, 12, lambda i: "vilezzz" if i in late else "nastyqq")
    calm = docs.where("doc_id = 0").first().text
    probe = spark.createDataFrame([(0, "vilezzz " + calm), (1, "nastyqq " + calm), (2, calm)], "doc_id long, text string")
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.scored(probe, toxicity.learn(docs, labels)).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_toxicity_learns_from_long_texts(spark):
    docs, labels = corpus(spark, 60, 12_000, lambda i: "vilezzz")
    assert docs.agg(F.min(F.length("text"))).first()[0] > 65_536
    assert toxicity.learn(docs, labels).weights


def test_telling_grams_are_those_of_a_slow_count(spark):
    docs, labels = corpus(spark, 300, 12, lambda i: "vilezzz")
    rows = docs.join(labels.withColumnRenamed("toxic", "y"), "doc_id").withColumn("text", F.encode("text", "UTF-8"))
    have = {0: Counter(), 1: Counter()}
    for r in rows.collect():
        have[r.y].update({(b" " + w)[i : i + n] for w in bytes(r.text).split() for n in toxicity.SIZES for i in range(len(w) + 2 - n)})
    want = {g for g, k in have[1].items() if k >= 4 and k / 150 > toxicity.RATIO * (have[0][g] + 0.5) / 150}
    got = toxicity.telling(rows, 150, 150)
    assert sorted(got ^ want) == [] and b"vilezz" in want
