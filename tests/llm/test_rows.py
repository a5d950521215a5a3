"""Rows that share an id or have none, clashing columns, crafted words, splits of the forest, targets of the mix, and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tradelake.llm import decontamination, embedding_dedup, fm_dedup, line_dedup, mixing, ngram_join, suffix_dedup, textops as t, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _row long, sig long, nth long, score double, n_removed long, _dropped long, _leaked long, `b.c` long"


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_crafted_words_and_strings_differ(spark):
    one, two = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    buf = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    starts, ends, _ = t.word_bounds(buf, np.array([0, len(buf)]))
    assert len(set(t.word_hashes(buf, starts, ends).tolist())) == 2
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(0, f"{one} {tail}"), (1, f"{two} {tail}"), (2, f"{one} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in fm_dedup.digest(docs).collect()} == {0: 0, 1: 0, 2: 20}
    short = spark.createDataFrame([(0, f"{one} x y z"), (1, f"{two} x y z"), (2, f"{one} x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.digest(short).collect()} == {0: 0, 1: 1, 2: 0}


def test_rows_of_one_id(spark):
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1, passage, "en", "a", None), (1, "other words\nsecond", "en", "b", None), (1, passage + " tail", "en", "a", None), (2, passage, "en", "a", None), (None, passage, "en", "a", None), (3, None, "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digest(docs).collect())
    n = len(passage)
    assert got == Counter([(1, n, n), (1, 18, 0), (1, n + 5, n), (2, n, n), (None, n, n), (3, 0, 0)])  # every whole text, with an id or without
    got = sorted((r.n_words, r.n_removed) for r in fm_dedup.digest(docs).where("doc_id = 1").collect())
    assert got[0] == (3, 0) and sorted(x[1] for x in got[1:]) == [0, 120]  # one of the two keeps the passage
    many = [(i, "boiler\nown %d" % i, "en", f"s{i}", None) for i in range(10)] + [(0, "only mine\nsecond", "en", "s0", None)]
    kept = Counter(line_dedup.cut(spark.createDataFrame(many, SCHEMA)).select("doc_id", "text").collect())
    assert kept == Counter([(i, f"own {i}") for i in range(10)] + [(0, "only mine\nsecond")])


def test_clashing_columns_stay(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, x, "en", "s", None, 1, 2, 3, 0.5, 4, 5, 6, 7) for i, x in enumerate([item, "plain words here", "plain words here", None, ""])]
    docs = spark.createDataFrame(rows, CLASHING)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out, want in ((line_dedup.cut(docs), {0, 1, 2, 3, 4}), (ngram_join.kept(docs), {0, 1, 3, 4}), (decontamination.clean(docs, bench), {1, 2, 3, 4}), (toxicity.clean(docs, labels), {0, 1, 2, 3, 4})):
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} == want
    mixed = mixing.digest(docs).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == Counter([(0, 30), (1, 3), (2, 3), (3, 0), (4, 0)])


def targets(sizes):
    """Targets by rounds: sources over their cap are held at it and the rest is shared anew by weight."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in out]
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]] if w else []
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 3 * sizes[s] for s in over}


def test_mix_by_brute_force(spark):
    random = np.random.default_rng(3)
    rows = [(int(random.integers(0, 60)) or None, " ".join("w" for _ in range(int(random.integers(0, 700)))), "en", [None, "a", "b", "c", "d"][int(random.integers(0, 100)) % 7 % 5], None) for _ in range(160)]
    rows += [(None, "x " * 80, "en", "tiny", None)] * 3 + [(5, "same text", "en", "a", None)] * 4
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = targets(dict(sizes))
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.digest(docs.repartition(7)).collect()))
    drawn = Counter()
    for r in mixing.corpus(docs, 8).collect():
        drawn[r.source] += r.words
        assert len(r.text.split(" ")) == r.words and 0 <= r.shard < 8
    for source, target in want.items():
        assert abs(drawn[source] - target) <= 64
        assert any(abs(r.target - target) < 1e-6 and r.source_size == sizes[source] for r in got)
    assert sum(r.taken for r in got) == sum(drawn.values())


@pytest.mark.parametrize("leaf, deepest", [(64, 12), (64, 2)])
def test_forest_splits(spark, leaf, deepest):
    random = np.random.default_rng(3)
    base = random.standard_normal((2500, 16))
    x = np.concatenate([base, base[:800] + random.standard_normal((800, 16)) * 0.07, base[5] + random.standard_normal((200, 16)) * 0.02])
    u, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(len(x)) % 2
    close = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    want = close.sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), i % 2, "extra") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, n string")
    got = {r.vec_id: r.n_links for r in embedding_dedup.digest(df, leaf=leaf, deepest=deepest).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_pipeline(spark, tmp_path):
    random = np.random.default_rng(11)
    text = lambda n: " ".join("".join(random.choice(list("abcdefgh"), 5)) for _ in range(n))
    insult = ["vilezzz", "nastyqq", "brutexx"]
    item = text(30)
    rows, labels = [], []
    for i in range(160):
        words = text(80).split()
        if i % 4 == 0:
            for k in range(0, 80, 6):
                words[k] = insult[k % 3]
        rows.append((i, " ".join(words) + "\nshared footer line", "en", f"s{i % 13}", None))
        if i < 120:
            labels.append((i, 1, int(i % 4 == 0)))
    near = rows[161 - 60][1].split(" ")
    near[3] = "changed"
    rows += [(200, rows[101][1], "en", "s1", None), (201, " ".join(near), "en", "s2", None), (202, text(40) + " " + item, "en", "s3", None), (203, None, "en", None, None), (204, "", None, "s4", None)]
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.collect()}
    everything, toxic = {r[0] for r in rows}, {i for i in range(160) if i % 4 == 0}
    assert len(kept["toxicity"] & toxic) <= 4 and len(everything - toxic - kept["toxicity"]) <= 4
    assert kept["line_dedup"] == kept["toxicity"]
    assert kept["toxicity"] - kept["ngram_join"] == {200, 201} & kept["toxicity"]
    assert kept["ngram_join"] - kept["decontamination"] == {202}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= kept["decontamination"] and not any("shared footer" in r.text for r in mixed)
    assert sum(r.words for r in mixed) > 0 and all(len(r.text.split(" ")) == r.words for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "block", "copy", "shard").collect())) == sorted((r.doc_id, r.block, r.copy, r.shard) for r in mixed)


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
