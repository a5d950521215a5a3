"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tradelake.llm import anchors, decontamination, embedding_dedup, fm_dedup, license_scan, line_dedup, mixing, ngram_join, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, h long"
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def rows():
    random = np.random.default_rng(4)
    word = lambda: "".join(random.choice(list("abcdeé"), random.integers(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, long = text(300), text(45), text(3000)
    edited = base.split(" ")
    edited[40] = "changed"
    texts = [base, base, base.upper(), " ".join(edited), passage + " " + text(30), text(25) + "\n" + passage, None, "", " \n ", "one", "a b c", "a b c", long, long[: len(long) // 2] + " end", "x" * 900, "ab " * 400, text(80), text(80), "Released under the MIT License.\nTHE GNU General  Public-License cc BY mit license", passage]
    return [(i, t, "en", ["s1", "s2", None][i % 3], None, 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def covered(items, width, later):
    seen: Counter = Counter()
    for _, x in items:
        seen.update(tuple(x[i : i + width]) for i in range(len(x) - width + 1))
    before, out = set(), {}
    for key, x in items:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            w = tuple(x[i : i + width])
            if (w in before) if later else seen[w] > 1:
                gone[i : i + width] = True
            before.add(w)
        out[key] = gone
    return out


@pytest.mark.parametrize("most", [256, 2])
@pytest.mark.parametrize("width", [400, 40])
def test_suffix_dedup(docs, monkeypatch, most, width):
    monkeypatch.setattr(anchors, "MOST_SEGMENTS", most)
    items = sorted((r[0], (r[1] or "").encode()) for r in rows())
    got = result(suffix_dedup.digest(docs, width))
    for key, gone in covered(items, width, False).items():
        text = np.frombuffer(dict(items)[key], np.uint8)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        assert got[key] == (len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest())


def test_suffix_intervals():
    assert {(1, 0, 3), (3, 0, 1), (4, 2, 3)} <= set(suffix_dedup.intervals(np.array([0, 3, 1, 4])))


@pytest.mark.parametrize("most", [256, 2])
def test_fm_dedup(docs, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST_SEGMENTS", most)
    items = sorted((r[0], SPLIT.findall((r[1] or "").encode())) for r in rows())
    got = result(fm_dedup.digest(docs))
    for key, gone in covered(items, 20, True).items():
        words = dict(items)[key]
        assert got[key] == (len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())


def test_wavelet_rank():
    values = np.random.default_rng(0).integers(0, 11, 200)
    index = fm_dedup.FMIndex(values + 1, np.array([120, 80]), np.array([0, 1]))
    lo, hi = index.extend(np.array([3]), np.array([0]), np.array([index.size]))
    assert hi[0] - lo[0] == (values == 2).sum()
    matrix = fm_dedup.WaveletMatrix(values, 4)
    lo = np.arange(0, 150)
    assert (matrix.least(lo, lo + 1 + lo % 40) == [values[a : a + 1 + a % 40].min() for a in lo]).all()


def _sets():
    out = {}
    for key, text, *_ in rows():
        words = SPLIT.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        out[key] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
    return out


@pytest.mark.parametrize("most", [128, 2])
def test_ngram_join(docs, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST_SETS", most)
    sets = _sets()
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert result(ngram_join.digest(docs)) == {k: (len(s), label[k]) for k, s in sets.items()}
    assert {r.doc_id for r in ngram_join.kept(docs).collect()} == {k for k in sets if label[k] == k}


def test_beginning_of_another_set():
    random = np.random.default_rng(5)
    for _ in range(200):
        whole = [np.unique(random.integers(1, 1 << 62, n).astype(np.uint64)) for n in (2, 9, 130)]
        sets = [w[:k] for w in whole for k in sorted({1, len(w) // 2, len(w) - 1, len(w)})]
        tree = ngram_join.PrefixTree(sets)
        for q in sets:
            want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))}
            assert set(tree.alike(q, 85, np.zeros(len(sets), bool)).tolist()) == want


def test_beginning_of_another_text(spark):
    random = np.random.default_rng(6)
    texts = [[f"w{x}" for x in random.integers(0, 1 << 40, 5)] for _ in range(40)]
    docs = [(2 * i + k, " ".join(t[: 4 + k])) for i, t in enumerate(texts) for k in (0, 1)]
    assert {r.doc_id: r.component_id for r in ngram_join.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {i: i for i, _ in docs}


def test_least_shared_is_safe():
    n = np.arange(0, 3000)
    spare, least = ngram_join.spare(n, 85), ngram_join.least_shared(n, 85)
    assert all(least[k] <= max(1, spare[(85 * k + 99) // 100 : 100 * k // 85 + 1].min()) for k in range(1, 2500))


@pytest.mark.parametrize("module", [license_scan, line_dedup])
def test_sql(docs, monkeypatch, module):
    frame = docs.toPandas()
    if module is line_dedup:
        frame["source"] = [f"s{i % 12}" for i in range(len(frame))]
        frame.loc[frame.text.notna(), "text"] = frame.text + "\nsame line"
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r[1:] for r in con.sql(module.ORACLE_SQL).fetchall()}
    got = result(module.digest(docs.sparkSession.createDataFrame(frame.astype(object).where(frame.notna(), None), SCHEMA)))
    assert got == want


def test_mixing(docs):
    got = result(mixing.digest(docs))
    again = result(mixing.digest(docs.repartition(5)))
    assert got == again
    for key, text, *_ in rows():
        assert got[key][0] == len(SPLIT.findall((text or "").encode())) and got[key][3] <= 3 * got[key][0]
    total = sum(x[0] for x in got.values())
    targets = {(x[1], x[2]) for x in got.values()}
    assert abs(sum(t for _, t in targets) - total) < 1e-6
    sized = mixing.sized(docs)
    plan = mixing.targets(sized.groupBy("src").agg({"size": "sum"}).toDF("src", "source_size"))
    shards = [r["count"] for r in mixing.mixed(sized, plan, 4).groupBy("shard").count().collect()]
    assert max(shards) - min(shards) <= 2


def test_embeddings(spark):
    random = np.random.default_rng(2)
    base = random.standard_normal((60, 16))
    near = base[:20] + random.standard_normal((20, 16)) * 0.03
    data = [(i, x.tolist(), i % 3) for i, x in enumerate(base)] + [(100 + i, x.tolist(), i % 3) for i, x in enumerate(near)]
    data += [(200, base[0].tolist(), 0), (201, base[0].tolist(), None), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [None] * 16, 1), (206, base[1].tolist()[:8], 1), (207, [], 1)]
    got = result(embedding_dedup.digest(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))
    fine = [(i, np.array(x), y) for i, x, y in data if y is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    found = want = 0
    for i, x, y in fine:
        n = sum(j != i and z == y and len(x) == len(v) and x @ v / np.linalg.norm(x) / np.linalg.norm(v) >= 0.98 for j, v, z in fine)
        assert got[i][0] <= n
        found, want = found + got[i][0], want + n
    assert found >= 0.9 * want
    assert got[200][1] == 0 and not got[200][2] and got[201] == (0, 201, True) == got[201]
    assert all(got[k] == (0, k, True) for k in range(201, 208))


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    good = [(known[k].quality, p) for k, (held, _, p) in result(quality.digest(docs, labels)).items() if held and k in known]
    assert np.mean([y == p for y, p in good]) > 0.85
    toxic = [(known[k].toxic, p) for k, (held, _, p) in result(toxicity.digest(docs, labels)).items() if held and k in known]
    assert np.mean([y == p for y, p in toxic]) > 0.75


def test_decontamination(spark):
    random = np.random.default_rng(7)
    word = lambda: "".join(random.choice(list("abcdefghij"), 5))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    noise = lambda n: " ".join(word() for _ in range(n))
    changed = items[1].split()
    changed[5] = changed[17] = "other"
    docs = [(0, noise(100) + " " + items[0] + " " + noise(50)), (1, noise(40) + " " + " ".join(changed)), (2, noise(300)), (3, None), (4, ""), (5, items[2].upper()), (None, items[3])]
    got = {r.doc_id: list(r["items"]) for r in decontamination.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (9, None), (10, "short")], "item_id long, text string")).collect()}
    assert got == {0: [0], 1: [1], 2: [], 3: [], 4: [], 5: [2], None: []}


def test_decontamination_at_all_lengths(spark):
    random = np.random.default_rng(8)
    word = lambda: "".join(random.choice(list("abcdefghij"), 5))
    sizes = [4, 7, 8, 15, 20, 28, 35, 60, 130, 300]
    items = [[word() for _ in range(n)] for n in sizes]
    docs, want = [], {}
    for i, w in enumerate(items):
        for at in (0, 3, 5, 7, 10, 13, 17, 20, 29):
            for changed in (0.0, 0.3 if len(w) >= 8 else 0.5):
                text = list(w)
                for k in random.permutation(len(w) * 2 // 3)[: int(changed * len(w))]:
                    text[k] = word()
                want[len(docs)] = [] if changed and len(w) < 8 else [i]
                docs.append((len(docs), " ".join([*(word() for _ in range(200 + at)), *text, *(word() for _ in range(150))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontamination.digest(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    assert {r.doc_id: list(r["items"]) for r in found.collect()} == want
    # brute force over all stretches says the same
    for key, text in docs:
        own = decontamination.plain_words(text.encode())
        for i, w in enumerate(items):
            item = [x.encode() for x in w]
            if len(w) < 8:
                hit = any(own[k : k + len(w)] == item for k in range(len(own)))
            else:
                size = len(w) + max(4, len(w) // 4)
                hit = len(set(own) & set(item)) >= 0.65 * len(w) and any(decontamination.common(item, own[k : k + size]) >= 0.65 * len(w) for k in range(max(1, len(own) - size + 1)))
            assert hit == (i in want[key])


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.digest(empty), fm_dedup.digest(empty), ngram_join.digest(empty), license_scan.digest(empty), line_dedup.digest(empty), mixing.digest(empty), toxicity.digest(empty, labels), quality.digest(empty, labels), decontamination.digest(empty, bench), embedding_dedup.digest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert df.collect() == []
