"""Toxicity by compression distance: each window of words is compressed with two zstandard dictionaries.

One dictionary is trained on ordinary labelled text, the other on what toxic labelled texts hold and
ordinary ones don't (the spans of their words that are far more frequent there). A window is compressed
with the content of the ordinary dictionary, and with that of the toxic one laid before it, so that what
both kinds of text share costs the same and the difference of the two lengths tells how much of the
window only toxic text explains. Windows are too short for a dictionary's entropy tables, which are left
out. The differences' mean, largest and shares above thresholds go through a calibration fitted on
labelled rows that trained neither dictionary.

Learning takes all labelled rows and whole texts: grams are counted by aggregation, pieces of text are dealt to
groups of PART_BYTES that train a larger dictionary each, of which dictionaries are trained again until one is left, and
the calibration's sums are added up over the rows. Dictionaries are some kB and go to each task with the function.

Results for unusual input: null and blank texts have no window and score as a text of no difference.
Without both labels among the rows to learn from, every text scores the share of toxic rows (0 if there
are no rows). Each row of docs is scored alone, so repeated rows agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import labelled, scratch, textops as t

#: Text that a dictionary is trained on at once, and how many times larger one is that others are trained on.
PART_BYTES, WIDER = 8 << 20, 4
#: Words of a piece of ordinary text, and bytes of one of a dictionary that others are trained on.
PIECE_WORDS, PIECE_BYTES = 40, 256
#: Grams and words that a task remembers.
MOST_KNOWN = 200_000
WINDOW, STEP = 10, 9
ORDINARY_BYTES, TOXIC_BYTES = 2048, 1024
#: Lengths of the grams by which toxic spans are told, and how frequent such grams are.
SIZES, SHARE, RATIO = (4, 5, 6, 8), 0.02, 12
THRESHOLD = 0.3


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lower-case windows of WINDOW words, STEP words apart, over each whole text, and each text's number of them."""
    low = t.lower(buf)
    starts, ends, bounds = t.word_bounds(low, offs)
    words = np.diff(bounds)
    count = np.where(words > 0, 1 + np.maximum(0, -((WINDOW - words) // STEP)), 0)
    row = np.repeat(np.arange(len(words)), count)
    first = bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    last = np.minimum(first + WINDOW, bounds[row + 1]) - 1
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], count


def _low(text: bytes) -> bytes:
    return t.lower(np.frombuffer(text, np.uint8)).tobytes()


def _grams(text: bytes) -> set[bytes]:
    out: set[bytes] = set()
    for word in set(text.split()):
        word = b" " + word
        for n in SIZES:
            out.update(word[i : i + n] for i in range(len(word) - n + 1))
    return out


def _counted(texts: DataFrame, of: Callable[[], Callable[[bytes], set[bytes]]]) -> DataFrame:
    """gram, n: in how many texts it stands, by what `of` makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, have = of(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], names=["gram", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                have.update(grams(_low(text)))
                if len(have) > MOST_KNOWN:
                    yield out()
                    have.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def telling(rows: DataFrame, toxic: int, ordinary: int) -> set[bytes]:
    """Grams in at least SHARE of the toxic texts, RATIO times as often as in ordinary ones."""
    often = {bytes(r.gram): r.n for r in _counted(rows.where("y = 1"), lambda: _grams).where(F.col("n") >= max(4, toxic * SHARE)).collect()}  # 1 / SHARE times a text's grams
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(often))

    def of() -> Callable[[bytes], set[bytes]]:
        known: dict[bytes, tuple[bytes, ...]] = {}

        def grams(text: bytes) -> set[bytes]:
            if len(known) > MOST_KNOWN:
                known.clear()
            found: set[bytes] = set()
            for word in set(text.split()):
                if word not in known:
                    known[word] = tuple(_grams(word) & shared.value)
                found.update(known[word])
            return found

        return grams

    have = {bytes(r.gram): r.n for r in _counted(rows.where("y = 0"), of).collect()}  # some of these
    return {g for g, k in often.items() if k / toxic > RATIO * (have.get(g, 0) + 0.5) / ordinary}


def excerpts(texts: list[bytes], grams: set[bytes]) -> list[bytes]:
    """The spans of each text's words that these grams cover, one to a line; texts without any are left out."""
    known: dict[bytes, list[bytes]] = {}

    def spans(word: bytes) -> list[bytes]:
        word = b" " + word
        covered = bytearray(len(word) + 1)
        for n in SIZES:
            for i in range(len(word) - n + 1):
                if word[i : i + n] in grams:
                    covered[i : i + n] = b"\1" * n
        edges = [i for i in range(len(word) + 1) if covered[i] != (covered[i - 1] if i else 0)]
        return [word[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]

    out = []
    for x in texts:
        found = []
        for word in x.split():
            if word not in known:
                known[word] = spans(word)
            found += known[word]
        if found:
            out.append(b"\n".join(found))
    return out


def content(texts: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the texts: its last `size` bytes, the most useful ones, after its tables."""
    try:
        return zstandard.train_dictionary(2 * size, texts).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on
        return b"\n".join(texts)[-size:]


def _pieces(rows: DataFrame, cut: Callable[[list[bytes]], list[list[bytes]]]) -> DataFrame:
    """h (a hash of the row), k, text: what `cut` makes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = cut([_low(x) for x in part.column("text").to_pylist()])
                ids = np.repeat(part.column("h").to_numpy(), [len(x) for x in found])
                places = [k for x in found for k in range(len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array([p for x in found for p in x], pa.binary())], names=["h", "k", "text"])

    return rows.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "h long, k int, text binary")


def _by_words(texts: list[bytes]) -> list[list[bytes]]:
    every = [x.split() for x in texts]
    return [[b" ".join(words[i : i + PIECE_WORDS]) for i in range(0, len(words), PIECE_WORDS)] for words in every]


def _level(pieces: DataFrame, groups: int, size: int, piece: int) -> DataFrame:
    """h (group), k, text: the content of a dictionary for each group of pieces, in pieces."""

    def train(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("k", "ascending"), ("text", "ascending")])
        found = content(table.column("text").to_pylist(), size)
        parts = [found[i : i + piece] for i in range(0, len(found), piece)]
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["h", "k", "text"])

    part = F.pmod(F.xxhash64("h", "k"), F.lit(groups)).alias("part")
    return pieces.groupBy(part).applyInArrow(train, "h long, k int, text binary")


def trained(pieces: DataFrame, total: int, size: int) -> bytes:
    """The content of a dictionary trained on all pieces (h, k, text; total bytes or fewer), PART_BYTES at a time."""
    while (groups := -(-total // PART_BYTES)) > 1:
        pieces = scratch.written(_level(pieces, groups, WIDER * size, PIECE_BYTES))
        total = groups * WIDER * size
    found = _level(pieces, 1, size, size).first()
    return bytes(found.text) if found else b""


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    rate: float

    def features(self, column: pa.Array) -> np.ndarray:
        """One row for each text: mean, largest and mean of the three largest differences, and shares of large ones."""
        compressors = [_compressor(d) for d in (self.ordinary, self.toxic)]
        parts = []
        for first, last, buf, offs in t.slices(column):
            texts, count = windows(buf, offs)
            a, b = (np.fromiter((len(c.compress(x)) for x in texts), np.int64, len(texts)) for c in compressors)
            d = (a - b).astype(np.float64)
            out = np.zeros((last - first, 5))
            full = np.flatnonzero(count)
            if len(full):
                heads = (np.cumsum(count) - count)[full]
                n = count[full]
                out[full, 0] = np.add.reduceat(d, heads) / n
                out[full, 1] = np.minimum(np.maximum.reduceat(d, heads), 12)
                for k, least in ((2, 2), (3, 3), (4, 5)):
                    out[full, k] = np.add.reduceat((d >= least).astype(np.float64), heads) / n
            parts.append(out)
        return np.concatenate(parts) if parts else np.zeros((0, 5))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(_expanded(x) @ np.array(self.weights), -30, 30)))


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip(x[:, 0], -1, 4), x[:, 1] / 4, np.sqrt(x[:, 2:]), (x[:, 1] >= 2), (x[:, 1] >= 3), (x[:, 1] >= 4)])


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(6, source_size=64, dict_size=4096, min_match=4, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def fit_logistic(measured: DataFrame, weight: dict[int, float], ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression of y on x (Model.features), by Newton steps whose sums are added up over all rows."""
    n = _expanded(np.zeros((1, 5))).shape[1]
    w = np.zeros(n)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n * n + n)
            for batch in batches:
                x = _expanded(batch.column("x").flatten().to_numpy().reshape(-1, 5))
                y = batch.column("y").to_numpy().astype(np.float64)
                each = np.where(y == 1, weight[1], weight[0])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total += np.append(((x * (each * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (each * (y - p)))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["total"])

        parts = [r.total for r in measured.select("x", "y").mapInArrow(run, "total array<double>").collect()]  # one for each task
        return np.array([fsum(x) for x in zip(*parts, strict=True)])

    for _ in range(steps):
        total = sums(w)
        step = np.linalg.solve(total[: n * n].reshape(n, n) + ridge * np.eye(n), total[n * n :] - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """x (Model.features), y of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    return rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "x array<double>, y int")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows, known = labelled.every(docs, labels, "toxic", 4, 2)
    rate = known.get(1, 0) / max(1, sum(known.values()))
    # two of three rows train the dictionaries, the others calibrate
    trains = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) < 2
    rows = scratch.written(rows.select("doc_id", F.encode("text", "UTF-8").alias("text"), "y", trains.alias("trains")))
    counts = {(r.y, r.trains): (r.n, r.size) for r in rows.groupBy("y", "trains").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    n = {(y, part): counts.get((y, part), (0, 0))[0] for y in (0, 1) for part in (True, False)}
    if min(n[y, True] + n[y, False] for y in (0, 1)) < 4:
        return Model(b"", b"", [], rate)
    train, rest = rows.where("trains"), rows.where("not trains")
    if min(n[y, True] for y in (0, 1)) < 2 or min(n[y, False] for y in (0, 1)) < 1:  # too few rows to part
        train = rest = rows
        n = {(y, part): n[y, True] + n[y, False] for y in (0, 1) for part in (True, False)}
    size = sum(counts.get((0, part), (0, 0))[1] for part in ((True,) if train is not rows else (True, False)))
    grams = telling(train, n[1, True], n[0, True])
    shared = docs.sparkSession.sparkContext.broadcast(grams)
    spans = scratch.written(_pieces(train.where("y = 1"), lambda texts: [excerpts([x], shared.value) for x in texts]))
    base = trained(_pieces(train.where("y = 0"), _by_words), size, ORDINARY_BYTES)
    model = Model(base, trained(spans, spans.agg(F.sum(F.octet_length("text"))).first()[0] or 0, TOXIC_BYTES) + base, [], rate)
    share = n[1, False] / (n[0, False] + n[1, False])
    model.weights = fit_logistic(scratch.written(_measured(rest, model)), {1: rate / share, 0: (1 - rate) / (1 - share)}).tolist()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(model.features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["row", "score"])

    texts = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text"))
    schema = docs.sparkSession.createDataFrame([], texts.select("row").schema).schema.add("score", "double")
    return texts.mapInArrow(run, schema).select("row.*", "score")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of docs, without those predicted toxic."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"), "doc_id", "text")
    return scored(rows, learn(docs, labels)).where(F.col("score") < THRESHOLD).select("_row.*")
