"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences.

Texts are cut in passages of WINDOW words. Words are hashed to TERMS columns; their counts over all
texts give inverse frequencies, and one pass gives A'(A R) for the weighted matrix A of all
passages and a fixed random R of RANK columns: a randomised singular value decomposition whose basis is
small whatever the corpus. Every passage is searched. Each passage (by running sums, half a passage apart) and each benchmark item is
a RANK vector; pairs of cosine COSINE or more are candidates. As no cosine is sure for every length and
alignment, stretches that hold as many of an item's rarest words as any leak must are candidates too
(a bound by count, which loses none). For these the words of stretches little
longer than the item are compared: they must hold WEIGHT_SHARE of the item's words by inverse
frequency, and the longest common subsequence must cover ITEM_SHARE of the item and ANSWER_SHARE of its
last third, in which the answer stands, so that paraphrases with words changed or put in are found and
texts on the same subject are not.

The benchmark is broadcast if it has MOST_ITEMS items or fewer; more are searched in turns of that
many. Results for unusual input: null and blank texts and items match nothing; items of fewer than
LEAST_WORDS words are found only whole, word after word. Equal items each count. Rows of one doc_id
are compared each by its own text. Rows with a null doc_id are kept and not compared. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors, scratch, textops as t

#: Words of a passage, and of one for items of fewer than SHORT_ITEM words; passages start half of that apart
#: and are made of runs of STEP words.
WINDOW, SHORT_WINDOW, SHORT_ITEM, STEP = 40, 20, 28, 10
TERMS, RANK = 1 << 14, 48
#: Words whose vectors are in memory at once, in a batch of texts.
BATCH = 20_000
COSINE = 0.58
ITEM_SHARE, ANSWER_SHARE, WEIGHT_SHARE = 0.65, 0.5, 0.6
LEAST_WORDS = 8
MOST_ITEMS = 4096
U = np.uint64
#: Words are compared without these characters at their ends.
_EDGE = b".,;:!?\"'()[]"


def terms(docs: DataFrame) -> DataFrame:
    """doc_id, sig, t (the words' terms, 16 bits each) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offs in t.slices(batch.column("text")):
                at, bounds = _terms(buf, offs)
                raw = at.astype(np.uint16).tobytes()
                rows = [raw[a * 2 : b * 2] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in anchors.ROW), pa.array(rows, pa.binary())], names=[*anchors.ROW, "t"])

    return anchors.texts(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, sig long, t binary")


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = t.lower(buf)
    starts, ends, bounds = t.word_bounds(low, offs)
    trim = np.isin(low[ends - 1], np.frombuffer(_EDGE, np.uint8)) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    return (t.word_hashes(low, starts, ends - trim) & U(TERMS - 1)).astype(np.int64), bounds


def _batches(column: pa.Array, words: int = 200_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of some words: first row, row after the last, terms, bounds."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    data = np.frombuffer(column.buffers()[2] or b"", np.uint16)
    first = 0
    while first < len(column):
        last = min(len(column), max(first + 1, int(np.searchsorted(offsets, offsets[first] + words, "right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _heads(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of `size` words that no two texts share, and how many each text has."""
    count = -(-np.diff(bounds) // size)
    row = np.repeat(np.arange(len(count)), count)
    return bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size, count


def inverse_frequencies(found: DataFrame) -> np.ndarray:
    """log of all words over each term's words (TERMS numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, _, at, _ in _batches(batch.column("t")):
                total += np.bincount(at, minlength=TERMS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS)), pa.array(total)], names=["term", "n"])

    counts = np.zeros(TERMS)
    for r in found.select("t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS rows
        counts[r.term] = r.n
    return np.log((counts.sum() + 1) / (counts + 1))


def basis(found: DataFrame, idf: np.ndarray, seed: int = 3) -> np.ndarray:
    """An orthonormal basis (TERMS x RANK) of the range of A'A R over all passages."""
    sketch = np.random.default_rng(seed).standard_normal((TERMS, RANK)).astype(np.float32) * idf[:, None].astype(np.float32)
    shared = found.sparkSession.sparkContext.broadcast(sketch)  # TERMS * RANK floats, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, RANK))
        for batch in batches:
            for _, _, at, bounds in _batches(batch.column("t"), BATCH):
                if not len(at):
                    continue
                heads, _ = _heads(bounds, WINDOW)
                sizes = np.diff(np.append(heads, len(at)))
                passages = np.add.reduceat(shared.value[at], heads, axis=0)
                passages /= np.linalg.norm(passages, axis=1, keepdims=True) + np.float32(1e-9)
                order = np.argsort(at, kind="stable")  # 16-bit terms: a radix sort
                ordered = at[order]
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                total[ordered[first]] += np.add.reduceat(passages[np.repeat(np.arange(len(heads)), sizes)[order]], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS)), pa.array(list(total), pa.list_(pa.float64()))], names=["term", "y"])

    sums = F.array(*(F.sum(F.element_at("y", i + 1)) for i in range(RANK)))
    product = np.zeros((TERMS, RANK))
    for r in found.select("t").mapInArrow(run, "term long, y array<double>").groupBy("term").agg(sums.alias("y")).collect():  # TERMS rows
        product[r.term] = r.y
    left, size, _ = np.linalg.svd(product * idf[:, None], full_matrices=False)
    # the first directions tell languages and common words; equal scales let the others speak
    scale = np.where(size > size.max(initial=0) * 1e-6, 1 / np.sqrt(np.maximum(size, 1e-30)), 0)  # none for directions that no text has
    return (left * scale * idf[:, None]).astype(np.float32)


def _weighty(at, before, heads, text_block, text_blocks, begin, end, around, where, item, weights, enough) -> np.ndarray:
    """Which candidates hold, with `around` blocks on either side, the weight of the item's terms that a leak must."""
    ends = np.append(heads[1:], len(at))
    low = heads[text_block[where] + np.maximum(0, begin[where] - around)]
    high = ends[text_block[where] + np.minimum(text_blocks[where], end[where] + around) - 1]
    keep = np.zeros(len(where), bool)
    for i in range(0, len(where), 5000):
        size = high[i : i + 5000] - low[i : i + 5000]
        start = np.cumsum(size) - size
        spot = np.repeat(low[i : i + 5000] - start, size) + np.arange(int(size.sum()))
        fresh = before[spot] < np.repeat(low[i : i + 5000], size)
        held = np.add.reduceat(weights[np.repeat(item[i : i + 5000], size), at[spot]] * fresh, start)
        keep[i : i + 5000] = held >= enough[item[i : i + 5000]]
    return keep


def candidates(found: DataFrame, items: list[np.ndarray], loading: np.ndarray, idf: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """doc_id, sig, item (number), first, last: passages (in words) whose cosine with the item reaches the bound.

    Passages around which too little of the item's weight stands for a leak are left out.
    """
    weights = np.zeros((len(items), TERMS), np.float32)
    for i, x in enumerate(items):
        weights[i, x] = idf[x]
    # a passage with its surroundings holds 2 * its size; longer items are asked for in proportion
    whole = np.array([min(1.0, (1.5 * (SHORT_WINDOW if len(x) < SHORT_ITEM else WINDOW)) / max(1, len(x))) for x in items])
    enough = (WEIGHT_SHARE - 0.1) * whole * weights.sum(1)
    vectors = np.array([loading[x].sum(0) for x in items]).reshape(-1, RANK)
    vectors = (vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    short = np.array([len(x) < SHORT_ITEM for x in items], bool)
    scales = [(size, np.flatnonzero(which)) for size, which in ((WINDOW, ~short), (SHORT_WINDOW, short)) if which.any()]
    shared = found.sparkSession.sparkContext.broadcast((loading, vectors, weights, enough))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loading, vectors, weights, enough = shared.value
        for batch in batches:
            for first, last, at, bounds in _batches(batch.column("t"), BATCH):
                if not len(at):
                    continue
                # sums of STEP words, of which a passage has a whole number
                heads, blocks = _heads(bounds, STEP)
                sums = np.add.reduceat(loading[at], heads, axis=0)
                running = np.zeros((len(heads) + 1, RANK), np.float64)
                np.cumsum(sums, axis=0, out=running[1:])
                at_block = np.cumsum(blocks) - blocks
                order = np.argsort(at, kind="stable")
                before = np.full(len(at), -1)  # the place before of the same term
                before[order[1:]] = np.where(at[order[1:]] == at[order[:-1]], order[:-1], -1)
                for size, which in scales:
                    width, step = size // STEP, size // STEP // 2
                    n = np.where(blocks > 0, 1 + np.maximum(0, -((width - blocks) // step)), 0)
                    row = np.repeat(np.arange(last - first), n)
                    begin = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
                    end = np.minimum(begin + width, blocks[row])
                    passages = (running[at_block[row] + end] - running[at_block[row] + begin]).astype(np.float32)
                    passages /= np.linalg.norm(passages, axis=1, keepdims=True) + np.float32(1e-9)
                    where, item = np.nonzero(passages @ vectors[which].T >= cosine)
                    near = _weighty(at, before, heads, at_block[row], blocks[row], begin, end, width // 2, where, which[item], weights, enough)
                    where, item = where[near], item[near]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first + row[where])) for c in anchors.ROW), pa.array(which[item].astype(np.int32)), pa.array((begin[where] * STEP).astype(np.int32)), pa.array((end[where] * STEP).astype(np.int32))], names=[*anchors.ROW, "item", "first", "last"])

    return found.mapInArrow(run, "doc_id long, sig long, item int, first int, last int")


def stretch(n: int) -> int:
    """Words of the stretches in which an item of n words is looked for."""
    return n + max(4, n // 4) if n >= LEAST_WORDS else n


def least_common(n: int) -> int:
    """Words of an item of n that a leak has in common with it at least."""
    return -int(-(ITEM_SHARE * n - 1e-9) // 1) if n >= LEAST_WORDS else n


def counted(found: DataFrame, items: list[np.ndarray], idf: np.ndarray) -> DataFrame:
    """doc_id, sig, item (number), first, last: all stretches with as many of the item's rarest words as a leak holds.

    Of any n - least_common(n) + k of the item's words a leak holds k; terms met repeatedly only make more candidates.
    """
    weights = np.zeros((len(items), TERMS), np.float32)
    for i, x in enumerate(items):
        weights[i, x] = idf[x]
    # 0.1 less for words that share a term
    enough = (WEIGHT_SHARE - 0.1) * weights.sum(1)
    size = np.array([stretch(len(x)) for x in items], np.int64)
    need = np.array([least_common(len(x)) for x in items], np.int64)
    least = np.minimum(need, np.array([max(1, len(x) // 6) if len(x) >= LEAST_WORDS else len(x) for x in items], np.int64))
    term, owner = [], []
    for i, x in enumerate(items):
        rare = np.unique(x[np.argsort(-idf[x], kind="stable")][: len(x) - need[i] + least[i]])
        term.append(rare)
        owner.append(np.full(len(rare), i))
    term, owner = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (term, owner))
    order = np.argsort(term, kind="stable")
    owner, begins = owner[order], np.searchsorted(term[order], np.arange(TERMS + 1))
    shared = found.sparkSession.sparkContext.broadcast((owner, begins, weights, enough, size, need, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, begins, weights, enough, size, need, least = shared.value
        many = np.diff(begins)
        for batch in batches:
            for first, _, at, bounds in _batches(batch.column("t"), BATCH):
                n = many[at]
                spot = np.repeat(np.arange(len(at)), n)
                item = owner[np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(len(spot))]
                order = np.argsort(item, kind="stable")
                spot, item = spot[order], item[order]
                until = np.arange(len(spot)) + least[item] - 1
                fits = until < len(spot)
                lead, until = np.flatnonzero(fits), until[fits]
                row = np.searchsorted(bounds, spot, "right") - 1
                near = (item[lead] == item[until]) & (row[lead] == row[until]) & (spot[until] - spot[lead] < size[item[lead]])
                lead = lead[near]
                which, row, spot = item[lead], row[lead], spot[lead]
                # a stretch that holds this word begins and ends in these bounds
                low, high = np.maximum(bounds[row], spot - size[which] + 1), np.minimum(bounds[row + 1], spot + size[which])
                keep = np.zeros(len(which), bool)
                for i in range(0, len(which), 2000):
                    part = slice(i, i + 2000)
                    length = high[part] - low[part]
                    start = np.cumsum(length) - length
                    each = np.repeat(np.arange(len(length)), length)
                    places = np.repeat(low[part] - start, length) + np.arange(int(length.sum()))
                    held = weights[which[part][each], at[places]]
                    # the largest number in one stretch, and the weight of all
                    running = np.concatenate([[0], np.cumsum(held > 0)])
                    end = np.minimum(np.arange(len(places)) + size[which[part]][each], (start + length)[each])
                    most = np.maximum.reduceat(running[end] - running[:-1], start)
                    keep[part] = (most >= need[which[part]]) & (np.add.reduceat(held, start) >= enough[which[part]] - 1e-3)
                which, row, low, high = which[keep], row[keep], low[keep], high[keep]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first + row)) for c in anchors.ROW), pa.array(which.astype(np.int32)), pa.array((low - bounds[row]).astype(np.int32)), pa.array((high - bounds[row]).astype(np.int32))], names=[*anchors.ROW, "item", "first", "last"])

    return found.mapInArrow(run, "doc_id long, sig long, item int, first int, last int")


def plain_words(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in t.lower(np.frombuffer(text, np.uint8)).tobytes().split()]


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, sig, item_id, share (of the item's words in the longest common subsequence), answer_share, for each leaked item."""
    raw = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    found = scratch.written(terms(docs))
    idf = inverse_frequencies(found)
    loading = basis(found, idf)
    size = raw.count()
    turns = 1 if size <= MOST_ITEMS else 2 * -(-size // MOST_ITEMS)
    out = None
    for k in range(turns):
        part = _leaks(docs, found, idf, loading, raw.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == k))
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(docs: DataFrame, found: DataFrame, idf: np.ndarray, loading: np.ndarray, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    items = [(r.item_id, plain_words(r.text.encode()), r.text.encode()) for r in benchmark.orderBy("item_id", "text").collect()]  # MOST_ITEMS or about as many
    items = [x for x in items if x[1]]
    coded = [_terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] for _, _, raw in items]
    pairs = scratch.written(candidates(found, coded, loading, idf).unionByName(counted(found, coded, idf)))
    wanted = scratch.written(pairs.groupBy(*anchors.ROW).agg(F.collect_set(F.struct("item", "first", "last")).alias("pairs")))
    texts = anchors.only(anchors.texts(docs), wanted.select(*anchors.ROW), anchors.ROW).join(wanted, anchors.ROW)
    words = spark.sparkContext.broadcast([(i, w, dict(zip(w, idf[at].tolist(), strict=True))) for (i, w, _), at in zip(items, coded, strict=True)])
    schema = "doc_id long, sig long, item_id long, share double, answer_share double"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(i, w, weight, sum(weight.values()), frozenset(weight)) for i, w, weight in words.value]
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                out: list[tuple[int, int, int, float, float]] = []
                for doc, sig, text, near in zip(*(part.column(c).to_pylist() for c in (*anchors.ROW, "text", "pairs")), strict=True):
                    own = plain_words(text)
                    best: dict[int, tuple[float, float]] = {}
                    for item, first, last in _runs(near):
                        if (found := _compared(known[item], own, first, last)) is not None:
                            best[item] = max(best.get(item, (0.0, 0.0)), found)
                    out += [(doc, sig, known[item][0], *x) for item, x in best.items()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(columns)], names=[*anchors.ROW, "item_id", "share", "answer_share"])

    return texts.select(*anchors.ROW, "text", "pairs").mapInArrow(check, schema)


def _compared(item, own: list[bytes], first: int, last: int) -> tuple[float, float] | None:
    """The best (share, answer share) among stretches around words first..last, if one is a leak."""
    _, w, weight, whole, kinds = item
    part = own[max(0, first - len(w)) : last + len(w)]
    if sum(weight[x] for x in kinds.intersection(part)) < WEIGHT_SHARE * whole:
        return None
    size, need = stretch(len(w)), least_common(len(w))
    tail = w[-max(1, len(w) // 3) :]
    held = list(accumulate((x in kinds for x in part), initial=0))
    best = None
    for at in range(max(1, len(part) - size + 1)):
        if held[min(len(part), at + size)] - held[at] < need:
            continue
        near = part[at : at + size]
        if sum(weight[x] for x in kinds.intersection(near)) < WEIGHT_SHARE * whole:
            continue
        share = common(w, near) / len(w)
        if share * len(w) >= need - 1e-9 and (answer := common(tail, near) / len(tail)) >= ANSWER_SHARE:
            best = max(best or (0.0, 0.0), (share, answer))
    return best


def _runs(pairs: list[dict]) -> list[tuple[int, int, int]]:
    """Overlapping passages of one item made one."""
    out: list[tuple[int, int, int]] = []
    for p in sorted((p["item"], p["first"], p["last"]) for p in pairs):
        if out and out[-1][0] == p[0] and out[-1][2] >= p[1]:
            out[-1] = (p[0], out[-1][1], max(out[-1][2], p[2]))
        else:
            out.append(p)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, items (their ids, ordered), best (largest share), contaminated, for each document."""
    found = leaks(docs, benchmark).groupBy(*anchors.ROW).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("best"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"))
    out = rows.join(scratch.written(found), anchors.ROW, "left")
    return out.select("doc_id", F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best"), F.col("items").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of docs in which no benchmark item is found."""
    return anchors.without(docs, scratch.written(leaks(docs, benchmark).select(*anchors.ROW).distinct()))
