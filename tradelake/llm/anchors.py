"""Routing of long repeated strings to places where all their occurrences meet.

A window is `width` consecutive symbols (bytes or words) of one text. Its anchor is the gram of
`gram` symbols in it whose hash is least (the leftmost at a tie). Equal windows have their anchor at
the same offset, so each window belongs to one anchor and equal windows to anchors of equal key.
Consecutive windows with one anchor make a segment. Only about two anchors stand in `width - gram`
symbols, so that a corpus sends two numbers for hundreds of bytes; text follows only for segments
whose anchor key and content call for a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch, textops as t

U = np.uint64
#: Most distinct segments of one key that are compared in one place; keys with more are settled window by window.
MOST_SEGMENTS = 256
#: Most document ids that are broadcast; beyond, documents are joined by a shuffle. A driver of 750 MB of heap holds two such tables at once
#: (a peak of 258 MB of heap was measured); two of 4 million do not fit.
BROADCAST_IDS = 500_000
#: Keys that hold more than one in so many rows are not dealt to one task.
LARGE_KEYS = 2000

SEGMENT_SCHEMA = "key long, ctx long, doc_id long, sig long, pos long, lo int, hi int"
#: A row of documents: its id, and a hash that tells rows of one id and different texts apart.
ROW = ["doc_id", "sig"]


def find(rolling: t.Rolling, bounds: np.ndarray, width: int, gram: int):
    """Anchors of one slice: text, anchor, first symbol and end of the segment, key.

    bounds: for each text the index of its first symbol, and the number of all.
    """
    keys = rolling.grams(gram)
    span = width - gram + 1
    n = len(rolling.prefix) - 1 - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U)
    order = (keys & U(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=U)
    size = 1
    while size * 2 <= span:
        order = np.minimum(order[:-size], order[size:])
        size *= 2
    rest = span - size
    least = np.minimum(order[: len(order) - rest], order[rest:]) if rest else order
    at = (least[:n] & U(0xFFFFFFFF)).astype(np.int64)
    text = np.zeros(n + 1, np.int64)
    first = bounds[:-1][bounds[:-1] < n]
    np.add.at(text, first, 1)
    text = np.cumsum(text[:n]) - 1
    end = np.asarray(bounds[1:])
    valid = np.arange(n) + width <= end[text]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    begin = np.flatnonzero(new & valid)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U)
    last_valid = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return text[begin], at[begin], begin, last_valid + width, keys[at[begin]]


def symbols(unit: str, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit symbols of a slice, and for each text the index of its first."""
    if unit == "byte":
        return t.byte_symbols(buf), offs
    starts, ends, bounds = t.word_bounds(buf, offs)
    return t.word_hashes(buf, starts, ends), bounds


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, sig, text (UTF-8; null: empty) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def segments(docs: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """One row for each segment of each text: key, ctx (hash of its content), doc_id, sig, pos of the anchor, symbols before and from it.

    docs: doc_id, text. Null texts are empty; texts of under `width` symbols have no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, buf, offs in t.slices(batch.column("text")):
                sym, bounds = symbols(unit, buf, offs)
                rolling = t.Rolling(sym)
                text, at, begin, end, key = find(rolling, bounds, width, gram)
                if not len(text):
                    continue
                size = 1 if unit == "byte" else 8
                ctx = t.digests(buf.tobytes() if unit == "byte" else sym.tobytes(), begin * size, end * size) ^ t.mix((at - begin).astype(U))
                where = pa.array(first + text)
                columns = [key.view(np.int64), ctx.view(np.int64), *(batch.column(c).take(where) for c in ROW), at - bounds[text], (at - begin).astype(np.int32), (end - at).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["key", "ctx", *ROW, "pos", "lo", "hi"])

    return texts(docs).where("doc_id is not null").mapInArrow(run, SEGMENT_SCHEMA)


def repeated(docs: DataFrame, unit: str, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Segments whose anchor key stands more than once, and the distinct contents among them.

    The second has key, ctx, n (places), m (distinct contents of the key) and the first place
    (doc_id, sig, pos, lo, hi). Both are written tables.
    """
    every = scratch.written(segments(docs, unit, width, gram))
    again = scratch.written(met_again(every))
    contents = again.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "pos", "lo", "hi")).alias("at"))
    many = contents.groupBy("key").agg(F.count("*").alias("m"))
    contents = contents.join(many, "key").select("key", "ctx", "n", "m", "at.*").where("m > 1 or n > 1")
    return again, scratch.written(contents)


def met_again(every: DataFrame) -> DataFrame:
    """The rows of every (written) whose key stands more than once. Keys with many rows are met by broadcast, the others by a shuffle."""
    counts = scratch.written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    # at most LARGE_KEYS keys can have so many of the rows each
    large = counts.where(F.col("n") * LARGE_KEYS > rows).select("key")
    hot = every.join(F.broadcast(large), "key", "left_semi")
    rest = every.join(F.broadcast(large), "key", "left_anti").join(counts.select("key"), "key", "left_semi")
    return hot.unionByName(rest)


def only(docs: DataFrame, ids: DataFrame, on: str | list[str] = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is in ids (distinct): by broadcast where the ids are few, else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows and columns of docs whose doc_id and text are not among rows (doc_id, sig, distinct)."""
    held = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"))
    return held.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, ROW, "left_anti").select("_row.*")


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs left-joined to lists (one row for each doc_id and sig, written), moving the texts of only those that have one where that is possible."""
    if lists.count() > BROADCAST_IDS:
        return docs.join(lists, ROW, "left")
    ids = F.broadcast(lists.select(*ROW))
    none = docs.join(ids, ROW, "left_anti")
    for field in lists.schema.fields[len(ROW) :]:
        none = none.withColumn(field.name, F.lit(None).cast(field.dataType))
    return docs.join(ids, ROW, "left_semi").join(lists, ROW).unionByName(none)


def contents_of(docs: DataFrame, chosen: DataFrame, unit: str) -> DataFrame:
    """chosen with `content`: the bytes of the segment, or its words' 64-bit hashes.

    chosen: key, ctx, doc_id, sig, pos, lo, hi and more. The list for one row is no longer than its text.
    Rows equal in id and text give their contents each.
    """
    others = [c for c in chosen.columns if c not in ROW]
    lists = scratch.written(chosen.groupBy(*ROW).agg(F.collect_list(F.struct(*others)).alias("items")))
    own = only(texts(docs), lists.select(*ROW), ROW)
    schema = f"doc_id long, sig long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in chosen.schema.fields if f.name not in ROW)}, content binary"
    size = 1 if unit == "byte" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, offs in t.slices(batch.column("text")):
                raw, bounds = (buf, offs) if unit == "byte" else symbols(unit, buf, offs)
                raw = raw.tobytes()
                items = batch.column("items").slice(first, last - first)
                lengths = items.value_lengths().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(last - first), lengths)
                flat = items.flatten()
                pos, lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "lo", "hi"))
                begin, end = (bounds[text] + pos - lo) * size, (bounds[text] + pos + hi) * size
                ids = [batch.column(c).slice(first, last - first).take(pa.array(text)) for c in ROW]
                for i in range(0, len(text), 5000):
                    content = pa.array([raw[b:e] for b, e in zip(begin[i : i + 5000].tolist(), end[i : i + 5000].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(x[i : i + 5000] for x in ids), *(flat.field(c)[i : i + 5000] for c in others), content], names=[*ROW, *others, "content"])

    return own.join(lists, ROW).select(*ROW, "text", "items").mapInArrow(run, schema)


def by_key(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn over tables of whole keys: rows are dealt by key and sorted, and a key that a batch cuts is carried to the next.

    The keys in df have MOST_SEGMENTS rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]).combine_chunks() if kept is not None else table
            if not table.num_rows:
                continue
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            kept = table.slice(cut)
            if cut:
                yield from fn(table.slice(0, cut).combine_chunks())
        if kept is not None and kept.num_rows:
            yield from fn(kept.combine_chunks())

    return df.repartition(scratch.partitions(df.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, schema)


def windows_of(df: DataFrame, width: int, unit: str) -> DataFrame:
    """Every window of the segments in df (with content): key, ctx, doc_id, sig, pos, start (from the anchor), window (its hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 2000
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                raw = part.column("content").to_pylist()
                size = 1 if unit == "byte" else 8
                lengths = np.array([len(x) // size for x in raw])
                counts = lengths - width + 1
                row = np.repeat(np.arange(len(raw)), counts)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = np.repeat(np.cumsum(lengths) - lengths, counts) + offset
                start = offset - part.column("lo").to_numpy()[row]
                window = t.digests(b"".join(raw), begin * size, (begin + width) * size) ^ t.mix(start.astype(np.int64).view(U))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("key", "ctx", *ROW, "pos")), pa.array(start.astype(np.int32)), pa.array(window.view(np.int64))], names=["key", "ctx", *ROW, "pos", "start", "window"])

    return df.select("key", "ctx", *ROW, "pos", "lo", "content").mapInArrow(run, "key long, ctx long, doc_id long, sig long, pos long, start int, window long")


def pieces_of(df: DataFrame, width: int, unit: str, size: int) -> DataFrame:
    """Segments of crowded keys cut in pieces of at most `size` windows, dealt by far longer strings.

    Pieces are aligned to the anchor, and the windows of one share all but size - 1 symbols (the core),
    whose hash is the piece's key: pieces that meet agree in width - size + 1 symbols. key, ctx: of the
    piece; whole_key, whole_ctx: of its segment; pos, lo: of the core's first symbol; base: its offset from the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                raw = part.column("content").to_pylist()
                unit_bytes = 1 if unit == "byte" else 8
                lengths = np.array([len(x) // unit_bytes for x in raw])
                sym = np.frombuffer(b"".join(raw), np.uint8 if unit == "byte" else U)
                rolling = t.Rolling(t.byte_symbols(sym) if unit == "byte" else sym)
                at = np.cumsum(lengths) - lengths
                lo = part.column("lo").to_numpy().astype(np.int64)
                first, last = -lo, lengths - width - lo  # window starts, from the anchor
                lowest, highest = first // size, last // size
                count = highest - lowest + 1
                row = np.repeat(np.arange(len(raw)), count)
                q = lowest[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin, end = np.maximum(first[row], q * size), np.minimum(last[row], q * size + size - 1) + width
                core = q * size + size - 1
                origin = at[row] + lo[row]
                key = rolling.ranges(origin + core, origin + q * size + width) ^ t.mix(q.view(U)) ^ t.mix(part.column("key").to_numpy().view(U)[row])
                own = sym.tobytes()
                ctx = t.digests(own, (origin + begin) * unit_bytes, (origin + end) * unit_bytes) ^ t.mix((core - begin).view(U))
                content = [own[a * unit_bytes : b * unit_bytes] for a, b in zip((origin + begin).tolist(), (origin + end).tolist(), strict=True)]
                where = pa.array(row)
                pos = part.column("pos").to_numpy()[row] + core
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), part.column("key").take(where), part.column("ctx").take(where), *(part.column(c).take(where) for c in ROW), pa.array(pos), pa.array((core - begin).astype(np.int32)), pa.array(core.astype(np.int32)), pa.array(content, pa.binary())],
                    names=["key", "ctx", "whole_key", "whole_ctx", *ROW, "pos", "lo", "base", "content"],
                )

    return df.select("key", "ctx", *ROW, "pos", "lo", "content").mapInArrow(run, "key long, ctx long, whole_key long, whole_ctx long, doc_id long, sig long, pos long, lo int, base int, content binary")


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    """Each content of each piece key once, at its first place: key, ctx, n (places), m (contents of the key), doc_id, sig, pos, lo, content."""
    each = pieces.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "pos", "lo", "content")).alias("at"))
    many = pieces.groupBy("key").agg(F.count_distinct("ctx").alias("m"), F.count("*").alias("all")).where("all > 1")
    return scratch.written(each.join(many, "key").select("key", "ctx", "n", "m", "at.*"))
