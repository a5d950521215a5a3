"""Repeated byte strings across and within texts, by an enhanced suffix array over anchored suffixes.

A string of `width` bytes that stands in several places has the same anchor in each (see anchors.py),
so the suffixes that begin at anchors of equal key hold all its occurrences. For each key the distinct
suffixes are sorted, and the longest common prefixes of neighbours are scanned with a stack: each node
of the common-prefix interval tree is a set of suffixes with a common extension to the right. Its
members' left contexts are then compared. As far as they agree the repeat goes on to the left; where
they begin to differ it is left-maximal, and is put out with all its occurrences if both sides
together have `width` bytes. A node whose members agree in more than a descendant's gives a shorter
repeat with more occurrences. A repeat that spans several anchors comes out in overlapping parts.

Results for unusual input: null texts count as empty, and a text shorter than `width` has no repeats.
Equal rows repeat each other; rows of one doc_id, or without one, are texts of their own. Further
columns of the input are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import anchors, scratch

GRAM = 100
#: Stands for a missing doc_id (and so is not to be used as one).
NO_ID = -(1 << 63)
#: Windows in a piece of a segment whose key is crowded.
PIECE = 16


def _common(rows: list[bytes], order: np.ndarray, same: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of each row and the one before in `order`; 0 where not `same`."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 20_000):
        part = order[i - 1 : i + 20_000]
        lengths = np.array([len(rows[j]) for j in part])
        wide = np.frombuffer(b"".join(rows[j].ljust(width, b"\0") for j in part), np.uint8).reshape(len(part), width)
        differs = wide[1:] != wide[:-1]
        first = np.where(differs.any(1), differs.argmax(1), width)
        out[i : i + len(part) - 1] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    out[1:][~same] = 0
    return out


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Nodes (depth, first, last) of the common-prefix interval tree of one sorted suffix list, by a stack scan."""
    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, len(common) + 1):
        depth, first = int(common[i]) if i < len(common) else -1, i - 1
        while stack and stack[-1][0] > depth:
            at, first = stack.pop()
            yield at, first, i - 1
        if depth > 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(keys: np.ndarray, lo: np.ndarray, contents: list[bytes], width: int) -> tuple[list[int], list[int], list[int]]:
    """(row, start, end) of each occurrence of each left-maximal repeat of at least `width` bytes, from the anchor."""
    right = [c[b:] for c, b in zip(contents, lo.tolist(), strict=True)]
    left = [c[:b][::-1] for c, b in zip(contents, lo.tolist(), strict=True)]
    key = keys.tolist()
    n = len(key)
    most = max(map(len, contents), default=0)
    by_right = np.array(sorted(range(n), key=lambda i: (key[i], right[i])), np.int64)
    by_left = np.array(sorted(range(n), key=lambda i: (key[i], left[i])), np.int64)
    same = keys[by_right][1:] == keys[by_right][:-1]
    right_common = _common(right, by_right, same, most)
    left_common = _common(left, by_left, same, most)
    heads = np.flatnonzero(np.append(True, ~same)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, n))
    rows: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    two = heads[sizes == 2]
    r, lf = right_common[two + 1], left_common[two + 1]
    good = r + lf >= width
    for a in (two[good], two[good] + 1):
        rows += by_right[a].tolist()
        starts += (-lf[good]).tolist()
        ends += r[good].tolist()
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if right_common[head + 1 : head + size].max() + left_common[head + 1 : head + size].max() < width:
            continue
        for depth, first, last in intervals(np.append(0, right_common[head + 1 : head + size])):
            members = by_right[head + first : head + last + 1]
            members = members[np.argsort(rank[members])]
            at = rank[members]
            between = np.minimum.reduceat(left_common[: at[-1] + 1], at[:-1] + 1)
            extension = np.maximum(np.append(0, between), np.append(between, 0))
            found = extension + depth >= width
            rows += members[found].tolist()
            starts += (-extension[found]).tolist()
            ends += [depth] * int(found.sum())
    return rows, starts, ends


def repeats(docs: DataFrame, width: int = 400, gram: int = GRAM) -> DataFrame:
    """doc_id, sig, start, end (bytes), group: each occurrence of each maximal repeat of `width` bytes or more.

    `group` is the hash of the repeated string. docs: doc_id, text.
    """
    again, contents = anchors.repeated(docs, "byte", width, min(gram, width))
    whole = contents.where("n > 1").select("key", "ctx", F.col("ctx").alias("group"), (-F.col("lo")).alias("start"), F.col("hi").alias("end"))

    def search(table: pa.Table):
        texts = table.column("content").to_pylist()
        lo = table.column("lo").to_numpy()
        rows, starts, ends = maximal_repeats(table.column("key").to_numpy(), lo, texts, width)
        group = [xxhash.xxh3_64_intdigest(texts[i][lo[i] + s : lo[i] + e]) for i, s, e in zip(rows, starts, ends, strict=True)]
        at = pa.array(rows, pa.int64())
        columns = [table.column("key").take(at), table.column("ctx").take(at), pa.array(np.array(group, np.uint64).view(np.int64)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["key", "ctx", "group", "start", "end"])

    texts = scratch.written(anchors.contents_of(docs, contents.where("m > 1"), "byte"))
    schema = "key long, ctx long, group long, start int, end int"
    found = anchors.by_key(texts.where(f"m <= {anchors.MOST_SEGMENTS}").select("key", "ctx", "lo", "content"), search, schema)
    # keys with more distinct segments are dealt anew in pieces that share all but PIECE - 1 bytes of a window
    pieces = scratch.written(anchors.pieces_of(texts.where(f"m > {anchors.MOST_SEGMENTS}"), width, "byte", min(PIECE, width)))
    each = anchors.distinct_pieces(pieces)
    again_whole = each.where("n > 1").select("key", "ctx", F.col("ctx").alias("group"), (-F.col("lo")).alias("start"), (F.octet_length("content") - F.col("lo")).alias("end"))
    again_found = anchors.by_key(each.where(f"m > 1 and m <= {anchors.MOST_SEGMENTS}").select("key", "ctx", "lo", "content"), search, schema)
    # in pieces of still more contents, nodes of depth `width` are equal windows, which aggregation finds without gathering them
    crowded = anchors.windows_of(each.where(f"m > {anchors.MOST_SEGMENTS}"), width, "byte")
    equal = crowded.groupBy("key", "window").count().where("count > 1")
    crowded = crowded.join(equal, ["key", "window"], "left_semi").select("key", "ctx", F.col("window").alias("group"), "start", (F.col("start") + width).alias("end"))
    of_pieces = again_whole.unionByName(again_found).unionByName(crowded)
    crowded = pieces.select("key", "ctx", "whole_key", "whole_ctx", "base").join(of_pieces, ["key", "ctx"])
    crowded = crowded.select(F.col("whole_key").alias("key"), F.col("whole_ctx").alias("ctx"), "group", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))
    spans = scratch.written(whole.unionByName(found).unionByName(crowded))
    return again.join(spans, ["key", "ctx"]).select(*anchors.ROW, (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"), "group")


def removed(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that no repeat of `width` covers), one row for each row of docs."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    spans = scratch.written(merged_lists(repeats(docs, width)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sizes, gone, runs, kept = [], [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    sizes.append(len(text))
                    if not spans.is_valid:
                        gone.append(0)
                        runs.append(0)
                        kept.append(text)
                        continue
                    flat = spans.values
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, np.minimum(flat.field("start").to_numpy(), len(text)), 1)
                    np.add.at(depth, np.minimum(flat.field("end").to_numpy(), len(text)), -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    gone.append(int(covered.sum()))
                    runs.append(int((covered & ~np.append(False, covered[:-1])).sum()))
                    kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = anchors.with_lists(anchors.texts(docs), spans).select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def merged_lists(spans: DataFrame) -> DataFrame:
    """doc_id, sig, spans: the distinct (start, end) of each row, unsorted."""
    return spans.select(*anchors.ROW, F.struct("start", "end").alias("span")).groupBy(*anchors.ROW).agg(F.collect_set("span").alias("spans"))


def digest(docs: DataFrame, width: int = 400) -> DataFrame:
    return removed(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
