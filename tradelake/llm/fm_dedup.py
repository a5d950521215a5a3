"""Repeated word windows, by backward search in FM-indexes.

Candidate segments (see anchors.py) are dealt to shards by the key of their anchor, so that all
occurrences of a window are in one shard. A shard's index is the Burrows-Wheeler transform of its
segments in a wavelet matrix, and the places of the suffixes, in suffix order, in another: packed bits
with a count for each 64. Neither the words nor the suffix order stay in it. The segments stream against
the index: backward search takes words from the right end of a window to the left as long as the match
also stands in an earlier segment, which the least place in the suffix range tells, itself read from the
second matrix. These matching statistics skip every window that holds a failed match, and a match of
`width` words is reported.

Results for unusual input: null texts count as empty; texts of fewer than `width` words are kept
whole. The first place is kept (by doc_id, among rows of one id by a hash of the text, then by position);
rows equal in id and text are one document in this and are kept alike.
Rows with a null doc_id are neither compared nor changed. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors, scratch, textops as t

GRAM = 5
#: Windows in a piece of a segment whose key is crowded.
PIECE = 4
U = np.uint64


class WaveletMatrix:
    """Rank over a sequence of small integers, one packed bit vector for each bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for bit in reversed(range(bits)):
            ones = (values >> bit) & 1 == 1
            packed = np.packbits(np.append(ones, np.zeros(64 + -len(ones) % 64, bool)), bitorder="little").view(U)
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.levels.append((packed, counts, int((~ones).sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, counts, _ = self.levels[level]
        block = at >> 6
        return counts[block] + np.bitwise_count(packed[block] & ((U(1) << (at & 63).astype(U)) - U(1)))

    def range(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of value in [lo, hi) stand in the last level's order."""
        both = np.concatenate([lo, hi])
        value = np.concatenate([value, value])
        for depth, (_, _, zeros) in enumerate(self.levels):
            ones = self._ones(depth, both)
            bit = (value >> (self.bits - 1 - depth)) & 1
            both = np.where(bit == 1, zeros + ones, both - ones)
        return both[: len(lo)], both[len(lo) :]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value in each range [lo, hi), which are not empty."""
        out = np.zeros(len(lo), np.int64)
        for depth, (_, _, zeros) in enumerate(self.levels):
            ones = self._ones(depth, np.concatenate([lo, hi]))
            one_lo, one_hi = ones[: len(lo)], ones[len(lo) :]
            none = hi - one_hi == lo - one_lo
            out = 2 * out + none
            lo, hi = np.where(none, zeros + one_lo, lo - one_lo), np.where(none, zeros + one_hi, hi - one_hi)
        return out


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of text in order of their first `longest` symbols, by doubling of ranks."""
    rank, size = text.astype(np.int64), 1
    while True:
        second = np.zeros(len(text), np.int64)
        second[: max(0, len(text) - size)] = rank[size:] + 1
        pair = rank * (int(rank.max()) + 2) + second
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        size *= 2
        if size >= longest or rank[order[-1]] == len(text) - 1:
            return order


class FMIndex:
    """Index of segments (words are numbers from 1 on); place: the order of each segment's first occurrence."""

    def __init__(self, segments: np.ndarray, lengths: np.ndarray, place: np.ndarray):
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = inside[-1] = False
        text[inside] = segments
        self.size = len(text)
        order = suffix_order(text, int(lengths.max()) + 2)
        symbols = int(text.max()) + 1
        counts = np.bincount(text, minlength=symbols)
        bits = max(1, int(symbols - 1).bit_length())
        self.tree = WaveletMatrix(text[order - 1], bits)
        # the last level's order groups symbols by their reversed bits; `shift` leads from there to the suffixes that begin with the symbol
        reverse = np.zeros(symbols, np.int64)
        for b in range(bits):
            reverse |= ((np.arange(symbols) >> b) & 1) << (bits - 1 - b)
        low = np.zeros(1 << bits, np.int64)
        low[reverse] = counts
        self.shift = np.cumsum(counts) - counts - (np.cumsum(low) - low)[reverse]
        owner = np.searchsorted(ends, np.arange(len(text)), "right")
        rank = np.append(place, len(place))[np.minimum(owner, len(place))]
        self.places = WaveletMatrix(rank[order], max(1, int(len(place)).bit_length()))

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with word and go on as those in [lo, hi)."""
        lo, hi = self.tree.range(word, lo, hi)
        return lo + self.shift[word], hi + self.shift[word]


def earlier_windows(lengths: np.ndarray, words: np.ndarray, place: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment, the starts of those of its windows that also stand in a segment of an earlier place."""
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    index = FMIndex(ids, lengths, place)
    hits_row, hits_start = [], []
    lane = np.flatnonzero(lengths >= width)
    end = np.cumsum(lengths)
    begin = end - lengths
    start = begin[lane].copy()
    at = start + width - 1
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
    while len(lane):
        lo, hi = index.extend(ids[at], lo, hi)
        earlier = index.places.least(lo, hi) < place[lane]
        whole = earlier & (at == start)
        if whole.any():
            hits_row.append(lane[whole])
            hits_start.append(start[whole] - begin[lane[whole]])
        moved = ~earlier | whole
        start = np.where(earlier, np.where(whole, start + 1, start), at + 1)
        at = np.where(moved, start + width - 1, at - 1)
        lo, hi = np.where(moved, 0, lo), np.where(moved, index.size, hi)
        live = start + width <= end[lane]
        lane, start, at, lo, hi = lane[live], start[live], at[live], lo[live], hi[live]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
    if hits_row:
        row, found = np.concatenate(hits_row), np.concatenate(hits_start)
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for r, part in zip(row[heads].tolist(), np.split(found, heads[1:]), strict=True):
            out[r] = part
    return out


def repeated_words(docs: DataFrame, width: int = 20, gram: int = GRAM) -> DataFrame:
    """doc_id, sig, start, end (words): spans of windows of `width` words that also start at an earlier place.

    docs: doc_id, text. Places are ordered by doc_id, then position.
    """
    again, contents = anchors.repeated(docs, "word", width, min(gram, width))
    first = F.expr(" and ".join(f"again.{c} = first.{c}" for c in [*anchors.ROW, "pos"]))
    later = (
        again.alias("again").join(contents.where("n > 1").select("key", "ctx", *anchors.ROW, "pos").alias("first"), ["key", "ctx"])
        .where(~first)
        .select("again.doc_id", "again.sig", (F.col("again.pos") - F.col("again.lo")).alias("start"), (F.col("again.pos") + F.col("again.hi")).alias("end"))
    )

    def search(table: pa.Table):
        places = np.stack([table.column(c).to_numpy() for c in ["key", *anchors.ROW, "pos"]])
        table = table.take(pa.array(np.sort(np.unique(places, axis=1, return_index=True)[1])))  # equal rows of one id are one place
        content = table.column("content").to_pylist()
        lengths = np.array([len(c) // 8 for c in content], np.int64)
        doc, sig, pos = (table.column(c).to_numpy() for c in [*anchors.ROW, "pos"])
        place = np.empty(len(doc), np.int64)
        place[np.lexsort((pos, sig, doc))] = np.arange(len(doc))
        found = earlier_windows(lengths, np.frombuffer(b"".join(content), U), place, width)
        base = pos - table.column("lo").to_numpy()
        out_row, out_start, out_end = [], [], []
        for i, starts in enumerate(found):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                heads, tails = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
                out_row += [i] * len(heads)
                out_start += (base[i] + heads).tolist()
                out_end += (base[i] + tails + width).tolist()
        row = np.array(out_row, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(sig[row]), pa.array(out_start, pa.int64()), pa.array(out_end, pa.int64())], names=[*anchors.ROW, "start", "end"])

    schema = "doc_id long, sig long, start long, end long"

    texts = scratch.written(anchors.contents_of(docs, contents.where("m > 1"), "word"))
    found = anchors.by_key(texts.where(f"m <= {anchors.MOST_SEGMENTS}").select("key", *anchors.ROW, "pos", "lo", "content"), search, schema)
    # keys with more distinct segments are dealt anew in pieces that share all but PIECE - 1 words of a window
    pieces = scratch.written(anchors.pieces_of(texts.where(f"m > {anchors.MOST_SEGMENTS}"), width, "word", min(PIECE, width)))
    each = anchors.distinct_pieces(pieces)
    firsts = each.where("n > 1").select("key", "ctx", *anchors.ROW, "pos")
    begin = F.col("again.pos") - F.col("again.lo")
    crowded_later = (
        pieces.alias("again").join(firsts.alias("first"), ["key", "ctx"]).where(~first)
        .select("again.doc_id", "again.sig", begin.alias("start"), (begin + F.octet_length("again.content") / 8).cast("long").alias("end"))
    )
    crowded_found = anchors.by_key(each.where(f"m > 1 and m <= {anchors.MOST_SEGMENTS}").select("key", *anchors.ROW, "pos", "lo", "content"), search, schema)
    # pieces of still more contents are not gathered: their windows are compared by aggregation
    crowded = anchors.windows_of(each.where(f"m > {anchors.MOST_SEGMENTS}"), width, "word")
    crowded = crowded.withColumn("start", F.col("pos") + F.col("start")).select("key", "window", *anchors.ROW, "start")
    firsts = crowded.groupBy("key", "window").agg(F.min(F.struct(*anchors.ROW, "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = crowded.join(firsts, ["key", "window"]).where("struct(doc_id, sig, start) > first").select(*anchors.ROW, "start", (F.col("start") + width).alias("end"))
    crowded = crowded.unionByName(crowded_later).unionByName(crowded_found)
    return later.unionByName(found).unionByName(crowded)


def removed(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words not removed, joined by one space), one row for each row of docs."""
    spans = repeated_words(docs, width).select(*anchors.ROW, F.struct("start", "end").alias("span")).groupBy(*anchors.ROW).agg(F.collect_set("span").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sizes, gone, kept = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    words = text.split()
                    sizes.append(len(words))
                    if spans.is_valid:
                        flat = spans.values
                        depth = np.zeros(len(words) + 1, np.int32)
                        np.add.at(depth, np.minimum(flat.field("start").to_numpy(), len(words)), 1)
                        np.add.at(depth, np.minimum(flat.field("end").to_numpy(), len(words)), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) <= 0)]
                    gone.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return anchors.with_lists(anchors.texts(docs), scratch.written(spans)).select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def digest(docs: DataFrame, width: int = 20) -> DataFrame:
    return removed(docs, width).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
