"""Two tokenizers' tokens aligned by bytes, and corpus-wide counts of the token pairs that end together.

Each map task tokenizes texts and cuts what it gathers into flushes. A flush is a row of a written table: the
documents' own figures, and for each radix of the B id a run of pair-document records (pair, document, times)
sorted by (B id, A id), compressed by zstd. The runs' keys and totals alone are dealt by radix and merged by a
k-way heap, in rounds of FAN_IN runs; the last round goes through the pairs B-major, so that the highest count
of a B id is known when its last pair has passed. The counts then return to the flushes, each of which adds up
its own documents: nothing is dealt by document, and no task holds all records of a pair, however frequent.

Two tokens that end at one byte of a text are such that one's bytes end the other's. So a vocabulary's
tokens meet at most as many pairs as both vocabularies' tokens have bytes (under a million here), whatever the corpus:
this bounds the counts that are collected and broadcast.

Results for unusual input: null and empty texts, and texts that either tokenizer does not give back byte for
byte, have no tokens: zeros and an empty groups_sha256. Repeated rows and rows of one id count each; a null id
stays null. Long texts are tokenized whole. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import scratch

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# A's special token, and the pattern by which byte-level vocabularies cut a text.
SPECIAL = "<|endoftext|>"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANK = re.compile(r"\s{2000}")
RADIXES = 16
FAN_IN = 64
#: Links and bytes of text after which a flush is written.
FLUSH_LINKS, FLUSH_BYTES = 1 << 17, 1 << 22
A_BITS = 20
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
FLUSH_SCHEMA = f"docs array<struct<{DOC.replace(' ', ':').replace(',:', ',')}>>, flush long, keys array<binary>, totals array<binary>, records array<binary>"
DOC_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class Vocabulary:
    """Bytes of each id, their lengths, and the ids printed with the separators that may follow them."""

    def __init__(self, pieces: list[bytes], last: str):
        self.pieces = pieces
        self.bytes_of = pieces.__getitem__
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(pieces))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(pieces))], object)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizers(folder: str):
    """(encode of A, its vocabulary, encode of B, its vocabulary), made once in a Python worker.

    A's file is read as ranks: an id is the rank of its merge, so tiktoken gives the ids that the file's own library
    gives (compared in the tests), at four times its speed. Long runs of white space, for which its pattern matcher
    has too small a stack, are left to that library.
    """
    import tiktoken
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    letters = _byte_letters()
    with open(f"{folder}/{A_FILE}", encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    ranks = {bytes(letters[c] for c in name): i for name, i in names.items() if set(name) <= letters.keys() and name != SPECIAL}
    a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
    a_pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        a_pieces[i] = piece
    b_pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]

    own = Tokenizer.from_file(f"{folder}/{A_FILE}")
    own.encode_special_tokens = True

    def encode_a(texts: list[str]) -> list[list[int]]:
        return [own.encode(f" {x}", add_special_tokens=False).ids if LONG_BLANK.search(x) else a.encode_ordinary(f" {x}") for x in texts]

    return encode_a, Vocabulary(a_pieces, "|"), (lambda texts: b.encode(texts, num_threads=1)), Vocabulary(b_pieces, ";")


def aligned(raw: bytes, ids_a: list[int], ids_b: list[int], va: Vocabulary, vb: Vocabulary) -> tuple[int, int, int, np.ndarray, str] | None:
    """(n_a, n_b, n_groups, keys of the links, groups as text) of space+text, or None where the tokens do not join to its bytes."""
    if not raw or b"".join(map(va.bytes_of, ids_a)) != b" " + raw or b"".join(map(vb.bytes_of, ids_b)) != b" " + raw:
        return None
    a, b = np.fromiter(ids_a, np.int64, len(ids_a)), np.fromiter(ids_b, np.int64, len(ids_b))
    end_a, end_b = np.cumsum(va.sizes[a]), np.cumsum(vb.sizes[b])
    met = np.searchsorted(end_b, end_a)
    closes_a = end_b[met] == end_a
    last_a, last_b = np.flatnonzero(closes_a), met[closes_a]
    closes_b = np.zeros(len(b), np.int64)
    closes_b[last_b] = 1
    # a group prints its A tokens, then its B tokens: each token moves behind those of the other side that precede it
    place_a = np.arange(len(a)) + np.append(0, last_b + 1)[np.cumsum(closes_a) - closes_a]
    place_b = np.arange(len(b)) + (last_a + 1)[np.cumsum(closes_b) - closes_b]
    parts = np.empty(len(a) + len(b), object)
    parts[place_a], parts[place_b] = va.inner[a], vb.inner[b]
    parts[place_a[last_a]], parts[place_b[last_b]] = va.last[a[last_a]], vb.last[b[last_b]]
    return len(a), len(b), len(last_a), b[last_b] << A_BITS | a[last_a], "".join(parts.tolist())[:-1]


def runs(keys: np.ndarray, docs: np.ndarray) -> tuple[list, list, list]:
    """By radix: sorted pair keys, their totals, and records (documents of each key, then document and times of each record)."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(keys)))
    keys, docs = keys[heads], docs[heads]
    out = ([], [], [])
    for radix in range(RADIXES):
        own = (keys >> A_BITS) % RADIXES == radix
        k, d, n = keys[own], docs[own], times[own]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        totals = np.add.reduceat(n, first) if len(k) else n
        out[0].append(packed(k[first]))
        out[1].append(packed(totals.astype(np.int64)))
        out[2].append(packed(np.concatenate([[len(first), len(k)], np.diff(np.append(first, len(k))), d, n]).astype(np.int32)))
    return out


def spilled(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The written flushes of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_a, va, encode_b, vb = tokenizers(folder)
        task, count = TaskContext.get().partitionId(), 0
        rows, keys, links, size = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate([np.zeros(0, np.int64), *keys])
            doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            columns = [pa.array([rows], DOC_TYPE), pa.array([task << 32 | count]), *(pa.array([x], pa.list_(pa.binary())) for x in runs(key, doc))]
            return pa.RecordBatch.from_arrays(columns, names=["docs", "flush", "keys", "totals", "records"])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, last in pieces(texts):
                raws = [x or b"" for x in texts.slice(first, last - first).to_pylist()]
                plain = [x.decode("utf-8", "replace") for x in raws]
                for doc_id, raw, a, b in zip(ids[first:last], raws, encode_a(plain), encode_b(plain), strict=True):
                    found = aligned(raw, a, b, va, vb)
                    n_a, n_b, n, key, groups = found or (0, 0, 0, np.zeros(0, np.int64), "")
                    rows.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": n, "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if found else ""})
                    keys.append(key)
                    links, size = links + n, size + len(raw) + 64
                    if links >= FLUSH_LINKS or size >= FLUSH_BYTES:
                        yield flush()
                        rows, keys, links, size, count = [], [], 0, 0, count + 1
        if rows:
            yield flush()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return scratch.written(given.mapInArrow(run, FLUSH_SCHEMA), **{"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 4})


def pieces(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive rows (first, after the last) of up to `most` bytes, at least one row each."""
    ends = np.cumsum(np.array([len(x) if x is not None else 0 for x in (s.as_buffer() for s in texts)], np.int64)) if len(texts) else []
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def heap_merged(runs_: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(pair, sum of its totals) in the order of pairs, from sorted runs of (pairs, totals)."""
    streams = [zip(keys.tolist(), totals.tolist(), strict=True) for keys, totals in runs_]
    for key, same in groupby(heapq.merge(*streams), lambda x: x[0]):
        yield key, sum(n for _, n in same)


def best(pairs: Iterator[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, whether a count is its B id's highest) from pairs in B-major order."""
    keys, counts, top = [], [], []
    for _, side in groupby(pairs, lambda x: x[0] >> A_BITS):
        own = list(side)
        highest = max(n for _, n in own)
        keys += [k for k, _ in own]
        counts += [n for _, n in own]
        top += [n == highest for _, n in own]
    return np.array(keys, np.int64), np.array(counts, np.int64), np.array(top, np.bool_)


def counted(flushes: DataFrame) -> DataFrame:
    """radix, keys, totals: one run for each radix, merged from the flushes' runs in rounds of about FAN_IN."""
    left = flushes.count()
    out = flushes.select("flush", F.posexplode(F.arrays_zip("keys", "totals")).alias("radix", "run")).select("radix", F.xxhash64("flush").alias("run"), "run.keys", "run.totals")

    def merge(table: pa.Table) -> pa.Table:
        merged = list(heap_merged([(unpacked(k, np.int64), unpacked(n, np.int64)) for k, n in zip(table.column("keys").to_pylist(), table.column("totals").to_pylist(), strict=True)]))
        keys, totals = np.array([k for k, _ in merged], np.int64), np.array([n for _, n in merged], np.int64)
        return pa.table({"radix": table.column("radix").slice(0, 1), "run": table.column("cell").slice(0, 1), "keys": pa.array([packed(keys)], pa.binary()), "totals": pa.array([packed(totals)], pa.binary())})

    while True:
        left = max(1, -(-left // FAN_IN))
        dealt = out.select("radix", F.pmod("run", F.lit(left)).alias("cell"), "keys", "totals")
        out = dealt.groupBy("radix", "cell").applyInArrow(merge, "radix int, run long, keys binary, totals binary")
        if left == 1:
            return out


def pair_counts(flushes: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By radix: pairs, counts, best. Bounded by the vocabularies, see above."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_))] * RADIXES
    for r in counted(flushes).collect():
        keys, totals = unpacked(r.keys, np.int64), unpacked(r.totals, np.int64)
        out[r.radix] = best(zip(keys.tolist(), totals.tolist(), strict=True))
    return out


def pairs(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """a, b, links, is_best: every pair of ids that end together somewhere, and in how many links."""
    found = pair_counts(spilled(docs, folder))
    rows = [(int(k) & (1 << A_BITS) - 1, int(k) >> A_BITS, int(n), bool(x)) for keys, counts, top in found for k, n, x in zip(keys, counts, top, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "a long, b long, links long, is_best boolean")


def digest(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    flushes = spilled(docs, folder)
    counts = docs.sparkSession.sparkContext.broadcast(pair_counts(flushes))

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, keys, records in zip(batch.column("docs"), batch.column("keys"), batch.column("records"), strict=True):
                rows = pa.RecordBatch.from_struct_array(own.values)
                n_best, count_sum = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                for (pair, count, top), k, r in zip(counts.value, keys, records, strict=True):
                    key, record = unpacked(k.as_py(), np.int64), unpacked(r.as_py(), np.int32).astype(np.int64)
                    n_keys, n = record[0], record[1]
                    at = np.repeat(np.searchsorted(pair, key), record[2 : 2 + n_keys])
                    doc, times = record[2 + n_keys : 2 + n_keys + n], record[2 + n_keys + n :]
                    np.add.at(n_best, doc, times * top[at])
                    np.add.at(count_sum, doc, times * count[at])
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(n_best), pa.array(count_sum), rows.column(5)], names=[*rows.schema.names[:5], "n_best", "count_sum", "groups_sha256"])

    return flushes.select("docs", "keys", "records").mapInArrow(contributions, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
