"""Vectorised text helpers used inside Arrow map tasks.

Every function works on one slice of a batch: the UTF-8 bytes of its texts laid end to end
(`buf`) and the offset at which each text starts (`offs`, one more entry than texts). Words are
runs of bytes other than space and 0x09-0x0D; these separators are ASCII, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SLICE_BYTES = 1 << 20
SEED = 20240229
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_BASE, _RNG = U(0x9E3779B97F4A7C15), np.random.default_rng(SEED)
_BYTE = _RNG.integers(1, 2**63, 256).astype(U) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


_BASE_INV = U(_inverse(int(_BASE)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of the base and of its inverse, kept for slices of the usual size.
_KEPT: list[np.ndarray] = []


class Rolling:
    """Prefix sums of a polynomial over 64-bit symbols: the hash of any range in constant time.

    Long ranges of crafted symbols can collide modulo 2 ** 64, so these hashes only deal texts out and
    name short ranges of mixed symbols; `digests` decides on the equality of long strings.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if not _KEPT:
            _KEPT[:] = [_powers(b, SLICE_BYTES) for b in (_BASE, _BASE_INV)]
        power, inverse = _KEPT if n <= SLICE_BYTES else [_powers(b, n) for b in (_BASE, _BASE_INV)]
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(symbols * power[:n], out=self.prefix[1:])
        self.inverse = inverse[: n + 1]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, U)
        return mix((self.prefix[k:] - self.prefix[: n + 1 - k]) * self.inverse[: n + 1 - k] + U(k * 0xD6E8FEB86659FD93 % 2**64))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive runs of rows of some MB.

    A text is never cut; nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry than texts)."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~sep[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit XXH3 of each range of bytes."""
    view = memoryview(raw)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), U, len(starts))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)
#: Words of more bytes are hashed one by one.
_LONG = 24


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its length, then eight bytes at a time, mixed in turn; XXH3 for long words."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(size.astype(U) * _BASE + U(SEED))
    for k in range(0, _LONG, 8):
        live = np.flatnonzero(size > k) if k else slice(None)
        left = np.minimum(size[live] - k, 8)
        out[live] = mix((out[live] ^ (eight[starts[live] + k] & _LOW_BYTES[left])) * _BASE)
    long = np.flatnonzero(size > _LONG)
    if len(long):
        out[long] = digests(buf.tobytes(), starts[long], ends[long])
    return out
