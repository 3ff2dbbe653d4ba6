"""Byte-level helpers on Arrow text columns: blocks of bounded size, word spans and 64-bit hashes, all in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one block holds (a longer document is a block of its own). Bounds the temporaries of a task.
BLOCK_BYTES = 2 << 20
#: Rows of a block at most, so that 16 bits number them.
MOST_ROWS = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, U64)
        a[0] = 1
        _powers[base] = have = np.multiply.accumulate(a)
    return have[:n]


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
    if lower:
        v[65:91] = v[97:123]
    return v


PLAIN, FOLDED = byte_values(False), byte_values(True)
#: Each byte, A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Ranges of so many bytes are hashed by a digest: sums modulo a power of two are equal for some pairs of longer ones, whatever the base.
DIGESTED = 256


class Rolling:
    """Hashes of any ranges of one byte buffer; with lower, A-Z count as a-z. Equal bytes have equal hashes; whoever takes equal hashes for equal bytes must compare them."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        self.buf, self.lower = buf, lower
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((FOLDED if lower else PLAIN)[buf] * powers(_BASE, len(buf)), out=self.sums[1:])
        self.inv = powers(_BASE_INV, len(buf) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U64))
        for i in np.flatnonzero(end - start >= DIGESTED).tolist():
            raw = self.buf[start[i] : end[i]]
            out[i] = int.from_bytes(hashlib.blake2b(LOWER[raw] if self.lower else raw, digest_size=8).digest(), "little")
        return out

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes from each position on."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[: len(self.sums) - k] + U64(k))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n, big = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def give_back() -> None:
    """Return freed memory to the system: idle workers stay alive between tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows whose texts have about `size` bytes together. Whole texts, never parts."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
            lo = 0
            while lo < batch.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1), lo + MOST_ROWS)
                yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                lo = hi
    finally:
        give_back()


def spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of word bytes; no run crosses a row's end."""
    m = is_word[buf]
    first, last = m.copy(), m
    first[1:] &= ~m[:-1]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = m[edge]
    last = m.copy()
    last[:-1] &= ~m[1:]
    last[edge - 1] = m[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with A-Z seen as a-z
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def gather_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, .. (count[0] of them), start[1], .."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - start, count)


def differing(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Of each pair of ranges of `size` bytes, one of a and one of b, whether their bytes differ. About `step` bytes are compared at once."""
    out = np.zeros(len(size), bool)
    some = np.flatnonzero(size)
    ends = np.cumsum(size[some])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        at, n = some[lo:hi], size[some[lo:hi]]
        out[at] = np.logical_or.reduceat(a[gather_ranges(a_start[at], n)] != b[gather_ranges(b_start[at], n)], np.cumsum(n) - n)
        lo = hi
    return out


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
