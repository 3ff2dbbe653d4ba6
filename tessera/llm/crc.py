"""Cyclic redundancy checks of many byte ranges at once."""

from __future__ import annotations

import numpy as np

#: Bytes that a lane works through before its check is joined to the range's.
CHUNK = 64


class ReflectedCRC:
    """A reflected CRC of 32 bits, init and final xor all ones. A step takes two bytes; lanes are chunks of all ranges."""

    def __init__(self, polynomial: int):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(polynomial), one >> 1)
        self.one = one
        low, high = np.arange(65536, dtype=np.uint32) & 255, np.arange(65536, dtype=np.uint32) >> 8
        first = one[low]
        self.two = (first >> 8) ^ one[(first & 255) ^ high]  # what 16 bits of state and data become after two bytes
        self.shifts = [self._tables(self._zero_bytes(1))]  # by 1, 2, 4, .. zero bytes
        for _ in range(40):
            t = self.shifts[-1]
            self.shifts.append(self._tables(self._apply(t, self._basis(t))))

    @staticmethod
    def _basis(tables: np.ndarray) -> np.ndarray:
        return np.array([tables[i // 8][1 << (i % 8)] for i in range(32)], np.uint32)

    def _zero_bytes(self, n: int) -> np.ndarray:
        x = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(n):
            x = (x >> 8) ^ self.one[x & 255]
        return x

    @staticmethod
    def _tables(basis: np.ndarray) -> np.ndarray:
        t = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                t[k] ^= np.where(np.arange(256) >> b & 1, basis[8 * k + b], np.uint32(0)).astype(np.uint32)
        return t

    @staticmethod
    def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The checks of buf[start:end], a uint32 each. Leading zeros don't change a check that begins at 0, so ranges are filled up in front."""
        size = (end - start).astype(np.int64)
        chunks = (size + CHUNK - 1) // CHUNK
        begin = np.cumsum(chunks) - chunks
        filled = np.zeros(int(chunks.sum()) * CHUNK, np.uint8)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        filled[at + np.repeat((begin + chunks) * CHUNK - size, size)] = buf[at + np.repeat(start, size)]
        words = np.ascontiguousarray(filled.view("<u2").reshape(-1, CHUNK // 2).T)
        state = np.zeros(words.shape[1], np.uint32)
        for w in words:
            state = (state >> 16) ^ self.two[(state & 0xFFFF) ^ w]
        out = np.zeros(len(size), np.uint32)
        by = np.argsort(-chunks, kind="stable")
        deepest = chunks[by]
        for k in range(int(deepest[0]) if len(by) else 0):  # ranges with more than k chunks, from their first on
            live = by[: np.searchsorted(-deepest, -k, "left")]
            out[live] = self._apply(self.shifts[CHUNK.bit_length() - 1], out[live]) ^ state[begin[live] + k]
        init = np.full(len(size), 0xFFFFFFFF, np.uint32)
        for k in range(int(size.max()).bit_length() if len(size) else 0):
            on = np.flatnonzero(size >> k & 1)
            init[on] = self._apply(self.shifts[k], init[on])
        return ~(out ^ init)


class PlainCRC16:
    """The CRC-16 of polynomial 0x8005, not reflected, from 0 on; lanes are whole ranges, from their ends aligned."""

    def __init__(self, polynomial: int = 0x8005):
        x = np.arange(256, dtype=np.uint32) << 8
        for _ in range(8):
            x = np.where(x & 0x8000, (x << 1) ^ polynomial, x << 1) & 0xFFFF
        self.one = x.astype(np.uint16)
        top, low = np.arange(65536, dtype=np.uint32) >> 8, np.arange(65536, dtype=np.uint32) & 255
        s = self.one[top]
        self.two = ((s << 8) ^ self.one[(s >> 8) ^ low]).astype(np.uint16)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        width = (int(size.max()) + 1) // 2 * 2 if len(size) else 0
        filled = np.zeros((len(size), width), np.uint8)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        filled.ravel()[at + np.repeat(np.arange(len(size)) * width + width - size, size)] = buf[at + np.repeat(start, size)]
        state = np.zeros(len(size), np.uint16)
        for w in np.ascontiguousarray(filled.view(">u2").T).astype(np.uint16):
            state = self.two[state ^ w]
        return state


def crc8(rows: list[bytes]) -> list[int]:
    """The CRC-8 of polynomial 7, from 0 on, of short byte strings."""
    return [_crc8(r) for r in rows]


_T8 = [0] * 256
for _i in range(256):
    _x = _i
    for _ in range(8):
        _x = (_x << 1 ^ 7 if _x & 128 else _x << 1) & 255
    _T8[_i] = _x


def _crc8(row: bytes) -> int:
    c = 0
    for b in row:
        c = _T8[c ^ b]
    return c


_c: dict[str, object] = {}


def crc32c() -> ReflectedCRC:
    if "32c" not in _c:
        _c["32c"] = ReflectedCRC(0x82F63B78)
    return _c["32c"]


def crc16() -> PlainCRC16:
    if "16" not in _c:
        _c["16"] = PlainCRC16()
    return _c["16"]
