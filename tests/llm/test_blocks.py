import random
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import blocks, crc


def test_blocks_hold_whole_rows_and_nulls_are_empty():
    b = pa.record_batch({"text": pa.array(["ab", None, "c" * 50, "", "d"])})
    parts = list(blocks.blocks(iter([b, b.slice(2, 2)]), "text", 10))
    assert [p.column("text").to_pylist() for p, _, _ in parts] == [["ab", None], ["c" * 50], ["", "d"], ["c" * 50], [""]]
    assert [bytes(buf) for _, buf, _ in parts][0] == b"ab"


def test_spans_do_not_cross_rows():
    buf, off = blocks.text_bytes(pa.array(["a b", "c", "", " dd"]))
    s, e, r = blocks.spans(buf, off, blocks.NOT_SPACE)
    assert [(bytes(buf[x:y]), k) for x, y, k in zip(s, e, r.tolist(), strict=True)] == [(b"a", 0), (b"b", 0), (b"c", 1), (b"dd", 3)]


def test_rolling_hashes_are_equal_just_for_equal_ranges():
    buf = np.frombuffer(b"abcabcxabd", np.uint8)
    h = blocks.Rolling(buf)
    a, b, c = h.ranges(np.array([0, 3, 7]), np.array([3, 6, 10]))
    assert a == b != c
    assert h.grams(3)[0] == h.grams(3)[3] == a


def test_crcs():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    start = np.array(sorted(random.Random(1).choices(range(4000), k=40)))
    end = start + rng.integers(0, 900, 40)
    assert crc.ReflectedCRC(0xEDB88320)(buf, start, end).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    digits = np.frombuffer(b"123456789", np.uint8)
    assert crc.crc32c()(digits, np.array([0]), np.array([9]))[0] == 0xE3069283
    assert crc.crc16()(digits, np.array([0]), np.array([9]))[0] == 0xFEE8
    assert crc.crc8([b"123456789"]) == [0xF4]


def twins(size):
    """Two words of that size whose hashes by sums modulo 2**64 would be equal."""
    a = "a"
    while len(a) < size:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_of_long_ranges_differ():
    for size in (1024, 2048):
        a, b = twins(size)
        buf, off = blocks.text_bytes(pa.array([a, b, a.upper()]))
        x, y, z = blocks.Rolling(buf).ranges(off[:-1], off[1:])
        assert len({int(x), int(y), int(z)}) == 3
        x, y, z = blocks.Rolling(buf, True).ranges(off[:-1], off[1:])
        assert x == z != y


def test_differing_ranges():
    a, b = np.frombuffer(b"abcabd", np.uint8), np.frombuffer(b"xabc", np.uint8)
    zero = np.zeros(4, np.int64)
    assert blocks.differing(a, np.array([0, 3, 3, 6]), b, zero + 1, np.array([3, 3, 2, 0])).tolist() == [False, True, False, False]
