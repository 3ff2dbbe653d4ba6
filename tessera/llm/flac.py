"""Media columns: lossless FLAC of 8-bit samples, written and read by this module alone.

A stream is `fLaC`, a STREAMINFO block, a SEEKTABLE block and frames of 576 samples (mono, 8 bits). Each frame's subframe is
the smallest of: constant, verbatim, fixed predictors of order 0 to 4 and linear predictors of order 1 to `lpc` with
quantised coefficients, the residual in one Rice partition. Frames of all documents of a block are worked on side by side,
in numpy: the Rice decoder takes one residual of each frame at a step. Header CRC-8, frame CRC-16 and the MD5 of all samples
are checked on reading; any mismatch raises. write_pcm() stores the decoded samples in the shared folder, with an index of
sample offsets by which any range is read without the rest.

Defined results: null and empty texts are one padded block of 255; texts are whole, however long; repeated rows stay and
equal texts give equal values; other columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .blocks import blocks, gather_ranges
from .crc import crc8, crc16
from .shared import collected, new_dir

#: Samples in a frame; payloads are filled up to a positive multiple with 255.
BLOCK = 576
RATE = 8000
#: Bits of a quantised linear predictor coefficient, with its sign.
PRECISION = 12
#: Frames from one seek point to the next.
SEEK = 4
#: Frames in one run of the encoder or decoder; bounds its memory.
LANES = 4096
BITS = 8
#: Samples of a zstd frame of the PCM files: a multiple of BLOCK.
CHUNK = 448 * BLOCK
PCM_INDEX = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("samples", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("first_sample", pa.int64()), ("count", pa.int64()),
     ("at", pa.int64()), ("frame", pa.int64()), ("packed", pa.int64()), ("size", pa.int64())]
)
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _frame_number(n: int) -> bytes:
    """The extended UTF-8 form of up to 31 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def _read_number(raw: bytes, at: int) -> tuple[int, int]:
    """(number, bytes it takes)."""
    n = raw[at]
    if n < 0x80:
        return n, 1
    size = 8 - (n ^ 0xFF).bit_length()
    value = n & (0x7F >> size)
    for b in raw[at + 1 : at + size]:
        value = value << 6 | b & 0x3F
    return value, size


def _header(n: int) -> bytes:
    """Sync code with fixed block size, 576 samples, rate from STREAMINFO, one channel, 8 bits, frame number, CRC-8."""
    raw = bytes([0xFF, 0xF8, 0x20, 0x02]) + _frame_number(n)
    return raw + bytes(crc8([raw]))


_headers: list[bytes] = []


def headers(n: int) -> list[bytes]:
    while len(_headers) < n:
        _headers.append(_header(len(_headers)))
    return _headers


def _residuals(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    """What predictors leave of each row from sample `order` on; coefficients[:, j] weighs the sample j + 1 before."""
    n = x.shape[1]
    total = np.zeros((len(x), n - order), np.int32)
    for j in range(order):
        total += coefficients[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
    return x[:, order:] - (total >> shift[:, None])


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded residuals, best parameter, bits) of each row."""
    folded = (residual << 1) ^ (residual >> 31)
    mean = folded.mean(axis=1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int32)
    best, least = guess, None
    for k in (guess, np.minimum(guess + 1, 14)):
        bits = (folded >> k[:, None]).sum(axis=1, dtype=np.int64) + (1 + k.astype(np.int64)) * folded.shape[1]
        if least is None:
            best, least = k, bits
        else:
            best, least = np.where(bits < least, k, best), np.minimum(bits, least)
    return folded, best, least


def _linear(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each row by Levinson-Durbin on the windowed autocorrelation: (coefficients, shift)."""
    n = x.shape[1]
    w = x * np.hanning(n + 2)[1:-1]
    auto = np.stack([np.einsum("ij,ij->i", w[:, : n - k], w[:, k:]) for k in range(order + 1)], 1)
    error = np.maximum(auto[:, 0] * (1 + 1e-9), 1e-9)
    a = np.zeros((len(x), order))
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(largest)).astype(np.int32), 0, 15)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int | np.ndarray) -> None:
    """Write the lowest `width` bits of each value, highest first, from bit `at` on."""
    width = np.broadcast_to(np.asarray(width), at.shape)
    for j in range(int(width.max(initial=0))):
        on = (value >> np.maximum(width - 1 - j, 0)) & 1 & (width > j)
        hit = np.flatnonzero(on)
        bits[at[hit] + j] = 1


def _subframes(x: np.ndarray, lpc: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of bits) of each row's subframe; x: int32 samples."""
    rows, n = x.shape
    constant = (x == x[:, :1]).all(axis=1)
    size = np.full(rows, 8 + BITS * n, np.int64)  # verbatim
    kind = np.full(rows, -1)
    tries: list[tuple[int, bool, np.ndarray, np.ndarray]] = []
    for order in range(5):
        tries.append((order, False, np.tile(np.array(_FIXED[order], np.int32), (rows, 1)), np.zeros(rows, np.int32)))
    for order in range(1, lpc + 1):
        tries.append((order, True, *_linear(x, order)))
    found = []
    for t, (order, linear, c, shift) in enumerate(tries):
        folded, k, bits = _rice(_residuals(x, c, shift, order))
        bits = bits + 8 + BITS * order + 10 + linear * (9 + PRECISION * order)
        better = bits < size
        kind[better], size[better] = t, bits[better]
        found.append((folded, k))
    kind[constant], size[constant] = -2, 8 + BITS
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for t in np.unique(kind):
        mine = np.flatnonzero(kind == t)
        at, s = start[mine], x[mine]
        if t == -2:
            _put(out, at + 8, s[:, 0] & 255, BITS)
            continue
        if t == -1:
            _put(out, at, np.full(len(mine), 0b00000010), 8)
            _put(out, (at[:, None] + 8 + BITS * np.arange(n)).ravel(), (s & 255).ravel(), BITS)
            continue
        order, linear, c, shift = tries[t]
        folded, k = found[t][0][mine], found[t][1][mine]
        _put(out, at, np.full(len(mine), (0b100000 | order - 1 if linear else 0b001000 | order) << 1), 8)
        at = at + 8
        for j in range(order):
            _put(out, at + BITS * j, s[:, j] & 255, BITS)
        at = at + BITS * order
        if linear:
            _put(out, at, np.full(len(mine), PRECISION - 1), 4)
            _put(out, at + 4, shift[mine], 5)
            for j in range(order):
                _put(out, at + 9 + PRECISION * j, c[mine, j] & ((1 << PRECISION) - 1), PRECISION)
            at = at + 9 + PRECISION * order
        _put(out, at + 6, k, 4)  # before it: coding method 0, partition order 0
        quotient = folded >> k[:, None]
        length = quotient + 1 + k[:, None]
        end = at[:, None] + 10 + np.cumsum(length, axis=1)
        wide = np.broadcast_to(k[:, None] + 1, folded.shape)
        _put(out, (end - wide).ravel(), ((folded & ((1 << k) - 1)[:, None]) | (1 << k)[:, None]).ravel(), wide.ravel())
    return out, size


def _frames(samples: np.ndarray, numbers: np.ndarray, lpc: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of whole frames, one a row of samples."""
    bits, size = _subframes(samples, lpc)
    body = (size + 7) // 8
    padded = np.zeros(int(body.sum()) * 8, np.uint8)
    padded[gather_ranges((np.cumsum(body) - body) * 8, size)] = bits
    body_bytes = np.packbits(padded)
    head = headers(int(numbers.max()) + 1)
    mine = [head[i] for i in numbers.tolist()]
    head_size = np.array([len(h) for h in mine], np.int64)
    total = head_size + body + 2
    start = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    out[gather_ranges(start, head_size)] = np.frombuffer(b"".join(mine), np.uint8)
    out[gather_ranges(start + head_size, body)] = body_bytes
    check = crc16()(out, start, start + total - 2)
    out[start + total - 2], out[start + total - 1] = check >> 8, check & 255
    return out, total


def encode(payloads: list[np.ndarray], lpc: int = 2) -> list[bytes]:
    """FLAC streams of byte arrays, each a positive multiple of BLOCK long."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.concatenate(payloads).astype(np.int32) - 128).reshape(-1, BLOCK)
    numbers = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    done = [_frames(samples[i : i + LANES], numbers[i : i + LANES], lpc) for i in range(0, len(samples), LANES)]
    raw, sizes = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, first = [], 0
    for p, n in zip(payloads, counts.tolist(), strict=True):
        size = sizes[first : first + n]
        at = ends[first : first + n] - ends[first]
        low, high = int(size.min()), int(size.max())
        info = BLOCK.to_bytes(2, "big") * 2 + low.to_bytes(3, "big") + high.to_bytes(3, "big") + (RATE << 44 | (BITS - 1) << 36 | n * BLOCK).to_bytes(8, "big")
        info += hashlib.md5((p ^ 128).tobytes()).digest()
        points = b"".join((f * BLOCK).to_bytes(8, "big") + int(at[f]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for f in range(0, n, SEEK))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + raw[ends[first] : ends[first + n]].tobytes())
        first += n
    return out


class Stream:
    """The metadata of one FLAC stream of this form."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.raw, at, last, self.points = raw, 4, False, []
        while not last:
            last, kind, size = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            block = raw[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block, self.samples, self.md5 = int.from_bytes(block[:2], "big"), packed & ((1 << 36) - 1), block[18:34]
                if (packed >> 36 & 31) + 1 != BITS or packed >> 41 & 7 or self.block != BLOCK or block[:2] != block[2:4]:
                    raise ValueError("only one channel of 8-bit samples in blocks of 576 is read here")
            elif kind == 3:
                self.points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
            at += 4 + size
        self.audio = at


def _peek(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 32 bits from bit `at` on, for each lane; words[i] holds bytes i to i + 4."""
    return ((words[at >> 3] << (at & 7)) >> 8) & 0xFFFFFFFF


def _windows(raw: np.ndarray) -> np.ndarray:
    b = np.zeros(len(raw) + 48, np.int64)
    b[: len(raw)] = raw
    return b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]


def _rows(words: np.ndarray, n: int, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode a subframe of n samples at each bit position, side by side; words: see _peek. Returns (samples, bit after each)."""
    kind = _peek(words, position) >> 24
    if (kind & 0x81).any():
        raise ValueError("wasted bits or a broken subframe")
    kind = kind >> 1
    out = np.zeros((n, len(position)), np.int32)
    signed = lambda v, bits: v - ((v >> (bits - 1)) << bits)
    at = position + 8
    same = np.flatnonzero(kind == 0)
    out[:, same] = signed(_peek(words, at[same]) >> 24, BITS)
    at[same] += BITS
    plain = np.flatnonzero(kind == 1)
    for i in range(n if len(plain) else 0):
        out[i, plain] = signed(_peek(words, at[plain]) >> 24, BITS)
        at[plain] += BITS
    fixed, linear = (kind >> 3) == 1, (kind >> 5) == 1
    if (~fixed & ~linear & (kind > 1)).any() or (fixed & ((kind & 7) > 4)).any():
        raise ValueError("a reserved kind of subframe")
    mine = np.flatnonzero(fixed | linear)
    if not len(mine):
        return np.ascontiguousarray(out.T), at
    p, fixed, linear = at[mine], fixed[mine], linear[mine]
    order = np.where(fixed, kind[mine] & 7, (kind[mine] & 31) + 1)
    deepest = int(order.max())
    x, weights, shift = np.zeros((n, len(mine)), np.int64), np.zeros((deepest, len(mine)), np.int64), np.zeros(len(mine), np.int64)
    for i in range(deepest):  # the samples that come as they are
        some = np.flatnonzero(order > i)
        x[i, some] = signed(_peek(words, p[some]) >> 24, BITS)
        p[some] += BITS
    for o in range(1, min(deepest, 4) + 1):
        weights[:o, fixed & (order == o)] = np.array(_FIXED[o])[:, None]
    some = np.flatnonzero(linear)
    head = _peek(words, p[some])
    precision, shift[some] = (head >> 28) + 1, (head >> 23) & 31
    p[some] += 9
    for j in range(deepest if len(some) else 0):
        on = order[some] > j
        weights[j, some[on]] = signed(_peek(words, p[some[on]]) >> (32 - precision[on]), precision[on])
        p[some[on]] += precision[on]
    head = _peek(words, p)
    if (head >> 30).any() or (head >> 26 & 15).any():
        raise ValueError("only Rice coding in one partition is read here")
    k = (head >> 22) & 15
    p = p + 10
    for i in range(n):
        some = slice(None) if i >= deepest else np.flatnonzero(order <= i)
        q, r = p[some], k[some]
        bits = _peek(words, q)
        zeros = 32 - np.frexp(bits)[1].astype(np.int64)
        if not bits.all():  # a quotient of 32 or more
            long = np.flatnonzero(bits == 0)
            for lane in long.tolist():
                start = int(q[lane])
                while not int(_peek(words, np.array([q[lane]]))[0]):
                    q[lane] += 32
                    if q[lane] - start > 1 << 20:
                        raise ValueError("a run of zeros has no end")
                zeros[lane] = 32 - int(_peek(words, np.array([q[lane]]))[0]).bit_length() + int(q[lane]) - start
                q[lane] = start
        q = q + zeros + 1
        value = zeros << r | _peek(words, q) >> (32 - r)
        x[i, some] = (value >> 1) ^ -(value & 1)
        p[some] = q + r
    for i in range(1, n if deepest else 0):
        total = weights[0] * x[i - 1]
        for j in range(1, min(deepest, i)):
            total += weights[j] * x[i - 1 - j]
        x[i] += np.where(order <= i, total >> shift, 0)
    out[:, mine], at[mine] = x, p
    return np.ascontiguousarray(out.T), at


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The payloads of whole streams, all checks made. Frames of all streams that begin at known places go side by side.

    A frame's end is known only when it is decoded, so the lanes are the stretches between seek points: each step decodes
    the next frame of every stretch.
    """
    metas = [Stream(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    raw = np.frombuffer(b"".join(streams), np.uint8)
    out = [np.zeros(m.samples, np.uint8) for m in metas]
    lane_stream, lane_byte, lane_frame, lane_left = [], [], [], []
    for s, m in enumerate(metas):
        frames = m.samples // m.block
        points = m.points or [(0, 0)]
        for i, (sample, offset) in enumerate(points):
            first = sample // m.block
            last = points[i + 1][0] // m.block if i + 1 < len(points) else frames
            lane_stream.append(s)
            lane_byte.append(int(base[s]) + m.audio + offset)
            lane_frame.append(first)
            lane_left.append(last - first)
    stream, byte, frame, left = (np.array(v, np.int64) for v in (lane_stream, lane_byte, lane_frame, lane_left))
    by = np.argsort(-left, kind="stable")
    stream, byte, frame, left = stream[by], byte[by], frame[by], left[by]
    text, words = raw.tobytes(), _windows(raw)
    step = 0
    while True:
        live = int(np.searchsorted(-left, -step, "left"))
        if not live:
            break
        for lo in range(0, live, LANES):
            lanes = np.arange(lo, min(lo + LANES, live))
            start = byte[lanes]
            head = np.zeros(len(lanes), np.int64)
            for i, b in enumerate(start.tolist()):
                number, size = _read_number(text, b + 4)
                head[i] = 4 + size + 1
                if number != frame[lanes[i]] + step or text[b : b + int(head[i])] != headers(number + 1)[number]:
                    raise ValueError("a frame's header is wrong")
            x, end = _rows(words, BLOCK, (start + head) * 8)
            tail = (end + 7) // 8
            if not (crc16()(raw, start, tail) == (raw[tail].astype(np.uint16) << 8 | raw[tail + 1])).all():
                raise ValueError("a frame's CRC-16 is wrong")
            byte[lanes] = tail + 2
            values = (x + 128).astype(np.uint8)
            for i, lane in enumerate(lanes.tolist()):
                s = int(stream[lane])
                f = int(frame[lane]) + step
                out[s][f * metas[s].block : (f + 1) * metas[s].block] = values[i]
        step += 1
    for m, p in zip(metas, out, strict=True):
        if hashlib.md5((p ^ 128).tobytes()).digest() != m.md5:
            raise ValueError("the samples differ from the stream's MD5")
    return out


def decode_range(stream: bytes, start: int, count: int) -> np.ndarray:
    """Samples start to start + count (as bytes), decoded from the nearest seek point before them on."""
    meta = Stream(stream)
    stop = min(start + count, meta.samples)
    if start >= stop:
        return np.zeros(0, np.uint8)
    sample, offset = max((p for p in meta.points or [(0, 0)] if p[0] <= start), default=(0, 0))
    raw, at, parts = np.frombuffer(stream, np.uint8), meta.audio + offset, []
    words = _windows(raw)
    first = sample
    while sample < stop:
        _, size = _read_number(stream, at + 4)
        x, end = _rows(words, BLOCK, np.array([(at + 4 + size + 1) * 8]))
        tail = (int(end[0]) + 7) // 8
        if crc16()(raw, np.array([at]), np.array([tail]))[0] != int.from_bytes(stream[tail : tail + 2], "big"):
            raise ValueError("a frame's CRC-16 is wrong")
        parts.append((x[0] + 128).astype(np.uint8))
        at, sample = tail + 2, sample + meta.block
    return np.concatenate(parts)[start - first : stop - first]


def padded(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        p = np.full(max(1, -(-(b - a) // BLOCK)) * BLOCK, 255, np.uint8)
        p[: b - a] = buf[a:b]
        out.append(p)
    return out


def features(p: np.ndarray) -> str:
    """Mean, deviation, share of steps that cross the middle, and the share of each quarter of the range, to 6 digits."""
    x = p.astype(np.int64) - 128
    n = len(x)
    mean = int(x.sum()) / n
    deviation = (int((x * x).sum()) / n - mean * mean) ** 0.5
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) / n
    quarters = np.bincount(p >> 6, minlength=4) / n
    return ",".join(f"{v:.6f}" for v in (mean, deviation, crossings, *quarters.tolist()))


def store(docs: DataFrame, lpc: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: the FLAC stream of each whole text's padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text"):
            media = encode(padded(buf, off), lpc)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    """(rows, streams, payloads) of store()'s rows."""
    for rows, _, _ in blocks(batches, "media"):
        media = rows.column("media").to_pylist()
        yield rows, media, decode(media)


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """store()'s rows, read back as unsigned 8-bit PCM: doc_id, media_sha256, first_sample and pcm, a row a frame of BLOCK samples.

    first_sample is the block's place in its stream, so samples a to b are those of the rows from a // BLOCK * BLOCK to b.
    media_sha256 tells streams of one doc_id apart; repeated rows give their blocks each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, media, payloads in _decoded(batches):
            n = np.array([len(p) // BLOCK for p in payloads], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            first = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
            pcm = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BLOCK), len(row), [None, pa.py_buffer(np.concatenate(payloads))]).cast(pa.binary())
            sha = pa.array([hashlib.sha256(m).hexdigest() for m in media])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), sha.take(pa.array(row)), pa.array(first, pa.int64()), pcm], ["doc_id", "media_sha256", "first_sample", "pcm"])

    return stored.mapInArrow(run, "doc_id long, media_sha256 string, first_sample long, pcm binary")


def write_pcm(stored: DataFrame, folder: str | None = None) -> DataFrame:
    """Decode store()'s rows and write their samples to files of the shared folder. Returns the manifest, a row a file: path and index.

    A file is a run of zstd frames, each of about CHUNK bytes of whole blocks of samples. The index beside it has a row for
    each stretch of a stream in a frame: where its first sample stands, in the stream, in the file and in the frame.
    """
    folder = folder or new_dir(stored.sparkSession, "pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, index = (files.new_file(folder, f"part-{shard:06d}", x) for x in (".pcm", ".index"))
        codec, out, rows, held, offset = pa.Codec("zstd"), None, [], bytearray(), 0

        def flush() -> None:
            nonlocal offset
            packed = codec.compress(bytes(held), asbytes=True)
            for r in rows:
                if r["frame"] is None:
                    r.update(frame=offset, packed=len(packed), size=len(held))
            out.write(packed)
            offset += len(packed)
            held.clear()

        for batch, media, payloads in _decoded(batches):
            if out is None and batch.num_rows:
                out = files.create(path)
            for i, (m, p) in enumerate(zip(media, payloads, strict=True)):
                about = {"doc_id": batch.column("doc_id")[i].as_py(), "n_bytes": batch.column("n_bytes")[i].as_py(), "samples": len(p), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}
                for first in range(0, len(p), CHUNK):
                    part = p[first : first + CHUNK]
                    if held and len(held) + len(part) > CHUNK:
                        flush()
                    rows.append(about | {"first_sample": first, "count": len(part), "at": len(held), "frame": None, "packed": None, "size": None})
                    held += part.tobytes()
        if out is not None:
            flush()
            out.close()
            with files.create(index) as f, pa.ipc.new_file(f, PCM_INDEX) as w:
                w.write_table(pa.Table.from_pylist(rows, PCM_INDEX))
            yield pa.RecordBatch.from_pydict({"path": [path], "index": [index]})

    return collected(stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "path string, index string"))


def _payloads(path: str, index: str) -> Iterator[tuple[dict, bytes]]:
    """(a stream's index row, its samples) of all streams of a file, a frame at a time."""
    codec, frame, raw, parts = pa.Codec("zstd"), None, b"", []
    for r in pa.ipc.open_file(files.read(index)).read_all().to_pylist():
        if r["frame"] != frame:
            frame, raw = r["frame"], codec.decompress(files.read_at(path, r["frame"], r["packed"]), r["size"], asbytes=True)
        parts.append(raw[r["at"] : r["at"] + r["count"]])
        if r["first_sample"] + r["count"] == r["samples"]:
            yield r, b"".join(parts)
            parts = []


def read_samples(path: str, index: str, doc_id: int | None, start: int, stop: int) -> bytes:
    """Samples start to stop of a document, by the index alone: only the frames that hold them are read."""
    codec, out = pa.Codec("zstd"), []
    for r in pa.ipc.open_file(files.read(index)).read_all().to_pylist():
        lo, hi = max(start, r["first_sample"]), min(stop, r["first_sample"] + r["count"])
        if r["doc_id"] == doc_id and lo < hi:
            raw = codec.decompress(files.read_at(path, r["frame"], r["packed"]), r["size"], asbytes=True)
            out.append(raw[r["at"] + lo - r["first_sample"] : r["at"] + hi - r["first_sample"]])
    return b"".join(out)


def describe(stored: DataFrame) -> DataFrame:
    """store()'s rows, decoded, written as PCM and read back: sizes, digests and features."""
    manifest = write_pcm(stored)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                rows = []
                for r, p in _payloads(f["path"], f["index"]):
                    rows.append((r["doc_id"], r["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), r["media_bytes"], r["media_sha256"], features(np.frombuffer(p, np.uint8))))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = manifest.repartition(max(1, stored.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
