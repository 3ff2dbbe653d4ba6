"""Token ids as length-delimited binary records.

A record file holds, for each document: uint64 length, uint32 masked CRC-32C of those 8 bytes, the data, uint32 masked
CRC-32C of the data (all little-endian). Data: one byte (2 or 4, the bytes of an id; 128 is added if there is no doc_id),
int64 doc_id, the ids. Beside it stands an offset index of 20 bytes a record (int64 doc_id, uint64 offset, uint32 data
bytes), so that a shuffled reader fetches any record without the others.

Files hold ascending runs of doc_id in file order (a range partitioning and a sort within each part). A task's files have
names of its attempt; the manifest, a row a file, names those of the attempts that count. Positions of a file's first id come
from a sum over the manifest, which has one row a file.

Defined results: null texts are empty documents of the end id alone; null doc_ids come first; documents with equal doc_ids
follow each other by text; empty tables give no files; other columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, files
from .blocks import blocks, gather_ranges
from .crc import crc32c
from .shared import collected, new_dir

END_ID = 1
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4")])
MANIFEST = "shard long, path string, index string, records long, tokens long, bytes long"
#: Bytes of a record besides its data; of data besides the ids.
FRAME, HEAD = 16, 9


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as the format stores it: rotated by 15 bits, a constant added."""
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frame(doc_ids: list[int | None], ids: np.ndarray, off: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(file bytes, record offsets, data sizes) of documents whose ids lie one after the other."""
    n = np.diff(off)
    size = n * width + HEAD
    at = np.concatenate([[0], np.cumsum(size + FRAME)])
    out, start = np.zeros(int(at[-1]), np.uint8), at[:-1]
    lengths = size.astype("<u8").view(np.uint8).reshape(-1, 8)
    eight = np.arange(8)
    out[start[:, None] + eight] = lengths
    crc = crc32c()
    check = lambda a, b: masked(crc(out, a, b)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start[:, None] + 8 + np.arange(4)] = check(start, start + 8)
    out[start + 12] = [width | 128 * (d is None) for d in doc_ids]
    out[start[:, None] + 13 + eight] = np.array([d or 0 for d in doc_ids], "<i8").view(np.uint8).reshape(-1, 8)
    out[gather_ranges(start + 12 + HEAD, n * width)] = ids.astype(f"<u{width}").view(np.uint8)
    out[(at[1:] - 4)[:, None] + np.arange(4)] = check(start + 12, at[1:] - 4)
    return out.tobytes(), start, size


def parse(raw: bytes, offset: np.ndarray, size: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records at those offsets. Wrong lengths or checksums raise."""
    buf = np.frombuffer(raw, np.uint8)
    offset, size = offset.astype(np.int64), size.astype(np.int64)
    crc = crc32c()
    four, eight = np.arange(4), np.arange(8)
    stored = lambda at: buf[at[:, None] + four].copy().view("<u4").ravel()
    if not (buf[offset[:, None] + eight].copy().view("<u8").ravel() == size).all():
        raise ValueError("a record's length differs from the index")
    if not ((masked(crc(buf, offset, offset + 8)) == stored(offset + 8)).all() and (masked(crc(buf, offset + 12, offset + 12 + size)) == stored(offset + 12 + size)).all()):
        raise ValueError("a record's checksum is wrong")
    for o, s in zip(offset.tolist(), size.tolist(), strict=True):
        kind = raw[o + 12]
        yield None if kind & 128 else int.from_bytes(raw[o + 13 : o + 21], "little", signed=True), np.frombuffer(raw, f"<u{kind & 127}", offset=o + 12 + HEAD, count=(s - HEAD) // (kind & 127))


def write(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenise with the library, append end_id to each document and write the record files. Returns the manifest."""
    folder = folder or new_dir(docs.sparkSession, "token-records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache, size = bpe.library(path)
        width = 2 if size <= 65536 else 4
        shard = TaskContext.get().partitionId()
        names = [files.new_file(folder, f"part-{shard:06d}", x) for x in (".records", ".index")]
        out = index = None
        records = tokens = written = 0
        for rows, buf, off in blocks(batches, "text", bpe.TEXT_BLOCK):
            if out is None:
                out, index = map(files.create, names)
            ids, at = bpe.encode_distinct(buf, off, encoder, cache)
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            doc_ids = rows.column("doc_id").to_pylist()
            raw, offset, size = frame(doc_ids, ids, at, width)
            entry = np.zeros(len(doc_ids), INDEX)
            entry["doc_id"], entry["offset"], entry["size"] = [d or 0 for d in doc_ids], offset + written, size
            out.write(raw)
            index.write(entry.tobytes())
            records, tokens, written = records + len(doc_ids), tokens + len(ids), written + len(raw)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [names[0]], "index": [names[1]], "records": [records], "tokens": [tokens], "bytes": [written]})

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return collected(ordered.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """Of every record of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    first = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                index, start = np.frombuffer(files.read(r["index"]), INDEX), r["first"]
                end = (index["offset"] + index["size"] + FRAME).astype(np.int64)
                lo = 0
                while lo < len(index):
                    begin = int(index["offset"][lo])
                    hi = max(lo + 1, int(np.searchsorted(end, begin + chunk)))
                    raw = files.read_at(r["path"], begin, int(end[hi - 1]) - begin)
                    rows = [(d, len(i), zlib.crc32(i.astype("<u4").tobytes())) for d, i in parse(raw, index["offset"][lo:hi].astype(np.int64) - begin, index["size"][lo:hi])]
                    n = np.array([x[1] for x in rows], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in rows], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([x[2] for x in rows], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start, lo = start + int(n.sum()), hi

    placed = manifest.withColumn("first", F.coalesce(first, F.lit(0)))
    spread = placed.select("path", "index", "first").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
