"""WARC archives: a writer, a normaliser of monolithic gzip files and an indexed reader.

Many tools gzip a whole archive as one stream, in which no record can be reached without inflating all before it. The
normaliser inflates such a file once, as a stream, and rewrites every record as a gzip member of its own, with a sidecar
index (tab-separated: offset, member bytes, type, page id, payload digest) by which a reader fetches single records.

Payloads of equal digest are stored once: the record of the largest page_id is the response, the others are revisits whose
HTTP header keeps the payload's length and whose WARC headers name the digest and the response's page.

Tasks write files with names of their attempt; manifests (a row a file) name those that count, so a lost
executor costs only its tasks' work. The response of each digest comes from an aggregation of (digest, page_id), with map-side
combining. Pages of a very common payload stay where they are and meet it by broadcast, so copies that hold a third of all
pages are no one task's work; the other pages are shuffled by digest, html included.

Defined results: a null html is an empty payload; rows without page_id lose to rows with one and equal page_ids with equal
payloads are all responses; null urls become an empty target URI; empty tables give no files; other columns of the input,
of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .shared import collected, join_split, materialize, new_dir

#: What WARC-Date says of every record; a parameter, as runs must not differ by their clock.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("5f0c7a4e-6d0e-5c1c-9a55-0d8f3e3a1b2c")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record with an HTTP response. A revisit's block ends with the HTTP header."""
    name = lambda p: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{p} {payload_digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """The header fields, names in lower case, of a record's or an HTTP message's head."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record bytes) of the records in a plain stream that arrives in chunks. No more than a record and a chunk is held."""
    held, chunks = bytearray(), iter(chunks)

    def more(size: int) -> bool:
        while len(held) < size:
            c = next(chunks, None)
            if c is None:
                return False
            held.extend(c)
        return True

    while more(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not more(looked + 1):
                raise ValueError("the archive ends inside a record's header")
        head = parse_head(bytes(held[:end]))
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        size = end + 4 + int(head["content-length"]) + 4
        if not more(size):
            raise ValueError("the archive ends inside a record")
        raw = bytes(held[:size])
        if raw[-4:] != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        del held[:size]
        yield head, raw


def inflate(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's content in chunks, be it one member or many."""
    z = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            out = z.decompress(data, 4 * chunk)
            if out:
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if rest := z.flush():
        yield rest


def write_monolithic(pages: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Write records (page_id, url, html, payload_digest, kind, refers_to) as one gzip stream a task. Returns the manifest: path, records."""
    folder = folder or new_dir(pages.sparkSession, "warc-monolithic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = files.new_file(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz"), None, 0
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                out = out or files.create(name)
                out.write(z.compress(record(r["kind"], r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["refers_to"])))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    wanted = pages.select("page_id", "url", "html", "payload_digest", "kind", "refers_to")
    return collected(wanted.mapInArrow(run, "path string, records long"))


def normalise(archives: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Rewrite each gzip archive (column path) with a member a record and a sidecar index. Returns the manifest: path, index, records."""
    folder = folder or new_dir(archives.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                stem = path.rpartition("/")[2].removesuffix(".warc.gz")
                name = files.new_file(folder, stem, ".warc.gz")
                index, at, n = [], 0, 0
                with files.stream(path) as source, files.create(name) as out:
                    for head, raw in records(inflate(source)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.append(f"{at}\t{len(member)}\t{head['warc-type']}\t{head['warc-page-id']}\t{head['warc-payload-digest']}\n")
                        at += len(member)
                        n += 1
                with files.create(name + ".idx") as side:
                    side.write("".join(index).encode())
                yield pa.RecordBatch.from_pydict({"path": [name], "index": [name + ".idx"], "records": [n]})

    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "path")
    return collected(spread.mapInArrow(run, "path string, index string, records long"))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame) -> DataFrame:
    """One row a record, each fetched by its index entry, inflated alone and verified: a response's payload has the digest and the length it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
                entries = [line.split("\t") for line in files.read(index).decode().splitlines()]
                at, place = files.store(path)
                out: dict[str, list] = {c.split()[0]: [] for c in READ.split(", ")}
                with at.open_input_file(place) as source:
                    for offset, size, *_ in entries:
                        source.seek(int(offset))
                        raw = zlib.decompress(source.read(int(size)), 31)
                        end = raw.index(b"\r\n\r\n")
                        head, block = parse_head(raw[:end]), raw[end + 4 : -4]
                        cut = block.index(b"\r\n\r\n")
                        length, named = int(parse_head(block[:cut])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(block) - cut - 4 != length or digest(block[cut + 4 :]) != named):
                            raise ValueError(f"the payload of page {head['warc-page-id']} differs from its header")
                        number = lambda k: int(head[k]) if head.get(k) else None  # noqa: B023, E731
                        for k, v in (("page_id", number("warc-page-id")), ("url", head["warc-target-uri"]), ("payload_bytes", length), ("payload_digest", named), ("record_type", head["warc-type"]), ("refers_to", number("warc-refers-to-page-id"))):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("page_id", "payload_bytes", "refers_to") else pa.string()) for k, v in out.items()], list(out))

    spread = archives.select("path", "index").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, READ)


def assign_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_digest, kind and refers_to. Payloads under min_bytes are always responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    with_key = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("key"))
    small = F.octet_length("html") < min_bytes
    shared = with_key.where(~small).groupBy("key").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).where("n > 1").select("key", "chosen", "n")
    revisit = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    return join_split(with_key, materialize(shared, "payloads"), ["key"], "n", pages.count(), "left").select(
        "page_id", "url", "html", _base32(F.hex("key")).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("chosen")).alias("refers_to")
    )


def _base32(hex_digits):
    """The base32 form of 40 hexadecimal digits: four letters of 5 bits for every five digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def dedup_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as monolithic archives, normalise these, and read the normalised archives back."""
    return read(normalise(write_monolithic(assign_roles(pages, min_bytes)))).drop("url")
