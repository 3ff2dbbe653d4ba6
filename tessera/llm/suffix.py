"""Exact removal of long repeats by a range-partitioned, sampled suffix array over bytes or words.

What follows speaks of bytes; with unit="word" a text is the sequence of its white-space-free words, each one token, and the
lengths count words: a passage then counts as repeated whatever white space stands between its words. A word's token is a
64-bit hash (a digest for long words); a run of 50 differing words would have to collide in every word that differs.

A string of `length` bytes that starts at two places makes the same choice in both of an anchor: the place of its smallest
hashed `GRAM`-byte gram, the leftmost of equals. So only the suffixes that begin at some string's anchor (about one in 180
bytes) are sorted, and of these only the ones whose gram occurs at two anchors or more.

Each such suffix is dealt, with the bytes on both sides that its strings reach, by its leading bytes: splitters are
quantiles of a bounded sample of leading bytes, and equal leading bytes fall between the same two splitters, so no two
suffixes that share a gram stand on different sides of a boundary: neighbours across boundaries differ within their leading
bytes and need no comparison beyond that. A bucket sorts its suffixes by multikey quicksort (eight bytes make a character;
runs of equals are sorted by the next), and, the same way, the reversed bytes to their left. In the two orders, suffixes
that agree on o bytes to the left and length - o to the right are neighbours; a string at offset o before the anchor starts
elsewhere just if another suffix of its group agrees so.

Equal texts are one text throughout; one that occurs twice and is long enough goes as a whole.

Defined results: null and empty texts keep nothing and lose nothing; repeated rows repeat their text; strings never cross
documents; other columns of the input, of whatever name, stay as they are in remove().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_SPACE, U64, Rolling, blocks, gather_ranges, give_back, mix, spans
from .shared import _NO_ID, HOT, forget, join_split, materialize

LENGTH = 400
#: Tokens of the grams that choose anchors, and bytes of a token.
GRAM = {"byte": 40, "word": 8}
SIZE = {"byte": 1, "word": 8}
_BYTE_RANKS = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)
#: Words of a passage that is a repeat.
PASSAGE = 50
#: Leading bytes that are sampled to choose splitters, and bytes of suffixes that a bucket should get.
SAMPLE, BUCKET_BYTES = 20_000, 8 << 20
#: Bytes of text that are scanned for anchors at once: several 64-bit values a byte are held.
SCAN_BYTES = 1 << 20


def tokens(buf: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of texts: their bytes, or a 64-bit value for each word."""
    if unit == "byte":
        return buf, off
    start, end, row = spans(buf, off, NOT_SPACE)
    return Rolling(buf).ranges(start, end), np.searchsorted(row, np.arange(len(off)))


def _ranks(units: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the n tokens from each place on, to choose anchors by: sums of twice the tokens come from two of half."""
    part = _BYTE_RANKS[units] if units.dtype == np.uint8 else (units ^ (units >> U64(32))).astype(np.uint32)
    size, width, at = len(units) - n + 1, 1, 0
    out = np.zeros(size, np.uint32)
    while width <= n:
        if n & width:
            out = out * np.uint32(0x9E3779B1) + part[at : at + size]
            at += width
        part = part[:-width] * np.uint32(0x85EBCA6B + 2 * width) + part[width:]
        width *= 2
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        out ^= out >> np.uint32(shift)
        out *= np.uint32(factor)
    return out ^ (out >> np.uint32(16))


def _names(units: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n tokens from each of the places on."""
    total = np.zeros(len(places), U64)
    for j in range(n):
        total = mix(total * U64(0xD6E8FEB86659FD93) + units[places + j].astype(U64) + U64(1))
    return total


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM["byte"]) -> tuple[np.ndarray, ...]:
    """(row, place in its text, gram hash, first 8 bytes, least and greatest offset of a string's start before it) of all anchors in texts' tokens."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(buf) < length:
        return none
    gram = min(gram, length)
    h = _ranks(buf, gram)
    ranked = h.astype(U64) << U64(32) | np.arange(len(h), dtype=U64)  # equals go by place
    width = length - gram + 1
    least = _sliding_least(ranked, width)
    size = np.diff(off)
    fits = np.flatnonzero(size >= length)
    starts = gather_ranges(off[fits], size[fits] - length + 1)
    row = np.repeat(fits, size[fits] - length + 1)
    if not len(starts):
        return none
    place = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(place)) - 1
    p = place[new]
    lead = np.zeros(len(p), U64)
    for j in range(8 if buf.dtype == np.uint8 else 0):
        lead = lead << U64(8) | buf[p + j].astype(U64)
    if buf.dtype != np.uint8:
        lead = buf[p]
    return row[new], p - off[row[new]], _names(buf, p, gram).view(np.int64), (lead ^ U64(1 << 63)).view(np.int64), p - starts[last], p - starts[new]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: prefix and suffix minima of blocks of that width meet in every window."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocked = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocked, axis=1).ravel()
    backward = np.minimum.accumulate(blocked[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def multikey_order(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows by group, then by their words: multikey quicksort with a word as a character.

    Rows that a character tells apart from all others are done; runs of equals go on to the next character.
    """
    order = np.argsort(group, kind="stable")
    label = group[order]
    at = _tied(np.arange(len(order)), label)
    label = label[at]
    for c in range(words.shape[1]):
        if not len(at):
            break
        w = words[order[at], c]
        by = np.lexsort((w, label))
        order[at] = order[at[by]]
        w, label = w[by], label[by]
        fresh = np.concatenate([[False], (w[1:] != w[:-1]) | (label[1:] != label[:-1])])
        label = np.cumsum(fresh)
        keep = _tied(np.arange(len(at)), label)
        at, label = at[keep], label[keep]
    return order


def _tied(at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Those of `at` whose label, in sorted labels, is not alone."""
    same = label[1:] == label[:-1]
    return at[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(at) else at


def _matrix(parts: list[bytes], width: int, backwards: bool) -> np.ndarray:
    """Rows of bytes, filled up with zeros behind."""
    sizes = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), width), np.uint8)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    col = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if backwards:
        col = np.repeat(sizes, sizes) - 1 - col
    out[np.repeat(np.arange(len(parts)), sizes), col] = raw
    return out


def _common(m: np.ndarray, order: np.ndarray, step: int = 4096) -> np.ndarray:
    """Of each neighbours in the order, the length of their common beginning."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for lo in range(0, len(out), step):
        rows = m[order[lo : lo + step + 1]]
        differ = rows[1:] != rows[:-1]
        out[lo : lo + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return out


def matched(group: np.ndarray, right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH, size: int = 1) -> list[tuple[int, int, int]]:
    """(suffix, first offset, last offset) of the strings of these suffixes that start at another suffix too.

    group: suffixes of one gram; right: the length - low bytes from the anchor on; left: the high bytes before it; a
    suffix's strings have the offsets low to high. Lengths count tokens, of `size` bytes each.
    """
    _, group, sizes = np.unique(group, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(sizes[group] > 1)
    if not len(keep):
        return []
    group, low, high = group[keep], low[keep], high[keep]
    width = (length * size + 7) // 8 * 8
    after, before = _matrix([right[i] for i in keep], width, False), _matrix([left[i] for i in keep], width, True)
    by_right, by_left = (multikey_order(np.ascontiguousarray(m).view(">u8"), group) for m in (after, before))
    same = group[by_right][1:] == group[by_right][:-1]
    lcp, lcs = np.where(same, _common(after, by_right) // size, -1), np.where(same, _common(before, by_left) // size, -1)
    out: list[tuple[int, int, int]] = []
    pair = np.flatnonzero(sizes[group[by_right[:-1]]] == 2)
    pair = pair[same[pair]]
    if len(pair):
        a, b = by_right[pair], by_right[pair + 1]
        first = np.maximum(length - lcp[pair], np.maximum(low[a], low[b]))
        last = np.minimum(lcs[pair], np.minimum(high[a], high[b]))
        for i in np.flatnonzero(first <= last).tolist():
            out += [(int(keep[a[i]]), int(first[i]), int(last[i])), (int(keep[b[i]]), int(first[i]), int(last[i]))]
    many = sizes[group] > 2
    if not many.any():
        return out
    right_rank, left_rank = np.argsort(by_right), np.argsort(by_left)
    members = np.flatnonzero(many)
    open_from = np.full(len(group), -1)
    for o in range(int(low[members].min()), int(high[members].max()) + 2):
        live = members[(low[members] <= o) & (o <= high[members])]
        hit = np.zeros(len(group), bool)
        if len(live) > 1:
            agree_right = np.concatenate([[0], np.cumsum(lcp < length - o)])[right_rank[live]]
            agree_left = np.concatenate([[0], np.cumsum(lcs < o)])[left_rank[live]]
            key = agree_right << 32 | agree_left
            by = np.argsort(key)
            equal = key[by][1:] == key[by][:-1]
            hit[live[by[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]]] = True
        for i in np.flatnonzero((open_from >= 0) & ~hit).tolist():
            out.append((int(keep[i]), int(open_from[i]), o - 1))
        open_from[(open_from >= 0) & ~hit] = -1
        open_from[(open_from < 0) & hit] = o
    return out


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text and a 128-bit key of the text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("key1"), F.xxhash64(F.lit(17), whole).alias("key2")
    )


_ANCHORS = "gram long, lead long, key1 long, key2 long, place int, low int, high int, doc_id long"
_CONTEXT = "bucket int, gram long, low int, high int, before binary, after binary, key1 array<long>, key2 array<long>, place array<int>"
_SPANS = "key1 long, key2 long, start int, stop int"


def _long_enough(keyed: DataFrame, length: int, unit: str) -> DataFrame:
    """Texts that may hold `length` tokens; words have a byte and a blank each."""
    return keyed.where(F.octet_length("text") >= (length if unit == "byte" else 2 * length - 1))


def _find_anchors(keyed: DataFrame, length: int, unit: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text", SCAN_BYTES):
            row, place, gram, lead, low, high = anchors(*tokens(buf, off, unit), length, GRAM[unit])
            of = lambda c: rows.column(c).take(pa.array(row))  # noqa: B023, E731
            small = lambda a: pa.array(a, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(lead, pa.int64()), of("key1"), of("key2"), small(place), small(low), small(high), of("doc_id")], [c.split()[0] for c in _ANCHORS.split(", ")])

    return _long_enough(keyed, length, unit).mapInArrow(run, _ANCHORS)


def _repeated(found: DataFrame) -> DataFrame:
    """The anchors, stored, whose gram occurs at two or more. Grams of more than one in HOT anchors are few: they are broadcast, and their anchors not shuffled."""
    most = max(1, found.count() // HOT)
    again = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated-grams")
    hot = F.broadcast(again.where(F.col("n") > most).select("gram"))
    rest = found.join(hot, "gram", "left_anti").join(again.where(F.col("n") <= most).select("gram").hint("merge"), "gram", "left_semi")
    out = materialize(found.join(hot, "gram", "left_semi").unionByName(rest), "repeated-anchors")
    forget(again, found)
    return out


def repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", unit: str = "byte") -> DataFrame:
    """(key1, key2, copies, spans) of the texts that lose something: spans holds the removed (start, stop) runs of tokens, or is null if all go."""
    spark, keyed, size = docs.sparkSession, _keyed(docs, text, doc_id), SIZE[unit]
    one = _find_anchors(keyed, length, unit).groupBy("gram", "key1", "key2", "place")
    found = materialize(one.agg(F.first("lead").alias("lead"), F.first("low").alias("low"), F.first("high").alias("high"), F.min("doc_id").alias("doc_id")), "anchors")
    suffixes = _repeated(found)
    total = suffixes.count()
    part = suffixes.select("lead").sample(min(1.0, SAMPLE / max(1, total)), seed=7)
    leads = np.sort(np.array([r.lead for r in part.limit(2 * SAMPLE).collect()], np.int64))
    n_buckets = max(1, total * 3 * length * size // 2 // BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = np.unique(leads[np.linspace(0, len(leads) - 1, n_buckets + 1).astype(int)[1:-1]]) if len(leads) else leads

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text"):
            found: dict[tuple, tuple[list, list, list]] = {}  # suffixes that look alike are one, with all their places
            units, at_unit = tokens(buf, off, unit)
            for i, places in enumerate(rows.column("places").to_pylist()):
                whole = units[at_unit[i] : at_unit[i + 1]].tobytes()
                key1, key2 = rows.column("key1")[i].as_py(), rows.column("key2")[i].as_py()
                for p in places:
                    at, low, high = p["place"], p["low"], p["high"]
                    same = found.setdefault((p["lead"], p["gram"], low, high, whole[(at - high) * size : at * size], whole[at * size : (at + length - low) * size]), ([], [], []))
                    for to, v in zip(same, (key1, key2, at), strict=True):
                        to.append(v)
            lead, gram, low, high, before, after = zip(*found, strict=True) if found else [()] * 6
            members = [pa.array([m[k] for m in found.values()], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            bucket = np.searchsorted(splitters, np.array(lead, np.int64), "right")
            fixed = [pa.array(bucket, pa.int32()), pa.array(gram, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            yield pa.RecordBatch.from_arrays([*fixed, *members], [c.split()[0] for c in _CONTEXT.split(", ")])

    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        plain = lambda c: np.array(table.column(c), np.int64)
        names, low, high = plain("gram"), plain("low"), plain("high")
        before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
        first: dict[tuple, int] = {}
        same = np.array([first.setdefault(k, i) for i, k in enumerate(zip(names.tolist(), low.tolist(), high.tolist(), before, after, strict=True))], np.int64)
        members = np.array(pc.list_value_length(table.column("place")), np.int64)
        copies = np.bincount(same, weights=members, minlength=len(same))
        hits = [(i, int(low[i]), int(high[i])) for i in np.flatnonzero(copies > 1).tolist()]
        one = np.array(list(first.values()), np.int64)
        hits += [(int(one[i]), a, b) for i, a, b in matched(names[one], [after[i] for i in one], [before[i] for i in one], low[one], high[one], length, size)]
        alike = np.argsort(same, kind="stable")  # the lines of each first one
        begin = np.searchsorted(same[alike], np.arange(len(same) + 1))
        hit = np.array(hits, np.int64).reshape(-1, 3)
        count = (begin[1:] - begin[:-1])[hit[:, 0]]
        line, of_hit = alike[gather_ranges(begin[hit[:, 0]], count)], np.repeat(np.arange(len(hit)), count)
        ends = np.cumsum(members)
        at = pa.array(gather_ranges(ends[line] - members[line], members[line]))
        of_hit = np.repeat(of_hit, members[line])
        flat = lambda c: pc.list_flatten(table.column(c)).combine_chunks().take(at)
        place = np.array(flat("place"), np.int64)
        give_back()
        return pa.table({"key1": flat("key1"), "key2": flat("key2"), "start": pa.array(place - hit[of_hit, 2], pa.int32()), "stop": pa.array(place - hit[of_hit, 1] + length, pa.int32())})

    of_text = suffixes.groupBy("key1", "key2", "doc_id").agg(F.collect_list(F.struct("gram", "lead", "place", "low", "high")).alias("places"))
    contexts = _long_enough(keyed, length, unit).join(of_text, ["key1", "key2", "doc_id"]).select("text", "key1", "key2", "places").mapInArrow(cut, _CONTEXT)
    runs = contexts.groupBy("bucket").applyInArrow(sort, _SPANS)
    spans = runs.groupBy("key1", "key2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    copies = _long_enough(keyed, length, unit).groupBy("key1", "key2").agg(F.count("*").alias("copies")).where("copies > 1")
    out = materialize(spans.join(copies, ["key1", "key2"], "full").select("key1", "key2", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("copies").isNull(), F.col("spans")).alias("spans")), "repeats")
    forget(suffixes)
    return out


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted (start, stop) spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def _kept(raw: bytes, copies: int | None, runs: list[dict] | None, length: int, unit: str) -> tuple[bytes, list[tuple[int, int]]]:
    """(the bytes that stay, the byte runs that go)."""
    if copies is None:
        return raw, []
    if unit == "word":
        buf = np.frombuffer(raw, np.uint8)
        start, end, _ = spans(buf, np.array([0, len(buf)]), NOT_SPACE)
        if copies > 1:
            gone = [(0, len(raw))] if len(start) >= length else []
        else:
            gone = [(int(start[a]), int(end[b - 1])) for a, b in merge(runs)]
    else:
        gone = merge(runs) if copies == 1 else [(0, len(raw))]
    at, parts = 0, []
    for a, b in gone:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]), gone


def _matched_texts(held: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """held (rows of docs with key1 and key2) with their copies and spans; rows of a text that very many rows have are not shuffled."""
    return join_split(held, found, ["key1", "key2"], "copies", docs.count(), "left")


def digest(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of every document.

    The first four tell of repeated strings of `length` bytes; text is what stays without repeated passages of `passage`
    words, which a number of bytes can't tell from shorter ones.
    """
    by_bytes, by_words = (repeats(docs, n, text, doc_id, unit).select("key1", "key2", F.col("copies").alias(f"{unit}_copies"), F.col("spans").alias(f"{unit}_spans")) for n, unit in ((length, "byte"), (passage, "word")))
    columns = ["byte_copies", "byte_spans", "word_copies", "word_spans"]
    both = by_bytes.join(by_words, ["key1", "key2"], "full")
    found = materialize(both.select("key1", "key2", F.greatest("byte_copies", "word_copies").alias("copies"), *columns), "repeats")
    keyed = _keyed(docs, text, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text"):
            out = []
            for i, (copies, runs, more, passages) in enumerate(zip(*[rows.column(c).to_pylist() for c in columns], strict=True)):
                raw = buf[off[i] : off[i + 1]].tobytes()
                (kept, gone), (prose, _) = _kept(raw, copies, runs, length, "byte"), _kept(raw, more, passages, passage, "word")
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), prose.decode()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *map(pa.array, cols[3:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = _matched_texts(keyed, docs, found).select("doc_id", "text", *columns)
    rows = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", unit: str = "byte") -> DataFrame:
    """docs, all columns, with the repeats cut out of the texts. A character of which a byte goes, goes as a whole. Texts that lose nothing, nulls too, stay as they are."""
    found = repeats(docs, length, text, doc_id, unit)

    @F.pandas_udf("string")
    def cut(texts, copies, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, c, s in zip(texts, copies, spans, strict=True):
            lost = not pd.isna(c)
            out.append(_kept(t.encode(), int(c), None if s is None else list(s), length, unit)[0].decode("utf-8", "ignore") if lost else t)
        return pd.Series(out, dtype=object)

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64(whole).alias("key1"), F.xxhash64(F.lit(17), whole).alias("key2"))
    joined = _matched_texts(held, docs, found)
    new = F.when(F.col("copies").isNull(), F.col("_row")[text]).otherwise(cut(F.col("_row")[text], F.col("copies"), F.col("spans")))
    return joined.select(*[(new if c == text else F.col("_row")[c]).alias(c) for c in names])
