"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: one row ("shard") holds, for a block of training documents, the posting lists
(term -> word positions) of all terms that occur in the benchmark. A first query sums the terms' corpus frequencies; the
second intersects, shard by shard, the offset-adjusted posting lists of each phrase, from its rarest term on. No row of a
document is ever shuffled, so a hot source or a passage in a third of all documents costs no more than its own postings.
decontaminate() returns exact phrases, proximity() words of a phrase that stand near each other.

Terms are found by hash and compared byte by byte. Benchmark items go in blocks of `query_bytes` of text, long ones in
pieces; only such a block (a stated query set of bounded size) is sent to the executors. With more than one block, the index is built for each block's terms and the hits are merged by document.

Defined results: null or word-less documents have 0 words and 0 hits and are not contaminated; items with null ids or
without words match nothing; rows repeated in either table count as they stand (equal item_ids once); other columns of the
input, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ALNUM, LOWER, Rolling, blocks, differing, gather_ranges, spans, text_bytes
from .shared import _NO_ID, map_materialize, row_key, without

WINDOW = 13
#: Bytes of benchmark text that are queried together.
QUERY_BYTES = 4 << 20
INDEX = "shard long, doc_ids array<long>, text_hashes array<long>, first array<long>, n_words array<long>, terms binary, counts binary, positions binary"
NEAR = "doc_id long, text_hash long, item_id long, first long, last long"
HITS = "shard long, doc_id long, text_hash long, n_words long, hits array<int>, items array<long>"


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of each word."""
    start, end, row = spans(buf, off, ALNUM)
    return start, end, row, Rolling(buf, True).ranges(start, end)


class Vocabulary:
    """Distinct words, numbered by their hash; words of one hash follow each other and are told apart by their bytes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray):
        raw = LOWER[buf].tobytes()
        found = sorted(set(zip(hashes.tolist(), (raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)), strict=True)))
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.raw, self.size = np.frombuffer(b"".join(w for _, w in found), np.uint8), np.array([len(w) for _, w in found], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))

    def __len__(self) -> int:
        return len(self.hashes)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1: equal hash and equal bytes."""
        out = np.full(len(start), -1)
        if not len(self):
            return out
        low, first, n = LOWER[buf], np.searchsorted(self.hashes, hashes), end - start
        for k in range(self.most):
            at = np.minimum(first + k, len(self) - 1)
            some = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == n) & (out < 0))
            same = some[~differing(low, start[some], self.raw, self.begin[at[some]], n[some])]
            out[same] = at[same]
        return out


class PhraseSet:
    """The distinct windows of one block of benchmark items, as term numbers padded with -1, and the items of each."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        buf, off = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        start, end, row, hashes = _terms(buf, off)
        self.vocabulary = Vocabulary(buf, start, end, hashes)
        term = self.vocabulary(buf, start, end, hashes)
        n_words = np.bincount(row, minlength=len(items)).astype(np.int64)
        begin, some = np.cumsum(n_words) - n_words, np.flatnonzero(n_words)
        count = np.maximum(1, n_words - window + 1)[some]
        first, of = gather_ranges(begin[some], count), np.repeat(some, count)
        length = np.minimum(window, n_words[of])
        column = np.arange(window)
        inside = column < length[:, None]
        windows = np.where(inside, np.append(term, -1)[np.where(inside, first[:, None] + column, len(term))], -1).astype(np.int32)
        self.windows, which = np.unique(windows, axis=0, return_inverse=True) if len(windows) else (windows, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([which.ravel(), np.array([i for i, _ in items], np.int64)[of]], 1), axis=0) if len(windows) else np.zeros((0, 2), np.int64)
        self.item_of, self.item_cut = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.lengths = (self.windows >= 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=window)) if len(self.windows) else 0

    def items(self, window: int) -> list[int]:
        return self.item_of[self.item_cut[window] : self.item_cut[window + 1]].tolist()


def build_index(docs: DataFrame, vocabulary: Vocabulary, min_run: int = 1, gap: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The positional index of the given terms, one row per block of documents.

    Positions count words, with `gap` empty places between documents. min_run: postings outside runs of so many
    neighbouring indexed terms are left out; a phrase of at least min_run terms cannot touch them.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for rows, buf, off in blocks(batches):
            start, end, row, hashes = _terms(buf, off)
            n_words = np.bincount(row, minlength=rows.num_rows)
            first = np.concatenate([[0], np.cumsum(n_words)[:-1]]) + np.arange(rows.num_rows) * gap
            place = np.arange(len(row)) + row * gap
            at = vocabulary(buf, start, end, hashes)
            keep = at >= 0
            if min_run > 1 and keep.any():
                p = place[keep]
                cut = np.flatnonzero(np.diff(p) != 1) + 1
                size = np.diff(np.concatenate([[0], cut, [len(p)]]))
                keep[np.flatnonzero(keep)[np.repeat(size, size) < min_run]] = False
            term, place = at[keep], place[keep]
            order = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": [shard], "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "text_hashes": pa.array([rows.column("text_hash").to_pylist()], pa.list_(pa.int64())),
                    "first": pa.array([first], pa.list_(pa.int64())), "n_words": pa.array([n_words], pa.list_(pa.int64())),
                    "terms": pa.array([terms.astype("<i4").tobytes()]), "counts": pa.array([counts.astype("<i4").tobytes()]), "positions": pa.array([place[order].astype("<u4").tobytes()]),
                }
            )
            shard += 1

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(text, doc_id)["_text"].alias("text_hash"))
    return map_materialize(keyed, build, INDEX, "positional-index")


def _postings(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("terms", "<i4"), ("counts", "<i4"), ("positions", "<u4")))


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Corpus frequency of each indexed term: shards' counts, summed. As many rows reach the driver as the vocabulary has terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                terms, counts, _ = _postings(b, i)
                total[terms] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms", "counts", "positions").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted


def exact_matches(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, windows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of the exact occurrences in one shard.

    windows: term numbers, padded with -1; order: each window's offsets from its rarest term on, the padding last.
    """
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(windows):
        return none, none
    have = np.zeros(int(max(windows.max(), terms.max())) + 2, bool)  # the last one stands for the padding
    have[terms] = have[-1] = True
    w = np.flatnonzero(have[windows].all(axis=1))
    slot = np.full(len(have), -1)
    slot[terms] = np.arange(len(terms))
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    keys = (np.repeat(terms.astype(np.int64), counts) << 32) | positions
    off = order[w, 0]
    s = slot[windows[w, off]]
    at = positions[gather_ranges(begin[s], counts[s])].astype(np.int64) - np.repeat(off, counts[s])
    w = np.repeat(w, counts[s])
    w, at = w[at >= 0], at[at >= 0]
    for k in range(1, windows.shape[1]):
        if not len(w):
            break
        off = order[w, k]
        ok = (k >= lengths[w]) | _find(keys, (windows[w, off].astype(np.int64) << 32) | (at + off))
        w, at = w[ok], at[ok]
    return w, at


def near_matches(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, wanted: list[int], frequency: np.ndarray, span: int) -> list[tuple[int, int]]:
    """(first, last) position of each occurrence of the term set `wanted`, in any order, within `span` places that holds no smaller one."""
    todo = sorted(set(wanted), key=lambda t: (frequency[t], t))
    if not todo or not _find(terms, np.array(todo)).all():
        return []
    end = np.cumsum(counts)
    lists = [positions[end[i] - counts[i] : end[i]].astype(np.int64) for i in np.searchsorted(terms, todo)]

    def close(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Those of x with one of `to` less than `span` away."""
        i = np.searchsorted(to, x - span + 1)
        return x[(i < len(to)) & (to[np.minimum(i, len(to) - 1)] < x + span)]

    rarest = lists[0]
    for x in lists[1:]:
        rarest = close(rarest, x)
        if not len(rarest):
            return []
    lo = np.unique(np.concatenate([close(x, rarest) for x in lists]))
    hi = lo
    for x in lists:
        hi = np.maximum(hi, np.append(x, np.iinfo(np.int64).max // 2)[np.searchsorted(x, lo)])
    keep = (hi - lo < span) & np.append(hi[1:] > hi[:-1], True)
    return list(zip(lo[keep].tolist(), hi[keep].tolist(), strict=True))


def _query(index: DataFrame, phrases: PhraseSet, frequency: np.ndarray) -> DataFrame:
    rare = np.where(phrases.windows < 0, np.iinfo(np.int64).max, np.append(frequency, 0)[phrases.windows])
    plan = (phrases, np.argsort(rare, axis=1, kind="stable").astype(np.int8 if rare.shape[1] < 128 else np.int32))
    sent = index.sparkSession.sparkContext.broadcast(plan)

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, order = sent.value
        windows, lengths = phrases.windows, phrases.lengths
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, hashes, first, n_words = (b.column(c)[i].as_py() for c in ("doc_ids", "text_hashes", "first", "n_words"))
                w, at = exact_matches(*_postings(b, i), windows, lengths, order)
                firsts = np.array(first, np.int64)
                row = np.searchsorted(firsts, at, "right") - 1
                by = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[by], np.arange(len(doc_ids) + 1))
                hits, found = [], []
                for d in range(len(doc_ids)):
                    mine = by[cut[d] : cut[d + 1]]
                    if not len(mine):
                        hits.append([])
                        found.append([])
                        continue
                    edge = np.zeros(n_words[d] + 1, np.int64)
                    np.add.at(edge, at[mine] - first[d], 1)
                    np.add.at(edge, at[mine] - first[d] + lengths[w[mine]], -1)
                    hits.append(np.flatnonzero(np.cumsum(edge) > 0))
                    found.append(sorted({x for k in np.unique(w[mine]).tolist() for x in phrases.items(k)}))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([b.column("shard")[i].as_py()] * len(doc_ids), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "text_hash": pa.array(hashes, pa.int64()),
                        "n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.int64())),
                    }
                )

    return index.mapInArrow(query, HITS)


def _near(index: DataFrame, phrases: PhraseSet, frequency: np.ndarray, span: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((phrases, frequency))

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, frequency = sent.value
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, hashes = (b.column(c)[i].as_py() for c in ("doc_ids", "text_hashes"))
                first, postings = np.array(b.column("first")[i].as_py(), np.int64), _postings(b, i)
                found = set()
                for k, window in enumerate(phrases.windows):
                    for lo, hi in near_matches(*postings, window[: phrases.lengths[k]].tolist(), frequency, span):
                        d = int(np.searchsorted(first, lo, "right")) - 1
                        found.update((doc_ids[d], hashes[d], item, lo - int(first[d]), hi - int(first[d])) for item in phrases.items(k))
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_hash", "item_id", "first", "last"])

    return index.mapInArrow(query, NEAR)


def proximity(docs: DataFrame, benchmark: DataFrame, span: int = 2 * WINDOW, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Where the words of a benchmark window stand in any order within `span` words of a document, whether or not they are its phrase.

    Distinct rows of doc_id, text_hash, item_id, first and last (word ordinals), of the spans that hold no smaller one. A
    word that a window repeats is asked for once. The index keeps all postings, with `span` places between documents.
    """
    out = docs.sparkSession.createDataFrame([], NEAR)
    for items in query_blocks(benchmark, query_bytes, window):
        phrases = PhraseSet(items, window)
        index = build_index(docs, phrases.vocabulary, gap=span)
        out = out.unionByName(_near(index, phrases, term_frequencies(index, len(phrases.vocabulary)), span))
    return out.distinct()


def pieces(benchmark: DataFrame, piece_words: int, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(i, t): items, long ones as pieces of piece_words words and the window - 1 after them, so that each window is in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "t"):
            start, end, row = spans(buf, off, ALNUM)
            words = np.searchsorted(row, np.arange(len(off)))
            for r, i in enumerate(rows.column("i").to_pylist()):
                a, b = int(words[r]), int(words[r + 1])
                first = range(a, max(a + 1, b - window + 1), piece_words) if b > a else []
                cut = [buf[start[x] : end[min(b, x + piece_words + window - 1) - 1]].tobytes().decode("utf-8", "ignore") for x in first]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(cut), pa.int64()), pa.array(cut, pa.string())], ["i", "t"])

    named = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    return named.mapInArrow(run, "i long, t string")


def query_blocks(benchmark: DataFrame, query_bytes: int, window: int = WINDOW) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item, text or piece of it) of about query_bytes together."""
    block, size = [], 0
    for r in pieces(benchmark, max(1, query_bytes // 32), window).toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t)
        if size >= query_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids), hits (word ordinals inside benchmark windows)."""
    found = []
    for items in query_blocks(benchmark, query_bytes, window):
        phrases = PhraseSet(items, window)
        index = build_index(docs, phrases.vocabulary, max(1, phrases.shortest))
        found.append(_query(index, phrases, term_frequencies(index, len(phrases.vocabulary))))
    if not found:
        found.append(_query(build_index(docs, PhraseSet([]).vocabulary), PhraseSet([]), np.zeros(0, np.int64)))
    out = found[0]
    if len(found) > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        merged = out.groupBy("doc_id", "text_hash").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(found)).cast("int").alias("rows"),
        )
        out = merged.withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
    return out.select("doc_id", "text_hash", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits")


def contaminated() -> Column:
    """One word in twenty or more inside benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    bad = decontaminate(docs, benchmark).where(contaminated())
    return without(docs, bad.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.col("text_hash").alias("_text")))


def digest(found: DataFrame) -> DataFrame:
    """decontaminate()'s rows as the query returns them."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def sha256_of_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
