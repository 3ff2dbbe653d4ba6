"""Self-join of documents by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

A document's tokens are the 64-bit hashes of its distinct five-word shingles, in one global order: rarest first. A set of
n tokens shares at least t = ceil(threshold * n) with any that it links to, so it meets all of them with l tokens or more if
it shows its first n - t + l. Each document picks its own l: a longer prefix costs longer posting lists, but asks for more
shared tokens before a pair is verified. It takes the l for which the estimated sum of posting visits and verifications is
least. How many shared prefix tokens a pair needs follows from both sizes and both prefixes (see _meet).

Plan:
1. Tokens go, packed, to buckets of hashes. There each token's document frequency is counted; only tokens of two or more
   documents go back to their block of documents. A document with under t of these links to none and is done.
2. Documents of equal token sets become one class. Only classes go on.
3. Prefix postings. Some rounds link each class to the best hub of its posting lists and take components of the verified
   links; then the classes of each component look up, in their posting lists, those of larger components, pairs with too few
   shared prefix tokens drop out, and all others are verified exactly. A group of copies is thus a few stars of links and
   not all its pairs.

Frequencies, lists, classes and components are tables in the shared folder. What is collected and broadcast are the rows of
at most a thousand hot keys of a join at a time, never documents.

Defined results: null, empty and word-less texts have no tokens and link with nothing; a text with under five words has its
whole sequence as one token; repeated rows link with each other; a null doc_id is reachable but never the smallest unless
all are null; other columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components as components_of

from .blocks import NOT_SPACE, U64, Rolling, blocks, mix, spans
from .shared import _NO_ID, in_groups, join_split, map_materialize, materialize, row_key, without

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
#: The longest prefix extension that is tried, and the cost of verifying a pair's token against that of visiting a posting.
MOST_MATCHES, VERIFY_COST = 8, 0.25
#: Bytes of text whose tokens are dealt together: larger blocks make fewer rows.
DEAL_BYTES = 3 << 20
#: Entries of a posting list that are looked through at once.
LIST = 4096
_META = "doc_ids array<long>, text_keys array<long>, sizes array<long>, first_keys array<long>, second_keys array<long>"
#: A token's 64 bits: those of its bucket, then up to 16 as counts of a bucket's sorted tokens by these bits, 16 and 32.
_PACKED = "batch long, bucket int, counts binary, middle binary, low binary, rows binary"


def shingles(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each text, by hash."""
    start, end, row = spans(buf, off, NOT_SPACE)
    word = Rolling(buf, True).ranges(start, end)
    counts = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(counts) - counts
    hashes, rows = [], []
    for size in range(1, k + 1):
        if size < k:
            at = first[counts == size]
        else:
            at = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
        total = np.full(len(at), size, U64)
        for j in range(size):
            total = total * U64(0xD6E8FEB86659FD93) + word[at + j]
        hashes.append(mix(total))
        rows.append(row[at])
    h, r = np.concatenate(hashes), np.concatenate(rows)
    by = np.argsort(h, kind="stable")  # rows ascend within a size, and sizes have no hash in common
    h, r = h[by], r[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The fewest tokens that a set of n shares with any that it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def links(shared: int, n: int, m: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (n + m - shared)


def pack_frequency(df: np.ndarray) -> np.ndarray:
    """A document frequency as one byte, in steps of a sixteenth of a doubling: any order that all documents share will do."""
    return np.minimum(255, np.floor(8 * np.log2(df))).astype(np.uint8)


def connected_components(edges: DataFrame) -> DataFrame:
    return components_of(edges, lambda e: materialize(e, "edges"))


def _deal(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 24
        for rows, buf, off in blocks(batches, "text", DEAL_BYTES):
            h, r = shingles(buf, off)
            by = np.argsort(r, kind="stable")
            sizes = np.bincount(r, minlength=rows.num_rows)
            some = np.flatnonzero(sizes)
            at = (np.cumsum(sizes) - sizes)[some]
            keys = np.zeros((2, rows.num_rows), U64)
            for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                if len(some):
                    keys[i, some] = np.add.reduceat(mix(h[by] ^ U64(salt)), at)
            bucket = (h >> U64(64 - bits)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            r = r.astype("<u2")
            home = batch % (1 << bits)
            out = {k: [] for k in ("batch", "bucket", "counts", "middle", "low", "rows", "doc_ids", "text_keys", "sizes", "first_keys", "second_keys")}
            for b in range(1 << bits):
                lo, hi = cut[b], cut[b + 1]
                if lo == hi and b != home:
                    continue
                mine = b == home
                values = (batch, b, *_pack(h[lo:hi], bits), r[lo:hi].tobytes(), rows.column("doc_id").to_pylist() if mine else None, rows.column("text_key").to_pylist() if mine else None, sizes if mine else None, keys[0].view(np.int64) if mine else None, keys[1].view(np.int64) if mine else None)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
            batch += 1

    return docs.mapInArrow(run, f"{_PACKED}, {_META}")


def _pack(h: np.ndarray, bits: int) -> tuple[bytes, bytes, bytes]:
    """(counts, middle, low) of a bucket's sorted tokens."""
    counts = np.bincount(((h >> U64(48)) & U64((1 << (16 - bits)) - 1)).astype(np.int64), minlength=1 << (16 - bits))
    return counts.astype("<u4").tobytes(), ((h >> U64(32)) & U64(0xFFFF)).astype("<u2").tobytes(), (h & U64(0xFFFFFFFF)).astype("<u4").tobytes()


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(64-bit hashes, row in block, line of the table, bits of a bucket) of packed tokens."""
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    low, middle, rows = join("low", "<u4"), join("middle", "<u2"), join("rows", "<u2")
    sizes = [len(x) // 2 for x in table.column("rows").to_pylist()]
    line = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    counts = join("counts", "<u4").reshape(len(sizes), -1)
    bits = 17 - counts.shape[1].bit_length()
    bucket = np.array(table.column("bucket"), np.int64).astype(U64)
    h = np.repeat((bucket[:, None] << U64(16 - bits) | np.arange(counts.shape[1], dtype=U64)).ravel(), counts.ravel())
    for part, shift in ((middle, 16), (low, 32)):
        h <<= U64(shift)
        h |= part
    return h, rows, line, bits


def _count(table: pa.Table) -> pa.Table:
    """Of a bucket: the tokens of two documents or more, with their frequencies, by block."""
    h, rows, line, bits = _unpack(table)
    by = np.argsort(h, kind="stable")
    s = h[by]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    df = np.zeros(len(h), np.int64)
    df[by] = np.repeat(np.diff(begin, append=len(s)), np.diff(begin, append=len(s)))
    keep = df > 1
    h, rows, line, packed = h[keep], rows[keep], line[keep], pack_frequency(df[keep])
    cut = np.searchsorted(line, np.arange(table.num_rows + 1))
    part = lambda a, t: [a[x:y].astype(t).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
    counts, middle, low = zip(*[_pack(h[x:y], bits) for x, y in zip(cut[:-1], cut[1:], strict=True)], strict=True)
    out = pa.table(
        {"batch": table.column("batch"), "bucket": table.column("bucket"), "counts": pa.array(counts, pa.binary()), "middle": pa.array(middle, pa.binary()), "low": pa.array(low, pa.binary()),
         "rows": pa.array(part(rows, "<u2"), pa.binary()), "frequencies": pa.array(part(packed, np.uint8), pa.binary())} | {c: table.column(c) for c in ("doc_ids", "text_keys", "sizes", "first_keys", "second_keys")}
    )
    return out.filter(pa.array((np.diff(cut) > 0) | ~np.array(table.column("sizes").is_null())))


_DOCS = "key long, doc_id long, text_key long, n long, first_key long, second_key long, tokens binary, frequencies binary"


def _gather(table: pa.Table) -> pa.Table:
    """Of a block: one row a document, with its repeated tokens, rarest first, if there are enough for a link."""
    home = table.filter(table.column("sizes").is_valid())
    ids, texts, sizes, first, second = (home.column(c)[0].as_py() for c in ("doc_ids", "text_keys", "sizes", "first_keys", "second_keys"))
    h, rows, _, _ = _unpack(table)
    df = np.frombuffer(b"".join(table.column("frequencies").to_pylist()), np.uint8)
    n = np.array(sizes, np.int64)
    have = np.bincount(rows, minlength=len(n))
    able = (n > 0) & (have >= needed(n))
    keep = able[rows]
    h, rows, df = h[keep], rows[keep], df[keep]
    by = np.lexsort((h, df, rows))
    h, df = h[by].astype("<u8"), df[by]
    cut = np.concatenate([[0], np.cumsum(np.where(able, have, 0))])
    part = lambda a: [a[cut[i] : cut[i + 1]].tobytes() if able[i] else None for i in range(len(n))]
    batch = home.column("batch")[0].as_py()
    return pa.table(
        {"key": pa.array([batch << 16 | i for i in range(len(n))], pa.int64()), "doc_id": pa.array(ids, pa.int64()), "text_key": pa.array(texts, pa.int64()), "n": pa.array(n), "first_key": pa.array(first, pa.int64()),
         "second_key": pa.array(second, pa.int64()), "tokens": pa.array(part(h), pa.binary()), "frequencies": pa.array(part(df), pa.binary())}
    )


def choose_matches(n: int, frequencies: np.ndarray) -> int:
    """The l of least estimated cost."""
    t, base = needed(n), n - len(frequencies)
    best, least = 1, None
    cumulative = np.concatenate([[0.0], np.cumsum(np.exp2((frequencies + 1) / 8.0) - 1)])
    for want in range(1, min(MOST_MATCHES, t) + 1):
        visits = cumulative[min(max(n - t + want - base, 0), len(frequencies))]  # other documents in the prefix's lists
        cost = visits + VERIFY_COST * n * visits / want  # each candidate takes `want` of these visits
        if least is None or cost < least:
            best, least = want, cost
    return best


def _among(rows: DataFrame, key: str, ids: DataFrame, of: str) -> DataFrame:
    """rows whose key is one of ids' column `of`, without moving them: the ids go to all tasks, by 256 neighbouring keys, as a byte each."""
    held = ids.groupBy(F.shiftright(of, 8).alias("_near")).agg(F.collect_set((F.col(of).bitwiseAND(255) - 128).cast("byte")).alias("_held"))
    there = F.array_contains("_held", (F.col(key).bitwiseAND(255) - 128).cast("byte"))
    return rows.withColumn("_near", F.shiftright(key, 8)).join(F.broadcast(held), "_near").where(there).drop("_near", "_held")


_POSTINGS = "token long, id long, n int, have int, prefix int"


def _postings(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]  # a column each
            for i in range(b.num_rows):
                node, n = b.column("id")[i].as_py(), b.column("n")[i].as_py()
                tokens, df = np.frombuffer(b.column("tokens")[i].as_py(), "<i8"), np.frombuffer(b.column("frequencies")[i].as_py(), np.uint8)
                prefix = n - needed(n) + choose_matches(n, df)
                take = max(0, prefix - (n - len(df)))  # the tokens of no other document come first and meet nothing
                for p, v in zip(parts, (tokens[:take], node, n, len(df), prefix), strict=True):
                    p.append(np.broadcast_to(v, min(take, len(tokens))))
            types = (pa.int64(), pa.int64(), *[pa.int32()] * 3)
            names = [c.split()[0] for c in _POSTINGS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p) if p else [], t) for p, t in zip(parts, types, strict=True)], names)

    return map_materialize(classes.select("id", "n", "tokens", "frequencies"), run, _POSTINGS, "prefix-postings")


def _verify(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            for i in range(batch.num_rows):
                both = np.concatenate([np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8")])
                both.sort()
                keep.append(links(int((both[1:] == both[:-1]).sum()), n[i], m[i]))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    left = _among(classes.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("x")), "a", pairs, "a")
    right = _among(classes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y")), "b", pairs, "b")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return map_materialize(both, run, "a long, b long", "verified-links")


def _meet(met: DataFrame) -> DataFrame:
    """Of rows (a, b, n, m, prefix, prefix_m), one per shared prefix token, the pairs that share enough.

    A linking pair has at least o = ceil(threshold / (1 + threshold) * (n + m)) tokens in common. Of the two prefixes, take
    the one that ends first in the global order; what its set has after it can't hold more than n - prefix of the o.
    """
    least = F.ceil(F.expr(f"{NUMERATOR} * (n + m) / {NUMERATOR + DENOMINATOR}")) - F.greatest(F.col("n") - F.col("prefix"), F.col("m") - F.col("prefix_m"))
    return met.groupBy("a", "b", least.alias("least")).agg(F.count("*").alias("shared")).where("shared >= least")


def _may_link(n: str, m: str, have: str, have_m: str) -> str:
    """Whether sets of n and m tokens, of which so many are repeated at all, can share enough: only repeated tokens are shared."""
    return f"{NUMERATOR} * ({n} + {m}) <= {NUMERATOR + DENOMINATOR} * least({have}, {have_m})"


def _hub_pairs(postings: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): each class with the hub, of another component, with which it shares most prefix tokens.

    A list's hub is, in the first turn, its class of the largest share of repeated tokens; later, one drawn by hash. Without
    labels each class is a component of its own.
    """
    p = postings.withColumn("label", F.col("id")) if labels is None else postings.join(labels, "id")
    rank = F.col("have") / F.col("n") if not turn else F.xxhash64("id", F.lit(turn))
    hub = p.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "id", "label", "n", "have", "prefix")).alias("hub"))
    met = p.join(hub, "token").where("label <> hub.label").where(_may_link("n", "hub.n", "have", "hub.have"))
    met = met.select(F.col("id").alias("a"), F.col("hub.id").alias("b"), "n", F.col("hub.n").alias("m"), "prefix", F.col("hub.prefix").alias("prefix_m"))
    return _meet(met).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b")


def _count_shared(table: pa.Table) -> pa.Table:
    """Of one class and what it may link to of its posting lists: the classes with which it shares enough prefix tokens."""
    entry = pc.list_flatten(table.column("list").combine_chunks())
    y, n, prefix = (np.array(pc.struct_field(entry, c), np.int64) for c in ("id", "n", "prefix"))
    mine = {c: table.column(c)[0].as_py() for c in ("id", "n", "prefix")}
    y, first, shared = np.unique(y, return_index=True, return_counts=True)
    n, prefix = n[first], prefix[first]
    least = -(-NUMERATOR * (n + mine["n"]) // (NUMERATOR + DENOMINATOR))
    good = shared >= least - np.maximum(n - prefix, mine["n"] - mine["prefix"])
    return pa.table({"a": pa.array(np.full(int(good.sum()), mine["id"])), "b": pa.array(y[good])})


def _cross_pairs(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): all candidates of different components.

    Each class looks up the posting lists of its prefix tokens and counts there; of two components, the smaller one's classes
    look for the larger one's, so a list's largest component only waits. Lists go as arrays, cut by a hash of the class into
    parts of about LIST entries; what a task counts at once is a class's parts of its prefix tokens' lists, so it grows with the
    class's prefix. No row is made for a pair and a token, and of a list only the entries that a class may link to are moved on.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    p = postings.join(labels.join(sizes, "label"), "id")
    component = F.struct("size", "label")
    top = p.groupBy("token").agg(F.max(component).alias("top"), F.min(component).alias("low"), F.count("*").alias("entries")).where("low < top")
    p = materialize(p.join(top.select("token", "top", "entries"), "token").select("token", "id", "n", "have", "prefix", "size", "label", (component == F.col("top")).alias("waits"), "entries"), "mixed-lists")
    longest = p.agg(F.max("entries")).first()[0] or 0
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-longest // LIST))))
    lists = p.groupBy("token", part.alias("part")).agg(F.collect_list(F.struct("id", "n", "have", "prefix", "size", "label")).alias("list"))
    asked = p.where("not waits").select("token", "id", "n", "have", "prefix", "size", "label").join(lists, "token")
    able = F.filter("list", lambda e: (F.struct(e["size"], e["label"]) > F.struct("size", "label")) & (NUMERATOR * (e["n"] + F.col("n")) <= (NUMERATOR + DENOMINATOR) * F.least(e["have"], "have")))
    asked = asked.select("id", "part", "n", "prefix", F.transform(able, lambda e: F.struct(e["id"], e["n"], e["prefix"])).alias("list")).where("size(list) > 0")
    return asked.groupBy("id", "part").applyInArrow(_count_shared, "a long, b long").distinct()


def bucket_bits(docs: DataFrame) -> int:
    """Buckets are a power of two, four or more to a shuffle partition, as many as the cluster's setting asks for."""
    return min(16, max(4, int(np.ceil(np.log2(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))))


def similar_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hub_rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, component, key (a number of the row), text_key (a hash of the text)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(text, doc_id)["_text"].alias("text_key"))
    dealt = _deal(docs, bucket_bits(docs))
    counted = dealt.groupBy("bucket").applyInArrow(_count, f"{_PACKED}, frequencies binary, {_META}")
    sets = map_materialize(*in_groups(counted, ["batch"], _gather), _DOCS, "shingle-sets")
    able = sets.where("tokens is not null")
    identity = ["first_key", "second_key", "n"]
    chosen = materialize(able.groupBy(*identity).agg(F.min("doc_id").alias("least_doc"), F.min("key").alias("id"), F.count("*").alias("copies")), "class-names")
    classes = materialize(_among(able, "key", chosen, "id").select(F.col("key").alias("id"), "n", "tokens", "frequencies"), "shingle-classes")
    postings = _postings(classes)
    repeated = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    postings = materialize(postings.join(repeated, "token"), "prefix-postings")
    labels = classes.select("id", F.col("id").alias("label"))
    found = None
    for turn in range(hub_rounds + 1):
        pairs = _cross_pairs(postings, labels) if turn == hub_rounds else _hub_pairs(postings, None if found is None else labels, turn)
        pairs = materialize(pairs.select("a", "b"), "candidate-pairs")
        linked = _verify(pairs, classes)
        if linked.isEmpty():
            continue
        # further rounds link whole components, by their labels
        if found is None:
            found = connected_components(linked)
        else:
            named = linked.join(labels.withColumnRenamed("id", "a").withColumnRenamed("label", "la"), "a").join(labels.withColumnRenamed("id", "b").withColumnRenamed("label", "lb"), "b")
            higher = connected_components(named.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("top"))
            found = labels.join(higher, "label", "left").select("id", F.coalesce("top", "label").alias("label"))
        labels = materialize(classes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    named = chosen.join(labels, "id")
    least = named.groupBy("label").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("members"))
    of_class = join_split(named, materialize(least, "components"), ["label"], "members", classes.count()).select(*identity, "copies", "component_id", F.col("label").alias("component"))
    kept = ["key", "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "component"]
    grouped = join_split(able.select("key", "doc_id", "text_key", *identity), materialize(of_class, "classes"), identity, "copies", sets.count()).select(*kept)
    return grouped.unionByName(sets.where("tokens is null").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")}).select(*kept))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id, null last; of repeated rows, one."""
    found = materialize(similar_components(docs, text, doc_id).where("component is not null").select("component", "doc_id", "text_key", "key"), "components")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("members"))
    first = materialize(first.select("component", F.col("first.key").alias("first"), "members"), "components")
    ident = {"_id": F.coalesce("doc_id", F.lit(_NO_ID)), "_text": F.col("text_key")}
    state = join_split(found, first, ["component"], "members", found.count()).withColumns(ident).groupBy("_id", "_text").agg(F.max((F.col("key") == F.col("first")).cast("int")).alias("kept"), F.count("*").alias("rows"))
    state = materialize(state.where("kept = 0 or rows > 1"), "components")
    out = without(docs, state, text, doc_id)
    twice = materialize(state.where("kept = 1 and rows > 1"), "components")
    if twice.isEmpty():
        return out
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in row_key(text, doc_id).items()])
    again = held.join(twice, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"])
    return out.unionByName(again.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
