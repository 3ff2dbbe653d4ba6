"""Hard-negative mining by ball trees with branch and bound on inner products.

Rows are whole-number vectors, stored in the order of (vec_id, vector) with a number of their own, dealt to partitions by
(label, number) and cut into blocks of one label and bounded bytes. A task builds a ball tree over each of its blocks. The
queries, chunk after chunk from files of the shared folder, go down a tree side by side: for a ball of centre c and radius r,
q.c - r|q| and q.c + r|q| bound all inner products in it. A query leaves a ball whose upper bound lies strictly beneath its
current k-th score, or whose bounds don't meet its window of scores; at the leaves, products are computed and counted
exactly. The k-th score among one row in `SAMPLE` is a query's first bound, so that all blocks together find some k *
`SAMPLE` rows a query, however many they are; these meet in one window per query.

Positives: the best rows of the anchor's own label. Negatives: the best rows of other labels whose score lies between
`low` and `high` percent of the positive's. Higher scores come first, ties by smaller vec_id, then by vector.

Defined results: rows with a null label, a null vector, or null or non-finite entries take no part. A null vec_id is no
anchor, and comes last among ties; repeated rows are rows of their own, so a repeated anchor has each copy's results.
Vectors of different lengths count as filled up with zeros. Scaled entries beyond 2**62 and scores beyond 63 bits are held
there, by exact arithmetic. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .shared import map_materialize, materialize
from .vectors import finite_rows, whole

#: Bytes of a block's matrix, of a chunk of queries, and rows of a leaf.
BLOCK_BYTES, CHUNK_BYTES, LEAF = 16 << 20, 1 << 20, 256
#: One row in so many gives the first bounds of the k-th scores. What is found doesn't depend on it.
SAMPLE = 16
_LEAST = -(1 << 63) + 1
ROWS = "vec_id long, label int, x array<long>"
CHUNKS = "rid array<long>, label array<int>, dims int, x binary, lo array<long>, hi array<long>"
FOUND = "query long, slot int, score long, rid long, vec_id long"


class Ball:
    """A node: rows start..end of the tree's order, with centre, radius and, unless it is a leaf, two children."""

    __slots__ = ("start", "end", "centre", "radius", "children")


class BallTree:
    """Rows of a matrix, parted at the median along the line between two far rows until a part has at most `leaf`."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        points = x.astype(np.float64)
        #: Products below this size are exact as doubles.
        self.most = float(np.abs(points).max(initial=0))
        self.root = self._ball(points, 0, len(x), leaf)

    def _ball(self, points: np.ndarray, start: int, end: int, leaf: int) -> Ball:
        node, mine = Ball(), points[self.order[start:end]]
        node.start, node.end, node.children = start, end, ()
        node.centre = mine.mean(axis=0)
        away = np.linalg.norm(mine - node.centre, axis=1)
        node.radius = float(away.max()) * (1 + 1e-9)
        if end - start > leaf and node.radius > 0:
            one = mine[away.argmax()]
            along = mine @ (mine[np.linalg.norm(mine - one, axis=1).argmax()] - one)
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(along, half)]
            node.children = (self._ball(points, start, start + half, leaf), self._ball(points, start + half, end, leaf))
        elif end - start > leaf:  # equal rows: any parting is as good
            half = (end - start) // 2
            node.children = (self._ball(points, start, start + half, leaf), self._ball(points, start + half, end, leaf))
        return node


class Best:
    """The first k (score, rid) of each slot: higher scores first, ties by smaller rid."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.rid, self.row = np.full((slots, k), _LEAST, np.int64), np.full((slots, k), 1 << 62, np.int64), np.full((slots, k), -1, np.int64)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, rid: np.ndarray, row: np.ndarray) -> None:
        some = np.unique(slot)
        slots = np.concatenate([np.repeat(some, self.k), slot])
        score, rid, row = (np.concatenate([old[some].ravel(), new]) for old, new in ((self.score, score), (self.rid, rid), (self.row, row)))
        by = np.lexsort((rid, -score, slots))
        slots = slots[by]
        place = np.arange(len(by)) - np.searchsorted(slots, slots)
        keep = by[place < self.k]
        self.score[some], self.rid[some], self.row[some] = (a[keep].reshape(-1, self.k) for a in (score, rid, row))


@dataclass
class Queries:
    """Anchors with a window of scores for each of their slots; label and own row say what they may find."""

    rid: np.ndarray
    label: np.ndarray
    x: np.ndarray
    lo: np.ndarray  # anchors x slots
    hi: np.ndarray


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of whole numbers, exact; beyond 63 bits they are held at the limit."""
    d = min(q.shape[1], x.shape[1])
    q, x = q[:, :d], x[:, :d]
    if float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, d) < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T if d else np.zeros((len(q), len(x)), object)
    return np.clip(exact, _LEAST + 1, -_LEAST - 1).astype(np.int64)


def search(tree: BallTree, x: np.ndarray, rid: np.ndarray, queries: Queries, asked: np.ndarray, k: int) -> tuple[Best, int]:
    """The best k rows of each slot of the asked anchors (slot = anchor * slots + its place), and how many products were computed."""
    slots = queries.lo.shape[1]
    best, done = Best(len(queries.rid) * slots, k), 0
    d = min(queries.x.shape[1], x.shape[1])
    q = queries.x[:, :d].astype(np.float64)
    length = np.linalg.norm(q, axis=1)
    slack = 1e-9 * length * (np.linalg.norm(np.full(d, tree.most)) + 1) + 1
    todo = [(tree.root, asked)]
    while todo:
        node, of = todo.pop()
        middle, reach = q[of] @ node.centre[:d], node.radius * length[of] + slack[of]
        least = np.maximum(queries.lo[of], best.kth().reshape(-1, slots)[of])
        alive = (((middle + reach)[:, None] >= least) & ((middle - reach)[:, None] <= queries.hi[of])).any(axis=1)
        of = of[alive]
        if not len(of):
            continue
        if node.children:
            above = [float((q[of] @ c.centre[:d] + c.radius * length[of]).mean()) for c in node.children]
            todo += [(node.children[i], of) for i in np.argsort(above, kind="stable")]
            continue
        rows = tree.order[node.start : node.end]
        s = products(queries.x[of], x[rows])
        done += s.size
        least = least[alive]
        a, m = np.nonzero((s >= least.min(axis=1)[:, None]) & (s <= queries.hi[of].max(axis=1)[:, None]) & (rid[rows][None, :] != queries.rid[of][:, None]))
        found = s[a, m]
        hit, slot = np.nonzero((found[:, None] >= least[a]) & (found[:, None] <= queries.hi[of][a]))
        if len(hit):
            row = rows[m[hit]]
            best.add(of[a[hit]] * slots + slot, found[hit], rid[row], row)
    return best, done


# -- the same on Spark


def vectors(df: DataFrame, scale: int, relabel: int = 0, labels: int = 10, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """rid, vec_id, label, x: rows that take part, numbered in the order of vec_id (null last). Stored. Where relabel divides vec_id, the label is the next one of `labels`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, c in finite_rows(b.column(2)):
                with np.errstate(over="ignore"):
                    x = whole(scale * c, 1 << 62)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "label", "x"])

    i, of = F.col(vec_id).cast("long"), F.col(label).cast("int")
    moved = F.when(i % relabel == 0, F.pmod(of + 1, F.lit(labels))).otherwise(of) if relabel else of
    named = df.select(i.alias("vec_id"), moved.alias("label"), F.col(vector).alias("v")).where("label is not null")
    ordered = named.mapInArrow(run, ROWS).orderBy(F.asc_nulls_last("vec_id"), "x", "label")
    return materialize(ordered.withColumn("rid", F.monotonically_increasing_id()), "rows")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in partitions of whole ranges of (label, rid), sorted by them: a common label fills many partitions."""
    return materialize(rows.repartitionByRange("label", "rid").sortWithinPartitions("label", "rid"), "by-label")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(label, rid, x, vec_id) for runs of a label of about `size` bytes."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return t.column("label")[0].as_py(), t.column("rid").to_numpy(), _matrix(t.column("x")), t.column("vec_id")

    for b in batches:
        labels = b.column("label").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and (held[-1].column("label")[0].as_py() != labels[lo] or sum(h.column("x").nbytes for h in held) >= size):
                yield block()
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield block()


def chunks(anchors: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Anchors (rid, label, x, lo, hi) in packed rows of about `size` bytes. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"))
            step = max(1, size // max(1, 8 * x.shape[1]))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                cells = [[part.column("rid").to_pylist()], [part.column("label").to_pylist()], [x.shape[1]], [x[at : at + step].tobytes()], [sum(part.column("lo").to_pylist(), [])], [sum(part.column("hi").to_pylist(), [])]]
                kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["rid", "label", "dims", "x", "lo", "hi"])

    return map_materialize(anchors.select("rid", "label", "x", "lo", "hi"), run, CHUNKS, "queries")


def _read(paths: list[str]) -> Iterator[Queries]:
    for path in paths:
        store, inner = files.store(path)
        with store.open_input_file(inner) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                rid = np.array(b.column("rid")[0].as_py(), np.int64)
                lo, hi = (np.array(b.column(c)[0].as_py(), np.int64).reshape(len(rid), -1) for c in ("lo", "hi"))
                yield Queries(rid, np.array(b.column("label")[0].as_py(), np.int64), np.frombuffer(b.column("x")[0].as_py(), np.int64).reshape(len(rid), b.column("dims")[0].as_py()), lo, hi)


def best_rows(rows: DataFrame, asked: DataFrame, k: int, may: Callable[[np.ndarray, int], np.ndarray], block: int = BLOCK_BYTES) -> DataFrame:
    """query, slot, rank, score, rid, vec_id: the best k rows of each slot of each query, among blocks whose label it may ask."""
    paths = sorted(asked.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, rid, x, ids in _blocks(batches, block):
            tree = BallTree(x)
            for q in _read(paths):
                of = np.flatnonzero(may(q.label, label))
                if not len(of):
                    continue
                best, _ = search(tree, x, rid, q, of, k)
                slot, place = np.nonzero(best.row >= 0)
                row, n = best.row[slot, place], q.lo.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(q.rid[slot // n]), pa.array((slot % n).astype(np.int32)), pa.array(best.score[slot, place]), pa.array(best.rid[slot, place]), ids.take(pa.array(row))], ["query", "slot", "score", "rid", "vec_id"])

    found = rows.mapInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query", "slot").orderBy(F.desc("score"), "rid"))).where(F.col("rank") <= k)


def first_k(rows: DataFrame, anchors: DataFrame, k: int, may: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """best_rows() of the anchors (rid, label, x, lo, hi), whose lower bounds are first raised to their k-th scores in a sample."""
    some = best_rows(rows.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0), chunks(anchors), k, may).where(F.col("rank") == k)
    kth = some.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # a slot once
    raised = F.transform("lo", lambda low, i: F.greatest(low, F.try_element_at("kth", i)))
    return best_rows(rows, chunks(anchors.join(kth, anchors.rid == kth["query"], "left").withColumn("lo", raised)), k, may)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose vec_id `every` divides.

    `rows` are those of vectors(). low and high are percent of the positive's score, both included.
    """
    by_label = dealt(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    everything = lambda v: F.array(F.lit(v).cast("long"))
    own = first_k(by_label, anchors.withColumn("lo", everything(_LEAST)).withColumn("hi", everything(-_LEAST)), positives, np.equal)
    own = materialize(own.select("query", "rank", "score", F.col("vec_id").alias("positive_id")), "positives")
    # percentages without overflow: s * p / 100 = s // 100 * p + s % 100 * p / 100
    share = lambda p, to: F.expr(f"(score - pmod(score, 100)) div 100 * {p} + {to}(pmod(score, 100) * {p} / 100.0)")
    windows = own.withColumn("lo", share(low, "ceil").cast("long")).withColumn("hi", share(high, "floor").cast("long"))
    slots = windows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))  # at most `positives` each
    padded = lambda c, none: F.concat(F.col(f"w.{c}"), F.array_repeat(F.lit(none).cast("long"), F.lit(positives) - F.size("w")))
    asked = anchors.join(slots, anchors.rid == slots.query).select("rid", "label", "x", padded("lo", -_LEAST).alias("lo"), padded("hi", _LEAST).alias("hi"))
    other = first_k(by_label, asked, negatives, np.not_equal)
    found = other.select("query", (F.col("slot") + 1).alias("_p"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = own.select("query", F.col("rank").alias("_p"), "positive_id", F.col("score").alias("positive_score")).join(anchors.select(F.col("rid").alias("query"), F.col("vec_id").alias("anchor_id")), "query")
    return found.join(pairs, ["query", "_p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
