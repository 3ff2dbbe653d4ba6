"""The exact best k of each vector's context by cosine and a bonus, from matrix products of blocks that bounds leave over.

Vectors are scaled to length 1 and dealt to blocks: rows of one context, one length and, as far as the context is large
enough to be split, the same sides of a few fixed hyperplanes, so that a block's rows are near each other. A block of more
than `ROWS` rows is cut by hash. Each block is packed into a row with its centre and radius, and finds its rows' best k
among themselves; the least of these k-th scores is what a row of another block must reach. Two blocks are compared only if
their centres and radii and the highest bonus allow that. A comparison is one task's group of two packed rows, for both
directions, a strip of `STRIP` rows at a time. What tiles move is a row's vector for each `ROWS` rows of its context, so
that blocks are large, and vectors that are of single precision are packed as such.

Null and zero vectors and those of different lengths have cosine 0 with each other. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Rows of a block, and planes that tell blocks of a context apart at most.
ROWS, PLANES = 8192, 30
#: Rows of a block that are scored at once, and rows of a block of which links are all looked at together.
STRIP, LINKED_ROWS = 1024, 2048
FOUND = "src long, dst long, score double, cos double"
_LIST, _FLOATS = pa.list_(pa.int64()), pa.list_(pa.float64())


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; null is a row of length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == column.null_count:
        return np.zeros((len(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1.0)[:, None]


def _code(batches):
    """Rows with the length of their vectors and, as bits, their sides of the planes."""
    for b in batches:
        x, size = b.column("v"), np.zeros(b.num_rows, np.int64)
        lengths = [len(v) if v.is_valid else 0 for v in x]
        for n in set(lengths) - {0}:
            at = np.flatnonzero(np.array(lengths) == n)
            planes = np.random.default_rng(n).standard_normal((n, PLANES))
            size[at] = ((_rows(x.take(pa.array(at))) @ planes) > 0) @ (1 << np.arange(PLANES))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths, pa.int32()), pa.array(size)], [*b.schema.names, "dims", "code"])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's first k, by score and then by smaller id. ids are in ascending order, -inf is no hit."""
    k = min(k, score.shape[1])
    if k == 0:
        return np.zeros((len(score), 0), np.int64)
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(score >= least)
    by = np.lexsort((col, -score[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return col[place < k].reshape(len(score), k)


def _scores(a: np.ndarray, b: np.ndarray, bonus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cos = np.round(a @ b.T, 9) if a.shape[1] == b.shape[1] else np.zeros((len(a), len(b)))
    return cos, np.round(cos + bonus, 9)


def _bytes(x: np.ndarray) -> bytes:
    """Rows in the least precision that holds them."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return np.ascontiguousarray(small if np.array_equal(small.astype(float), x) else x).tobytes()


def _held(x: bytes, n: int, dims: int) -> np.ndarray:
    """_bytes()'s rows, scaled to length 1."""
    return _units(np.frombuffer(x, np.float32 if len(x) == 4 * n * dims else np.float64).astype(float).reshape(n, dims))


def _first(a: np.ndarray, b: np.ndarray, bonus: np.ndarray, k: int, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in b, score, cos) of the best k of b for each row of a, but itself."""
    parts = []
    for i in range(0, len(a), STRIP):
        cos, score = _scores(a[i : i + STRIP], b, bonus)
        score[a_ids[i : i + STRIP, None] == b_ids[None, :]] = -np.inf
        top = _best(score, b_ids, k)
        parts.append((top, np.take_along_axis(score, top, 1), np.take_along_axis(cos, top, 1)))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _pack(k: int, low: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, bonus, given = t.column("id").to_numpy(), t.column("bonus").to_numpy(), _rows(t.column("v"))
        x = _units(given)
        top, rank, cos = _first(x, x, bonus, k, ids, ids)
        row, col = np.nonzero(np.isfinite(rank) & (rank >= low))
        kth = np.maximum(rank[:, -1], low) if k and rank.shape[1] == k else np.full(len(ids), low)
        centre = x.mean(axis=0)
        best = top[row, col]
        cells = [
            [t.column("grp")[0].as_py()], [t.column("blk")[0].as_py()], [len(ids)], [x.shape[1]], [ids.tolist()], [_bytes(given)], [bonus.tobytes()], [centre.tolist()], [float(np.linalg.norm(x - centre, axis=1).max())],
            [float(bonus.max())], [kth.tobytes()], [float(kth.min())], [ids[row].tolist()], [ids[best].tolist()], [rank[row, col].tolist()], [cos[row, col].tolist()],
        ]
        kinds = [t.schema.field("grp").type, pa.string(), pa.int64(), pa.int32(), _LIST, pa.binary(), pa.binary(), _FLOATS, pa.float64(), pa.float64(), pa.binary(), pa.float64(), _LIST, _LIST, _FLOATS, _FLOATS]
        names = ["grp", "blk", "n", "dims", "ids", "x", "bonus", "centre", "radius", "high", "kth", "low", "src", "dst", "score", "cos"]
        return pa.table([pa.array(c, kind) for c, kind in zip(cells, kinds, strict=True)], names=names)

    return run


def blocks(nodes: DataFrame, k: int, least: float | None = None, rows: int = ROWS) -> DataFrame:
    """Packed blocks of nodes (id, grp, v, bonus), with what their rows find among themselves. Stored."""
    kind = dict(nodes.dtypes)["grp"]
    held = nodes.where("grp is not null").select(F.col("id").cast("long").alias("id"), "grp", F.col("v").cast("array<double>").alias("v"), F.col("bonus").cast("double").alias("bonus"))
    coded = stored(held.mapInArrow(_code, f"id long, grp {kind}, v array<double>, bonus double, dims int, code long"))
    size = coded.groupBy("grp", "dims").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows)))).cast("int")
    near = coded.join(size.select("grp", "dims", bits.alias("bits")), ["grp", "dims"]).withColumn("near", F.expr("code & (shiftleft(1L, bits) - 1)"))
    parts = near.groupBy("grp", "dims", "near").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = near.join(parts, ["grp", "dims", "near"]).withColumn("blk", F.concat_ws("/", "dims", "near", F.pmod(F.xxhash64("id"), F.col("parts"))))
    schema = f"grp {kind}, blk string, n long, dims int, ids array<long>, x binary, bonus binary, centre array<double>, radius double, high double, kth binary, low double, src array<long>, dst array<long>, score array<double>, cos array<double>"
    return stored(dealt.select("grp", "blk", "id", "v", "bonus").groupBy("grp", "blk").applyInArrow(_pack(k, float("-inf") if least is None else least), schema))


def tiles(packed: DataFrame) -> DataFrame:
    """(grp, a, b, n_pairs) of the ordered pairs of different blocks of a context of which b may hold a hit for a row of a. Stored."""
    side = lambda p: packed.select("grp", *[F.col(c).alias(f"{p}_{c}") for c in ("blk", "n", "dims", "centre", "radius", "high", "low")])
    both = side("a").join(side("b"), "grp").where("a_blk <> b_blk")
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda p: F.sqrt(F.aggregate(f"{p}_centre", F.lit(0.0), lambda s, v: s + v * v))
    # x.y <= c.d + |c| r_y + |d| r_x + r_x r_y for x in a ball (c, r_x) and y in (d, r_y); unit vectors have at most 1
    most = F.least(F.lit(1.0), dot + norm("a") * F.col("b_radius") + norm("b") * F.col("a_radius") + F.col("a_radius") * F.col("b_radius"))
    most = F.when(F.col("a_dims") == F.col("b_dims"), most).otherwise(0.0)
    return stored(both.where(most + F.col("b_high") + 1e-8 >= F.col("a_low")).select("grp", F.col("a_blk").alias("a"), F.col("b_blk").alias("b"), (F.col("a_n") * F.col("b_n")).alias("n_pairs")))


def _compare(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cell = lambda t, c: t.column(c)[0].as_py()
        sides = [
            (_held(cell(t, f"{p}_x"), cell(t, f"{p}_n"), cell(t, f"{p}_dims")), np.array(cell(t, f"{p}_ids"), np.int64), np.frombuffer(cell(t, f"{p}_bonus"), np.float64), np.frombuffer(cell(t, f"{p}_kth"), np.float64), cell(t, f"{p}_wants"))
            for t, p in ((left, "a"), (right, "b"))
        ]
        found = []
        for (x, src, _, kth, wants), (y, dst, bonus, _, _) in (sides, sides[::-1]):
            if wants:
                top, rank, cos = _first(x, y, bonus, k, src, dst)
                row, col = np.nonzero(np.isfinite(rank) & (rank >= kth[:, None]))
                found.append(pa.table({"src": src[row], "dst": dst[top[row, col]], "score": rank[row, col], "cos": cos[row, col]}))
        return pa.concat_tables(found)

    return run


def _span(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what a symmetric matrix of links connects: each linked row with the first of its component."""
    first = np.full(len(near), -1)
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        if first[i] < 0:
            first[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (first < 0))
                first[front] = i
    at = np.flatnonzero((first >= 0) & (first != np.arange(len(near))))
    return at, first[at]


def _span_block(least: float):
    def run(t: pa.Table) -> pa.Table:
        ids, x = np.array(t.column("ids")[0].as_py(), np.int64), _held(*(t.column(c)[0].as_py() for c in ("x", "n", "dims")))
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        a, b = _span(near)
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def _span_tile(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cell = lambda t, c: t.column(c)[0].as_py()
        x, y = (_held(*(cell(t, f"{p}_{c}") for c in ("x", "n", "dims"))) for t, p in ((left, "a"), (right, "b")))
        ids = np.array(cell(left, "a_ids") + cell(right, "b_ids"), np.int64)
        near = np.zeros((len(ids), len(ids)), bool)
        if x.shape[1] == y.shape[1]:
            near[: len(x), len(x) :] = x @ y.T >= least
            near |= near.T
        a, b = _span(near)
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def _sides(packed: DataFrame, met: DataFrame) -> list:
    """The packed rows of either side of each tile, grouped by tile."""
    keys = ["grp", "a", "b"]
    extra = [c for c in met.columns if c.endswith("_wants")]

    def side(p: str) -> DataFrame:
        body = packed.select(F.col("grp").alias(f"{p}_grp"), F.col("blk").alias(f"{p}_blk"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "dims", "ids", "x", "bonus", "kth")])
        named = met.select(*[F.col(c).alias(f"{p}_key_{c}") for c in keys], *[c for c in extra if c.startswith(p)])
        return named.join(body, (F.col(f"{p}_key_grp") == F.col(f"{p}_grp")) & (F.col(f"{p}_key_{p}") == F.col(f"{p}_blk"))).drop(f"{p}_grp", f"{p}_blk")

    return [side(p).groupBy(*[f"{p}_key_{c}" for c in keys]) for p in "ab"]


def linked(nodes: DataFrame, least: float, rows: int = LINKED_ROWS) -> DataFrame:
    """(a, b): links that connect the same nodes (id, grp, v) of a context as all pairs with a cosine of at least `least` (above 0) do; a block or a tile gives at most one link a row."""
    packed = blocks(nodes.withColumn("bonus", F.lit(0.0)), 0, least, rows)
    left, right = _sides(packed, tiles(packed).where("a < b"))
    inner = packed.select("grp", "blk", "n", "dims", "ids", "x").groupBy("grp", "blk").applyInArrow(_span_block(least), "a long, b long")
    return inner.unionByName(left.cogroup(right).applyInArrow(_span_tile(least), "a long, b long"))


def nearest(nodes: DataFrame, k: int, least: float | None = None, rows: int = ROWS) -> DataFrame:
    """(src, dst, cos, score, rank): the best k of each node's context, but itself, with a score (cos + the other's bonus, to nine digits) of at least `least`."""
    packed = blocks(nodes, k, least, rows)
    met = tiles(packed).groupBy("grp", F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.max(F.col("a") < F.col("b")).alias("a_wants"), F.max(F.col("a") > F.col("b")).alias("b_wants"))
    left, right = _sides(packed, met.withColumnsRenamed({"_a": "a", "_b": "b"}))
    own = packed.select(F.explode(F.arrays_zip("src", "dst", "score", "cos")).alias("r")).select("r.*")
    found = own.unionByName(left.cogroup(right).applyInArrow(_compare(k), FOUND))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
