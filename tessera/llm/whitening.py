"""Whitening of embeddings: principal components by matrix-free block subspace iteration.

Vectors become whole numbers, packed in blocks in the shared folder. A pass over the blocks multiplies a block of columns Q
by the covariance without forming it: tasks centre their rows and add up X'(XQ), Spark sums the parts. The driver, which
only ever holds d x b numbers, takes Rayleigh-Ritz pairs from Q'(VQ), measures their residuals |Vq - eq| and
orthonormalises VQ by QR for the next pass, until all k pairs have residuals below `TOLERANCE` of the largest eigenvalue.
The rate of convergence is that of eigenvalue b+1 to k. Where the residuals seen say that more than `PATIENCE` passes are
still to come, the block is doubled, in the end to all d columns, with which one pass is enough; so flat spectra cost few
passes too.

Centred rows are (n*x - S) / n: the integer numerator is exact, also where it takes more than 64 bits.

Defined results: vectors that are null or hold null or non-finite entries are left out, as are those of other lengths than
most have (of equally common ones, the longest counts). Scaled entries beyond 2**43 are held there; a deviation beyond 64
bits is null. Components of an eigenvalue of 0 (up to rounding) can't be whitened and don't appear: constant or single
vectors give no rows. Null and repeated vec_ids stay; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_materialize
from .vectors import finite_rows, whole

COMPONENTS = 8
#: Residuals, as parts of the largest eigenvalue, that certify a component; the eigenvector's error is this over its gap.
TOLERANCE = 1e-13
#: Passes to come, by the rate seen, that the present block is kept for.
PATIENCE = 12
_MOST = 1 << 43
_NOTHING = 1e-12
BLOCKS = "ids array<long>, n long, dims int, x binary"
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def pack(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 1024, shift: int = 100000) -> DataFrame:
    """Blocks of whole-number vectors floor(scale * c) + shift, of one length each. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, c in finite_rows(b.column(1)):
                with np.errstate(over="ignore"):
                    x = whole(scale * c, _MOST) + shift
                ids = b.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([len(rows)], pa.int64()), pa.array([c.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "n", "dims", "x"])

    return map_materialize(df.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).alias("v")), run, BLOCKS, "vectors")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i], np.frombuffer(b.column(3)[i].as_py(), np.int64).reshape(-1, b.column(2)[i].as_py())


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: 64-bit integers or, if they may not hold it, Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(numerators: np.ndarray, n: int) -> np.ndarray:
    return (numerators / n).astype(np.float64)


def column_sums(blocks: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches):
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dims), pa.int32()), "s": pa.array(x.sum(axis=0), pa.int64())})

    found = blocks.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(found, key=lambda r: r.i)]


def _summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks' part(x), matrices of the shape: added up in each task, then by Spark, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    sums = blocks.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(shape[1])]).alias("v")).collect()
    out = np.zeros(shape)
    for r in sums:
        out[r.i] = r.v
    return out


@dataclass
class Whitening:
    """n and S of the fit list; unit eigenvectors in columns by falling eigenvalue; the trace of the covariance; passes and block it took."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    block: int


def subspace_iteration(multiply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(eigenvalues, eigenvectors, passes, block) of the k largest of a symmetric operator, given as Q -> VQ."""
    rng = np.random.default_rng(0)
    k, b = min(k, dims), min(dims, block or 3 * k)
    q = np.linalg.qr(rng.standard_normal((dims, b)))[0]
    passes, seen = 0, []
    while True:
        y = multiply(q)
        passes += 1
        t = q.T @ y
        values, w = np.linalg.eigh((t + t.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        ritz, image = q @ w, y @ w
        worst = np.linalg.norm((image - ritz * values)[:, :k], axis=0).max(initial=0.0)
        if worst <= TOLERANCE * max(abs(values[0]), np.finfo(float).tiny) or (b == dims and len(seen) >= 3):
            return values[:k], ritz[:, :k], passes, b
        seen.append(worst)
        if len(seen) >= 3 and b < dims:
            rate = max(seen[-1] / seen[-3], 0.0) ** 0.5
            if rate >= 1 or np.log(TOLERANCE * values[0] / worst) / np.log(rate) > PATIENCE:
                image = np.hstack([image, rng.standard_normal((dims, min(b, dims - b))) * np.linalg.norm(image[:, 0])])
                b, seen = image.shape[1], []
        q = np.linalg.qr(image)[0]


def fit(blocks: DataFrame, k: int = COMPONENTS, block: int | None = None) -> Whitening | None:
    """The first k components of the blocks' rows, all of one length; None if there are no rows."""
    first = blocks.agg(F.max("dims").alias("d"), F.sum("n").alias("n")).first()
    if not first.n or not first.d:
        return None
    n, dims = int(first.n), int(first.d)
    sums = column_sums(blocks, dims)

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(_numerators(x, n, sums), n)
            return c.T @ (c @ q)

        return _summed(blocks, part, q.shape) / n

    trace = _summed(blocks, lambda x: np.array([[np.square(_centred(_numerators(x, n, sums), n)).sum()]]), (1, 1))[0, 0] / n
    if not trace:
        return None
    values, vectors, passes, b = subspace_iteration(multiply, dims, k, block)
    real = values > _NOTHING * values[0]
    return Whitening(n, sums, vectors[:, real], values[real], float(trace), passes, b)


def _projected(numerators: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(numerators, model.n) @ (model.vectors / np.sqrt(model.values))


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the whitened rows' covariance less the identity."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = _projected(_numerators(x, model.n, model.sums), model)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(blocks, part, (k + 1, k)) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def most_common_length(blocks: DataFrame) -> DataFrame:
    best = blocks.groupBy("dims").agg(F.sum("n").alias("n")).agg(F.max(F.struct("n", "dims")).alias("b")).first().b
    return blocks.where(F.col("dims") == F.lit(best.dims if best else -1))


def whiten(df: DataFrame, k: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 1024, shift: int = 100000) -> DataFrame:
    """ROWS: for each vector and component its whitened coordinate, with figures of the row and of the whole."""
    blocks = most_common_length(pack(df, vector, vec_id, scale, shift))
    model = fit(blocks, k)
    if model is None:
        return df.sparkSession.createDataFrame([], ROWS)
    error, count = identity_error(blocks, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            num = _numerators(x, model.n, model.sums)
            white, n = _projected(num, model), len(x)
            small = num.dtype != object and int(np.abs(num).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63
            deviation = np.square(num if small else num.astype(object)).sum(axis=1).tolist()
            each = lambda a, kind: pa.array(np.repeat(np.asarray(a, object), count), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    each(ids.as_py(), pa.int64()), pa.array(np.tile(np.arange(1, count + 1), n), pa.int32()), pa.array(np.full(n * count, model.n), pa.int64()),
                    each([d if d < 1 << 63 else None for d in deviation], pa.int64()), pa.array(white.ravel()), pa.array(np.tile(model.values / model.trace, n)), pa.array(np.full(n * count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return blocks.mapInArrow(run, ROWS)
