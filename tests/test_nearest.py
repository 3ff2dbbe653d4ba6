"""The exact best k of each context against all pairs, with ties, several blocks, and blocks that bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nearest


def rows_of(n, dims, seed, centres=None, spread=1.0):
    rng = np.random.default_rng(seed)
    at = np.zeros((n, dims)) if centres is None else 4 * np.random.default_rng(9).standard_normal((centres, dims))[rng.integers(0, centres, n)]
    v = at + spread * rng.standard_normal((n, dims))
    return [(i, int(i % 3), v[i].tolist(), float(rng.integers(0, 5)) / 50) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp long, v array<double>, bonus double").repartition(3)


def brute(rows, k, least=-9.0):
    out = []
    for i, g, v, _ in rows:
        scored = []
        for j, h, w, b in rows:
            if g is not None and g == h and i != j:
                length = np.linalg.norm(v or []) * np.linalg.norm(w or [])
                cos = round(float(np.dot(v, w) / length), 9) if v and w and len(v) == len(w) and length else 0.0
                scored.append((-round(cos + b, 9), j, cos))
        out += [(i, j, r + 1, c, -s) for r, (s, j, c) in enumerate(sorted(scored)[:k]) if -s >= least]
    return sorted(out)


def got(spark, rows, k, least=None, size=nearest.ROWS):
    return sorted(map(tuple, nearest.nearest(frame(spark, rows), k, least, size).select("src", "dst", "rank", "cos", "score").collect()))


def same(found, want):
    assert [f[:3] for f in found] == [w[:3] for w in want] and np.allclose([f[3:] for f in found], [w[3:] for w in want], atol=2e-9)


@pytest.mark.parametrize("size", [nearest.ROWS, 16])
def test_best_of_each_context(spark, size):
    rows = rows_of(150, 8, 1)
    rows += [(200 + i, 1, rows[4][2], 0.02) for i in range(12)]  # ties
    rows += [(300, 1, [0.0] * 8, 0.0), (301, 1, None, 0.5), (302, 1, [1.0, 2.0], 0.1), (303, 1, [2.0, 4.0], 0.1), (304, None, [1.0] * 8, 0.1), (305, 7, [1.0] * 8, 0.1), (306, 1, [], 0.2)]
    same(got(spark, rows, 4, size=size), brute(rows, 4))
    same(got(spark, rows, 3, 0.4, size), brute(rows, 3, 0.4))


def test_few_rows(spark):
    assert got(spark, [], 4) == []
    for rows in ([(1, 1, [1.0], 0.0)], [(1, 1, [1.0], 0.0), (2, 1, [1.0], 0.0), (3, 2, [1.0], 0.0)]):
        same(got(spark, rows, 4), brute(rows, 4))


def test_bounds_leave_blocks_out(spark):
    """Rows that lie in clusters: far fewer pairs are scored than there are, and more than proportionally fewer of more."""
    shares = []
    for n in (400, 1600):
        rows = [(i, 1, v, 0.0) for i, _, v, _ in rows_of(n, 12, 3, centres=16, spread=0.05)]
        packed = nearest.blocks(frame(spark, rows), 3, None, 25)
        inner = packed.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        across = nearest.tiles(packed).agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
        shares.append((inner + across) / n**2)
    assert shares[0] < 0.6 and shares[1] < 0.8 * shares[0]
    same(got(spark, rows[:300], 3, size=25), brute(rows[:300], 3))
