"""Greedy clusters by components against the sequential walk, and the links that the components come from."""

import numpy as np
import pytest

from tessera.operators import memory, nearest
from tessera.operators.components import connected_components


def rows_of(seed, n=150, dims=5, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    rows = [(int(i), int(i % 2), (centres[rng.integers(0, 6)] * rng.uniform(0.2, 3) + spread * rng.standard_normal(dims)).tolist()) for i in rng.permutation(n)]
    return rows + [(n + i, 1, rows[0][2]) for i in range(20)] + [(n + 30, 0, [0.0] * dims), (n + 31, 0, [0.0] * dims), (n + 32, 9, [1.0] * dims)]


def sequential(rows, t=0.82):
    out = {}
    for g in {r[1] for r in rows}:
        sums, first = [], []
        for i, _, v in sorted(r for r in rows if r[1] == g):
            x = np.array(v)
            scores = [float(x @ s / ((np.linalg.norm(x) or 1) * (np.linalg.norm(s) or 1))) for s in sums]
            best = int(np.argmax(scores)) if scores else -1
            if best >= 0 and scores[best] >= t:
                sums[best] = sums[best] + x
            else:
                best = len(sums)
                sums.append(x)
                first.append(i)
            out[i] = first[best]
    return out


@pytest.mark.parametrize("size", [nearest.ROWS, 16])
def test_equals_the_sequential_clusters(spark, monkeypatch, size):
    monkeypatch.setattr(nearest.linked, "__defaults__", (size,))
    rows = rows_of(1) if size == 16 else rows_of(2)
    extra = [(None, 1, [1.0] * 5), (900, None, [1.0] * 5), (901, 1, None)]
    got = memory.greedy_clusters(spark.createDataFrame(rows + extra, "id long, grp int, v array<double>").repartition(3), "grp", "id", "v")
    found = {r.id: r.cluster for r in got.collect()}
    assert found == sequential(rows) and 10 < len(set(found.values())) < 120


def test_links_connect_what_all_pairs_do(spark):
    rows = rows_of(3, 120)
    frame = spark.createDataFrame(rows, "id long, grp int, v array<double>")
    found = {r.id: r.label for r in connected_components(nearest.linked(frame, 0.9, 16)).collect()}
    label = {i: i for i, _, _ in rows}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows}
    for _ in rows:
        for i, g, _ in rows:
            for j, h, _ in rows:
                if g == h and float(unit[i] @ unit[j]) >= 0.9:
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in label) and len(set(label.values())) <= len({found.get(i, i) for i in label}):
            break
    assert {i: found.get(i, i) for i in label} == label


def test_no_memories(spark):
    assert memory.greedy_clusters(spark.createDataFrame([], "id long, grp int, v array<double>"), "grp", "id", "v").collect() == []
