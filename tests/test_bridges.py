"""The best k over two bridges against all that objects.bridge_walk reaches."""

import random

import numpy as np

from tessera.operators import bridges, objects


def test_search_against_the_walk(spark):
    """Blocks and batches of few rows; units of one, two and more objects behind an entity, some without entities; queries with one seed or two."""
    rng = random.Random(5)
    held = {i: (i // 3, sorted({min(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randrange(3))})) for i in range(60)}
    x = np.random.default_rng(5).standard_normal((60, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seeds = [(q, n, r + 1) for q in range(0, 60, 3) for r, n in enumerate(rng.sample([q + 1, q + 2], 1 + (q % 2)))]
    walk = objects.bridge_walk(spark.createDataFrame(seeds, "q long, node long, rank int"), spark.createDataFrame([(i, o, e) for i, (o, es) in held.items() for e in es], "id long, object long, entity long"), 2)
    rows = {(r.q, r.node): (r.path, r.g, round(float(x[r.q] @ x[r.node]), 9)) for r in walk.collect()}
    idx = [0, 1, 2, 3]
    asked = [(q, held[q][0], idx, x[q].tolist(), [(r, n, held[n][1]) for p, n, r in seeds if p == q]) for q in sorted({s[0] for s in seeds})]
    queries = spark.createDataFrame(asked, "q long, object long, idx array<int>, val array<double>, seeds array<struct<rank:int,node:long,ents:array<long>>>")
    units = spark.createDataFrame([(i, o, idx, x[i].tolist(), es) for i, (o, es) in held.items()], "id long, object long, idx array<int>, val array<double>, ents array<long>")
    score = lambda p, g, c: round(0.52 * c + 0.36 * g + (0.12 if len(p) > 1 else 0.0) + 0.03 * 0.86, 9)
    want = {q: sorted((-score(*row), n) for (p, n), row in rows.items() if p == q)[:4] for q, *_ in asked}
    got = bridges.search(queries, units, 4, 0.86, 4, rows=7, batch=16).collect()
    for r in got:
        path, g, cos = rows[r.q, r.node]
        assert (r.path, round(r.g, 9), r.cos) == (path, round(g, 9), cos)
    assert {q: sorted((-score(r.path, r.g, r.cos), r.node) for r in got if r.q == q)[:4] for q in want} == want
    assert any(len(r.path) == 3 for r in got) and any(len(r.path) == 2 for r in got) and len(got) <= 6 * len(want)


def test_links_are_read_and_not_copied_to_blocks(spark):
    """What a block needs of the links grows with the links, so moving it grows with links times blocks: only queries are moved. Pieces and batches of any size find the same."""
    idx, x = [0, 1], np.random.default_rng(3).standard_normal((40, 2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    units = [(i, i // 2, idx, x[i].tolist(), [i % 5, 5 + i % 7]) for i in range(40)]
    asked = [(i, i // 2, idx, x[i].tolist(), [(1, i + 1, units[i + 1][4])]) for i in range(0, 40, 2)]
    given = spark.createDataFrame(asked, "q long, object long, idx array<int>, val array<double>, seeds array<struct<rank:int,node:long,ents:array<long>>>"), spark.createDataFrame(units, "id long, object long, idx array<int>, val array<double>, ents array<long>")
    found = bridges.search(*given, 3, 0.86, 2, rows=4, batch=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(found.collect()) == sorted(bridges.search(*given, 3, 0.86, 2).collect())
