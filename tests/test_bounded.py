"""Counts, lookups and best k without the pairs that they are about."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import graph, hybrid, memory, nearest
from tessera.plans import base, graph_queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", ["typed_topk", "density_scores", "query_subgraph"])
def test_no_scores_of_all_pairs(spark, name, monkeypatch):
    monkeypatch.setattr(base, "sim", None)
    assert plans.QUERIES[name](spark, SF).limit(1).collect()


def test_evidence_by_counts(spark, tmp_path):
    """wanted_of() against all pairs, with a member that is evidence itself, a repeated row, a null group and a group of one."""
    rows = [(1, 0), (2, 0), (3, 0), (3, 0), (4, 1), (5, None)]
    spark.createDataFrame(rows, "vec_id long, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    buys = [(u, "purchase") for u in (1, 1, 3, 3, 3, 4, 4, 5, 5, 2)] + [(2, "view")]
    spark.createDataFrame(buys, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    good, want = {1, 3, 4, 5}, {}
    for (q, g), (node, h) in itertools.product(rows, rows):
        if g is not None and g == h and q != node and node in good:
            want[q] = want.get(q, 0) + 1
    assert {r.q: r.wanted for r in graph_queries.wanted_of(spark, str(tmp_path)).collect()} == want


def test_rescue_of_counts(spark):
    hits = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 1, 1)], "q long, node long, rank int")
    gold = spark.createDataFrame([(1, 2), (1, 4), (1, 9), (1, 8), (2, 9)], "q long, node long")
    edges = spark.createDataFrame([(2, 4, 0.5), (2, 3, 0.4), (1, 5, 0.3)], "src long, dst long, weight double")
    few = gold.where("node < 8")
    whole = sorted(graph.rescue(hits, gold, edges).collect())
    assert whole == sorted(graph.rescue(hits, few, edges, wanted=graph.evidence_counts(gold)).collect()) and whole[0].wanted == 4


def test_blocks_of_single_precision(spark):
    """Vectors of single precision move as such, others whole; either finds the same as it did."""
    x = np.random.default_rng(2).standard_normal((40, 6)).astype(np.float32).astype(float)
    for v, width in ((x, 4), (x / 3, 8)):
        nodes = spark.createDataFrame([(i, 1, r.tolist(), 0.0) for i, r in enumerate(v)], "id long, grp long, v array<double>, bonus double")
        packed = nearest.blocks(nodes, 2, None, 16)
        assert packed.where(F.length("x") != width * F.col("n") * F.col("dims")).count() == 0
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        cos = np.round(unit @ unit.T, 9) - 9 * np.eye(len(v))
        found = {(r.src, r["rank"]): r.dst for r in nearest.nearest(nodes, 2, None, 16).collect()}
        assert all(found[i, 1] == cos[i].argmax() for i in range(len(v)))


def test_most_shared(spark):
    """Against all pairs, on words of which some are in most cases; what is met stays far below the pairs."""
    rng = np.random.default_rng(5)
    rows = [(i, [f"w{w}" for w in set((rng.pareto(0.8, rng.integers(0, 7)) * 2).astype(int).clip(0, 40).tolist())]) for i in range(160)]
    rows += [(500 + i, ["w0", "w1", "w2"]) for i in range(60)]
    score = F.round(F.col("shared") / F.sqrt(F.col("n_a") * F.col("n_b")), 9)
    found = memory.most_shared(spark.createDataFrame(rows, "id long, kw array<string>"), "id", "kw", score, 3).collect()
    want = []
    for a, x in rows:
        scored = [(-round(len(set(x) & set(y)) / (len(x) * len(y)) ** 0.5, 9), b, len(set(x) & set(y))) for b, y in rows if a != b and set(x) & set(y)]
        want += [(a, b, n, r + 1) for r, (_, b, n) in enumerate(sorted(scored)[:3])]
    assert sorted((r.a, r.b, r.shared, r["rank"]) for r in found) == sorted(want)


def test_sets_of_cases_are_not_broadcast(spark, tmp_path):
    """A stored table of cases is small where the sets of its keywords, 255 a case, are not."""
    spark.createDataFrame([(i, [f"w{i % 7}", f"v{i % 5}"]) for i in range(50)], "id long, kw array<string>").write.parquet(f"{tmp_path}/cases")
    found = memory.most_shared(spark.read.parquet(f"{tmp_path}/cases"), "id", "kw", F.col("shared").cast("double"), 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 150


def test_hybrid_tiles(spark):
    """Pairs, sums and components of links over several blocks, some of them empty, against all pairs."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(70):
        v = rng.standard_normal(8)
        pick = lambda p, n, top: [f"{p}{x}" for x in dict.fromkeys(rng.integers(0, top, n).tolist())]  # noqa: B023, E731
        rows.append((i * 3, pick("k", int(rng.integers(0, 14)), 60), pick("e", int(rng.integers(0, 4)), 9), [None, "", "x", "y"][i % 4], (v / np.linalg.norm(v)).tolist()))
    given = spark.createDataFrame(rows, "id long, kw array<string>, ev array<string>, answer string, v array<double>")
    want = {}
    for (a, ka, ea, wa, va), (b, kb, eb, wb, vb) in itertools.combinations(rows, 2):
        if set(ka[:8]) & set(kb[:8]):
            share = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
            want[a, b] = 0.35 * max(0.0, float(np.dot(va, vb))) + 0.35 * share(ka, kb) + 0.2 * share(ea, eb) + 0.1 * bool(wa and wa == wb)
    for size in (10, 8192):
        found = {(r.a, r.b): r.score for r in hybrid.pairs(given, size).collect()}
        assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 2e-9 for p in want)
        got, linked = hybrid.links(given, 0.3, size).collect(), {p: s for p, s in want.items() if s >= 0.3}
        assert abs(sum(r.s for r in got if r.s is not None) - sum(linked.values())) < 1e-6

        def parts(edges):
            label = {r[0]: r[0] for r in rows}
            for a, b in edges:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
            return label

        assert parts([(r.a, r.b) for r in got if r.s is None]) == parts(linked)


def test_pagerank_of_similar(spark):
    """similar_pagerank() in chunks of queries against pagerank() over all pairs' priors."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((30, 4))
    nodes = spark.createDataFrame([(i, i % 2, x.tolist(), 0.5) for i, x in enumerate(v)] + [(90, 0, None, 0.5), (91, 5, [1.0], 0.5)], "id long, grp long, v array<double>, conf double")
    s = base.sim(nodes.selectExpr("*", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x)) AS norm", "0 AS usage"))
    e = base.top_edges(s, "cos").select("grp", "src", "dst", F.col("cos").alias("weight"))
    total = F.sum(F.greatest(F.lit(0.0), "cos")).over(Window.partitionBy("src"))
    priors = s.select("grp", F.col("src").alias("q"), F.col("dst").alias("node"), (F.greatest(F.lit(0.0), "cos") / F.when(total == 0, 1.0).otherwise(total)).alias("p"))
    want = {(r.q, r.node): r["rank"] for r in graph.pagerank(priors, e, "grp").collect()}
    found = {(r.q, r.node): r["rank"] for r in graph.similar_pagerank(nodes, e.drop("grp"), queries=4, cells=40).collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in want)


def test_contexts_are_stored_once_whatever_the_number_of_chunks(spark):
    """Contexts of several sizes in one folder or in their own: chunks are read, not shuffled, and find the same."""
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, f"g{(i % 9) % 4}", rng.standard_normal(3).tolist(), 0.5) for i in range(45)] + [(99, None, [1.0, 0.0, 0.0], 0.5)], "id long, grp string, v array<double>, conf double")
    e = spark.createDataFrame([(i, (i + 9) % 45, 0.5) for i in range(45)], "src long, dst long, weight double")
    whole = sorted(graph.similar_pagerank(nodes, e).collect())
    assert len(whole) == sum(n * (n - 1) for n in (15, 10, 10, 10))
    for chunk in (2, 6):
        found = graph.similar_pagerank(nodes, e, queries=chunk)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(found.collect())
        assert [r[:2] for r in got] == [r[:2] for r in whole] and np.allclose([r[2:] for r in got], [r[2:] for r in whole])
    assert graph.similar_pagerank(nodes.limit(0), e).count() == 0
