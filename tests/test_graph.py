import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, memory, state
from tessera.operators.components import connected_components
from tessera.plans.graph_queries import pair_strategies, path_proximity


def test_path_proximity(spark):
    rows = [(["p", "s", "1"], ["p", "s", "2"], 2 / 3), (["p", "s", "1"], ["p", "t", "1"], 1 / 3), (["p"], ["q"], 0.0), ([], ["q"], 0.0), (["p", "s"], ["p", "s", "1"], 2 / 3 / 1.25)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in rows], "a array<string>, b array<string>, w double")
    assert all(math.isclose(r[0], r[1]) for r in df.select(path_proximity(F.col("a"), F.col("b")), "w").collect())


def test_position_scores(spark):
    df = spark.createDataFrame([(1, 3, 4, "u", "u", 0.0), (1, 3, 12, "u", "a", 0.5)], "conv int, a_turn int, b_turn int, a_role string, b_role string, cos double")
    got = {(r.b_turn, r.strategy): r.score for r in pair_strategies(df, F.lit(0.55)).collect()}
    assert got[4, "position_only"] == 0.5 and got[12, "position_only"] == 0.1
    assert math.isclose(got[12, "cam_style"], 0.55 * 0.5 + 0.45 * 0.1)


def test_edge_rules(spark):
    rows = [
        (["X"], ["X", "Y"], ["system", "report"], ["system"], 0.9), ([], [], ["graph", "film", "node"], ["graph", "film", "node"], 0.9), ([], [], ["system", "report"], ["system", "report"], 0.0),
        ([], [], ["graph"], ["graph"], 0.5), ([], [], ["graph"], ["graph"], 0.1),
    ]
    df = spark.createDataFrame(rows, "a_ents array<string>, b_ents array<string>, a_kw array<string>, b_kw array<string>, cos double")
    got = [(r.relation_type, round(r.weight, 6)) for r in state.edge_rule(df).collect()]
    assert got == [("shared_entity", 0.67), ("keyword_overlap", 0.51), (None, 0.0), ("embedding_similarity", 0.5), (None, 0.0)]


def test_edge_upsert_keeps_the_larger_weight(spark):
    schema = "s string, t string, r string, weight double"
    old = spark.createDataFrame([("a", "b", "x", 0.5), ("b", "a", "x", 0.9)], schema)
    new = spark.createDataFrame([("a", "b", "x", 0.3), ("a", "b", "x", 0.7), ("c", "a", "x", 0.1)], schema)
    got = {(r.s, r.t): (r.weight, r.action) for r in state.upsert_edges(old, new, ["s", "t", "r"]).collect()}
    assert got == {("a", "b"): (0.7, "updated"), ("b", "a"): (0.9, "kept"), ("c", "a"): (0.1, "created")}


def test_usage_counts_repeats(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 0)], "id string, usage long")
    touched = spark.createDataFrame([("a", 5), ("a", 7)], "id string, at long")
    got = {r.id: (r.usage, r.last_accessed) for r in state.fold_usage(nodes, touched, "id", "at").collect()}
    assert got == {"a": (3, 7), "b": (0, None)}


def test_activation_and_feedback_are_clamped(spark):
    e = spark.createDataFrame([("a", "b", 0.99, 0), ("b", "c", 0.012, 0)], "src string, dst string, weight double, activations long")
    used = spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string")
    got = {r.src: (r.weight, r.activations) for r in state.activate(e, used).collect()}
    assert got["a"] == (1.0, 2) and got["b"] == (0.012, 0)
    fb = spark.createDataFrame([("a", "b", True), ("a", "b", False), ("b", "c", False)], "src string, dst string, support boolean")
    got = {r.src: round(r.weight, 6) for r in state.adjust(e, fb).collect()}
    assert got == {"a": 0.996, "b": 0.01}


def test_path_edges(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "q int, path array<int>")
    assert sorted((r.q, r.src, r.dst) for r in state.path_edges(df, ["q"]).collect()) == [(1, 1, 2), (1, 2, 3)]


def walk(edges, seeds, base, hops):
    """The queue-based expansion, one query at a time."""
    from collections import deque

    und = sorted([(s, t, s, t, w) for s, t, w in edges] + [(t, s, s, t, w) for s, t, w in edges], key=lambda e: (e[2], e[3]))
    best, signals = {n: ([n], 0.0) for n in {*base, *seeds}}, []
    queue = deque((s, [s], 0.0, 0) for s in seeds)
    while queue:
        node, path, g, depth = queue.popleft()
        if depth >= hops:
            continue
        for at, nxt, _, _, w in und:
            if at != node or nxt in path:
                continue
            score = g + w / (depth + 1)
            signals.append((nxt, tuple([*path, nxt]), round(score, 9)))
            if nxt not in best or score > best[nxt][1]:
                best[nxt] = ([*path, nxt], score)
                queue.append((nxt, [*path, nxt], score, depth + 1))
    return sorted(signals), {n: (tuple(p), round(g, 9)) for n, (p, g) in best.items()}


def test_expansion_is_the_queues(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.5), (1, 3, 0.2), (3, 4, 0.7), (4, 1, 0.1), (2, 4, 0.4), (5, 2, 0.3), (2, 1, 0.85)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    start = spark.createDataFrame([(0, 1, 1), (0, 3, 2)], "q long, node long, rank int")
    base = spark.createDataFrame([(0, 5)], "q long, node long")
    signals, best = graph.expand(start, base, graph.neighbours(e), 3)
    want_signals, want_best = walk(edges, [1, 3], [5], 3)
    assert sorted((r.node, tuple(r.path), round(r.g, 9)) for r in signals.collect()) == want_signals
    assert {r.node: (tuple(r.path), round(r.g, 9)) for r in best.collect()} == want_best


def test_dense_paths_score_below_sparse_ones(spark):
    rows = [(0, 1, 0.7, 1, "shared_entity", 0)] + [(0, 2, 0.7, 1, "shared_entity", 0)] * 24
    df = spark.createDataFrame(rows, "q int, node int, g double, depth int, relation string, activations int")
    f = {r.node: r for r in graph.path_features(df).collect()}
    assert math.isclose(f[1].path_support, math.log(1.9)) and f[2].path_support == 1.0
    assert math.isclose(f[2].noise, 0.035 * math.log(13)) and f[1].noise == 0.0
    s = spark.createDataFrame([(1, 0.5, 0.7, 0, 0.86), (2, 0.5, 0.7, 0, 0.86)], "node int, cos double, g double, usage long, conf double").join(graph.path_features(df), "node")
    weak = graph.relation_noise(df.where("node = 1"), spark.createDataFrame([("shared_entity", 0.87)], "relation string, noise_rate double")).first()
    assert math.isclose(weak.relation_noise, 0.32 * 0.08)
    assert {r.node for r in s.where(graph.rerank(s, "semantic_heavy") > 0).collect()} == {1, 2}


def test_pagerank_loses_dangling_mass(spark):
    p = spark.createDataFrame([("g", 0, 1, 0.5), ("g", 0, 2, 0.5), ("h", 9, 8, 1.0)], "part string, q int, node int, p double")
    e = spark.createDataFrame([("g", 1, 2, 0.4), ("g", 2, 0, 0.4)], "part string, src int, dst int, weight double")
    for rows in (400_000, 1):
        got = {r.node: r.rank for r in graph.pagerank(p, e, "part", rows=rows).collect()}
        assert math.isclose(got[8], 0.22) and len(got) == 3
    assert math.isclose(got[1], 0.11) and math.isclose(got[2], 0.11 + 0.78 * 0.11)


def test_rescue(spark):
    base = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "q int, node int, rank int")
    gold = spark.createDataFrame([(0, 1), (0, 3)], "q int, node int")
    edges = spark.createDataFrame([(1, 3, 0.9)], "src int, dst int, weight double")
    every = spark.createDataFrame([(0, n) for n in (1, 2, 3)], "q int, node int")
    r = graph.rescue_metrics(graph.rescue(base, gold, edges, every), []).first()
    assert (r.baseline_hits, r.rescued, r.eligible, r.rescue_precision, r.recall_gain) == (1, 1, 1, 1.0, 0.5)


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([("p", 0, 1, 1, [1]), ("p", 0, 2, 2, [1, 2])], "k string, q int, node int, rank int, path array<int>")
    gold = spark.createDataFrame([(0, 2), (0, 9)], "q int, node int")
    m = graph.ranking_metrics(hits, gold, hits.select("k", "q"), 2, ["k"]).first()
    assert (m.evidence_recall, m.precision_at_k, m.mrr, m.graph_path_support_hits) == (0.5, 0.5, 0.5, 1)
    assert math.isclose(m.ndcg_at_k, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert {r.id: r.label for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert connected_components(e.limit(0)).count() == 0


def test_insight_clusters(spark):
    df = spark.createDataFrame([(1, ["film", "a1"]), (2, ["b2", "film"]), (3, ["soccer"]), (4, ["soccer", "film"]), (5, ["answer", "zz"])], "id int, kw array<string>")
    assert {r.id: r.cluster for r in memory.insight_clusters(df, "id", "kw").collect()} == {1: "film", 2: "film", 3: "soccer", 4: "soccer"}
    lone = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "id int, kw array<string>")
    assert {r.cluster for r in memory.insight_clusters(lone, "id", "kw").collect()} == {"general"}


def test_greedy_clusters(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.95, 0.05]), (0, 3, [0.0, 1.0]), (0, 4, [0.05, 0.95])], "g int, id int, v array<double>")
    assert {r.id: r.cluster for r in memory.greedy_clusters(df, "g", "id", "v").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_hybrid_score(spark):
    df = spark.createDataFrame([(0.9986, ["film", "actor"], ["film", "actor"], ["e"], ["f"], "x", "x")], "c double, ka array<string>, kb array<string>, ea array<string>, eb array<string>, a string, b string")
    got = df.select(memory.hybrid_score(*[F.col(c) for c in df.columns])).first()[0]
    assert math.isclose(got, 0.35 * 0.9986 + 0.35 + 0.10)


def test_bridges_and_delta(spark):
    u = spark.createDataFrame([("p1", "a", "method:graph"), ("p2", "b", "method:graph"), ("p2", "c", "method:x")], "object string, unit string, entity string")
    assert memory.entity_bridges(u).count() == 2
    old = spark.createDataFrame([("login", "v1"), ("same", "s")], "unit string, text string")
    new = spark.createDataFrame([("login", "v2"), ("test_login", "t"), ("same", "s")], "unit string, text string")
    assert {r.unit: r.change for r in memory.delta(old, new, ["unit"], "text").collect()} == {"login": "updated", "test_login": "added", "same": "same"}


def test_judge_policies(spark):
    df = spark.createDataFrame([("keyword_overlap", []), ("shared_entity", ["X"])], "r string, s array<string>")
    for policy, want in (("off", [False, False]), ("all", [True, True]), ("risky", [True, False])):
        assert [x[0] for x in df.select(state.judge_wanted(F.col("r"), F.col("s"), policy)).collect()] == want
    with pytest.raises(ValueError):
        state.judge_wanted(F.col("r"), F.col("s"), "some")
    assert df.select(F.round(state.judged(F.lit(0.8), F.lit(0.5)), 6)).first()[0] == 0.68


def test_reconstruction_metrics(spark):
    held = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["b"], "x"), (3, ["c"], "y"), (4, [], None)], "id int, ev array<string>, answer string")
    groups = spark.createDataFrame([("all", 1, 1), ("all", 1, 2), ("all", 1, 3), ("all", 1, 4), ("each", 1, 1), ("each", 2, 2), ("each", 3, 3), ("each", 4, 4), ("pair", 1, 1), ("pair", 1, 2)], "strategy string, g int, id int")
    got = {r.strategy: r for r in memory.reconstruction_metrics(held, groups, ["none", "all", "each", "pair"]).collect()}
    assert (got["none"].units, got["none"].compression_ratio, got["none"].evidence_coverage, got["none"].quality) == (4, 1.0, 0.0, round(0.1 / 3, 6))
    assert (got["all"].units, got["all"].redundancy, got["all"].support_trace, round(got["all"].answer_consistency, 4)) == (1, 0.0, 1.0, 0.6667)
    assert (got["each"].trace_edges, round(got["each"].redundancy, 4), got["each"].average_group_size) == (4, 0.25, 1.0)
    assert (got["pair"].covered, got["pair"].full_trace, round(got["pair"].trace_noise, 4), got["pair"].answer_consistency) == (0.5, 1.0, 0.5, 1.0)


def test_rescue_walk_counts_every_step_against_its_seed(spark):
    edges = [("s", "a", 0.9), ("s", "b", 0.8), ("s", "q", 0.99), ("a", "b", 0.7), ("a", "c", 0.6), ("a", "s", 0.5), ("b", "d", 0.9), ("c", "e", 0.9), ("t", "far", 0.9), ("t", "a", 0.2)]
    cos = {"a": 0.5, "b": 0.5, "c": 0.5, "d": 0.5, "e": 0.5, "s": 0.9, "far": 0.01}
    scored = lambda pairs: pairs.join(spark.createDataFrame(list(cos.items()), "node string, cos double"), "node")
    run = lambda hops, budget: graph.rescue_walk(spark.createDataFrame([("q", "s", 1), ("q", "t", 2)], "q string, seed string, rank int"), spark.createDataFrame(edges, "src string, dst string, weight double"), scored, hops, budget, 0.05)
    steps = lambda df: [(r.seed, ">".join(r.path)) for r in df.orderBy("seed", "depth", "ord").collect()]
    assert steps(run(1, 9)) == [("s", "s>a"), ("s", "s>b"), ("t", "t>a")]
    assert steps(run(2, 3)) == [("s", "s>a"), ("s", "s>b"), ("s", "s>a>b"), ("t", "t>a"), ("t", "t>a>b"), ("t", "t>a>c")]
    assert steps(run(3, 5))[:5] == [("s", "s>a"), ("s", "s>b"), ("s", "s>a>b"), ("s", "s>a>c"), ("s", "s>b>d")]
    assert steps(run(3, 7))[5:7] == [("s", "s>a>b>d"), ("s", "s>a>c>e")]
