"""Walks over edges made on the way, settings, and the state between rounds, on a context small enough to follow by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators.retrieval import SETTINGS, Setting


@pytest.fixture(scope="module")
def nodes(spark):
    """q asks; a is like it; a and b share an entity, b and c two keywords, d nothing; s sums up the context; x is of another one."""
    row = lambda i, o, kw, ents, v, ctx=1, top=False: (i, ctx, o, top, kw, ents, [float(x) for x in v], 0, 0.5)
    rows = [
        row("q", 0, ["k"], [], [1, 0, 0, 0]), row("a", 1, ["u"], ["E"], [0.9, 0.43588989, 0, 0]), row("b", 2, ["m", "n"], ["E"], [0, 0, 1, 0]), row("c", 3, ["m", "n"], [], [0, 0, 0, 1]), row("d", 4, ["z"], [], [0.1, 0, 0.7, 0.7]),
        row("s", 99, ["m", "n"], [], [0, 1, 0, 0], top=True), row("x", 0, ["m", "n"], ["E"], [1, 0, 0, 0], ctx=2),
    ]
    return spark.createDataFrame(rows, "id string, ctx long, ord long, summary boolean, kw array<string>, ents array<string>, v array<double>, usage long, conf double")


def walked(nodes, setting, hops=2, k=2):
    asked = nodes.where("id = 'q'").select(F.col("id").alias("q"), "ctx", "v", "kw")
    cand = retrieval.candidates(asked, nodes, lambda: F.lit(0.0))
    vector = retrieval.hits(cand, setting.lexical, k)
    edges = retrieval.Edges(nodes.select(*retrieval.NODE))
    signals, best = retrieval.walk(vector.withColumn("seed", F.col("rank") == 1), hops if setting.use_graph else 0, nodes, edges if setting.on_demand else None, setting.summaries)
    rows = retrieval.scored(best, signals, cand, None, setting, "semantic_heavy")
    return retrieval.final(rows, vector, setting, k, 1), signals, edges


def paths(found):
    return {r.node: r.path for r in found.collect()}


def test_edges_are_made_around_the_walk_alone(nodes):
    found, signals, edges = walked(nodes, SETTINGS["full"], hops=1)
    assert {r.id for r in edges.around.collect()} == {"a"}
    made = {(r.src, r.dst, r.relation) for r in edges.made.collect()}
    assert ("a", "b", "shared_entity") in made and not any("x" in e[:2] for e in made) and all(e[0] == "a" for e in made)
    assert edges.cost().first().pairs_scored == 5  # the others of the context, its summary among them
    steps = signals.where("relation = 'shared_entity'").collect()
    assert {(r.src, r.dst) for r in steps} == {("a", "b"), ("b", "a")} and {r.node for r in steps} == {"b"}
    assert paths(found)["a"] == ["a"]


def test_context_edges_are_taken_from_seeds_alone(nodes):
    _, signals, edges = walked(nodes, SETTINGS["full"])
    assert {r.depth for r in signals.where("relation = 'context_cooccurrence'").collect()} == {1}
    assert signals.where("depth = 2 and relation = 'keyword_overlap' and node = 'c'").count() > 0
    assert signals.where("node = 's'").count() == 0 and edges.around.count() > 1


def test_settings(nodes):
    plain = paths(walked(nodes, SETTINGS["no_graph"])[0])
    assert all(len(p) == 1 for p in plain.values())
    single = walked(nodes, SETTINGS["no_multipath"], k=4)[0].collect()
    assert {r.n_paths for r in single} == {1} and {r.path_support for r in single} == {0.0}
    static = walked(nodes, SETTINGS["static_graph"])[1]
    assert {r.relation for r in static.collect()} == {"context_cooccurrence"}
    summed = walked(nodes, SETTINGS["with_summary"], k=6)[0]
    ranks = {r.node: r["rank"] for r in summed.collect()}
    assert max(ranks, key=ranks.get) == "s"  # summaries only fill up
    with_two = walked(nodes, Setting(vector_keep=2), k=2)[0].collect()
    assert all(r.anchor for r in with_two)


def test_a_round_is_folded_into_the_state(spark, nodes):
    found = spark.createDataFrame([("q", "b", ["a", "b"]), ("q", "c", ["a", "b", "c"]), ("p", "b", ["a", "b"]), ("p", "d", ["case:1", "d"])], "q string, node string, path array<string>")
    edges = spark.createDataFrame([("a", "b", 0.67, "shared_entity"), ("a", "b", 0.08, "context_cooccurrence"), ("b", "c", 0.51, "keyword_overlap"), ("c", "b", 0.51, "keyword_overlap")], "src string, dst string, weight double, relation string")
    after, active = retrieval.finalise(found, nodes, edges)
    assert {r.id: r.usage for r in after.collect()} == {"q": 0, "a": 0, "b": 2, "c": 1, "d": 1, "s": 0, "x": 0}
    assert {(r.src, r.dst, r.relation): r.n for r in active.collect()} == {("a", "b", "shared_entity"): 2, ("b", "c", "keyword_overlap"): 1}


def test_loans_of_cases(spark, nodes):
    best = spark.createDataFrame([("q", "a", ["a"], 0.0), ("q", "b", ["a", "b"], 0.9)], "q string, node string, path array<string>, g double")
    signals = spark.createDataFrame([], "q string, node string, path array<string>, g double, relation string, src string, dst string, depth int")
    loans = spark.createDataFrame([("q", "b", "case:1", 0.5, 0.76), ("q", "b", "case:2", 0.2, 0.76), ("q", "c", "case:2", 0.2, 0.62)], "q string, node string, case string, match double, conf double")
    more, merged = retrieval.lend(signals, best, loans)
    rows = {r.node: (r.path, round(r.g, 6), r.boost and round(r.boost, 6)) for r in merged.collect()}
    assert rows == {"a": (["a"], 0.0, None), "b": (["a", "b"], 0.9, 0.06), "c": (["case:2", "c"], round(0.72 * 0.2 + 0.18 * 0.62 + 0.1, 6), 0.024)}
    assert {(r.node, r.src) for r in more.collect()} == {("b", "case:1"), ("c", "case:2")}
