"""Walks across objects against walks over all their bridges; deliveries against a rebuild, and batches that run again."""

import random

from pyspark.sql import functions as F

from tessera.operators import objects
from tessera.operators.stored import folder
from tessera.streaming import ingest


def brute_walk(seeds, units, hops):
    """Breadth first over all pairs of units that share an entity."""
    held = {}
    for i, o, e in units:
        held.setdefault(i, (o, set()))[1].add(e)
    out = {}
    for q in {s[0] for s in seeds}:
        start = [n for _, n in sorted((r, n) for p, n, r in seeds if p == q)]
        best, queue = {n: ([n], 0.0) for n in start}, [(n, [n], 0.0) for n in start]
        for depth in range(hops):
            level, arrived = [], {}
            for u, path, g in queue:
                for v in sorted(held):
                    if u in held and held[u][0] != held[v][0] and held[u][1] & held[v][1] and v != q and v not in path:
                        arrived.setdefault(v, (path + [v], g + 0.72 / (depth + 1), queue.index((u, path, g))))
            for v in sorted(arrived, key=lambda v: (arrived[v][2], v)):
                path, g, _ = arrived[v]
                best[v] = (path, g)
                level.append((v, path, g))
            queue = level
        out |= {(q, n): (p, round(g, 6)) for n, (p, g) in best.items()}
    return out


def test_bridge_walk(spark):
    rng = random.Random(3)
    units = [(f"o{o}:{u}", f"o{o}", f"e{min(rng.randrange(9), rng.randrange(9))}") for o in range(9) for u in range(3) for _ in range(2)]
    ids = sorted({u[0] for u in units})
    seeds = [(q, n, r + 1) for q in ids[::4] + ["elsewhere"] for r, n in enumerate(rng.sample([i for i in ids if i != q], 3))]
    for hops in (0, 1, 2, 3):
        got = objects.bridge_walk(spark.createDataFrame(seeds, "q string, node string, rank int"), spark.createDataFrame(units + units[:5], "id string, object string, entity string").repartition(3), hops)
        assert {(r.q, r.node): (r.path, round(r.g, 6)) for r in got.collect()} == brute_walk(seeds, units, hops)


def test_a_walk_from_units_without_entities(spark):
    units = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x")], "id string, object string, entity string")
    got = objects.bridge_walk(spark.createDataFrame([("q", "a", 1), ("q", "lone", 2)], "q string, node string, rank int"), units, 2).collect()
    assert {(r.node, r.g) for r in got} == {("a", 0.0), ("lone", 0.0)}


def test_changed_units_and_hubs(spark):
    schema = "object long, unit long, version int, text string, entities array<string>"
    before = spark.createDataFrame([(1, 1, 0, "a", ["x", "y"]), (1, 2, 0, "b", ["x"]), (1, 3, 0, None, []), (2, 1, 0, "z", ["x"])], schema)
    batch = spark.createDataFrame([(1, 1, 1, "a2", ["x", "z"]), (1, 3, 1, None, []), (1, 4, 1, "n", ["q"]), (3, 1, 1, "", ["x"])], schema)
    after, delta = objects.changed_units(before, batch)
    assert {(r.object, r.unit): r.change for r in delta.collect()} == {(1, 1): "updated", (1, 2): "removed", (1, 3): "same", (1, 4): "added", (3, 1): "added"}
    assert {(r.object, r.unit, r.text) for r in after.collect()} == {(1, 1, "a2"), (1, 3, None), (1, 4, "n"), (2, 1, "z"), (3, 1, "")}
    assert {(r.object, r.unit, r.entity, r.op) for r in objects.changed_hubs(delta).collect()} == {(1, 1, "z", 1), (1, 1, "y", -1), (1, 2, "x", -1), (1, 4, "q", 1), (3, 1, "x", 1)}
    assert objects.changed_units(before, batch.limit(0))[1].collect() == []


def test_insertion_in_batches_equals_a_rebuild_and_may_run_again(spark):
    rng = random.Random(5)
    schema = "id string, ctx long, kw array<string>, ents array<string>"
    rows = [(f"n{i:02}", rng.choice([1, 1, 2, None]), rng.sample(["alpha", "beta", "gamma", "delta", "film", "data"], 3), rng.sample(["A", "B", "C", "D", "E", "F"], rng.randrange(2))) for i in range(30)]
    nodes = spark.createDataFrame(rows, schema)

    def edges_of(parts, again):
        log = ingest.Log(spark, folder(nodes), nodes.schema)
        work = ingest.insertion(log, lambda batch: batch)

        def process(batch, number):
            work(batch, number)
            if again:  # as after a failure that came before the stream's progress was written
                work(batch, number)

        ingest.replay(log, parts, process)
        return {(r.src, r.dst, r.relation, round(r.weight, 6)) for r in log.read("edges", ingest.EDGES).collect()}, log.read("edges", ingest.EDGES).count()

    parts = [nodes.where(F.col("id").between(a, b)) for a, b in (("n00", "n09"), ("n10", "n10"), ("n11", "n29"))]
    whole, n = edges_of([nodes], False)
    assert len(whole) == n > 20 and edges_of(parts, False) == (whole, n) == edges_of(parts, True)
    want = set()
    for i, c, k, e in rows:
        for j, d, l, f in rows:
            if i != j and c is not None and c == d:
                ents, kws = set(e) & set(f), set(k) & set(l) - {"film", "data"}
                if ents:
                    want.add((i, j, "shared_entity", round(min(0.95, 0.55 + 0.12 * len(ents)), 6)))
                elif len(kws) >= 2:
                    want.add((i, j, "keyword_overlap", round(min(0.85, 0.35 + 0.08 * len(kws)), 6)))
    assert whole == want
