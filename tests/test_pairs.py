"""Cosines of given pairs against the column expression, and what they move."""

from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators.pairs import cosines


def test_cosines_are_those_of_the_expression_and_vectors_do_not_go_with_pairs(spark):
    odd = {3: None, 5: [], 7: [0.0] * 4, 9: [1.0, 2.0], 11: [1.0, None, 2.0, 3.0]}
    rows = [(i, i % 2, odd.get(i, [((i * 7 + k * 13) % 11 - 5) / 3.0 for k in range(4)]), i, 0.86) for i in range(60)]
    rows += [(4, 0, [0.5, 0.1, 0.2, 0.3], 1, 0.5), (99, None, [1.0] * 4, 0, 0.86)]  # a repeated id, and one without a context
    nodes = spark.createDataFrame(rows, "id long, grp int, v array<double>, usage long, conf double").withColumn("norm", vectors.norm(F.col("v")))
    pairs = spark.createDataFrame([(a, b, [a, b]) for a in range(64) for b in range(64) if a % 2 == b % 2] + [(2, 4, [2, 0, 4])], "q long, node long, path array<long>")
    a, b = nodes.select(F.col("id").alias("q"), F.col("v").alias("_a")), nodes.select(F.col("id").alias("node"), F.col("v").alias("_b"), "usage", "conf")
    want = pairs.join(a, "q").join(b, "node").select("q", "node", "path", vectors.cosine(F.col("_a"), F.col("_b")).alias("cos"), "usage", "conf")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for size in (7, 1000):
        got = cosines(pairs, nodes, rows=size)
        assert got.columns == want.columns and key(got) == key(want)
    assert cosines(pairs.limit(0), nodes).count() == 0 == cosines(pairs, nodes.limit(0)).count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "node" in line for line in plan.splitlines())  # no pair is joined by its other end
