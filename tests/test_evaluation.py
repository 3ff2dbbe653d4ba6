from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import evaluation


def test_lexical_score_of_no_terms_is_zero(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), (["a"], [])], "q array<string>, n array<string>")
    assert [r[0] for r in rows.select(evaluation.lexical_score(F.col("q"), F.col("n"))).collect()] == [0.5, 0.0, 0.0]


def test_cost_effect(spark):
    rows = spark.createDataFrame([("plain", 10, 100, 1.0, 2, 4), ("other", 5, 100, 0.5, 4, 4), ("none", 0, 50, 0.0, 0, 0)], "strategy string, edges long, candidate_pairs long, seconds double, found long, wanted long")
    got = {r.strategy: r for r in evaluation.cost_effect(rows, "plain").collect()}
    assert got["plain"].cost_index == 1.0 and got["plain"].score == 0.25 and got["plain"].gain == 0
    assert abs(got["other"].cost_index - 0.65) < 1e-12 and abs(got["other"].balanced_score - 0.9025) < 1e-12 and got["other"].gain == 0.5
    assert got["none"].recall is None


def test_leaks_are_parts_and_not_substrings(spark):
    rows = spark.createDataFrame([(1, ["a", "q1"]), (2, ["a", "q10"]), (3, ["q1", "q2"]), (4, None)], "id int, path array<string>")
    ids = spark.createDataFrame([("q1",), ("q2",), ("q1",)], "id string")
    assert evaluation.leaks(rows, "id", "path", ids).collect() == [(4, 2)]
    assert evaluation.leaks(rows.limit(0), "id", "path", ids).collect() == [(0, 0)]


def test_json_object(spark):
    rows = spark.createDataFrame([('```json\n{"a": {"b": 1}}\n```',), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.json_object(F.col("t"))).collect()] == ['{"a": {"b": 1}}', "", None]


def test_analogy_signal_is_bounded(spark):
    score, boost = evaluation.analogy_signal(F.lit(5.0), F.lit(1.0))
    assert spark.range(1).select(score, boost).collect() == [(1.0, 0.16)]
