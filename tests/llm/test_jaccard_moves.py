"""What the Jaccard join moves between tasks."""

from tessera.llm import jaccard


def test_rows_are_picked_by_keys_without_a_shuffle_of_the_rows(spark):
    keys = [0, 127, 128, 255, 256, 1 << 16, (7 << 40) + 3]
    rows = spark.createDataFrame([(k, b"x" * 10) for k in [*keys, 1, 129, (1 << 16) + 256]], "key long, tokens binary")
    ids = spark.createDataFrame([(k,) for k in [*keys, *keys, 99, None]], "id long")
    picked = jaccard._among(rows, "key", ids, "id")
    assert sorted(r.key for r in picked.collect()) == keys and picked.columns == ["key", "tokens"]
    assert jaccard._among(rows, "key", ids.limit(0), "id").count() == 0
    plan = picked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # that of the keys


def test_a_class_gets_of_a_list_only_what_it_may_link_to(spark, monkeypatch):
    """Class 1 looks up a list with an entry of its own component, of a smaller one, of a size that can't link, and one that can."""
    postings = spark.createDataFrame([(t, i, n, n, n) for t in range(8) for i, n in ((1, 8), (2, 8), (3, 8), (4, 50), (5, 9))], "token long, id long, n int, have int, prefix int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4), (7, 4)], "id long, label long")
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: df)
    seen = spark.sparkContext.accumulator(0)
    count = jaccard._count_shared

    def counted(table):
        seen.add(sum(len(x) for x in table.column("list").to_pylist()))
        return count(table)

    monkeypatch.setattr(jaccard, "_count_shared", counted)
    found = {(r.a, r.b) for r in jaccard._cross_pairs(postings, labels).collect()}
    assert found == {(1, 5), (2, 5), (3, 1), (3, 2), (3, 5)} and seen.value == 8 * 5
