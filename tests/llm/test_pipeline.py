"""run() against its stages' brute-force versions on a small table."""

import os

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components, brute_hits, brute_passages

from tessera.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_do_as_the_brute_force_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5 and os.path.isdir(SF)
    (_, first), (_, second), (_, third), (_, fourth), (_, last) = corpus_pipeline.STAGES
    assert list(steps.values()) == [first, second, third, fourth, last]

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    one = first(spark, docs, SF).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {d for d, _ in rows} == good and one.columns == docs.columns

    two = second(spark, one, SF).cache()
    assert {r.doc_id for r in two.collect()} == {c for _, _, c in brute_components(rows)}
    rows = [(r.doc_id, r.text) for r in two.collect()]

    three = third(spark, two, SF).cache()
    assert sorted(((r.doc_id, r.text) for r in three.collect()), key=repr) == brute_passages(rows)
    assert all(r.n_chars == len(r.text) for r in three.collect())
    rows = [(r.doc_id, r.text) for r in three.collect()]

    four = fourth(spark, three, SF)
    assert {r.doc_id for r in four.collect()} == {d for d, *_, bad in brute_hits(rows, items) if not bad}
    assert last(spark, four, SF).count() == four.count() == corpus_pipeline.run(spark, SF).count()


def test_stages_on_nulls_repeats_clashing_columns_and_nothing(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (1 << 40, "", "en", "s", 0), ((1 << 40) + 1, "z" * 300_000, None, "s", 300_000), ((1 << 40) + 2, " \n", "en", None, 2)]
    docs = base.unionByName(base.limit(7)).unionByName(spark.createDataFrame(odd, base.schema))
    docs = docs.withColumns({c: F.lit(c) for c in ("_id", "_text", "key", "spans", "copies", "component", "y")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == corpus_pipeline.COLUMNS and 0 < kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.keep_one_of_similar(spark, docs, SF).groupBy("doc_id").count().where("count > 1").count() == 0
    assert corpus_pipeline.cut_repeats(spark, docs, SF).where("doc_id is null").count() == 1
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert clean.where("doc_id is null").count() == 1 and clean.where(f"doc_id >= {1 << 40}").count() == 3
    tokens = corpus_pipeline.tokenise(spark, docs, SF)
    assert tokens.count() == docs.count() and tokens.where("doc_id is null").first().n_tokens == 0
    assert corpus_pipeline.tokenise(spark, docs.limit(0), SF).count() == 0
