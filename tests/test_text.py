import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text, vectors, words

SAMPLE = "Ab-c x_1 语义记忆 é9 -z"


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def py_tokens(t):
    found = [x.lower() for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-]*|[一-鿿]{2,}", t)]
    return [x for x in found if x not in words.STOPWORDS and len(x) > 1]


def test_tokens(spark):
    assert one(spark, SAMPLE, text.tokens(F.col("t")))[0] == ["ab-c", "x_1", "语义记忆"]
    assert one(spark, None, text.tokens(F.col("t")))[0] == []
    assert len(words.STOPWORDS) == 59


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["spark", "the", "graph", "Memory", "x", "语义", "a-b", "9", "é"]), max_size=25))
def test_keywords_break_ties_by_first_place(spark, parts):
    t = " ".join(parts)
    assert one(spark, t, text.top_tokens(text.tokens(F.col("t")), 3))[0] == [w for w, _ in Counter(py_tokens(t)).most_common(3)]


def test_keywords_of_rows(spark):
    df = spark.createDataFrame([(1, "b a a b c"), (2, None)], "id int, t string")
    got = sorted((r.id, r["rank"], r.token, r.n) for r in text.keywords(df, "id", "t", 2).collect())
    assert got == []  # all are single characters
    df = spark.createDataFrame([(1, "bb aa aa bb cc")], "id int, t string")
    assert [(r.token, r.n) for r in text.keywords(df, "id", "t", 2).orderBy("rank").collect()] == [("bb", 2), ("aa", 2)]


def test_stable_id_and_hash_dimension(spark):
    assert one(spark, "x", text.stable_id("mem", F.col("t")))[0] == "mem_" + hashlib.sha1(b"x").hexdigest()[:16]
    assert tuple(one(spark, "spark", vectors.bucket(F.col("t")), vectors.sign(F.col("t")))) == (222, 1.0)


def test_hash_embedding_is_normalised(spark):
    df = spark.createDataFrame([(1, ["spark", "graph", "spark"]), (2, [])], "id int, toks array<string>")
    rows = vectors.hash_embedding(df, ["id"], "toks").collect()
    assert {r.id for r in rows} == {1} and math.isclose(sum(r.val**2 for r in rows), 1.0)


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 0.96)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert math.isclose(df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0], want)


def test_overlap_and_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["x"]), ([], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(text.overlap_ratio(F.col("a"), F.col("b")), text.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.5, 0.25), (0.0, 0.0), (0.0, 0.0)]


def test_surface_entities(spark):
    t = "What did Felix De Lacey say to Agatha? Felix De Lacey left Éire. XÉ"
    assert one(spark, t, text.surface_entities(F.col("t")))[0] == ["Felix De Lacey", "Agatha"]


def test_chunks(spark):
    assert one(spark, "  ab  \n\n cd ", text.chunks(F.col("t"), 3, 1))[0] == ["ab", "cd", "d"]
    assert one(spark, "", text.chunks(F.col("t"), 3, 1))[0] == []


def test_sentences_and_names(spark):
    assert one(spark, " One  two. Three! ", text.first_sentence(F.col("t")))[0] == "One two."
    assert one(spark, "no end", text.first_sentence(F.col("t")))[0] == "no end"
    assert one(spark, "Graph_RAG method", text.entity_name(F.col("t")))[0] == "graph_rag_method"
    assert one(spark, " The ", text.entity_name(F.col("t")))[0] == "the"
    assert one(spark, " A-b C! ", text.safe_segment(F.col("t")))[0] == "a_b_c"
    assert one(spark, "a  b c", text.compact(F.col("t"), 4))[0] == "a b…"


def test_answer_terms(spark):
    gold, got = "Felix, De Lacey, Agatha, Safie", "felix and agatha met safie"
    df = spark.createDataFrame([(gold, got)], "g string, h string")
    assert df.select(text.term_coverage(F.col("g"), F.col("h"))).first()[0] == 0.75


def test_centroid(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3.0), (1, [0.0, 1.0], 4.0), (2, [0.0, 0.0], 1.0)], "g int, v array<double>, w double")
    got = {r.g: [round(x, 6) for x in r.embedding] for r in vectors.centroid(df, ["g"], "v", F.col("w")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_term_coverage_reads_a_text_once(spark):
    """The text is not lower-cased again for each of the answer's terms."""
    df = spark.createDataFrame([("alpha beta gamma delta", "ALPHA and Beta, gamma"), ("one", "ONE"), (None, "x"), ("alpha beta", None)], "g string, h string")
    shares = df.select(text.term_coverage(F.col("g"), F.lower("h")).alias("s"))
    assert [r.s for r in shares.collect()] == [0.75, 0.0, 0.0, 0.0]
    assert "contains(lower(" not in shares._jdf.queryExecution().optimizedPlan().toString().lower()
