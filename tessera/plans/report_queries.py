"""Queries of reports, plans and comparisons on top of retrieval and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import hybrid
from tessera.operators.stored import stored

from . import base
from .base import EDGES, EMB, MSG, PAIRS, SIM, VEC, table
from .graph_queries import ANCHORED, METRICS, RERANK, SCORES, STRATEGY_EDGES, SUPPORT, anchored, pair_strategies, ranking_metrics, strategy_edges_of
from .memory_queries import BAD, CON, HEAVY, bad_flags, con
from .registry import query, with_
from .state_queries import MADE, RULES, rules

FINAL = (*RERANK, ANCHORED)


@query(with_(*FINAL) + "SELECT f.q AS query_id, f.node AS node_id, f.rank AS rank, round(s.cos, 4) AS similarity, round(f.g, 4) AS graph_score, round(f.path_support, 4) AS path_support, array_to_string(f.path, '>') AS path FROM final f JOIN sim s ON s.src = f.q AND s.dst = f.node WHERE profile = 'semantic_heavy'")
def explain_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the final hits' scores are made of, to four digits."""
    f = anchored(spark, sf_dir, ("semantic_heavy",))
    return f.select(F.col("q").alias("query_id"), F.col("node").alias("node_id"), F.col("rank").cast("long").alias("rank"), F.round("cos", 4).alias("similarity"), F.round("g", 4).alias("graph_score"), F.round("path_support", 4).alias("path_support"), F.array_join("path", ">").alias("path"))


@query(with_(*FINAL, SUPPORT, METRICS) + "SELECT arg_max(profile, {'r': round(r, 6), 'm': round(m, 6), 'p': profile}) AS best_profile, round(max(round(r, 6)) - max(CASE WHEN profile = 'balanced' THEN round(r, 6) END), 6) AS gain_over_balanced FROM (SELECT profile, sum(found) / sum(wanted) AS r, avg(coalesce(1.0 / first, 0)) AS m FROM x GROUP BY 1)")
def best_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranker profile of the best recall, then the best reciprocal rank."""
    m = ranking_metrics(spark, sf_dir)
    return m.agg(F.max_by("profile", F.struct("evidence_recall", "mrr", "profile")).alias("best_profile"), F.round(F.max("evidence_recall") - F.max(F.when(F.col("profile") == "balanced", F.col("evidence_recall"))), 6).alias("gain_over_balanced"))


@query(with_(*FINAL, HEAVY, SUPPORT, BAD) + "SELECT count(*) AS queries, CAST(sum(base) AS BIGINT) AS baseline_hits, CAST(sum(found) AS BIGINT) AS memory_hits, CAST(sum(found) - sum(base) AS BIGINT) AS hit_gain, round((sum(found) - sum(base)) / sum(wanted), 6) AS recall_gain, count(*) FILTER (WHERE found > base) AS improved, count(*) FILTER (WHERE found < base) AS regressed FROM bad")
def memory_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What expansion and reranking gain over similarity alone."""
    b = bad_flags(spark, sf_dir)
    return b.agg(
        F.count("*").alias("queries"), F.sum("base").alias("baseline_hits"), F.sum("found").alias("memory_hits"), (F.sum("found") - F.sum("base")).alias("hit_gain"), F.round((F.sum("found") - F.sum("base")) / F.sum("wanted"), 6).alias("recall_gain"),
        F.sum((F.col("found") > F.col("base")).cast("long")).alias("improved"), F.sum((F.col("found") < F.col("base")).cast("long")).alias("regressed"),
    )


@query(with_(MSG) + "SELECT id AS query_id, conv AS session, concat_ws(' ', text, array_to_string(kw, ' '), role) AS retrieval_query, CAST(len(kw) AS BIGINT) AS n_keywords FROM msg")
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a question: the text that retrieval gets."""
    return base.msg(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("conv").alias("session"), F.concat_ws(" ", "text", F.array_join("kw", " "), "role").alias("retrieval_query"), F.size("kw").cast("long").alias("n_keywords"))


@query(with_(MSG, EMB, PAIRS) + """, w AS (SELECT p.a_id AS a_id, p.b_id AS b_id, len(list_intersect(p.a_kw, p.b_kw)) AS w FROM pairs p WHERE len(list_intersect(p.a_kw, p.b_kw)) > 0)
SELECT w.a_id AS query_id, e.idx AS idx, round(sum(w.w * e.val) / any_value(t.t), 6) AS value FROM w JOIN emb e ON e.id = w.b_id JOIN (SELECT a_id, sum(w) AS t FROM w GROUP BY 1) t ON t.a_id = w.a_id GROUP BY 1, 2""")
def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors as the mean of the context's vectors, weighted by shared keywords, as sparse rows."""
    m = base.msg(spark, sf_dir)
    w = base.pairs(m, ["kw"]).withColumn("w", F.size(F.array_intersect("a_kw", "b_kw"))).where("w > 0").select("a_id", "b_id", "w")
    total = w.groupBy("a_id").agg(F.sum("w").alias("t"))
    e = base.message_embeddings(m).withColumnRenamed("id", "b_id")
    out = w.join(e, "b_id").groupBy("a_id", "idx").agg(F.sum(F.col("w") * F.col("val")).alias("s")).join(total, "a_id")
    return out.select(F.col("a_id").alias("query_id"), F.col("idx").cast("long").alias("idx"), F.round(F.col("s") / F.col("t"), 6).alias("value"))


@query("SELECT 'order_' || o_orderkey || '::root' AS source_id, 'order_' || o_orderkey || '::' || l_linenumber AS target_id, 'object_contains' AS relation_type, CAST(0.64 AS DOUBLE) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'order_' || o_orderkey || '::' || l_linenumber, 'order_' || o_orderkey || '::root', 'contained_by_object', CAST(0.48 AS DOUBLE) FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between an object's root and its units."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    root, unit = F.concat(F.lit("order_"), "o_orderkey", F.lit("::root")), F.concat(F.lit("order_"), "o_orderkey", F.lit("::"), "l_linenumber")
    both = F.array(F.struct(root.alias("s"), unit.alias("t"), F.lit("object_contains").alias("r"), F.lit(0.64).alias("w")), F.struct(unit.alias("s"), root.alias("t"), F.lit("contained_by_object").alias("r"), F.lit(0.48).alias("w")))
    return rows.select(F.explode(both).alias("e")).select(F.col("e.s").alias("source_id"), F.col("e.t").alias("target_id"), F.col("e.r").alias("relation_type"), F.col("e.w").alias("weight"))


@query(with_(VEC, SIM, EDGES) + "SELECT id, count(e.src) FILTER (WHERE e.src = id) AS n_out, count(e.src) FILTER (WHERE e.dst = id) AS n_in, round(least(1.0, coalesce(sum(weight), 0) / 3.0), 6) AS strength FROM vec LEFT JOIN edges e ON e.src = id OR e.dst = id GROUP BY 1")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and neighbourhood strength: each directed edge counts at both of its ends."""
    e = base.edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("id"), "weight", F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst").alias("id"), "weight", F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("weight").alias("w"))
    v = base.vec(spark, sf_dir).select("id").join(sums, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return v.select("id", zero("o").cast("long").alias("n_out"), zero("i").cast("long").alias("n_in"), F.round(F.least(F.lit(1.0), zero("w") / 3.0), 6).alias("strength"))


def ordered_overlap(path: Column, pattern: Column) -> Column:
    """1 if the path holds the pattern without a gap, else the share of the pattern that a greedy walk along the path meets in order."""
    whole = lambda a: F.concat(F.lit(">"), F.array_join(a, ">"), F.lit(">"))
    met = F.aggregate(path, F.lit(0), lambda n, x: n + F.when((n < F.size(pattern)) & (x == F.get(pattern, n)), 1).otherwise(0))
    return F.when((F.size(pattern) == 0) | (F.size(path) == 0), F.lit(0.0)).when(F.contains(whole(path), whole(pattern)), F.lit(1.0)).otherwise(met / F.size(pattern))


@query(with_(MSG, EMB, PAIRS, RULES, MADE) + """, p AS (SELECT x.conv AS conv, x.a_id AS a, x.b_id AS m, y.b_id AS b, [x.relation_type, y.relation_type] AS rels FROM made x JOIN made y ON y.conv = x.conv AND y.a_id = x.b_id WHERE y.b_id <> x.a_id)
SELECT conv AS conv_id, array_to_string(rels, '>') AS path, count(*) AS n, CASE WHEN rels[1] = 'shared_entity' AND rels[2] = 'embedding_similarity' THEN 1.0 WHEN rels[1] = 'shared_entity' OR rels[2] = 'shared_entity' THEN 0.5 ELSE 0.0 END AS overlap FROM p GROUP BY conv, rels""")
def relation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step relation paths of each conversation against the pattern shared_entity, embedding_similarity."""
    e = rules(spark, sf_dir).where("relation_type is not null").select("conv", "a_id", "b_id", "relation_type")
    step = e.select("conv", F.col("a_id").alias("m"), F.col("b_id").alias("b"), F.col("relation_type").alias("r2"))
    p = e.select("conv", F.col("a_id").alias("a"), F.col("b_id").alias("m"), F.col("relation_type").alias("r1")).join(step, ["conv", "m"]).where("a <> b").withColumn("rels", F.array("r1", "r2"))
    pattern = F.array(F.lit("shared_entity"), F.lit("embedding_similarity"))
    return p.groupBy("conv", "rels").agg(F.count("*").alias("n")).select(F.col("conv").alias("conv_id"), F.array_join("rels", ">").alias("path"), "n", ordered_overlap(F.col("rels"), pattern).alias("overlap"))


@query(with_(MSG, CON, EMB, PAIRS, RULES, MADE) + """, k AS (SELECT conv, len(list_slice(kw, 1, 8)) AS n, unnest(list_slice(kw, 1, 8)) AS w FROM con), sh AS (SELECT x.conv AS a, y.conv AS b, count(*) AS shared, any_value(x.n) AS n FROM k x JOIN k y USING (w) WHERE x.conv <> y.conv GROUP BY 1, 2),
rel AS (SELECT c.conv AS conv, coalesce(list(DISTINCT relation_type) FILTER (WHERE relation_type IS NOT NULL), []) AS rels FROM con c LEFT JOIN made m USING (conv) GROUP BY 1)
SELECT a AS case_id, b AS other_case, round(0.54 * shared / n + 0.32 * CASE WHEN len(list_distinct(list_concat(x.rels, y.rels))) = 0 THEN 0 ELSE len(list_intersect(x.rels, y.rels)) / len(list_distinct(list_concat(x.rels, y.rels))) END + 0.14 * CASE WHEN len(y.rels) > 0 THEN 1 ELSE 0 END, 6) AS score FROM sh JOIN rel x ON x.conv = a JOIN rel y ON y.conv = b""")
def hint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How useful another case is as a hint: shared keywords, like relations, and whether it has any relations at all."""
    c = stored(con(spark, sf_dir).select("conv", F.slice("kw", 1, 8).alias("kw")))
    made = rules(spark, sf_dir).where("relation_type is not null").groupBy("conv").agg(F.collect_set("relation_type").alias("rels"))
    rel = stored(c.join(made, "conv", "left").select(F.col("conv").cast("long").alias("id"), "kw", F.coalesce("rels", F.array().cast("array<string>")).alias("kinds")))

    def score(shared: int, n: int, a: frozenset, b: frozenset) -> float:
        like = len(a & b) / len(a | b) if a | b else 0.0
        return text.half_up(0.54 * shared / n + 0.32 * like + (0.14 if b else 0.0), 6)

    return hybrid.by_table(rel, score).select(F.col("a").alias("case_id"), F.col("b").alias("other_case"), "score")


@query(with_(MSG, EMB, PAIRS, SCORES, STRATEGY_EDGES) + """, s AS (SELECT strategy, count(*) AS n, min(score) AS lo, max(score) AS hi FROM sedges GROUP BY 1)
SELECT w.strategy AS strategy, CASE WHEN n IS NULL THEN 'fail' WHEN lo < 0 OR hi > 1.000001 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT unnest(['semantic_only', 'position_only', 'cam_style', 'context_path_only', 'context_blend', 'no_graph']) AS strategy) w LEFT JOIN s USING (strategy)""")
def strategy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each strategy is in the report and its scores are in range."""
    from .graph_queries import ALPHA, STRATEGY_NAMES

    e = strategy_edges_of(pair_strategies(base.scored_pairs(spark, sf_dir), F.lit(ALPHA))).groupBy("strategy").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    wanted = spark.createDataFrame([(s,) for s in (*STRATEGY_NAMES, "no_graph")], "strategy string")
    status = F.when(F.col("n").isNull(), "fail").when((F.col("lo") < 0) | (F.col("hi") > 1.000001), "warn").otherwise("pass")
    return wanted.join(e, "strategy", "left").select("strategy", status.alias("status"))


@query(r"""WITH t AS (SELECT conv_id, turn, lower(text) AS gold, lower(coalesce(lead(text) OVER w, '')) AS after, lower(coalesce(lag(text) OVER w, '')) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, list_distinct(list_filter(string_split_regex(trim(regexp_replace(gold, '[^\p{L}\p{N}]+', ' ', 'g')), ' +'), lambda x: len(x) >= 3 AND x NOT IN (""" + base.quoted(base.words.ANSWER_STOPWORDS) + r"""))) AS terms FROM t),
c AS (SELECT CASE WHEN len(terms) < 2 THEN 0.0 ELSE len(list_filter(terms, lambda x: contains(before, x))) / len(terms) END AS b, CASE WHEN len(terms) < 2 THEN 0.0 ELSE len(list_filter(terms, lambda x: contains(after, x))) / len(terms) END AS a FROM s)
SELECT CASE WHEN a > b THEN 'improved' WHEN a < b THEN 'regressed' ELSE 'unchanged' END AS status, count(*) AS n, round(avg(a - b), 6) AS mean_delta FROM c GROUP BY 1""")
def generation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of answers to each message, the one before and the one after it, by how much of its terms they cover."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"after": F.lower(F.coalesce(F.lead("text").over(w), F.lit(""))), "before": F.lower(F.coalesce(F.lag("text").over(w), F.lit("")))})
    scored = c.select(text.term_coverage(F.col("text"), F.col("before")).alias("b"), text.term_coverage(F.col("text"), F.col("after")).alias("a"))
    status = F.when(F.col("a") > F.col("b"), "improved").when(F.col("a") < F.col("b"), "regressed").otherwise("unchanged")
    return scored.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_delta"))
