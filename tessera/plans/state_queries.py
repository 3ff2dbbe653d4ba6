"""Queries on state: edge rules, upserts, folds, feedback, summaries, agents' memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text, words
from tessera.operators import state
from tessera.operators.stored import stored

from . import base
from .base import EMB, MSG, PAIRS, quoted, table
from .graph_queries import ANCHORED, RERANK, SUPPORT, anchored, support_of
from .registry import query, with_

NOISE = quoted(sorted({*words.GENERIC_EDGE_KEYWORDS, *words.LOW_INFORMATION_EDGE_KEYWORDS}))
RULES = f"""rules AS MATERIALIZED (SELECT conv, a_id, b_id, a_turn, b_turn, shared, overlap, CASE WHEN len(shared) > 0 THEN 'shared_entity' WHEN len(overlap) >= 2 THEN 'keyword_overlap' WHEN cos >= 0.18 THEN 'embedding_similarity' END AS relation_type,
  CASE WHEN len(shared) > 0 THEN least(0.95, 0.55 + 0.12 * len(shared)) WHEN len(overlap) >= 2 THEN least(0.85, 0.35 + 0.08 * len(overlap)) WHEN cos >= 0.18 THEN least(0.8, cos) ELSE 0.0 END AS weight
  FROM (SELECT *, list_filter(a_ents, lambda x: list_contains(b_ents, x)) AS shared, list_filter(a_kw, lambda x: list_contains(b_kw, x) AND x NOT IN ({NOISE})) AS overlap FROM pairs))"""
MADE = "made AS MATERIALIZED (SELECT * FROM rules WHERE relation_type IS NOT NULL)"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.edge_rule(base.scored_pairs(spark, sf_dir))


@query(with_(MSG, EMB, PAIRS, RULES) + """SELECT a_id, b_id, relation_type, round(weight, 6) AS weight, CAST(len(shared) AS BIGINT) AS n_entities, CAST(len(overlap) AS BIGINT) AS n_keywords, CASE WHEN len(overlap) = 0 THEN 'low_information_keyword_overlap' ELSE 'normal' END AS edge_quality,
  coalesce(relation_type IN ('keyword_overlap', 'embedding_similarity'), false) AS to_judge FROM rules""")
def edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules(spark, sf_dir)
    quality = F.when(F.size("overlap") == 0, "low_information_keyword_overlap").otherwise("normal")
    wanted = F.coalesce(state.judge_wanted(F.col("relation_type"), F.col("shared")), F.lit(False))
    return r.select("a_id", "b_id", "relation_type", F.round("weight", 6).alias("weight"), F.size("shared").cast("long").alias("n_entities"), F.size("overlap").cast("long").alias("n_keywords"), quality.alias("edge_quality"), wanted.alias("to_judge"))


@query("SELECT a.conv_id || ':' || a.turn AS source_id, b.conv_id || ':' || b.turn AS target_id, 'context_cooccurrence' AS relation_type, CAST(0.08 AS DOUBLE) AS weight FROM conversations a JOIN conversations b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.turn <> b.turn")
def context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one conversation, both ways; messages without one are linked with each other."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    left, right = (c.select(F.col("conv_id").alias(f"{p}c"), F.col("turn").alias(f"{p}t")) for p in "ab")
    ahead = left.join(right, F.col("ac").eqNullSafe(F.col("bc")) & (F.col("at") < F.col("bt"))).select(F.concat_ws(":", "ac", "at").alias("x"), F.concat_ws(":", "bc", "bt").alias("y"))
    both = F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("t")), F.struct(F.col("y").alias("s"), F.col("x").alias("t"))))
    return ahead.select(both.alias("e")).select(F.col("e.s").alias("source_id"), F.col("e.t").alias("target_id"), F.lit("context_cooccurrence").alias("relation_type"), F.lit(0.08).alias("weight"))


UPSERT = """up AS MATERIALIZED (SELECT coalesce(o.a_id, n.a_id) AS a_id, coalesce(o.b_id, n.b_id) AS b_id, coalesce(o.relation_type, n.relation_type) AS relation_type, greatest(o.weight, n.weight) AS weight,
  CASE WHEN n.weight IS NULL THEN 'kept' WHEN o.weight IS NULL THEN 'created' ELSE 'updated' END AS action
  FROM (SELECT a_id, b_id, relation_type, weight * 0.9 AS weight FROM made WHERE a_turn < b_turn) o FULL JOIN (SELECT a_id, b_id, relation_type, weight FROM made WHERE relation_type <> 'shared_entity') n USING (a_id, b_id, relation_type))"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that point forward are there, a little weaker; those that rest on keywords or similarity come in."""
    made = rules(spark, sf_dir).where("relation_type is not null")
    old = made.where("a_turn < b_turn").withColumn("weight", F.col("weight") * 0.9)
    return state.upsert_edges(old, made.where("relation_type <> 'shared_entity'"), ["a_id", "b_id", "relation_type"])


@query(with_(MSG, EMB, PAIRS, RULES, MADE, UPSERT) + "SELECT a_id, b_id, relation_type, round(weight, 6) AS weight, action FROM up")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(with_(MSG, EMB, PAIRS, RULES, MADE, UPSERT) + """, n AS (SELECT count(*) AS n FROM msg), q AS (SELECT count(DISTINCT conv) AS q FROM msg)
SELECT relation_type, count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action <> 'kept') AS touched, count(DISTINCT {'a': a_id, 'b': b_id}) AS directed_edges,
  count(DISTINCT {'l': least(a_id, b_id), 'g': greatest(a_id, b_id)}) AS undirected_pairs, round(count(DISTINCT {'l': least(a_id, b_id), 'g': greatest(a_id, b_id)}) / (any_value(n) * (any_value(n) - 1) / 2), 9) AS ratio,
  round(count(DISTINCT {'l': least(a_id, b_id), 'g': greatest(a_id, b_id)}) / any_value(q), 6) AS pairs_per_query FROM up, n, q GROUP BY relation_type""")
def build_cost_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base.msg(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("conv").alias("q"))
    pairs = F.countDistinct(F.struct(F.least("a_id", "b_id"), F.greatest("a_id", "b_id")))
    per = upserted(spark, sf_dir).groupBy("relation_type").agg(
        F.sum((F.col("action") == "created").cast("long")).alias("created"), F.sum((F.col("action") != "kept").cast("long")).alias("touched"), F.countDistinct("a_id", "b_id").alias("directed_edges"), pairs.alias("undirected_pairs")
    )
    return per.join(m).select("relation_type", "created", "touched", "directed_edges", "undirected_pairs", F.round(F.col("undirected_pairs") / (F.col("n") * (F.col("n") - 1) / 2), 9).alias("ratio"), F.round(F.col("undirected_pairs") / F.col("q"), 6).alias("pairs_per_query"))


SUMMARY = f"""summ AS MATERIALIZED (SELECT conv, text, substr(text, 1, 240) AS summary, list_slice(list_transform(list_sort(list_transform(list_distinct(ks), lambda k: {{'p': list_position(ks, k), 'k': k}})), lambda s: s.k), 1, 12) AS keywords, n FROM (
  SELECT conv, string_agg(role || ': ' || substr(text, 1, 180), chr(10) ORDER BY CAST(turn AS VARCHAR)) AS text, flatten(list(list_slice(kw, 1, 6) ORDER BY CAST(turn AS VARCHAR))) AS ks, count(*) AS n FROM msg GROUP BY conv))"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary memory for each conversation, its messages in the order of their turns as texts."""
    m = base.msg(spark, sf_dir)
    held = m.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("o"), F.concat_ws(": ", "role", F.substring("text", 1, 180)).alias("t"), F.slice("kw", 1, 6).alias("k"), F.col("id")))).alias("m"))
    body = F.array_join(F.transform("m", lambda x: x["t"]), "\n")
    return held.select("conv", body.alias("text"), F.substring(body, 1, 240).alias("summary"), F.slice(F.array_distinct(F.flatten(F.transform("m", lambda x: x["k"]))), 1, 12).alias("keywords"), F.size("m").cast("long").alias("n"), F.transform("m", lambda x: x["id"]).alias("children"))


@query(with_(MSG, SUMMARY) + "SELECT conv AS conv_id, summary, array_to_string(keywords, ' ') AS keywords, n AS n_children, CAST(0.78 AS DOUBLE) AS confidence FROM summ")
def summary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).select(F.col("conv").alias("conv_id"), "summary", F.array_join("keywords", " ").alias("keywords"), F.col("n").alias("n_children"), F.lit(0.78).alias("confidence"))


@query("SELECT 'summary:' || conv_id AS source_id, conv_id || ':' || turn AS target_id, 'summary_parent' AS relation_type, CAST(0.32 AS DOUBLE) AS weight FROM conversations UNION ALL SELECT conv_id || ':' || turn, 'summary:' || conv_id, 'summary_child', CAST(0.32 AS DOUBLE) FROM conversations")
def summary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = summaries(spark, sf_dir).select(F.concat_ws(":", F.lit("summary"), "conv").alias("s"), F.explode("children").alias("c"))
    down = e.select(F.col("s").alias("source_id"), F.col("c").alias("target_id"), F.lit("summary_parent").alias("relation_type"))
    return down.unionByName(e.select(F.col("c").alias("source_id"), F.col("s").alias("target_id"), F.lit("summary_child").alias("relation_type"))).withColumn("weight", F.lit(0.32))


@query("""WITH o AS (SELECT vec_id AS id, CAST(0 AS DOUBLE) AS created, CAST(0.86 AS DOUBLE) AS confidence FROM embeddings),
n AS (SELECT user_id AS id, max({'event_id': event_id, 'created': CAST(epoch(ts) AS DOUBLE), 'confidence': value}) AS n FROM events GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.created, n.n.created) AS created, round(coalesce(n.n.confidence, o.confidence), 6) AS confidence, o.id IS NULL AS is_new FROM o FULL JOIN n ON o.id = n.id""")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a batch of memories that come in: known ones keep when they were made, all take the last event's confidence."""
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0.0).alias("created_at"), F.lit(0.86).alias("confidence"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_at"), F.col("value").alias("confidence"))
    out = state.upsert_nodes(old, new, "id", "event_id", ["created_at"], ["confidence"])
    return out.select("id", F.col("created_at").alias("created"), F.round("confidence", 6).alias("confidence"), F.col("created").alias("is_new"))


@query("SELECT vec_id AS id, coalesce(n, 0) AS usage_count, last_event FROM embeddings LEFT JOIN (SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1) ON user_id = vec_id")
def usage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("usage"))
    out = state.fold_usage(nodes, table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id"), "id", "event_id")
    return out.select("id", F.col("usage").alias("usage_count"), F.col("last_accessed").alias("last_event"))


FINAL = (*RERANK, ANCHORED)
STEPS = "walked AS (SELECT q, node, path[i] AS src, path[i + 1] AS dst FROM (SELECT q, node, path, unnest(range(1, len(path))) AS i FROM final WHERE profile = 'semantic_heavy'))"


def walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(final hits of the default profile, the edges on their paths)."""
    hits = stored(anchored(spark, sf_dir, ("semantic_heavy",)))
    return hits, state.path_edges(hits, ["q", "node"])


@query(with_(*FINAL, STEPS) + """SELECT src, dst, round(least(1.0, weight + 0.015 * coalesce(n, 0)), 6) AS weight, coalesce(n, 0) AS activation_count FROM edges LEFT JOIN (SELECT src, dst, count(*) AS n FROM walked GROUP BY 1, 2) USING (src, dst)""")
def edge_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, used = walked(spark, sf_dir)
    e = base.edges(spark, sf_dir).select("src", "dst", "weight", F.lit(0).cast("long").alias("activations"))
    return state.activate(e, used).select("src", "dst", F.round("weight", 6).alias("weight"), F.col("activations").alias("activation_count"))


FEEDBACK = """fb AS (SELECT src, dst, count(*) FILTER (WHERE s.q IS NOT NULL) AS up, count(*) FILTER (WHERE s.q IS NULL) AS down FROM walked w LEFT JOIN support s ON s.q = w.q AND s.node = w.node GROUP BY 1, 2),
raised AS (SELECT src, dst, weight AS old, coalesce(up, 0) AS up, coalesce(down, 0) AS down, CASE WHEN up > 0 THEN least(1.0, greatest(0.01, weight + 0.025 * up)) ELSE weight END AS w FROM edges LEFT JOIN fb USING (src, dst)),
adjusted AS (SELECT src, dst, old, up, down, CASE WHEN down > 0 THEN least(1.0, greatest(0.01, w - 0.004 * down)) ELSE w END AS weight FROM raised)"""


def fed_back(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges before, edges after feedback on the final hits' paths)."""
    _, used = walked(spark, sf_dir)
    used = stored(used)
    marked = used.join(support_of(spark, sf_dir, used).withColumn("support", F.lit(True)), ["q", "node"], "left").withColumn("support", F.coalesce("support", F.lit(False)))
    before = base.edges(spark, sf_dir).select("src", "dst", "weight")
    return before, state.adjust(before, marked)


@query(with_(*FINAL, SUPPORT, STEPS, FEEDBACK) + "SELECT src, dst, round(weight, 6) AS weight, up, down FROM adjusted")
def feedback_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fed_back(spark, sf_dir)[1].select("src", "dst", F.round("weight", 6).alias("weight"), F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))


@query(with_(*FINAL, SUPPORT, STEPS, FEEDBACK) + "SELECT src, dst, round(weight - old, 6) AS delta, row_number() OVER (ORDER BY round(abs(weight - old), 9) DESC, src, dst) AS rank FROM adjusted WHERE abs(weight - old) > 1e-12 QUALIFY rank <= 50")
def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the fifty edges that changed most."""
    c = state.changes(*fed_back(spark, sf_dir)).withColumn("size", F.round(F.abs("delta"), 9))
    top = c.orderBy(F.desc("size"), "src", "dst").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "src", "dst"))).select("src", "dst", F.round("delta", 6).alias("delta"), F.col("rank").cast("long").alias("rank"))


@query(with_(*FINAL, SUPPORT, STEPS) + """SELECT event_type, count(*) AS n FROM (SELECT 'node_retrieved' AS event_type FROM final WHERE profile = 'semantic_heavy' UNION ALL SELECT 'edge_traversed' FROM walked
  UNION ALL SELECT CASE WHEN s.q IS NOT NULL THEN 'support_hit' ELSE 'path_rejected' END FROM final f LEFT JOIN support s ON s.q = f.q AND s.node = f.node WHERE profile = 'semantic_heavy' AND (s.q IS NOT NULL OR len(path) > 1)) GROUP BY 1""")
def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a round of retrieval and feedback appends, by type."""
    hits, used = walked(spark, sf_dir)
    marked = hits.join(support_of(spark, sf_dir, hits).withColumn("ok", F.lit(True)), ["q", "node"], "left").where(F.col("ok") | (F.size("path") > 1))
    kinds = hits.select(F.lit("node_retrieved").alias("event_type")).unionAll(used.select(F.lit("edge_traversed").alias("event_type"))).unionAll(marked.select(F.when(F.col("ok"), "support_hit").otherwise("path_rejected").alias("event_type")))
    return kinds.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS newest, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"), F.round(F.avg("value"), 6).alias("mean_value"), F.countDistinct("user_id").alias("users"))


# -- agents: a conversation is a session, a role an agent, a turn a version

@query("SELECT conv_id, role, turn AS version, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("version", F.col("turn"))
    return state.latest_versions(c, ["conv_id", "role"], "version", "text").select("conv_id", "role", "version", "text")


@query("SELECT conv_id, max(turn) + 1 AS next_version, count(*) AS memories, count(DISTINCT role) AS agents FROM conversations GROUP BY 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_version"), F.count("*").alias("memories"), F.countDistinct("role").alias("agents"))


CONFLICT = "cand AS (SELECT conv, id, turn, least(0.95, 0.5 + 0.005 * len(toks)) AS confidence FROM msg WHERE role = 'assistant'), ranked AS (SELECT *, count(*) OVER (PARTITION BY conv) AS n, row_number() OVER (PARTITION BY conv ORDER BY round(confidence, 9) DESC, turn DESC) AS r FROM cand)"


def conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base.msg(spark, sf_dir).where("role = 'assistant'").select("conv", "id", "turn", F.least(F.lit(0.95), 0.5 + 0.005 * F.size("toks")).alias("confidence"))
    w = Window.partitionBy("conv")
    return m.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(F.desc(F.round("confidence", 9)), F.desc("turn")))})


@query(with_(MSG, CONFLICT) + "SELECT conv AS conv_id, id, round(confidence, 6) AS confidence, CASE WHEN n < 2 THEN NULL WHEN r = 1 THEN 'selected' ELSE 'rejected' END AS conflict_status FROM ranked")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' answers of a session compete: the most confident, then the newest, is selected; a lone one has no conflict."""
    status = F.when(F.col("n") < 2, None).when(F.col("r") == 1, "selected").otherwise("rejected")
    return conflict_candidates(spark, sf_dir).select(F.col("conv").alias("conv_id"), "id", F.round("confidence", 6).alias("confidence"), status.alias("conflict_status"))


@query(with_(MSG, CONFLICT) + """SELECT count(*) AS candidates, count(*) FILTER (WHERE n >= 2 AND r = 1) AS resolutions, count(*) FILTER (WHERE n >= 2 AND r > 1) AS rejected, count(DISTINCT conv) AS sessions, max(turn) AS max_version,
  round(count(*) FILTER (WHERE n >= 2 AND r > 1) / count(*), 6) AS rejected_rate FROM ranked""")
def collab_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conflict_candidates(spark, sf_dir)
    n = lambda cond: F.sum(cond.cast("long"))
    contested = F.col("n") >= 2
    return c.agg(F.count("*").alias("candidates"), n(contested & (F.col("r") == 1)).alias("resolutions"), n(contested & (F.col("r") > 1)).alias("rejected"), F.countDistinct("conv").alias("sessions"), F.max("turn").alias("max_version"), F.round(n(contested & (F.col("r") > 1)) / F.count("*"), 6).alias("rejected_rate"))


@query(with_(MSG, EMB, PAIRS, CONFLICT) + """SELECT a_id AS query_id, b_id AS memory_id, round(cos + 0.03 * 0.86, 6) AS score, row_number() OVER (PARTITION BY a_id ORDER BY cos DESC, b_turn) AS rank FROM pairs p LEFT JOIN ranked r ON r.id = p.b_id
WHERE a_role = 'user' AND b_role = 'assistant' AND NOT coalesce(r.n >= 2 AND r.r > 1, false) QUALIFY rank <= 3""")
def agent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' messages ask the session's memories of the assistant; rejected ones don't answer."""
    gone = conflict_candidates(spark, sf_dir).where("n >= 2 and r > 1").select(F.col("id").alias("b_id"))
    p = base.scored_pairs(spark, sf_dir).where("a_role = 'user' and b_role = 'assistant'").join(gone, "b_id", "left_anti")
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("cos"), "b_turn"))).where("rank <= 3")
    return ranked.select(F.col("a_id").alias("query_id"), F.col("b_id").alias("memory_id"), F.round(F.col("cos") + 0.03 * 0.86, 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# -- cases: relation paths inside a conversation

@query(with_(MSG, EMB, PAIRS, RULES, MADE, """p1 AS (SELECT conv, [a_id, b_id] AS path, [relation_type] AS rels FROM made)""", """p2 AS (SELECT p.conv AS conv, list_append(path, m.b_id) AS path, list_append(rels, m.relation_type) AS rels FROM p1 p JOIN made m ON m.conv = p.conv AND m.a_id = path[-1] WHERE NOT list_contains(path, m.b_id))""",
             """p3 AS (SELECT p.conv AS conv, list_append(path, m.b_id) AS path, list_append(rels, m.relation_type) AS rels FROM p2 p JOIN made m ON m.conv = p.conv AND m.a_id = path[-1] WHERE NOT list_contains(path, m.b_id))""")
       + "SELECT conv AS conv_id, array_to_string(rels, '>') AS pattern, count(*) AS n FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1, 2")
def relation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each sequence of relations occurs on the simple directed paths of up to three edges of a conversation."""
    e = stored(rules(spark, sf_dir).where("relation_type is not null").select("conv", "a_id", "b_id", "relation_type"))
    now = e.select("conv", F.array("a_id", "b_id").alias("path"), F.array("relation_type").alias("rels"))
    out = now
    for _ in range(2):
        step = e.select("conv", F.col("a_id").alias("end"), "b_id", "relation_type")
        now = now.withColumn("end", F.element_at("path", -1)).join(step, ["conv", "end"]).where(~F.array_contains("path", F.col("b_id")))
        now = now.select("conv", F.concat("path", F.array("b_id")).alias("path"), F.concat("rels", F.array("relation_type")).alias("rels"))
        out = out.unionByName(now)
    return out.groupBy(F.col("conv").alias("conv_id"), F.array_join("rels", ">").alias("pattern")).agg(F.count("*").alias("n"))
