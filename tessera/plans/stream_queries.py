"""Queries that run through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, objects
from tessera.operators.stored import folder, stored
from tessera.streaming import events, ingest, shared_memory

from . import base
from .base import EMB, MSG, PAIRS
from .registry import query, with_
from .state_queries import MADE, NOISE, RULES


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts. The log is delivered in the order of time, a range of it a file, so that the watermark of a day closes windows as the stream goes on and yet no event is late."""
    log = base.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.run_available(events.windowed_counts(events.read_in_order(log, "ts"), late="1 day"), ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, count(*) AS usage, max(event_id) AS last_event FROM events GROUP BY 1")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_available(events.usage_counts(events.read_log(spark, sf_dir)), ["user_id"])


# -- conversations that come in three deliveries, by turns

DELIVERIES = 3
LOCAL = f"local AS MATERIALIZED (SELECT m.*, least({DELIVERIES - 1}, turn // 3) AS delivery FROM msg m)"


def inserted(spark: SparkSession, sf_dir: str) -> ingest.Log:
    """Messages as nodes, three turns a delivery."""
    rows = stored(base.msg(spark, sf_dir).select("id", F.col("conv").alias("ctx"), "kw", "ents", F.least(F.lit(DELIVERIES - 1), F.floor(F.col("turn") / 3)).cast("int").alias("part")))
    log = ingest.Log(spark, folder(rows), rows.schema)
    ingest.replay(log, [rows.where(F.col("part") == n) for n in range(DELIVERIES)], ingest.insertion(log, lambda batch: batch))
    return log


@query(with_(MSG, EMB, PAIRS, RULES, MADE) + "SELECT a_id AS source_id, b_id AS target_id, relation_type, round(weight, 6) AS weight FROM made WHERE relation_type <> 'embedding_similarity'")
def online_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges after all deliveries were inserted, each with the nodes there were: those of a rebuild of the whole."""
    e = inserted(spark, sf_dir).read("edges", ingest.EDGES)
    return e.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("relation").alias("relation_type"), F.round("weight", 6).alias("weight"))


@query(with_(MSG, LOCAL, f"d AS (SELECT unnest(range({DELIVERIES})) AS delivery)", "so_far AS MATERIALIZED (SELECT d.delivery AS delivery, l.delivery AS own, l.* EXCLUDE (delivery) FROM d JOIN local l ON l.delivery <= d.delivery)",
             f"""met AS MATERIALIZED (SELECT a.delivery AS delivery, len(list_filter(a.ents, lambda x: list_contains(b.ents, x))) AS e, len(list_filter(a.kw, lambda x: list_contains(b.kw, x) AND x NOT IN ({NOISE}))) AS k
  FROM so_far a JOIN so_far b ON a.delivery = b.delivery AND a.conv = b.conv AND a.id < b.id WHERE greatest(a.own, b.own) = a.delivery)""")
       + """SELECT n.delivery AS delivery, n.nodes AS nodes, total * (total - 1) // 2 AS full_rebuild_pairs, CAST(local_pairs AS BIGINT) AS local_pairs, coalesce(scored, 0) AS incremental_pairs, 0::BIGINT AS lazy_pairs, coalesce(made, 0) AS edges
FROM (SELECT delivery, count(*) AS total, count(*) FILTER (WHERE own = delivery) AS nodes FROM so_far GROUP BY 1) n JOIN (SELECT delivery, sum(c * (c - 1) // 2) AS local_pairs FROM (SELECT delivery, conv, count(*) AS c FROM so_far GROUP BY 1, 2) GROUP BY 1) USING (delivery)
LEFT JOIN (SELECT delivery, count(*) FILTER (WHERE e + k > 0) AS scored, 2 * count(*) FILTER (WHERE e > 0 OR k >= 2) AS made FROM met GROUP BY 1) USING (delivery)""")
def insertion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delivery costs by way of insertion: pairs of a rebuild of all there is, of a rebuild inside contexts, of the lists' candidates alone, and of leaving edges to the queries."""
    log = inserted(spark, sf_dir)
    counts, nodes = log.read("counts", ingest.COUNTS), stored(log.read("nodes", "ctx string, id string"))
    later = F.explode(F.sequence(F.col("batch"), F.lit(DELIVERIES - 1).cast("long")))
    held = nodes.select("ctx", later.alias("delivery")).groupBy("delivery", "ctx").agg(F.count("*").alias("n"))
    pairs = held.groupBy("delivery").agg(F.sum("n").alias("total"), F.sum(F.expr("n * (n - 1) div 2")).alias("local_pairs"))
    whole = F.expr("total * (total - 1) div 2")
    return counts.withColumnRenamed("batch", "delivery").join(pairs, "delivery").select("delivery", "nodes", whole.alias("full_rebuild_pairs"), "local_pairs", F.col("scored").alias("incremental_pairs"), F.lit(0).cast("long").alias("lazy_pairs"), "edges")


UNITS = f"""units AS MATERIALIZED (SELECT v, conv AS object, turn % 3 AS unit, text, ents FROM msg JOIN (SELECT unnest(range({DELIVERIES})) AS v) ON turn BETWEEN 2 * v AND 2 * v + 2 WHERE conv IS NOT NULL),
delta AS MATERIALIZED (SELECT object, unit, v, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN text IS NOT DISTINCT FROM was_text AND ents = was THEN 'same' ELSE 'updated' END AS change, coalesce(ents, CAST([] AS VARCHAR[])) AS ents, coalesce(was, CAST([] AS VARCHAR[])) AS was
  FROM (SELECT object, unit, v, text, ents, 1 AS n FROM units) FULL JOIN (SELECT object, unit, v + 1 AS v, text AS was_text, ents AS was, 1 AS o FROM units u WHERE EXISTS (SELECT 1 FROM units x WHERE x.object = u.object AND x.v = u.v + 1)) USING (object, unit, v))"""


def object_log(spark: SparkSession, sf_dir: str) -> ingest.Log:
    """Conversations as objects that remember three turns: version v holds turns 2v to 2v + 2, each in the place (unit) of the turn three before."""
    m = base.msg(spark, sf_dir).where("conv is not null").select(F.col("conv").cast("long").alias("object"), (F.col("turn") % 3).cast("long").alias("unit"), "text", F.col("ents").alias("entities"), "turn")
    rows = stored(m)
    parts = [rows.where(F.col("turn").between(2 * v, 2 * v + 2)).drop("turn") for v in range(DELIVERIES)]
    log = ingest.Log(spark, folder(rows), parts[0].schema)
    ingest.replay(log, parts, ingest.object_versions(log))
    return log


@query(with_(MSG, UNITS) + """SELECT v AS version, object, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'same') AS same, count(*) FILTER (WHERE change = 'removed') AS removed,
  CAST(sum(len(list_filter(ents, lambda x: NOT list_contains(was, x)))) AS BIGINT) AS hubs_gained, CAST(sum(len(list_filter(was, lambda x: NOT list_contains(ents, x)))) AS BIGINT) AS hubs_lost FROM delta GROUP BY 1, 2""")
def object_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version of each object: its units that are new, changed, as they were, or gone, and the entities that its units came to hold or hold no longer."""
    d = object_log(spark, sf_dir).read("delta", ingest.DELTA)
    kind = lambda c: F.count_if(F.col("change") == c).alias(c)
    gained, lost = F.sum(F.size(F.array_except("entities", "was"))), F.sum(F.size(F.array_except("was", "entities")))
    return d.groupBy("version", "object").agg(kind("added"), kind("updated"), kind("same"), kind("removed"), gained.cast("long").alias("hubs_gained"), lost.cast("long").alias("hubs_lost"))


@query(with_(MSG, UNITS, f"held AS (SELECT seen, object, unit, unnest(ents) AS entity FROM (SELECT seen, u.*, max(v) OVER (PARTITION BY seen, object) AS last FROM units u JOIN (SELECT unnest(range({DELIVERIES})) AS seen) ON v <= seen) WHERE v = last)")
       + "SELECT a.seen AS version, count(*) AS links FROM held a JOIN held b ON a.seen = b.seen AND a.entity = b.entity AND a.object <> b.object GROUP BY 1")
def object_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links between units of different objects stand after each delivery, from what the deliveries changed alone."""
    d = object_log(spark, sf_dir).read("delta", ingest.DELTA).withColumn("_o", F.col("object")).withColumn("object", F.struct("object", "version"))
    hubs = objects.changed_hubs(d).select("object.object", "object.version", "entity", "op")
    return ingest.links(hubs, F.array(*[F.lit(v) for v in range(DELIVERIES)])).where("links > 0")


# -- sessions of agents: a conversation is a session, four turns a task, a role an agent

AGENT_EVENTS = """wr AS MATERIALIZED (SELECT id AS message, conv AS session, turn // 4 AS task, turn, role, least(0.95, 0.5 + 0.005 * len(toks)) AS confidence FROM msg),
aev AS MATERIALIZED (SELECT session, task, 3 * turn AS seq, 'write' AS op, 'w:' || message AS node, role AS agent, NULL AS source, NULL AS target, CASE WHEN role = 'assistant' THEN 'session' ELSE 'working' END AS layer, confidence, message FROM wr
  UNION ALL SELECT session, task, 3 * turn + 1, 'handoff', 'h:' || message, 'assistant', 'assistant', 'user', 'session', confidence, message FROM wr WHERE role = 'assistant'
  UNION ALL SELECT session, task, 3 * max(turn) + 2, 'resolve', 'r:' || session || ':' || task, 'verifier', NULL, NULL, 'session', NULL, NULL FROM wr GROUP BY session, task HAVING count(*) FILTER (WHERE role = 'assistant') >= 2),
ver AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session, task ORDER BY seq, node) AS version FROM aev),
cnf AS MATERIALIZED (SELECT c.node AS node, r.node AS resolution, c.confidence AS confidence, c.message AS message, row_number() OVER (PARTITION BY r.node ORDER BY c.confidence DESC, c.version DESC) AS r FROM ver c JOIN ver r ON r.op = 'resolve' AND c.op = 'write' AND c.agent = 'assistant' AND c.session = r.session AND c.task = r.task AND c.seq < r.seq),
mem AS MATERIALIZED (SELECT v.* EXCLUDE (confidence, message), CASE WHEN s.node IS NULL THEN v.confidence ELSE least(0.98, greatest(0.7, s.confidence + 0.04)) END AS confidence, coalesce(s.message, v.message) AS message, CASE WHEN v.op = 'resolve' THEN 'resolved' WHEN m.r = 1 THEN 'selected' WHEN m.r > 1 THEN 'rejected' END AS conflict_status
  FROM ver v LEFT JOIN cnf s ON s.resolution = v.node AND s.r = 1 LEFT JOIN cnf m ON m.node = v.node)"""


def agent_log(spark: SparkSession, sf_dir: str) -> ingest.Log:
    """Each message is written by its role, the assistant's are handed to the user, and the assistant's answers to a task, if there are several, end in a resolution."""
    m = base.msg(spark, sf_dir).select(F.col("id").alias("message"), F.col("conv").cast("string").alias("session"), F.floor(F.col("turn") / 4).cast("long").alias("task"), F.col("turn").cast("long").alias("turn"), "role", F.least(F.lit(0.95), 0.5 + 0.005 * F.size("toks")).alias("confidence"))
    w, none = stored(m), F.lit(None).cast("string")
    ours = F.col("role") == "assistant"
    event = lambda rows, at, op, node, agent, source, target, layer, confidence, message: rows.select("session", "task", at.cast("long").alias("seq"), F.lit(op).alias("op"), node.alias("node"), agent.alias("agent"), source.alias("source"), target.alias("target"), layer.alias("layer"), confidence.cast("double").alias("confidence"), message.cast("string").alias("message"))
    session = F.lit("session")
    writes = event(w, 3 * F.col("turn"), "write", F.concat(F.lit("w:"), "message"), F.col("role"), none, none, F.when(ours, session).otherwise("working"), F.col("confidence"), F.col("message"))
    handed = event(w.where(ours), 3 * F.col("turn") + 1, "handoff", F.concat(F.lit("h:"), "message"), F.lit("assistant"), F.lit("assistant"), F.lit("user"), session, F.col("confidence"), F.col("message"))
    ends = w.groupBy("session", "task").agg(F.max("turn").alias("turn"), F.count_if(ours).alias("n")).where("n >= 2")
    resolved = event(ends, 3 * F.col("turn") + 2, "resolve", F.concat_ws(":", F.lit("r"), "session", "task"), F.lit("verifier"), none, none, session, F.lit(None), F.lit(None))
    rows = stored(writes.unionByName(handed).unionByName(resolved))
    log = ingest.Log(spark, folder(rows), rows.schema)
    part = F.least(F.lit(DELIVERIES - 1), F.floor(F.floor(F.col("seq") / 3) / 3))
    ingest.replay(log, [rows.where(part == n) for n in range(DELIVERIES)], shared_memory.folding(log, F.col("agent") == "assistant"))
    return log


@query(with_(MSG, AGENT_EVENTS) + "SELECT node, CAST(session AS VARCHAR) AS session_id, task AS task_id, agent AS agent_id, target AS target_agent_id, layer, op = 'handoff' AS handoff, version, round(confidence, 6) AS confidence, conflict_status FROM mem")
def shared_memory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared memory after three deliveries of events: versions, handoffs, and what conflicts were decided."""
    m = shared_memory.memories(agent_log(spark, sf_dir))
    return m.select("node", F.col("session").alias("session_id"), F.col("task").alias("task_id"), F.col("agent").alias("agent_id"), F.col("target").alias("target_agent_id"), "layer", (F.col("op") == "handoff").alias("handoff"), "version", F.round("confidence", 6).alias("confidence"), "conflict_status")


SHARED = f"""seen AS MATERIALIZED (SELECT * FROM mem WHERE layer = 'session' AND (target IS NULL OR target = 'user') AND conflict_status IS DISTINCT FROM 'rejected' QUALIFY row_number() OVER (PARTITION BY session, task, agent, source, target, layer, op ORDER BY version DESC, node) = 1),
ask AS MATERIALIZED (SELECT u.id AS q, s.node AS node, round(coalesce(cos, 0), 9) AS cos, s.confidence AS confidence FROM msg u JOIN seen s ON s.session = u.conv LEFT JOIN pairs p ON p.a_id = u.id AND p.b_id = s.message WHERE u.role = 'user'),
one AS (SELECT node, count(*) AS usage FROM (SELECT node FROM ask QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(cos + 0.03 * confidence, 9) DESC, node) <= 3) GROUP BY 1)"""


@query(with_(MSG, EMB, PAIRS, AGENT_EVENTS, SHARED) + """SELECT q AS query_id, node AS memory_id, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, node) AS rank
FROM (SELECT q, a.node AS node, round(cos + least(0.12, 0.02 * coalesce(usage, 0)) + 0.03 * confidence, 9) AS s FROM ask a LEFT JOIN one USING (node)) QUALIFY rank <= 3""")
def shared_memory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user asks the session's memories twice: of each kind the newest version, meant for them and not rejected; what answered the first time counts as used the second."""
    m = stored(shared_memory.visible(shared_memory.memories(agent_log(spark, sf_dir)), layers=["session"], agent="user", latest=True))
    users = base.msg(spark, sf_dir).where("role = 'user'").select(F.col("id").alias("q"), F.col("conv").cast("string").alias("session"))
    cos = base.scored_pairs(spark, sf_dir).where("a_role = 'user'").select(F.col("a_id").alias("q"), F.col("b_id").alias("message"), "cos")
    ask = stored(users.join(m, "session").join(cos, ["q", "message"], "left").select("q", "node", F.coalesce("cos", F.lit(0.0)).alias("cos"), "confidence"))
    plain = F.col("cos") + 0.03 * F.col("confidence")
    first = graph.top_k(ask.withColumn("s", F.round(plain, 9)), "q", "s", "node", 3).groupBy("node").agg(F.count("*").alias("usage"))
    again = ask.join(first, "node", "left").withColumn("s", F.round(F.col("cos") + F.least(F.lit(0.12), 0.02 * F.coalesce("usage", F.lit(0))) + 0.03 * F.col("confidence"), 9))
    return graph.top_k(again, "q", "s", "node", 3).select(F.col("q").alias("query_id"), F.col("node").alias("memory_id"), F.round("s", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
