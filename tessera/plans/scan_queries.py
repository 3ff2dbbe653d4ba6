"""Scans of stores and logs, and small measures of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text, vectors

from . import base
from .base import EDGES, SIM, VEC, table
from .registry import query, with_


@query(with_(VEC) + "SELECT e.event_id AS position, v.id AS node_id, v.grp AS context, v.usage AS usage FROM events e JOIN vec v ON v.id = e.user_id")
def nodes_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that a list of ids names, in the list's order and as often as it names them; ids of no memory are left out. The list is the event log's."""
    wanted = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("id"))
    return wanted.join(base.vec(spark, sf_dir).select("id", "grp", "usage"), "id").select("position", F.col("id").alias("node_id"), F.col("grp").alias("context"), "usage")


INCIDENT = "wanted AS (SELECT user_id AS id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2)"


@query(with_(VEC, SIM, EDGES, INCIDENT) + "SELECT src AS source_id, dst AS target_id, round(weight, 6) AS weight, src IN (SELECT id FROM wanted) AS outgoing FROM edges WHERE src IN (SELECT id FROM wanted) OR dst IN (SELECT id FROM wanted)")
def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge that touches a wanted memory, once, and whether it goes out of one."""
    wanted = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").count().where("count >= 2").select(F.col("user_id").alias("id"))
    side = lambda c: wanted.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_wanted"))
    rows = base.edges(spark, sf_dir).join(side("src"), "src", "left").join(side("dst"), "dst", "left").where("src_wanted or dst_wanted")
    return rows.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.round("weight", 6).alias("weight"), F.coalesce("src_wanted", F.lit(False)).alias("outgoing"))


@query("SELECT event_id, event_type, user_id, value FROM events WHERE event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, newest first, of some types, as far as its limit of 50 goes."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "user_id", "value")


@query("""SELECT 'evt_' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 16) AS id, event_type, user_id AS node_id, '{"value":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',"k":' || json_extract_string(props, '$.k') || '}' AS payload FROM events""")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the log holds after all events were appended: id, type, node and a JSON payload."""
    payload = F.concat(F.lit('{"value":'), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select(text.stable_id("evt", F.col("event_id")).alias("id"), "event_type", F.col("user_id").alias("node_id"), payload.alias("payload"))


@query("SELECT conv_id, role, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY 1, 2")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated prompt tokens of each side of a conversation: a quarter of the characters, at least one a message."""
    n = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(n).alias("tokens"), F.count("*").alias("messages"))


@query("""SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id) AS position
FROM (SELECT source, CASE WHEN doc_id % 3 = 0 THEN lang || '-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source by the number that their id is, then those whose id is none by their text."""
    name = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("-", "lang", F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    order = Window.partitionBy("source").orderBy(F.expr("try_cast(id as bigint)").asc_nulls_last(), "id")
    return table(spark, sf_dir, "documents").select("source", name.alias("id")).withColumn("position", F.row_number().over(order).cast("long"))


@query(with_(VEC) + """SELECT a.id AS id, b.id AS next_id, round(coalesce(list_sum(list_transform(list_zip(list_slice(a.v, 1, 24), list_slice(b.v, 1, 24)), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(list_slice(a.v, 1, 24), lambda x: x * x))) * sqrt(list_sum(list_transform(list_slice(b.v, 1, 24), lambda x: x * x))), 0), 0), 6) AS similarity
FROM vec a JOIN vec b ON b.id = a.id + 1""")
def truncated_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of vectors of different lengths: the longer one is cut to the shorter one's length. Here, 24 dimensions against the next memory's 64."""
    v = base.vec(spark, sf_dir).select("id", "v")
    pairs = v.select("id", F.slice("v", 1, 24).alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("id").alias("next_id"), F.col("v").alias("b")), "id")
    return pairs.select("id", "next_id", F.round(vectors.cosine_of_shared(F.col("a"), F.col("b")), 6).alias("similarity"))


TYPED = "typed AS (SELECT *, CASE WHEN usage = 0 THEN 'summary' WHEN id % 5 = 0 THEN 'consolidated' ELSE 'episodic' END AS kind FROM vec)"


@query(with_(VEC, SIM, TYPED) + """SELECT src AS query_id, dst AS node_id, kind AS node_type, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS rank FROM sim JOIN typed ON typed.id = dst WHERE kind <> 'summary' QUALIFY rank <= 4""")
def typed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best four of a query's context that are not of an excluded node type."""
    kind = F.when(F.col("dst") % 5 == 0, "consolidated").otherwise("episodic")
    summary = F.when(F.col("usage") == 0, float("-inf")).otherwise(0.0)  # a score below any least one
    ranked = base.near(base.vec(spark, sf_dir), 4, -2.0, summary).withColumn("node_type", kind)
    return ranked.select(F.col("src").alias("query_id"), F.col("dst").alias("node_id"), "node_type", F.col("rank").cast("long").alias("rank"))


@query("""SELECT 'documents' AS dataset, count(*) AS records, count(DISTINCT doc_id) AS ids, count(*) - count(text) AS empty, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters FROM documents
UNION ALL SELECT 'benchmark', count(*), count(DISTINCT item_id), count(*) - count(text), CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM benchmark
UNION ALL SELECT 'conversations', count(*), count(DISTINCT conv_id), count(*) - count(text), CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM conversations""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest says of each data set: records, ids, records without text and characters."""
    one = lambda name, key: table(spark, sf_dir, name).agg(
        F.lit(name).alias("dataset"), F.count("*").alias("records"), F.countDistinct(key).alias("ids"), (F.count("*") - F.count("text")).alias("empty"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("characters")
    )
    return one("documents", "doc_id").unionByName(one("benchmark", "item_id")).unionByName(one("conversations", "conv_id"))
