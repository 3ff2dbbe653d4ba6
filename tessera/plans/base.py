"""The relations that the queries start from, on both sides: memories with vectors, memories with texts, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text, vectors, words
from tessera.operators.nearest import nearest
from tessera.operators.pairs import cosines
from tessera.operators.stored import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


# -- memories with vectors: a context group is a label, usage counts a memory's events

CONFIDENCE = 0.86


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))
    return v.join(used, v.id == used.user_id, "left").select("id", "grp", "v", vectors.norm(F.col("v")).alias("norm"), F.coalesce("n", F.lit(0)).alias("usage"), F.lit(CONFIDENCE).alias("conf"))


def tiled(a: DataFrame, b: DataFrame, context: str, a_id: str, b_id: str, tile: int = 4096) -> DataFrame:
    """All pairs of a and b within a context, as tiles of about tile x tile rows: a context of any size is many tasks' work, and a row goes to as many tiles as its own context has on a side, which is one up to `tile` rows."""
    large = a.groupBy(context).agg(F.ceil(F.count("*") / tile).cast("int").alias("_n")).where("_n > 1")  # at most a row for each `tile` rows of a
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = lambda rows: rows.join(large, context, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("_n")).cast("int")
    left = sized(a).withColumn("_i", place(a_id)).withColumn("_j", every).drop("_n").repartition(parts, context, "_i", "_j")
    right = sized(b).withColumn("_j", place(b_id)).withColumn("_i", every).drop("_n").repartition(parts, context, "_i", "_j")
    return left.join(right, [context, "_i", "_j"]).drop("_i", "_j")


def sim(nodes: DataFrame) -> DataFrame:
    """(src, dst, grp, cos, usage, conf): each memory as a query against the others of its context group; usage and conf are dst's."""
    nodes = stored(nodes)
    a = nodes.select("grp", F.col("id").alias("src"), F.col("v").alias("va"), F.col("norm").alias("na"))
    b = nodes.select("grp", F.col("id").alias("dst"), F.col("v").alias("vb"), F.col("norm").alias("nb"), "usage", "conf")
    cos = F.round(vectors.cosine(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")), 9)
    return tiled(a, b, "grp", "src", "dst").where("src <> dst").select("src", "dst", "grp", cos.alias("cos"), "usage", "conf")


def near(nodes: DataFrame, k: int, least: float | None = None, bonus: Column | None = None) -> DataFrame:
    """(src, dst, cos, score, rank): each memory's best k of its context group, without scoring all pairs; score is cos, with a bonus of dst's if there is one."""
    return nearest(nodes.select("id", "grp", "v", (F.lit(0.0) if bonus is None else bonus).alias("bonus")), k, least)


def pair_cos(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (q, node, ..) of one context each, with cos, usage and conf (of node), scored pair by pair."""
    return cosines(pairs, nodes).withColumn("cos", F.round("cos", 9))


VEC = f"""vec AS (SELECT vec_id AS id, label AS grp, CAST(embedding AS DOUBLE[]) AS v, coalesce(n, 0) AS usage, CAST({CONFIDENCE} AS DOUBLE) AS conf
  FROM embeddings LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u ON user_id = vec_id)"""
SIM = """sim AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, a.grp AS grp, round(list_cosine_similarity(a.v, b.v), 9) AS cos, b.usage AS usage, b.conf AS conf
  FROM vec a JOIN vec b ON a.grp = b.grp AND a.id <> b.id)"""


# -- edges: each memory's four most similar of its group, from a similarity of 0.18 on

TOP_EDGES, THRESHOLD = 4, 0.18


def top_edges(scored: DataFrame, score: str, k: int = TOP_EDGES, threshold: float = THRESHOLD) -> DataFrame:
    """The best k of each src from the threshold on, the smaller dst of equals."""
    order = Window.partitionBy("src").orderBy(F.desc(score), "dst")
    return scored.where(F.col(score) >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vec(spark, sf_dir)
    return near(nodes, TOP_EDGES, THRESHOLD).join(nodes.select(F.col("id").alias("src"), "grp"), "src").select("src", "dst", "grp", F.col("cos").alias("weight"))


EDGES = f"""edges AS MATERIALIZED (SELECT src, dst, grp, cos AS weight FROM sim WHERE cos >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) <= {TOP_EDGES})"""


# -- memories with texts: messages, in the context of their conversation

def sql_tokens(text_sql: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text_sql}, ''), '[A-Za-z0-9][A-Za-z0-9_\\-]*|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda t: lower(t)), lambda t: len(t) > 1 AND t NOT IN ({quoted(words.STOPWORDS)}))"


def sql_top(toks: str, limit: int) -> str:
    return f"list_transform(list_slice(list_sort(list_transform(list_distinct({toks}), lambda t: {{'c': -len(list_filter({toks}, lambda x: x = t)), 'p': list_position({toks}, t), 't': t}})), 1, {limit}), lambda s: s.t)"


def sql_entities(text_sql: str, limit: int = 8) -> str:
    """Distinct in order of first occurrence. A mark after each sign stands for the look-around that this engine lacks; other letters become §."""
    marked = f"regexp_replace(regexp_replace(coalesce({text_sql}, ''), '[^\\x00-\\x7F]', '§', 'g'), '([^A-Za-z0-9_§])', '\\1' || chr(1), 'g')"
    word = "[A-Z](?:[A-Za-z0-9_]|-\\x01)*"
    found = f"list_transform(regexp_extract_all({marked}, '(?:^|\\x01)({word}(?:(?:\\s\\x01)+{word})*)(?:$|[^A-Za-z0-9_§])', 1), lambda e: replace(e, chr(1), ''))"
    kept = f"list_filter({found}, lambda e: lower(e) NOT IN ({quoted(words.QUESTION_WORDS)}))"
    return f"list_slice(list_transform(list_sort(list_transform(list_distinct({kept}), lambda e: {{'p': list_position({kept}, e), 'e': e}})), lambda s: s.e), 1, {limit})"


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")  # the work on a text is far more than moving it, and a file may be one split
    toks = text.tokens(F.col("text"))
    base = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("conv"), "turn", "role", "text", toks.alias("toks"), text.surface_entities(F.col("text")).alias("ents"))
    return base.withColumn("kw", text.top_tokens(F.col("toks"), 8))


def pairs(messages: DataFrame, columns: list[str]) -> DataFrame:
    """All ordered pairs of different messages of one conversation, the context that bounds them, with columns of both (a_.., b_..)."""
    side = lambda p: messages.select("conv", *[F.col(c).alias(f"{p}_{c}") for c in ("id", *columns)])
    return tiled(side("a"), side("b"), "conv", "a_id", "b_id").where("a_id <> b_id")


def message_embeddings(messages: DataFrame) -> DataFrame:
    return vectors.hash_embedding(messages, ["id"], "toks")


MSG = f"""msg AS MATERIALIZED (SELECT *, {sql_top("toks", 8)} AS kw FROM (
  SELECT conv_id || ':' || turn AS id, conv_id AS conv, turn, role, text, {sql_tokens("text")} AS toks, {sql_entities("text")} AS ents FROM conversations))"""
EMB = """emb AS MATERIALIZED (SELECT id, idx, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS val FROM (
  SELECT id, CAST('0x' || substr(sha1(t), 1, 8) AS BIGINT) % 256 AS idx, sum(CASE WHEN CAST('0x' || substr(sha1(t), 9, 2) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s
  FROM (SELECT id, unnest(toks) AS t FROM msg) GROUP BY ALL) WHERE s <> 0)"""
PAIRS = """pairs AS MATERIALIZED (SELECT a.conv AS conv, a.id AS a_id, b.id AS b_id, a.turn AS a_turn, b.turn AS b_turn, a.role AS a_role, b.role AS b_role, a.kw AS a_kw, b.kw AS b_kw, a.ents AS a_ents, b.ents AS b_ents,
    round(coalesce(cos, 0.0), 9) AS cos
  FROM msg a JOIN msg b ON a.conv = b.conv AND a.id <> b.id
  LEFT JOIN (SELECT x.id AS i, y.id AS j, sum(x.val * y.val) AS cos FROM emb x JOIN msg mx ON mx.id = x.id JOIN emb y USING (idx) JOIN msg my ON my.id = y.id AND mx.conv = my.conv GROUP BY 1, 2) s ON i = a.id AND j = b.id)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs() of messages with cos. Messages are tokenised and embedded once; a pair's score needs no shuffle of its own."""
    m = stored(vectors.packed_embedding(msg(spark, sf_dir), ["id"], "toks").drop("toks", "text"))
    p = pairs(m.withColumn("v", vectors.dense(F.col("lookup"))), ["turn", "role", "kw", "ents", "v"])
    return p.withColumn("cos", F.round(vectors.dot(F.col("a_v"), F.col("b_v")), 9)).drop("a_v", "b_v")
