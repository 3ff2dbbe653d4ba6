"""Queries on texts: tokens, keywords, ids, entities, chunks, embeddings, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text, vectors

from . import base
from .base import EMB, MSG, sql_entities, sql_tokens, sql_top, table
from .registry import query, with_


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM t),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS p FROM e GROUP BY 1, 2)
SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c QUALIFY rank <= 8""")
def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keywords(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, 'mem_' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 16) AS id, substr(text, 1, 180) AS summary, CAST(0.86 AS DOUBLE) AS confidence, source AS context_group FROM documents")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.stable_id("mem", F.col("doc_id")).alias("id"), F.substring("text", 1, 180).alias("summary"), F.lit(0.86).alias("confidence"), F.col("source").alias("context_group"))


@query(f"SELECT doc_id, unnest(ents) AS entity, unnest(range(1, len(ents) + 1)) AS ord FROM (SELECT doc_id, {sql_entities('text')} AS ents FROM documents)")
def surface_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.surface_entities(F.col("text"))).alias("ord", "entity"))
    return e.select("doc_id", "entity", (F.col("ord") + 1).cast("long").alias("ord"))


@query(r"""WITH c AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(coalesce(html, ''),
    '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), ' '), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM pages),
s AS (SELECT page_id, list_filter(list_transform(range(0, CAST(len(t) AS BIGINT), 280), lambda i: regexp_replace(substr(t, i + 1, 300), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM c)
SELECT page_id, unnest(range(1, len(parts) + 1)) AS chunk, unnest(parts) AS text FROM s""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.chunks(text.strip_tags(F.col("html")), 300, 20)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(parts).alias("chunk", "text")).select("page_id", (F.col("chunk") + 1).cast("long").alias("chunk"), "text")


@query(with_(MSG, EMB) + "SELECT id, idx, round(val, 6) AS val FROM emb")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.message_embeddings(base.msg(spark, sf_dir)).select("id", F.col("idx").cast("long").alias("idx"), F.round("val", 6).alias("val"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(c, '[。！？.!?]\s') THEN regexp_extract(c, '^(.*?[。！？.!?])\s', 1) ELSE c END AS sentence, CAST(len(string_split_regex(c, ' ')) AS BIGINT) AS n_words,
  CASE WHEN len(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 79)) || '…' END AS compact
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)""")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"), F.size(F.split(clean, " ")).cast("long").alias("n_words"), text.compact(F.col("text"), 80).alias("compact"))


@query(r"""SELECT p_partkey, p_name, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS segment,
  CASE WHEN len(k) > 0 THEN array_to_string(k, '_') ELSE lower(trim(p_name)) END AS entity
FROM (SELECT *, """ + sql_top("toks", 16) + " AS k FROM (SELECT *, " + sql_tokens("replace(p_name, '_', ' ')") + " AS toks FROM part))")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", text.safe_segment(F.col("p_type")).alias("segment"), text.entity_name(F.col("p_name")).alias("entity"))


ANSWER = r"""list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' +'), lambda t: len(t) >= 3 AND t NOT IN ({1})))"""


@query(f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
a AS (SELECT conv_id, turn, lower(text) AS gold, lower(coalesce(answer, '')) AS got, {ANSWER.format('text', base.quoted(base.words.ANSWER_STOPWORDS))} AS terms FROM t)
SELECT conv_id, turn, CAST(len(terms) AS BIGINT) AS n_terms, round(CASE WHEN len(terms) < 2 THEN 0.0 ELSE len(list_filter(terms, lambda x: contains(got, x))) / len(terms) END, 6) AS coverage,
  CASE WHEN contains(gold, got) OR contains(got, gold) THEN 'substring' WHEN len(terms) >= 2 AND len(list_filter(terms, lambda x: contains(got, x))) >= 0.5 * len(terms) THEN 'key_terms_covered' ELSE 'miss' END AS verdict
FROM a""")
def answer_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as the gold answer, the one after it as the answer given; an empty answer is in any gold."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    gold, got = F.lower("text"), F.lower(F.coalesce("answer", F.lit("")))
    coverage = text.term_coverage(F.col("text"), got)
    verdict = F.when(F.contains(gold, got) | F.contains(got, gold), "substring").when(coverage >= 0.5, "key_terms_covered").otherwise("miss")
    return c.select("conv_id", "turn", F.size(text.answer_terms(F.col("text"))).cast("long").alias("n_terms"), F.round(coverage, 6).alias("coverage"), verdict.alias("verdict"))


@query("""SELECT item_id, doc_id FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS r FROM benchmark b JOIN documents d ON contains(d.text, b.text)) WHERE r = 1""")
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage's first document that contains it. Candidates come by an equi-join on the passage's rarest inner word, so no pair is scanned that shares none; the few passages without one (empty or of one or two words) are sent to all documents."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    # the first and last word may be parts of words in the document
    whole = b.select("item_id", F.col("text").alias("passage"), F.explode(F.expr("slice(split(text, '\\\\s+'), 2, greatest(size(split(text, '\\\\s+')) - 2, 0))")).alias("w")).distinct()
    in_docs = d.select("doc_id", F.explode(words(F.col("text"))).alias("w")).join(whole.select("w").distinct(), "w")
    rare = in_docs.groupBy("w").agg(F.count("*").alias("df"))
    pick = whole.join(rare, "w").groupBy("item_id", "passage").agg(F.min(F.struct("df", "w")).alias("m")).select("item_id", "passage", "m.w")
    found = pick.join(in_docs, "w").join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage"))
    short = b.where(F.size(F.split("text", r"\s+")) < 3).select("item_id", F.col("text").alias("passage")).distinct()
    found = found.select("item_id", "doc_id").unionByName(d.join(F.broadcast(short), F.contains("text", "passage")).select("item_id", "doc_id"))
    return found.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
