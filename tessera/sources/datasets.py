"""Adapters of evaluation data sets. Each returns DataFrames: documents (id, dataset, title, text, source, metadata columns)
and queries (id, dataset, question, answer, supporting_doc_ids, candidate_doc_ids).

All are plans over spark.read: nothing is collected, and files may lie wherever Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text

DOCUMENT = "id string, dataset string, title string, text string, source string, tags array<string>, keywords array<string>, metadata map<string,string>"
QUERY = "id string, dataset string, question string, answer string, supporting_doc_ids array<string>, candidate_doc_ids array<string>, metadata map<string,string>"
UNIFIED = f"schema_version string, dataset_info map<string,string>, processing map<string,string>, documents array<struct<{', '.join(c.replace(' ', ':', 1) for c in DOCUMENT.split(', '))}>>, queries array<struct<{', '.join(c.replace(' ', ':', 1) for c in QUERY.split(', '))}>>"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path).na.drop("all")


def unified(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of a unified data-set file; a schema_version other than `version` raises when rows are read."""
    whole = spark.read.schema(UNIFIED).json(path, multiLine=True)
    known = F.when(F.col("schema_version") == version, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown schema_version: "), F.coalesce("schema_version", F.lit("none")))).cast("boolean"))
    checked = whole.where(known)
    return checked.select(F.explode("documents").alias("d")).select("d.*"), checked.select(F.explode("queries").alias("q")).select("q.*")


def write_unified(documents: DataFrame, queries: DataFrame, path: str, name: str, version: str) -> None:
    """One JSON object with all documents and queries, as unified() reads it. The format is one object, so one row holds all: for evaluation sets, not for corpora."""
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    d = documents.agg(F.collect_list(F.struct(*names(DOCUMENT))).alias("documents"))
    q = queries.agg(F.collect_list(F.struct(*names(QUERY))).alias("queries"))
    head = [F.lit(version).alias("schema_version"), F.create_map(F.lit("name"), F.lit(name)).alias("dataset_info"), F.create_map().cast("map<string,string>").alias("processing")]
    d.join(q).select(*head, "documents", "queries").coalesce(1).write.mode("overwrite").json(path)


HOTPOT = "_id string, question string, answer string, supporting_facts array<array<string>>, context array<struct<title:string, sentences:array<string>>>"


def hotpot(spark: SparkSession, path: str, sample_size: int, max_scan: int) -> tuple[DataFrame, DataFrame]:
    """Questions whose support titles are two or more, all in the context, and of which one text mentions another title."""
    raw = spark.read.json(path, multiLine=True, schema="_id string, question string, answer string, supporting_facts string, context string")
    parsed = raw.select(
        "_id", "question", "answer", F.monotonically_increasing_id().alias("ord"),
        F.array_distinct(F.transform(F.from_json("supporting_facts", "array<array<string>>"), lambda f: f[0])).alias("support"),
        F.transform(F.from_json("context", "array<array<string>>"), lambda c: F.struct(c[0].alias("title"), F.array_join(F.from_json(c[1], "array<string>"), " ").alias("text"))).alias("paragraphs"),
    ).orderBy("ord").limit(max_scan)
    gold = F.filter("paragraphs", lambda p: F.array_contains("support", p["title"]))
    mentions = F.exists(gold, lambda p: F.exists("support", lambda t: (t != p["title"]) & F.contains(F.lower(p["text"]), F.lower(t))))
    titles = F.transform("paragraphs", lambda p: p["title"])
    kept = parsed.where((F.size("support") >= 2) & (F.size(F.array_except("support", titles)) == 0) & mentions).orderBy("ord").limit(sample_size)
    doc_id = lambda pos: F.concat(F.lit("hotpotqa_"), "_id", F.lit("_"), pos.cast("string"))
    each = kept.select("_id", "support", titles.alias("titles"), F.posexplode("paragraphs").alias("pos", "p"))
    entities = F.array_distinct(F.concat(F.array("p.title"), F.filter("titles", lambda t: F.contains(F.lower(F.col("p.text")), F.lower(t)))))
    documents = each.select(doc_id(F.col("pos")).alias("id"), F.lit("hotpotqa").alias("dataset"), F.col("p.title").alias("title"), F.col("p.text").alias("text"), F.lit("hotpotqa").alias("source"), F.col("_id").alias("query_id"), F.col("pos").alias("paragraph_index"), entities.alias("entities"), F.array_contains("support", F.col("p.title")).alias("is_supporting"))
    ids = F.transform("paragraphs", lambda p, i: F.struct(doc_id(i).alias("id"), F.array_contains("support", p["title"]).alias("s")))
    queries = kept.select(F.col("_id").alias("id"), F.lit("hotpotqa").alias("dataset"), "question", "answer", F.transform(F.filter(ids, lambda x: x["s"]), lambda x: x["id"]).alias("supporting_doc_ids"), F.transform(ids, lambda x: x["id"]).alias("candidate_doc_ids"))
    return documents, queries


def litsearch(spark: SparkSession, query_path: str, corpus_path: str, sample_size: int) -> tuple[DataFrame, DataFrame]:
    """Papers as documents, questions whose gold papers are all in the corpus; every paper is a candidate's pool member by its id."""
    q = jsonl(spark, query_path, "query_set string, query string, specificity bigint, quality bigint, corpusids array<bigint>").withColumn("ord", F.monotonically_increasing_id())
    c = jsonl(spark, corpus_path, "corpusid bigint, title string, abstract string, citations array<bigint>")
    doc_id = lambda x: F.concat(F.lit("litsearch_doc_"), x.cast("string"))
    documents = c.select(doc_id(F.col("corpusid")).alias("id"), F.lit("litsearch").alias("dataset"), "title", F.col("abstract").alias("text"), F.lit("litsearch").alias("source"), F.transform("citations", doc_id).alias("citations"))
    there = q.select("ord", F.explode("corpusids").alias("corpusid")).join(c.select("corpusid").distinct().withColumn("ok", F.lit(1)), "corpusid", "left").groupBy("ord").agg(F.count("*").alias("wanted"), F.count("ok").alias("found"))
    kept = q.join(there.where("wanted = found"), "ord").orderBy("ord").limit(sample_size)
    queries = kept.select(F.concat(F.lit("litsearch_"), F.col("ord").cast("string")).alias("id"), F.lit("litsearch").alias("dataset"), F.col("query").alias("question"), F.lit("").alias("answer"), F.transform("corpusids", doc_id).alias("supporting_doc_ids"))
    return documents, queries


def scifact(spark: SparkSession, corpus_path: str, claims_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, evidence): claims with labels and rationale sentences by document."""
    c = jsonl(spark, corpus_path, "doc_id bigint, title string, abstract array<string>, structured boolean")
    q = jsonl(spark, claims_path, "id bigint, claim string, evidence map<string, array<struct<label:string, sentences:array<int>>>>, cited_doc_ids array<bigint>")
    doc_id = lambda x: F.concat(F.lit("scifact_doc_"), x.cast("string"))
    documents = c.select(doc_id(F.col("doc_id")).alias("id"), F.lit("scifact").alias("dataset"), "title", F.array_join("abstract", " ").alias("text"), F.lit("scifact").alias("source"), "abstract")
    gold = F.transform(F.map_keys("evidence"), doc_id)
    queries = q.select(F.concat(F.lit("scifact_"), F.col("id").cast("string")).alias("id"), F.lit("scifact").alias("dataset"), F.col("claim").alias("question"), gold.alias("supporting_doc_ids"), F.array_distinct(F.concat(gold, F.transform("cited_doc_ids", doc_id))).alias("candidate_doc_ids"))
    each = q.select("id", F.explode("evidence").alias("doc", "sets")).select("id", "doc", F.explode("sets").alias("s"))
    evidence = each.select(F.concat(F.lit("scifact_"), F.col("id").cast("string")).alias("query_id"), doc_id(F.col("doc")).alias("doc_id"), "s.label", "s.sentences")
    rationale = evidence.join(documents.select(F.col("id").alias("doc_id"), "abstract"), "doc_id", "left").withColumn("rationale", F.transform("sentences", lambda i: F.get("abstract", i))).drop("abstract")
    return documents.drop("abstract"), queries, rationale


QASPER = "id string, title string, full_text struct<section_name:array<string>, paragraphs:array<array<string>>>, qas array<struct<question:string, question_id:string, answers:array<struct<answer:struct<free_form_answer:string, extractive_spans:array<string>, evidence:array<string>, highlighted_evidence:array<string>, unanswerable:boolean, yes_no:boolean>>>>>"


def qasper(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with their path (paper, section, paragraph); questions whose evidence texts are matched to paragraphs by equality."""
    raw = jsonl(spark, path, QASPER)
    sections = raw.select("id", "title", F.posexplode(F.arrays_zip("full_text.section_name", "full_text.paragraphs")).alias("s", "sec"))
    each = sections.select("id", "title", "s", F.col("sec.section_name").alias("section"), F.posexplode("sec.paragraphs").alias("p", "text")).where(F.trim("text") != "")
    number = F.row_number().over(Window.partitionBy("id").orderBy("s", "p")) - 1
    key = F.concat(F.lit("qasper_"), "id", F.lit("_para_"), F.lpad(F.col("n").cast("string"), 4, "0"))
    documents = each.withColumn("n", number).select(
        key.alias("id"), F.lit("qasper").alias("dataset"), "title", "text", F.lit("qasper").alias("source"), F.col("id").alias("paper_id"), "section", F.col("n").alias("position"),
        F.array(F.concat(F.lit("paper:"), "id"), F.concat(F.lit("section:"), "section"), F.concat(F.lit("paragraph:"), F.col("n").cast("string"))).alias("context_path"),
    )
    qas = raw.select("id", F.explode("qas").alias("q")).select(F.col("id").alias("paper_id"), "q.question_id", "q.question", F.col("q.answers")[0]["answer"].alias("a"))
    answer = F.coalesce(F.nullif("a.free_form_answer", F.lit("")), F.nullif(F.array_join("a.extractive_spans", "; "), F.lit("")), F.when(F.col("a.yes_no"), "yes").when(~F.col("a.yes_no"), "no"))
    wanted = qas.select("paper_id", "question_id", F.explode(F.array_distinct(F.concat(F.coalesce("a.evidence", F.array()), F.coalesce("a.highlighted_evidence", F.array())))).alias("text"))
    found = wanted.join(documents.select("paper_id", "text", F.col("id").alias("doc")), ["paper_id", "text"]).groupBy("question_id").agg(F.array_sort(F.collect_set("doc")).alias("supporting_doc_ids"))
    queries = qas.select(F.concat(F.lit("qasper_"), "question_id").alias("id"), "question_id", F.lit("qasper").alias("dataset"), "question", answer.alias("answer")).join(found, "question_id").drop("question_id")
    return documents, queries


def novel_chunks(spark: SparkSession, books: str, size: int = 300, overlap: int = 20) -> DataFrame:
    """Chunks of whole text files, a document each."""
    raw = spark.read.text(books, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("book_id"), "value")
    each = raw.select("book_id", F.posexplode(text.chunks(F.col("value"), size, overlap)).alias("chunk_index", "text"))
    return each.select(F.concat(F.lit("novelqa_"), "book_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"), F.lit("novelqa").alias("dataset"), "book_id", "chunk_index", "text")


def best_chunk(evidence: DataFrame, chunks: DataFrame, least: float = 0.35) -> DataFrame:
    """(key, id): of each evidence (key, book_id, evidence), the first chunk that contains it, or else the one that covers most of its keywords, from `least` on."""
    kw = text.top_tokens(text.tokens(F.col("evidence")), 32)
    e = evidence.withColumn("kw", kw)
    pairs = e.join(chunks.select("book_id", "id", "chunk_index", "text"), "book_id")
    inside = F.contains(F.lower("text"), F.lower(F.trim("evidence")))
    cover = text.overlap_ratio(F.col("kw"), text.tokens(F.col("text")))
    ranked = pairs.withColumns({"inside": inside, "cover": cover}).where(F.col("inside") | (F.col("cover") >= least))
    order = Window.partitionBy("key").orderBy(F.desc("inside"), F.when(F.col("inside"), F.lit(0.0)).otherwise(-F.col("cover")), "chunk_index")
    return ranked.withColumn("r", F.row_number().over(order)).where("r = 1").select("key", "id")


def nodes(documents: DataFrame) -> DataFrame:
    """Memories of documents: id, text, summary, keywords, confidence."""
    kw: Column = text.top_tokens(text.tokens(F.concat_ws("\n", "title", "text")), 8)
    return documents.select(text.stable_id("mem", F.col("id")).alias("id"), F.col("id").alias("original_doc_id"), "dataset", "title", "text", F.substring("text", 1, 180).alias("summary"), kw.alias("keywords"), "source", F.lit(0.86).alias("confidence"))


def first_queries(documents: DataFrame, queries: DataFrame, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n queries and only their candidate documents."""
    kept = queries.orderBy(order).limit(n)
    ids = kept.select(F.explode("candidate_doc_ids").alias("id")).distinct()
    return documents.join(ids, "id", "left_semi"), kept
