"""A corpus pipeline of five stages, each one of the training-data operators. Part of the subpackage tessera.llm.

Stages take what their predecessor kept, written as Parquet and read again. The first four return the columns of documents,
the last the tokens' digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard, quality, suffix
from tessera.llm.shared import materialize, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1. Learnt from what documents these are and the labels' training rows.

    Null and empty texts have the score of the bias alone; repeated rows get equal scores; an empty table gives an empty one.
    """
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document of the smallest doc_id; of repeated rows of that doc_id, one. Texts without words are groups of their own and stay."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of fifty words or more that start anywhere else too; n_chars follows the text.

    Null texts stay null, and texts that lose nothing stay as they are; a text that stands in several rows goes whole if it
    has fifty words.
    """
    cut = suffix.remove(docs, suffix.PASSAGE, unit="word")
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark rule does not call contaminated. Null and word-less texts stay, and so do all documents if the benchmark is empty; repeated rows go or stay together."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, a row a document: null and empty texts have 0 tokens, repeated rows stay."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_quality), ("n-gram jaccard join", keep_one_of_similar), ("suffix-array dedup", cut_repeats), ("benchmark decontamination", drop_contaminated), ("bpe encoding and decoding", tokenise)]
#: The classifier and the tokenizer have no SQL form; tests/llm hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
