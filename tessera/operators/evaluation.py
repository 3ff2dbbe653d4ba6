"""Scores of evaluations: seeds of a walk, analogies, cost against effect, densities, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lexical_score(query_terms: Column, node_terms: Column) -> Column:
    """The share of a query's distinct terms that a node has; 0 of no terms."""
    return F.when(F.size(query_terms) > 0, F.size(F.array_intersect(query_terms, node_terms)) / F.size(query_terms)).otherwise(F.lit(0.0))


def seed_score(cos: Column, lexical: Column) -> Column:
    return 0.62 * cos + 0.38 * lexical


def analogy_signal(match: Column, confidence: Column) -> tuple[Column, Column]:
    """(graph score, boost) that a node gets from a similar case: match is the cases' similarity, confidence the case's."""
    return F.least(F.lit(1.0), 0.72 * match + 0.18 * confidence + 0.10), F.least(F.lit(0.16), 0.12 * match)


def cost_effect(rows: DataFrame, baseline: str) -> DataFrame:
    """rows (strategy, edges, candidate_pairs, seconds, found, wanted) with recall, cost_index, score, balanced_score and the gain over a baseline strategy. One row a strategy."""
    whole = Window.partitionBy()
    part = lambda weight, c: weight * F.col(c) / F.max(c).over(whole)
    r = rows.withColumn("recall", F.col("found") / F.nullif(F.col("wanted"), F.lit(0))).withColumn("cost_index", part(0.4, "edges") + part(0.3, "candidate_pairs") + part(0.3, "seconds"))
    of_baseline = F.max(F.when(F.col("strategy") == baseline, F.col("recall"))).over(whole)
    return r.withColumns({"score": F.col("recall") / (1 + F.col("cost_index")), "balanced_score": F.col("recall") - 0.15 * F.col("cost_index"), "gain": F.col("recall") - of_baseline})


def density_score(gain: Column, edges: Column, noise: Column, seconds: Column | None = None) -> Column:
    time = F.lit(0.0) if seconds is None else seconds
    return (F.greatest(F.lit(0.0), gain) + 0.5 * (edges - noise) / edges) / ((1 + edges / 1000 + time) * (1 + noise / edges))


def leaks(rows: DataFrame, key: str, path: str, query_ids: DataFrame) -> DataFrame:
    """paths and leaks: rows, and rows of whose path a part is a query's id. Parts meet ids by equality, not by substrings of all pairs."""
    wanted = query_ids.select(F.col(query_ids.columns[0]).cast("string").alias("_part")).distinct()
    bad = rows.select(key, F.explode(path).alias("_part")).join(wanted, "_part", "left_semi").agg(F.countDistinct(key).alias("leaks"))
    return rows.agg(F.count("*").alias("paths")).crossJoin(bad)  # one row each
