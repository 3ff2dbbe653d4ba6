"""State: upserts, folds of activations and feedback, and logs, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import words

ACTIVATION_STEP, SUPPORT_STEP, REJECT_STEP, LEAST_WEIGHT = 0.015, 0.025, -0.004, 0.01


def edge_rule(pairs: DataFrame, similarity_threshold: float = 0.18, overlap_threshold: int = 2) -> DataFrame:
    """pairs (a_ents, b_ents, a_kw, b_kw, cos) with shared, overlap, relation_type (null: no edge) and weight. The first rule that holds decides."""
    shared = F.array_sort(F.array_intersect("a_ents", "b_ents"))
    noise = F.array(*[F.lit(w) for w in sorted({*words.GENERIC_EDGE_KEYWORDS, *words.LOW_INFORMATION_EDGE_KEYWORDS})])
    overlap = F.array_sort(F.array_except(F.array_intersect("a_kw", "b_kw"), noise))
    p = pairs.withColumns({"shared": shared, "overlap": overlap})
    by_entity, by_keyword, by_cos = F.size("shared") > 0, F.size("overlap") >= overlap_threshold, F.col("cos") >= similarity_threshold
    return p.withColumns(
        {
            "relation_type": F.when(by_entity, "shared_entity").when(by_keyword, "keyword_overlap").when(by_cos, "embedding_similarity"),
            "weight": F.when(by_entity, F.least(F.lit(0.95), 0.55 + 0.12 * F.size("shared"))).when(by_keyword, F.least(F.lit(0.85), 0.35 + 0.08 * F.size("overlap"))).when(by_cos, F.least(F.lit(0.8), "cos")).otherwise(0.0),
        }
    )


def judge_wanted(relation: Column, shared: Column, policy: str = "risky") -> Column:
    """Whether an edge goes to a relation judge: none, all, or those that rest on keywords, similarity or no entity."""
    if policy not in ("off", "all", "risky"):
        raise ValueError(f"unknown policy: {policy}")
    risky = relation.isin("keyword_overlap", "embedding_similarity") | ((relation == "shared_entity") & (F.size(shared) == 0))
    return {"off": F.lit(False), "all": F.lit(True), "risky": risky}[policy]


def judged(weight: Column, confidence: Column) -> Column:
    return F.least(F.lit(0.98), weight * (0.7 + 0.3 * confidence))


def upsert_edges(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weight (the larger one) and action: created, updated or kept. Repeats of a key in a batch count once, with the largest weight."""
    old = existing.groupBy(*keys).agg(F.max("weight").alias("old"))
    new = incoming.groupBy(*keys).agg(F.max("weight").alias("new"))
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "created").otherwise("updated")
    return old.join(new, keys, "full").select(*keys, F.greatest("old", "new").alias("weight"), action.alias("action"))


def upsert_nodes(existing: DataFrame, incoming: DataFrame, key: str, order: str, kept: list[str], taken: list[str]) -> DataFrame:
    """Rows by key: `kept` columns stay those of the existing row, `taken` ones become those of the last incoming row (by order)."""
    last = incoming.groupBy(key).agg(F.max(F.struct(order, *kept, *taken)).alias("n"))
    both = existing.select(key, F.struct(*kept, *taken).alias("o")).join(last, key, "full")
    return both.select(key, *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in taken], F.col("o").isNull().alias("created"))


def fold_usage(nodes: DataFrame, touches: DataFrame, key: str, at: str) -> DataFrame:
    """nodes (key, usage) after every touch added one; last_accessed is the latest touch."""
    n = touches.groupBy(key).agg(F.count("*").alias("n"), F.max(at).alias("last_accessed"))
    return nodes.join(n, key, "left").select(key, (F.col("usage") + F.coalesce("n", F.lit(0))).alias("usage"), "last_accessed")


def path_edges(paths: DataFrame, keep: list[str]) -> DataFrame:
    """keep, src and dst of the neighbouring pairs of each row's path."""
    steps = F.expr("transform(slice(path, 1, size(path) - 1), (x, i) -> struct(x as src, path[i + 1] as dst))")
    return paths.where(F.size("path") > 1).select(*keep, F.explode(steps).alias("_e")).select(*keep, "_e.src", "_e.dst")


def activate(edges: DataFrame, used: DataFrame) -> DataFrame:
    """edges (src, dst, weight, activations) after each occurrence in used (src, dst) added its step; the clamp at 1 is one-sided, so the steps add up."""
    n = used.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hit = F.coalesce("n", F.lit(0))
    return edges.join(n, ["src", "dst"], "left").select("src", "dst", F.least(F.lit(1.0), F.col("weight") + ACTIVATION_STEP * hit).alias("weight"), (F.col("activations") + hit).alias("activations"))


def adjust(edges: DataFrame, feedback: DataFrame) -> DataFrame:
    """edges (src, dst, weight) after feedback (src, dst, support): first all support steps, then all rejections, each clamped to [0.01, 1]."""
    n = feedback.groupBy("src", "dst").agg(F.sum(F.col("support").cast("int")).alias("up"), F.sum((~F.col("support")).cast("int")).alias("down"))
    clamp = lambda w: F.least(F.lit(1.0), F.greatest(F.lit(LEAST_WEIGHT), w))
    up, down = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    raised = F.when(up > 0, clamp(F.col("weight") + SUPPORT_STEP * up)).otherwise(F.col("weight"))
    return edges.join(n, ["src", "dst"], "left").select("src", "dst", F.when(down > 0, clamp(raised + REJECT_STEP * down)).otherwise(raised).alias("weight"), up.alias("up"), down.alias("down"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges whose weight differs, with the difference."""
    b = before.select("src", "dst", F.col("weight").alias("old"))
    return b.join(after.select("src", "dst", F.col("weight").alias("new")), ["src", "dst"]).where(F.abs(F.col("new") - F.col("old")) > 1e-12).withColumn("delta", F.col("new") - F.col("old"))


def latest_versions(memories: DataFrame, keys: list[str], version: str, order: str) -> DataFrame:
    """The newest version of each key, the first in order of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), order)
    return memories.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
