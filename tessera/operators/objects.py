"""Objects (a session, a paper, a repository) made of units that hold entities: walks across objects, and what a new version of an object changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: The weight of a bridge, and what similarity, walk, bridge and confidence give a hit.
BRIDGE_WEIGHT = 0.72
SIMILARITY, GRAPH, BONUS, CONFIDENCE = 0.52, 0.36, 0.12, 0.03


def bridge_walk(seeds: DataFrame, units: DataFrame, hops: int) -> DataFrame:
    """(q, node, path, g) that a breadth-first walk from a query's seeds reaches over bridges: steps between units of different objects that share an entity.

    seeds: (q, node, rank); units: (id, object, entity), which no query is one of unless it may be reached. A later arrival
    at a deeper level weighs more, so that each level's first arrival at a node counts, in the order of the queue: by the
    node left, then by the node reached. No pair of units is made: entities are hubs. A query comes to a hub with the first
    two of its units that are of different objects, which are all that any other unit needs to know, and leaves it once for
    each unit that holds it. Only where a unit might come back to a place on its own path all ways to it are looked at.
    """
    held = units.select("id", "object", "entity").distinct()
    out = seeds.select("q", "node", F.array("node").alias("path"), F.lit(0.0).alias("g"), F.lit(0).alias("depth"))
    frontier = seeds.select("q", "node", F.array("node").alias("path"), F.lit(0.0).alias("g"), F.col("rank").cast("long").alias("ord"))
    way = F.struct("ord", "path", "g")
    for depth in range(hops):
        frontier = stored(frontier)
        at = frontier.join(held.withColumnRenamed("id", "node"), "node")
        firsts = at.groupBy("q", "entity", "object").agg(F.min(way).alias("w"))
        two = firsts.withColumn("r", F.row_number().over(Window.partitionBy("q", "entity").orderBy("w.ord"))).where("r <= 2").select("q", "entity", "object", "w")
        behind = frontier.select("q", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("next")).distinct()
        ahead = held.select(F.col("id").alias("next"), F.col("object").alias("to"), "entity")
        reached = two.join(ahead, "entity").where((F.col("object") != F.col("to")) & (F.col("next") != F.col("q"))).groupBy("q", "next").agg(F.min("w").alias("w"))
        if depth:
            back = at.select("q", "entity", "object", way.alias("w")).join(behind.join(ahead, "next"), ["q", "entity"]).where((F.col("object") != F.col("to")) & (F.col("next") != F.col("q")) & ~F.array_contains("w.path", F.col("next")))
            reached = reached.join(behind, ["q", "next"], "left_anti").unionByName(back.groupBy("q", "next").agg(F.min("w").alias("w")))
        step = reached.select("q", F.col("next").alias("node"), F.concat("w.path", F.array("next")).alias("path"), (F.col("w.g") + BRIDGE_WEIGHT / (depth + 1)).alias("g"), F.col("w.ord").alias("from"))
        step = stored(step.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("from", "node")).cast("long")))
        out = out.unionByName(step.select("q", "node", "path", "g", F.lit(depth + 1).alias("depth")))
        frontier = step.select("q", "node", "path", "g", "ord")
    last = Window.partitionBy("q", "node").orderBy(F.desc("depth"))
    return out.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("q", "node", "path", "g")


def walk_score(cos: Column, g: Column, path: Column, confidence: Column) -> Column:
    """Similarity, walk and confidence, and a bonus for what a bridge led to."""
    return SIMILARITY * cos + GRAPH * g + F.when(F.size(path) > 1, BONUS).otherwise(0.0) + CONFIDENCE * confidence


def changed_units(before: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units after a batch, delta). Both tables: (object, unit, version, text, entities), a row a unit; a batch holds all units of its objects, in their newest versions.

    delta: (object, unit, change, entities, was), change being added, updated, same or removed, was the entities before.
    """
    touched = batch.select("object").distinct()
    old = before.join(touched, "object", "left_semi").select("object", "unit", F.col("text").alias("_text"), F.col("entities").alias("was"), F.lit(True).alias("_old"))
    both = batch.withColumn("_new", F.lit(True)).join(old, ["object", "unit"], "full")
    same = F.col("text").eqNullSafe(F.col("_text")) & F.col("entities").eqNullSafe(F.col("was"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "same").otherwise("updated")
    none = F.array().cast("array<string>")
    delta = both.select("object", "unit", change.alias("change"), F.coalesce("entities", none).alias("entities"), F.coalesce("was", none).alias("was"))
    return before.join(touched, "object", "left_anti").unionByName(batch.select(*before.columns)), delta


def changed_hubs(delta: DataFrame) -> DataFrame:
    """(object, unit, entity, op): entities that units came to hold (1) or hold no longer (-1): a bridge stands where two objects' units hold an entity, so these are all that makes or retracts bridges."""
    one = lambda a, b, op: delta.select("object", "unit", F.explode(F.array_except(a, b)).alias("entity"), F.lit(op).alias("op"))
    return one("entities", "was", 1).unionByName(one("was", "entities", -1))
