"""Memories that come in deliveries: nodes inserted with the edges they bring, and objects in new versions.

Every micro-batch writes under its own number what it adds, and reads what those before it wrote. A batch that runs again
(after a failure, or a lost executor) therefore sees the same state and replaces its own rows: nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.functions import words
from tessera.operators import objects

LISTS = "ctx string, term string, id string"
EDGES = "src string, dst string, relation string, weight double"
COUNTS = "nodes long, scored long, edges long"
UNITS = "object long, unit long, version int, text string, entities array<string>"
DELTA = "object long, unit long, change string, entities array<string>, was array<string>, version int"


class Log:
    """A folder that deliveries are written to and a stream reads, with tables that its batches write."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root, schema

    def deliver(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/log/delivery={number}")

    def run(self, process: Callable[[DataFrame, int], None]) -> None:
        """Process what has come since the last run. Progress is checkpointed, so a run goes on where the last one ended."""
        stream = self.spark.readStream.schema(StructType([*self.schema.fields, StructField("delivery", IntegerType())])).parquet(f"{self.root}/log")
        stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(process).start().awaitTermination()

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows that batches (before one) wrote, with `batch`."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        kind = StructType([*StructType.fromDDL(schema).fields, StructField("batch", LongType())])
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(f"{self.root}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)


def replay(log: Log, deliveries: Iterable[DataFrame], process: Callable[[DataFrame, int], None]) -> None:
    """Deliver one after the other, and run the stream after each."""
    for number, rows in enumerate(deliveries):
        log.deliver(rows, number)
        log.run(process)


# -- nodes


def lists(nodes: DataFrame) -> DataFrame:
    """The inverted lists (ctx, term, id) of nodes (id, ctx, kw, ents): entities, and keywords that tell something."""
    noise = sorted({*words.GENERIC_EDGE_KEYWORDS, *words.LOW_INFORMATION_EDGE_KEYWORDS})
    terms = F.array_union(F.transform("ents", lambda e: F.concat(F.lit("e:"), e)), F.transform(F.filter("kw", lambda k: ~k.isin(noise)), lambda k: F.concat(F.lit("k:"), k)))
    return nodes.where("ctx is not null").select(F.col("ctx").cast("string").alias("ctx"), F.explode(terms).alias("term"), F.col("id").cast("string").alias("id"))


def shared_terms(new: DataFrame, old: DataFrame) -> DataFrame:
    """(a, b, entities, keywords): how many of either a new node shares with one before it, or with a new one of larger id. Both tables are lists()."""
    ahead = new.select("ctx", "term", F.col("id").alias("a"))
    among = ahead.join(new.withColumnRenamed("id", "b"), ["ctx", "term"]).where("a < b")
    both = ahead.join(old.select("ctx", "term", F.col("id").alias("b")), ["ctx", "term"]).unionByName(among)
    return both.groupBy("a", "b").agg(F.count_if(F.col("term").startswith("e:")).alias("entities"), F.count_if(F.col("term").startswith("k:")).alias("keywords"))


def insertion(log: Log, nodes_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A micro-batch's work: its nodes' lists, edges with the nodes there are, found by the lists of the terms they hold, and counts. Similarity makes no edges here: those are made when a query comes by."""

    def process(batch: DataFrame, number: int) -> None:
        nodes = nodes_of(batch)
        log.write("nodes", nodes.select(F.col("ctx").cast("string").alias("ctx"), F.col("id").cast("string").alias("id")), number)
        log.write("lists", lists(nodes), number)
        every = log.read("lists", LISTS)
        new = every.where(F.col("batch") == number).drop("batch")
        old = every.where(F.col("batch") < number).drop("batch").join(new.select("ctx", "term").distinct(), ["ctx", "term"], "left_semi")
        met = shared_terms(new, old)
        by_entity, by_keyword = F.col("entities") > 0, F.col("keywords") >= 2
        relation = F.when(by_entity, "shared_entity").when(by_keyword, "keyword_overlap")
        weight = F.when(by_entity, F.least(F.lit(0.95), 0.55 + 0.12 * F.col("entities"))).otherwise(F.least(F.lit(0.85), 0.35 + 0.08 * F.col("keywords")))
        log.write("scored", met.select("a", "b", relation.alias("relation"), weight.alias("weight")), number)
        made = log.read("scored", "a string, b string, relation string, weight double").where(F.col("batch") == number)
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        log.write("edges", made.where("relation is not null").select(both.alias("e"), "relation", "weight").select("e.src", "e.dst", "relation", "weight"), number)
        sizes = made.agg(F.count("*").alias("scored"), (2 * F.count("relation")).alias("edges"))
        held = log.read("nodes", "ctx string, id string").where(F.col("batch") == number).agg(F.count("*").alias("nodes"))
        log.write("counts", held.crossJoin(sizes).select("nodes", "scored", "edges"), number)  # one row each

    return process


# -- objects


def current(units: DataFrame) -> DataFrame:
    """The units of each object's newest version."""
    newest = Window.partitionBy("object")
    return units.withColumn("_v", F.max("version").over(newest)).where("version = _v").drop("_v")


def object_versions(log: Log) -> Callable[[DataFrame, int], None]:
    """A micro-batch's work: the units of the objects that it brings in a new version, and what differs from the version before."""

    def process(batch: DataFrame, number: int) -> None:
        log.write("units", current(batch.select("object", "unit", F.col("delivery").alias("version"), "text", "entities")), number)
        rows = log.read("units", UNITS)
        new = rows.where(F.col("batch") == number).drop("batch")
        old = rows.where(F.col("batch") < number).drop("batch").join(new.select("object").distinct(), "object", "left_semi")
        _, delta = objects.changed_units(current(old), new)
        versions = new.select("object", "version").distinct()
        log.write("delta", delta.join(versions, "object").select("object", "unit", "change", "entities", "was", "version"), number)

    return process


def links(hubs: DataFrame, versions: Column) -> DataFrame:
    """(version, links): the ordered pairs of units of different objects that hold an entity, for each entity, after each of the versions (an array).

    hubs: changed_hubs() with version. Counts of units an entity and object are enough: no pair is made.
    """
    later = F.explode(F.filter(versions, lambda v: v >= F.col("version")))
    held = hubs.select(later.alias("at"), "entity", "object", "op").groupBy("at", "entity", "object").agg(F.sum("op").alias("n"))
    each = held.groupBy("at", "entity").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("n"))
    return each.groupBy(F.col("at").alias("version")).agg(F.sum("n").alias("links"))
