"""Streams over the memory event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.stored import folder


def read_log(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The Parquet table of that name in a folder, one file or a directory of them, as its files come."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{folder}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)  # a stream's path must be a directory


def read_in_order(log: DataFrame, time: str, files: int = 4) -> DataFrame:
    """A stream of a log's rows as they would have come: a range of time a file, the files' own times in that order, one a trigger."""
    spark, root = log.sparkSession, folder(log)
    log.select("*", F.col(time).alias("_at")).repartitionByRange(files, "_at").drop("_at").write.parquet(f"{root}/ranges")
    fs = spark._jvm.org.apache.hadoop.fs
    names = sorted(p.rpartition("/")[2] for p in spark.read.parquet(f"{root}/ranges").inputFiles())  # tasks, and so files, are numbered by range
    store = fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(names):
        store.setTimes(fs.Path(f"{root}/ranges/{name}"), 1_000_000_000_000 + 1000 * i, -1)  # a file stream takes the oldest first
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/ranges")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by type in tumbling windows; events later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def usage_counts(events: DataFrame) -> DataFrame:
    """Running usage of each memory: the stream's form of the usage fold."""
    return events.groupBy("user_id").agg(F.count("*").alias("usage"), F.max("event_id").alias("last_event"))


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run all that is there through the stream; the result has each key's latest row.

    Every micro-batch writes the rows that it changed to the shared folder, under its number, so a batch that runs again
    replaces what it wrote; the stream's own state and progress are checkpointed beside them. In update mode a watermark lets
    old state go, and nothing but the batches' names reaches the driver.
    """
    spark, root = stream.sparkSession, folder(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
