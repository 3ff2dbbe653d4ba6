"""Agents' shared memory as a fold over ordered events: writes, handoffs and resolutions of conflicts.

An event makes a memory, whose version is the next of its (session, task). A resolution picks, of the memories that were
written under its (session, task) by the agents in conflict before it, the most confident (then the newest); it makes a
memory of its own and marks the others. State is the memories and marks that earlier batches wrote, so a batch may run
again, and batches of any cut of the log leave what one batch of the whole log does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import Log

#: seq orders a (session, task); op is write, handoff or resolve; message is what a memory's text and vector come from.
EVENT = "session string, task long, seq long, op string, node string, agent string, source string, target string, layer string, confidence double, message string"
MEMORY = EVENT + ", version long"
MARK = "node string, conflict_status string, resolution string, at long"
KEY = ["session", "task"]
#: A resolution's confidence over that of the memory it selects, its floor and its cap.
RAISE, FLOOR, CAP = 0.04, 0.7, 0.98
#: What tells memories of different kinds apart: of each kind, agents may ask for the newest version alone.
KIND = ["session", "task", "agent", "source", "target", "layer", "op"]


def folding(log: Log, contested: Column) -> Callable[[DataFrame, int], None]:
    """A micro-batch's work. contested: which written memories a resolution of their (session, task) is about."""

    def process(batch: DataFrame, number: int) -> None:
        columns = [c.split()[0] for c in EVENT.split(", ")]
        before = log.read("memories", MEMORY, number)
        touched = batch.select(*KEY).distinct()
        old = before.join(touched, KEY, "left_semi").drop("batch")
        last = old.groupBy(*KEY).agg(F.max("version").alias("_last"))
        place = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq", "node"))
        new = batch.select(*columns).join(last, KEY, "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + place).cast("long")).drop("_last")
        log.write("given", new, number)
        new = log.read("given", MEMORY).where(F.col("batch") == number).drop("batch")
        asked = new.where("op = 'resolve'").select(*KEY, F.col("seq").alias("_at"), F.col("node").alias("resolution"))
        met = old.unionByName(new).where(F.col("op") == "write").where(contested).join(asked, KEY).where("seq < _at")
        best = Window.partitionBy("resolution").orderBy(F.desc("confidence"), F.desc("version"))
        ranked = met.withColumn("_r", F.row_number().over(best))
        chosen = ranked.where("_r = 1").select(F.col("resolution").alias("node"), F.least(F.lit(CAP), F.greatest(F.lit(FLOOR), F.col("confidence") + RAISE)).alias("_c"), F.col("message").alias("_m"))
        made = new.join(chosen, "node", "left").withColumns({"confidence": F.coalesce("_c", "confidence"), "message": F.coalesce("_m", "message")})
        log.write("memories", made.select(*columns, "version"), number)
        marks = ranked.select("node", F.when(F.col("_r") == 1, "selected").otherwise("rejected").alias("conflict_status"), "resolution", F.col("_at").alias("at"))
        log.write("marks", marks.unionByName(asked.select(F.col("resolution").alias("node"), F.lit("resolved").alias("conflict_status"), "resolution", F.col("_at").alias("at"))), number)

    return process


def memories(log: Log) -> DataFrame:
    """MEMORY with conflict_status, null where none, and resolution: of several marks that of the last resolution counts."""
    marks = log.read("marks", MARK).groupBy("node").agg(F.max_by(F.struct("conflict_status", "resolution"), F.struct("at", "resolution")).alias("m"))
    return log.read("memories", MEMORY).drop("batch").join(marks, "node", "left").select(*[c.split()[0] for c in MEMORY.split(", ")], "m.conflict_status", "m.resolution")


def visible(rows: DataFrame, *, layers: list[str] | None = None, task: int | None = None, agent: str | None = None, source: str | None = None, statuses: list[str] | None = None, include_rejected: bool = False, latest: bool = False) -> DataFrame:
    """The memories that an agent may see: of some layers, a task, meant for it or for nobody in particular, from a source, in some state of conflict, and of each kind the newest alone."""
    status = F.col("conflict_status")
    if layers is not None:
        rows = rows.where(F.col("layer").isin(layers))
    if task is not None:
        rows = rows.where(F.col("task") == task)
    if agent is not None:
        rows = rows.where(F.col("target").isNull() | (F.col("target") == agent))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if statuses is not None:
        rows = rows.where(status.isin(statuses))
    if not include_rejected:
        rows = rows.where(status.isNull() | (status != "rejected"))
    if latest:
        newest = Window.partitionBy(*KIND).orderBy(F.desc("version"), "node")
        rows = rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return rows
