"""The event log's streams over tables of one file, of several files and of partitions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera import plans

ROWS = [(i, i % 7, ("view", "buy")[i % 2], datetime.datetime(2024, 1, 1 + i % 3, 12)) for i in range(60)]


@pytest.mark.parametrize("form", ["file", "files", "partitions"])
def test_streams_read_the_whole_table(spark, tmp_path, form):
    log = spark.createDataFrame(ROWS, "event_id long, user_id long, event_type string, ts timestamp")
    table = tmp_path / "events.parquet"
    if form == "file":
        log.coalesce(1).write.parquet(str(tmp_path / "out"))
        next((tmp_path / "out").glob("part-*.parquet")).rename(table)
    else:
        writer = log.repartition(4).write
        (writer if form == "files" else writer.partitionBy("event_type")).parquet(str(table))
        log.limit(5).coalesce(1).write.parquet(str(tmp_path / "other.parquet"))
    usage = plans.QUERIES["stream_usage"](spark, str(tmp_path))
    want = log.groupBy("user_id").agg(F.count("*").alias("usage"), F.max("event_id").alias("last_event"))
    assert sorted(map(tuple, usage.collect())) == sorted(map(tuple, want.collect()))
    counts = plans.QUERIES["stream_event_counts"](spark, str(tmp_path)).collect()
    want = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()
    assert sorted((r.day, r.event_type, r.n) for r in counts) == sorted(map(tuple, want))


def test_late_events_are_dropped_and_batches_add_up(spark, tmp_path):
    from tessera.streaming import events

    day = lambda d, n, first: [(first + i, 1, "view", datetime.datetime(2024, 1, d, 6)) for i in range(n)]
    for name, rows in (("a", day(1, 3, 0)), ("b", day(9, 2, 10) + day(1, 1, 20)), ("c", day(1, 5, 30) + day(9, 4, 40)), ("d", day(1, 7, 50) + day(9, 1, 60))):
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    log = events.read_log(spark, str(tmp_path))
    counts = {r.start.day: r.n for r in events.run_available(events.windowed_counts(log), ["start", "event_type"]).collect()}
    assert counts == {1: 9, 9: 7}  # the last file's seven were more than a day late by what earlier batches had seen
    usage = events.run_available(events.usage_counts(events.read_log(spark, str(tmp_path))), ["user_id"]).first()
    assert (usage.usage, usage.last_event) == (23, 60)


def test_a_log_in_order_of_time_has_no_late_events(spark):
    from tessera.streaming import events

    rows = [(i, 1, "view", datetime.datetime(2024, 1, 1 + (i * 7) % 20, 6)) for i in range(200)]
    log = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").repartition(5)
    stream = events.windowed_counts(events.read_in_order(log, "ts", 5), late="1 day")
    got = {r.start.day: r.n for r in events.run_available(stream, ["start", "event_type"]).collect()}
    assert got == {d: 10 for d in range(1, 21)}


def test_stored_tables_go(spark):
    from tessera.operators.stored import forget, stored

    kept, gone = stored(spark.range(5)), stored(spark.range(5))
    forget(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST"):
        gone.count()
