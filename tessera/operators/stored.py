"""Tables that are computed once: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(df: DataFrame) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, local mode gets a temporary folder, and any other master is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _LOCAL.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-tables-"))
    return f"{root.rstrip('/')}/tables-{sc.applicationId}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that stored() gave and nothing will read again."""
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if "/tables-" in path:
                _delete(t.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this session has stored. Results that are not written elsewhere are lost."""
    _delete(spark, folder(spark.range(0)).rpartition("/")[0])


def stored(df: DataFrame) -> DataFrame:
    """df's rows, computed now. What lies before is never run again, by whatever uses them or by executors that come back."""
    path = folder(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: str, parts: int) -> Callable[[int], pa.Table | None]:
    """df's rows, computed now and written to a folder for each integer of `by`; what is returned reads one in a task, None where there are no rows."""
    path = folder(df)
    df.repartition(parts, by).write.partitionBy(by).parquet(path)

    def read(i: int) -> pa.Table | None:
        store, at = fs.FileSystem.from_uri(f"{path}/{by}={i}")
        return pq.read_table(at, filesystem=store, partitioning=None) if store.get_file_info(at).type == fs.FileType.Directory else None

    return read
