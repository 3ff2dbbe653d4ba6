"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files
from .blocks import give_back

#: Bytes of rows that make a row group of a table in the shared folder.
GROUP_BYTES = 4 << 20
#: Rows that go to a Python worker at once: whole texts, so a batch has some MB.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_RUN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's own folder (a URI) below spark.checkpoint.dir.

    Where that setting is unset, local mode gets a temporary folder (one machine, so it is shared); any other master is
    an error, as no folder of one machine is visible to all.
    """
    sc = spark.sparkContext
    small_batches(spark)
    app = sc.applicationId
    if app not in _RUN:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tessera-{app}")
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        _RUN[app] = re.sub(r"^file:/+", "file:///", whole)
    return _RUN[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses. Not created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages survive lost executors and never rerun what lies before.

    Tasks write files of their attempt's own name, and only those that a finished attempt reports are read, so nothing has
    to be renamed or committed. A store that pyarrow doesn't know is written by Spark's own writer.
    """
    spark, path, schema = df.sparkSession, new_dir(df.sparkSession, name), df.schema
    try:
        files.store(path)
    except (pa.ArrowException, OSError, ValueError):
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(schema).parquet(path)

    return _read(spark, [r.path for r in df.mapInArrow(_writer(path), "path string").collect()], schema)


def map_materialize(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """materialize(df.mapInArrow(run, schema)), run and written by one worker."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    try:
        files.store(path)
    except (pa.ArrowException, OSError, ValueError):
        return materialize(df.mapInArrow(run, schema), name)
    write = _writer(path)
    kind = StructType.fromDDL(schema)
    return _read(spark, [r.path for r in df.mapInArrow(lambda batches: write(run(batches)), "path string").collect()], kind)


def in_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table]) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """(rows, run) for map_materialize: run gives each group of the keys to work, as one table. A group should be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current: tuple | None = None
        for b in batches:
            names = list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            start = 0
            for end in range(1, len(names) + 1):
                if end < len(names) and names[end] == names[start]:
                    continue
                if held and names[start] != current:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                current = names[start]
                held.append(b.slice(start, end - start))
                start = end
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys), run


def _read(spark: SparkSession, written: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's rows to a file of its own in the folder and yields the file's name, if there were rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = out = writer = None
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> None:
            nonlocal target, out, writer, size
            if writer is None:
                target = files.new_file(path, "part", ".parquet")
                out = files.create(target)
                writer = pq.ParquetWriter(out, held[0].schema, compression="zstd")
            writer.write_table(pa.Table.from_batches(held))
            held.clear()
            size = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= GROUP_BYTES:
                    flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [target]})
        give_back()

    return write


def collected(df: DataFrame) -> DataFrame:
    """df's rows, run now and kept in the driver: for manifests, of a row a file."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of BATCH_ROWS instead of the default 10,000; a setting of the user's own stays."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


#: A key of more than this part of all rows is hot: there are at most so many, so what belongs to them may be broadcast.
HOT = 1000


def join_split(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """big joined to small, which has one row a key, non-null keys, and in `weight` at least the number of big's rows of that key.

    Rows of a hot key stay where they are and meet the key's one row by broadcast; only the others are shuffled.
    """
    hot = small.where(F.col(weight) > max(1, total // HOT)).collect()
    if not hot:
        return big.join(small, keys, how)
    held = F.broadcast(big.sparkSession.createDataFrame(hot, small.schema))
    rest = big.join(F.broadcast(held.select(*keys)), keys, "left_anti")
    return big.join(held, keys).unionByName(rest.join(small.where(F.col(weight) <= max(1, total // HOT)), keys, how))


def forget(*tables: DataFrame) -> None:
    """Delete tables of the shared folder that nothing will read again, and let Spark drop the shuffles that nobody holds."""
    for t in tables:
        jvm = t.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


_NO_ID = -(1 << 63)


def row_key(text: str = "text", doc_id: str = "doc_id") -> dict[str, Column]:
    """Columns _id and _text that tell rows apart, but for those of equal doc_id and text; never null."""
    return {"_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)), "_text": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))}


def without(docs: DataFrame, keys: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs but for the rows whose row_key() is in keys. keys is written first, so the planner knows its size and picks the join by it."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in row_key(text, doc_id).items()])
    rest = held.join(materialize(keys.select("_id", "_text").distinct(), "keys"), ["_id", "_text"], "left_anti")
    return rest.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def cleanup(spark: SparkSession) -> None:
    """Delete all that this session has written to the shared folder. Results not yet stored elsewhere are lost."""
    path = _RUN.pop(spark.sparkContext.applicationId, None)
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
