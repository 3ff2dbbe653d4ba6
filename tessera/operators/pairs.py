"""Cosines of given pairs inside contexts, without a vector for each pair.

Nodes of a context are dealt to blocks by hash. A pair goes, as it is, to the tile of its two ends' blocks, and there meets
the blocks' vectors. So a vector moves once or, in a context of many blocks, twice for each `ROWS` rows of it, however
many pairs it is in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a block, and pairs that are scored at once.
ROWS, STRIP = 16384, 65536


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, padded with 0; their lengths, -1 for null and for those with a null in them)."""
    lists = column.combine_chunks()
    sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten()
    row, n = np.repeat(np.arange(len(sizes)), sizes), sizes.copy()
    n[np.array(lists.is_null())] = -1
    n[row[np.array(flat.is_null())]] = -1
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    return x, n


def _ends(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place in the sorted ids, and number of places."""
    first = np.searchsorted(ids, wanted)
    return first, np.searchsorted(ids, wanted, side="right") - first


def _score(q: str, node: str, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        ids, length = right.column("id").to_numpy(), right.column("norm").fill_null(0.0).to_numpy()
        x, n = _matrix(right.column("v"))
        (a, n_a), (b, n_b) = (_ends(ids, left.column(c).to_numpy()) for c in (q, node))
        times = n_a * n_b  # ids may be repeated
        row = np.repeat(np.arange(len(times)), times)
        place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        a, b = a[row] + place // np.maximum(n_b[row], 1), b[row] + place % np.maximum(n_b[row], 1)
        cos = np.zeros(len(row))
        for i in range(0, len(row), STRIP):
            u, v = a[i : i + STRIP], b[i : i + STRIP]
            xu, xv, dot = x[u].T, x[v].T, np.zeros(len(u))
            for k in range(x.shape[1]):  # added up in the order of the dimensions
                dot += xu[k] * xv[k]
            scale = length[u] * length[v]
            fits = (n[u] > 0) & (n[u] == n[v]) & ~(scale <= 0)
            cos[i : i + STRIP] = np.where(fits, dot / np.where(fits, scale, 1.0), 0.0)
        out = left.take(pa.array(row))
        return pa.table([*[out.column(c) for c in names], pa.array(cos), *[right.column(c).take(pa.array(b)) for c in ("usage", "conf")]], names=[*names, "cos", "usage", "conf"])

    return run


def cosines(pairs: DataFrame, nodes: DataFrame, q: str = "q", node: str = "node", rows: int = ROWS) -> DataFrame:
    """pairs with cos, usage and conf (of node). nodes: (id, grp, v, norm, usage, conf); both ends of a pair are of one context; a pair of which an end is no node is left out."""
    held = nodes.where("grp is not null").select("id", "grp", "v", "norm", F.col("usage").cast("long").alias("usage"), F.col("conf").cast("double").alias("conf"))
    sizes = held.groupBy("grp").agg(F.ceil(F.count("*") / rows).cast("int").alias("_n"))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.col("_n")).cast("int")
    named = held.select(F.col("id").alias(q), F.col("grp").alias("_grp")).distinct()
    asked = pairs.join(named, q).join(sizes.withColumnRenamed("grp", "_grp"), "_grp").select(*pairs.columns, "_grp", place(q).alias("_i"), place(node).alias("_j"))
    own = held.join(sizes, "grp").withColumn("_at", place("id"))
    way = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.array(way(F.col("_at"), o), way(o, F.col("_at")))))
    dealt = own.withColumn("_t", F.explode(F.array_distinct(both))).select("grp", F.col("_t.i").alias("_ri"), F.col("_t.j").alias("_rj"), "id", "v", "norm", "usage", "conf")
    schema = StructType(list(pairs.schema.fields)).add("cos", "double").add("usage", "long").add("conf", "double")
    return asked.groupBy("_grp", "_i", "_j").cogroup(dealt.groupBy("grp", "_ri", "_rj")).applyInArrow(_score(q, node, pairs.columns), schema)
