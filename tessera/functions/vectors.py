"""Vectors as arrays of doubles, and sparse hash embeddings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for null, empty, zero or differently long vectors. Norms that are known already needn't be computed for each pair."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(fits, dot(a, b) / scale).otherwise(F.lit(0.0))


def cosine_of_shared(a: Column, b: Column) -> Column:
    """Cosine over the dimensions that both have: the longer vector is cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, cosine(F.slice(a, 1, n), F.slice(b, 1, n))).otherwise(F.lit(0.0))


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """A token's dimension: the first four bytes of its SHA-1."""
    return (F.conv(F.substring(F.sha1(token.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def sign(token: Column) -> Column:
    """+1 or -1 by the fifth byte of its SHA-1."""
    return F.when(F.conv(F.substring(F.sha1(token.cast("binary")), 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hash_embedding(rows: DataFrame, keys: list[str], toks: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(keys, idx, val): the L2-normalised signed token counts of each row, as a sparse table. Rows are dealt once by keys."""
    each = rows.select(*keys, F.explode(toks).alias("token")).repartition(*keys)
    summed = each.groupBy(*keys, bucket(F.col("token"), dimensions).alias("idx")).agg(F.sum(sign(F.col("token"))).alias("s")).where("s <> 0")
    norms = summed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return summed.join(norms, keys).select(*keys, "idx", (F.col("s") / F.col("norm")).alias("val"))


def packed_embedding(rows: DataFrame, keys: list[str], toks: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """rows with their hash embedding as `lookup`, a map of dimension to value. To be stored, and made dense() before pairs are."""
    held = hash_embedding(rows, keys, toks, dimensions).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("lookup"))
    return rows.join(held, keys, "left")


def dense(lookup: Column, dimensions: int = DIMENSIONS) -> Column:
    """The map as an array of all dimensions, absent ones 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(0.0)))


def centroid(rows: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """(keys, embedding): the weighted mean of each group's vectors, then normalised. Sums are per dimension, so a group of any size is added up before the shuffle."""
    each = rows.select(*keys, weight.alias("_w"), F.posexplode(vector).alias("pos", "x"))
    mean = each.groupBy(*keys, "pos").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x"))
    held = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("m"))
    length = norm(F.col("m"))
    return held.select(*keys, F.when(length > 0, F.transform("m", lambda v: v / length)).otherwise(F.col("m")).alias("embedding"))
