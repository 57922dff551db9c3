"""Vectors as array columns, in double arithmetic whatever they are stored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero. The norm is bound before the elements are visited, so it is computed once."""
    bound = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.get(F.transform(bound, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0)))), F.lit(0))


def require_unit(frame: DataFrame, column: str) -> DataFrame:
    """The frame with unit vectors; a zero, non-finite or empty vector raises when it is read."""
    v = F.col(column)
    bad = (F.size(v) < 1) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(v) == 0)
    return frame.withColumn(column, F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("vectors must be non-empty, finite and not zero"))).otherwise(l2_normalize(v)))


def mean_vector(frame: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """keys, vector: the weighted mean of each group by position. Groups whose weights are all zero get the plain mean of
    all rows. Position sums are aggregated before the shuffle, so a large group is never gathered."""
    w = F.lit(1.0) if weight is None else weight
    rows = frame.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_at", "_x")).withColumn("_x", F.col("_x").cast("double"))
    sums = rows.groupBy(*keys, "_at").agg(F.sum(F.col("_w") * F.col("_x")).alias("_wx"), F.sum("_w").alias("_ws"), F.avg("_x").alias("_mean"))
    value = F.when(F.col("_ws") > 0, F.col("_wx") / F.col("_ws")).otherwise(F.col("_mean"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value.alias("v")))), lambda s: s["v"]).alias(vector))


def vector_profile(frame: DataFrame, vector: str) -> DataFrame:
    n = frame.select(norm(F.col(vector)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("vectors"), F.min("n").alias("min_norm"), F.avg("n").alias("mean_norm"), F.max("n").alias("max_norm"), F.avg((F.col("n") == 0).cast("double")).alias("zero_rate"))
