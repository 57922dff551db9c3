"""Read-only reports on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def quantiles(frame: DataFrame, by: str, value: str, at: tuple[float, ...]) -> DataFrame:
    """by, quantile, value: exact, with linear interpolation."""
    q = frame.groupBy(by).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("_q"))
    return q.select(by, F.posexplode("_q").alias("_i", "value")).select(by, F.get(F.array(*map(F.lit, at)), F.col("_i")).alias("quantile"), "value")


def rates(frame: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    return frame.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *(F.avg(c.cast("int")).alias(n) for n, c in flags.items()))


def value_shares(frame: DataFrame, value: str) -> DataFrame:
    n = frame.groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy()))


def mean_pivot(frame: DataFrame, by: str, over: str, value: str, names: list[str]) -> DataFrame:
    return frame.groupBy(by).pivot(over, names).agg(F.avg(value))


def duplicates(frame: DataFrame, keys: list[str], when: str) -> DataFrame:
    """rows, duplicate_rows (beyond the first of equal rows), duplicate_keys, missing_keys, first_date, last_date.

    Rows are first counted by key and row hash, so distinct rows aren't gathered in one place."""
    each = frame.groupBy(*keys, F.xxhash64(*frame.columns).alias("_row")).agg(F.count(F.lit(1)).alias("_n"), F.min(when).alias("_a"), F.max(when).alias("_z"))
    by_key = each.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return by_key.agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - F.col("_d")).alias("duplicate_rows"), F.sum((F.col("_n") > 1).cast("long")).alias("duplicate_keys"),
        F.sum(F.when(missing, F.col("_n")).otherwise(0)).alias("missing_keys"), day(F.min("_a")).alias("first_date"), day(F.max("_z")).alias("last_date"),
    )


def numeric_by_group(frame: DataFrame, by: str, value: str) -> DataFrame:
    return frame.groupBy(by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))
