"""Relational building blocks with explicit keys, order and null rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orrery.contracts import ContractError, duplicate_keys


def first_by(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; rows with a null key are dropped."""
    at = W.partitionBy(*keys).orderBy(*order)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return frame.where(known).withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def union_fixed(frames: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """All rows of unlike frames under one schema; missing columns are typed nulls."""
    aligned = [f.select(*((F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items())) for f in frames]
    return reduce(DataFrame.unionByName, aligned)


def left_validated(left: DataFrame, right: DataFrame, keys: list[str], one_to_one: bool = True) -> DataFrame:
    """Left join after a check (an action) that the right side's keys, and for one-to-one the left side's, are unique."""
    for name, frame in (("right", right), *((("left", left),) if one_to_one else ())):
        bad = duplicate_keys(frame, keys).limit(5).collect()
        if bad:
            raise ContractError(f"{name} keys {keys} are not unique: {sorted(str(tuple(r)[:-1]) for r in bad)}")
    return left.join(right, keys, "left")


def with_member_flag(frame: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds whether the key occurs among the members."""
    known = members.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return frame.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def rated_pivot(ratings: DataFrame, keys: list[str], scale: str, value: str, scales: dict[str, str], order: list[Column]) -> DataFrame:
    """One column a scale with its first non-null value in the given order; keys without any are dropped."""
    picks = [F.min_by(value, F.when((F.col(scale) == s) & F.col(value).isNotNull(), F.struct(*order))).alias(name) for s, name in scales.items()]
    wide = ratings.groupBy(*keys).agg(*picks)
    return wide.where(reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in scales.values())))


def first_known(frame: DataFrame, keys: list[str], columns: list[str], order: list[Column]) -> DataFrame:
    """For each column its first non-null value in a total order."""
    return frame.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns))


def join_unique(column: str, separator: str = " | ") -> Column:
    """Sorted distinct non-null values, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def keep_unless(frame: DataFrame, flag: Column) -> DataFrame:
    """Drops rows whose flag is true; a null flag keeps the row."""
    return frame.where(~F.coalesce(flag, F.lit(False)))


def complete_grid(entities: DataFrame, sources: list[str], facts: DataFrame, key: str, source: str) -> DataFrame:
    """Every entity with every source; facts are null where there are none."""
    grid = entities.select(key).distinct().withColumn(source, F.explode(F.array(*map(F.lit, sources))))
    return grid.join(facts, [key, source], "left")


def open_first(frame: DataFrame, key: str, end: str, start: str, tie: str) -> DataFrame:
    """Position of each interval of an entity: open ones first, then by end and start, latest first."""
    far = F.lit("9999-12-31").cast("timestamp")
    order = W.partitionBy(key).orderBy(F.coalesce(F.col(end).cast("timestamp"), far).desc(), F.col(start).desc_nulls_last(), F.col(tie))
    return frame.withColumn("position", F.row_number().over(order))


def chained_spans(frame: DataFrame, key: str, order: str, duration: str, gap: str, snapshot: str) -> DataFrame:
    """Spans that go back in time from the snapshot: each ends a gap before the next began."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    past = F.coalesce(F.sum(F.col(duration) + F.col(gap)).over(before), F.lit(0)).cast("int")
    end = F.date_sub(F.lit(snapshot).cast("date"), past)
    return frame.withColumn("end_date", end).withColumn("start_date", F.date_sub(end, F.col(duration).cast("int")))
