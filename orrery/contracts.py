"""Data contracts: each check is a frame of violations; ``require`` runs a set of them in one action."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data that breaks a contract."""


def require_columns(frame: DataFrame, columns: set[str], name: str) -> DataFrame:
    missing = sorted(columns - set(frame.columns))
    if missing:
        raise ContractError(f"{name} lacks columns: {', '.join(missing)}")
    return frame


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has (nulls are equal), with the number of rows."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent."""
    keys = child.select(F.col(child_key).alias("key")).where("key IS NOT NULL").distinct()
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def outside(frame: DataFrame, condition: Column) -> DataFrame:
    """Rows that don't meet the condition; unknown counts as not met."""
    return frame.where(~F.coalesce(condition, F.lit(False)))


def incomplete_ranks(frame: DataFrame, key: str, rank: str, size: int) -> DataFrame:
    """Entities whose ranks aren't 1..size, each once."""
    seen = frame.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(rank).alias("ranks"), F.min(rank).alias("least"), F.max(rank).alias("most"))
    return seen.where((F.col("rows") != size) | (F.col("ranks") != size) | (F.col("least") != 1) | (F.col("most") != size))


def short_groups(entities: DataFrame, frame: DataFrame, key: str, size: int) -> DataFrame:
    """Entities with fewer rows than ``size``, those without any included."""
    held = frame.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return entities.select(key).distinct().join(held, key, "left").fillna(0, ["rows"]).where(F.col("rows") < size)


def disagreeing(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of the left whose column differs from the right's of the same keys, or whose keys the right lacks."""
    other = right.select(*keys, F.col(column).alias("_other"), F.lit(True).alias("_there")).distinct()
    return left.select(*keys, column).join(other, keys, "left").where(F.col("_there").isNull() | ~F.col(column).eqNullSafe(F.col("_other"))).drop("_there")


def wrong_sums(frame: DataFrame, key: str, weight: str, tolerance: float = 1e-5) -> DataFrame:
    """Entities whose weights don't sum to one."""
    return frame.groupBy(key).agg(F.sum(weight).alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def both_or_neither(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def refuse_sealed(frame: DataFrame, split: str = "split", sealed: str = "test") -> DataFrame:
    """The frame, which raises when a sealed row is read."""
    return frame.withColumn(split, F.when(F.col(split) == sealed, F.raise_error(F.lit(f"the {sealed} split is sealed"))).otherwise(F.col(split)))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations: one row each."""
    frames = [f.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, f in checks.items()]
    return reduce(DataFrame.unionByName, frames)


def require(checks: dict[str, DataFrame], samples: int = 5) -> None:
    """Raises with the checks that have violations and a sorted sample of the first."""
    bad = {r["check"]: r["violations"] for r in summary(checks).where("violations > 0").collect()}
    if bad:
        first = next(n for n in checks if n in bad)
        shown = sorted(str(tuple(r)) for r in checks[first].limit(samples).collect())
        raise ContractError("; ".join(f"{n}: {bad[n]} violations" for n in checks if n in bad) + f"; for example {', '.join(shown)}")
