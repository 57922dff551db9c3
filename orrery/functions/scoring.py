"""Scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base trust and half life in days of each source.
SOURCE_TRUST = {
    "resume": (0.90, 1825),
    "projects": (0.82, 1460),
    "job_history": (0.88, 2920),
    "courses": (0.72, 2190),
    "self_reported_skills": (0.65, 1095),
}
SOURCES = tuple(SOURCE_TRUST)
GOLDEN = 0.6180339887498949


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _flag(value: Column) -> Column:
    return F.coalesce(value.cast("int"), F.lit(0))


def relevance(importance: Column, level: Column, hot: Column, demand: Column, not_relevant: Column, is_software: Column) -> Column:
    """Relation strength in 0.03..1: rated items by importance and level, software by its flags."""
    rated = 0.65 * _number(importance) / 5 + 0.35 * _number(level) / 7
    software = 0.42 + 0.20 * _flag(hot) + 0.14 * _flag(demand)
    return F.when(_flag(not_relevant) == 1, F.lit(0.03)).otherwise(clip(F.when(is_software, software).otherwise(rated), 0.03, 1.0))


def occupation_score(importance: Column, level: Column, hot: Column, demand: Column) -> Column:
    return 0.60 * clip(_number(importance) / 5, 0, 1) + 0.30 * clip(_number(level) / 7, 0, 1) + 0.06 * _flag(hot) + 0.04 * _flag(demand)


def reliability(source: Column, age: Column, items: Column, trust: dict[str, tuple[float, float]] = SOURCE_TRUST, crowded: str | None = "self_reported_skills", crowd: int = 30) -> Column:
    """Trust that fades with age and, for the crowded source, with volume; 0 without items."""
    base = F.coalesce(*(F.when(source == k, F.lit(float(v[0]))) for k, v in trust.items()))
    half = F.coalesce(*(F.when(source == k, F.lit(float(v[1]))) for k, v in trust.items()))
    fresh = F.exp(-F.greatest(F.coalesce(age, F.lit(0)), F.lit(0)) / half)
    over = F.lit(False) if crowded is None else (source == crowded) & (items > crowd)
    volume = F.when(over, 1 / (1 + 0.35 * F.log1p(items - crowd))).otherwise(F.lit(1.0))
    return F.when(items == 0, F.lit(0.0)).otherwise(F.round(clip(base * fresh * volume, 0, 1), 4))


def sample_weight(strength: Column, proficiency: Column, parts: tuple[float, float, float] = (0.7, 0.3, 0.1)) -> Column:
    """parts: the weights of strength and proficiency, and the least result."""
    return clip(parts[0] * clip(strength, 0, 1) + parts[1] * clip(proficiency.cast("double"), 1, 5) / 5, parts[2], 1.0)


def quality_vector(available: Column, trust: Column, age: Column, items: Column, stale: Column, crowded: Column, stale_days: float = 730, volume_scale: float = 40) -> Column:
    """Six features of a source, all zero where it is missing."""
    parts = [
        clip(trust, 0, 1),
        F.exp(-F.greatest(F.coalesce(age, F.lit(0)), F.lit(0)) / float(stale_days)),
        F.least(F.log1p(items.cast("double")) / F.log1p(F.lit(float(volume_scale))), F.lit(2.0)),
        stale.cast("double"),
        crowded.cast("double"),
        F.lit(1.0),
    ]
    return F.array(*(F.when(available, p).otherwise(F.lit(0.0)) for p in parts))


def golden_split(index: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    at = index.cast("double") * GOLDEN
    at = at - F.floor(at)
    return F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1.0)


def coverage_bucket(sources: Column) -> Column:
    return F.when(sources <= 2, "0-2").when(sources <= 4, "3-4").otherwise("5")
