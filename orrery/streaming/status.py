"""Source status kept up to date from a stream of dated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_counts(events: DataFrame, key: str, source: str, when: str, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """key, source, day, item_count, updated_at by day windows; events later than the watermark are dropped. The sum and
    maximum over days are what ``complete_grid`` and ``reliability`` need."""
    marked = events.withWatermark(when, late)
    days = marked.groupBy(F.window(when, window).alias("w"), F.col(key), F.col(source)).agg(F.count(F.lit(1)).alias("item_count"), F.max(when).alias("updated_at"))
    return days.select(key, source, F.col("w.start").alias("day"), "item_count", "updated_at")
