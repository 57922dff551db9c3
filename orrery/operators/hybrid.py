"""Weighted reciprocal-rank fusion of retrieval channels into pools with a protected head."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from orrery.operators.truth import Truth

RRF, TOWER_WEIGHT, OCCUPATION_WEIGHT = 60, 0.75, 0.65


def fuse(learned: DataFrame, towers: DataFrame, occupations: DataFrame, rrf: int = RRF, tower_weight: float = TOWER_WEIGHT, occupation_weight: float = OCCUPATION_WEIGHT, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """query, item, rrf_score and the audit columns of each channel.

    learned: rank, score; towers: tower_order, reliability, rank, score; occupations: rank, score. channel_count counts
    contributions, so every tower hit adds one. The best tower hit is the least rank, then the earlier tower."""
    none = F.lit(None)
    parts = [
        learned.select(query, item, F.lit("learned").alias("c"), (1.0 / (rrf + F.col("rank"))).alias("w"), "rank", "score", none.cast("int").alias("tower_order")),
        towers.select(query, item, F.lit("tower").alias("c"), (tower_weight * F.col("reliability") / (rrf + F.col("rank"))).alias("w"), "rank", "score", F.col("tower_order").cast("int").alias("tower_order")),
        occupations.select(query, item, F.lit("occupation").alias("c"), (F.lit(occupation_weight) / (rrf + F.col("rank"))).alias("w"), "rank", "score", none.cast("int").alias("tower_order")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = lambda c, v: F.max(F.when(F.col("c") == c, F.col(v)))
    best = F.when(F.col("c") == "tower", F.struct("rank", "tower_order"))
    return rows.groupBy(query, item).agg(
        F.sum("w").alias("rrf_score"), of("learned", "rank").alias("learned_rank"), of("learned", "score").alias("learned_score"), of("occupation", "rank").alias("occupation_rank"), of("occupation", "score").alias("occupation_score"),
        F.min(F.when(F.col("c") == "tower", F.col("rank"))).alias("best_tower_rank"), F.min_by("score", best).alias("best_tower_score"),
        F.sum((F.col("c") == "tower").cast("long")).alias("tower_hit_count"), F.count(F.lit(1)).alias("channel_count"),
    )


def fill_pools(fused: DataFrame, queries: DataFrame, catalog: DataFrame, pool: int, protect: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Pools of ``pool`` items: learned ranks up to ``protect`` stay where they are, then the others by fused score, then
    the catalog in its order for queries that are still short. Only those meet the catalog, and only its first ``pool`` +
    their own rows."""
    tier = F.when(F.col("learned_rank") <= protect, 0).otherwise(1)
    order = W.partitionBy(query).orderBy("tier", F.when(F.col("tier") == 0, F.col("learned_rank")), F.round("rrf_score", 12).desc(), item)
    head = fused.withColumn("tier", tier).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)
    held = head.groupBy(query).agg(F.count(F.lit(1)).alias("held"))
    short = queries.select(query).join(held, query, "left").fillna(0, ["held"]).where(F.col("held") < pool)
    spare = catalog.select(item).orderBy(item).limit(2 * pool)
    extra = short.crossJoin(spare).join(fused.select(query, item), [query, item], "left_anti")
    extra = extra.withColumn("n", F.row_number().over(W.partitionBy(query).orderBy(item))).where(F.col("n") <= pool - F.col("held"))
    extra = extra.select(query, item, F.lit(2).alias("tier"), (F.col("held") + F.col("n")).cast("int").alias("rank"), F.lit(0.0).alias("rrf_score"), F.lit(0).cast("long").alias("tower_hit_count"), F.lit(0).cast("long").alias("channel_count"))
    out = head.unionByName(extra, allowMissingColumns=True)
    return out.withColumn("is_learned_protected", F.col("tier") == 0).withColumn("is_fallback", F.col("tier") == 2).drop("tier")


def stage_metrics(stages: DataFrame, truth: Truth, catalog_size: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """stage, rows, unique_items, catalog_coverage, truth_item_coverage, truth_pair_recall, mean_query_recall."""
    from orrery.operators.audit import stage_recall

    base = stages.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(item).alias("unique_items"))
    return base.withColumn("catalog_coverage", F.col("unique_items") / F.lit(catalog_size)).join(stage_recall(stages, truth, query, item), "stage").drop("truth_items")
