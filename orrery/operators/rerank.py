"""Constrained reranking of pools: evidence, popularity and diversity, with a grid of trials.

The static score is window arithmetic. Only trials with a diversity penalty need the greedy order, one (trial, query)
group at a time in an Arrow kernel over a pool of bounded size; the others are a plain window."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, l2_normalize
from orrery.operators.retrieval import ranked
from orrery.operators.truth import Truth, item_counts


def min_max(value: str, key: str = "query_id") -> Column:
    """Scaled to 0..1 inside each query; 0 where all are equal."""
    w = W.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def train_popularity(catalog: DataFrame, train_truth: Truth, item: str = "item_id") -> DataFrame:
    """item, popularity_score: log counts of train truth over the largest; 0 without any."""
    score = catalog.select(item).join(item_counts(train_truth, item), item, "left").withColumn("_p", F.log1p(F.coalesce("_n", F.lit(0)).cast("double")))
    top = score.agg(F.max("_p").alias("_top"))
    return score.crossJoin(top).select(item, F.when(F.col("_top") > 0, F.col("_p") / F.col("_top")).otherwise(0.0).alias("popularity_score"))


def gated_evidence(pool: DataFrame, towers: DataFrame, catalog: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """query, item, evidence_score: the sum over towers (query, source, v, gate_weight) of gate x cosine. Raises if a row
    of the pool has no tower or no vector."""
    t = towers.select(query, l2_normalize(F.col("v")).alias("_t"), "gate_weight")
    scored = pool.select(query, item).join(t, query, "left").join(catalog.select(item, l2_normalize(F.col("v")).alias("_i")), item, "left")
    lost = F.col("_t").isNull() | F.col("_i").isNull() | F.col("gate_weight").isNull()
    part = F.when(lost, F.raise_error(F.lit("a row of the pool has no gate or vector")).cast("double")).otherwise(F.col("gate_weight") * dot(F.col("_t"), F.col("_i")))
    return scored.groupBy(query, item).agg(F.sum(part).alias("evidence_score"))


def grid(evidence: tuple[float, ...], popularity: tuple[float, ...], diversity: tuple[float, ...]) -> list[tuple[int, float, float, float]]:
    """Trial 0 changes nothing; the others are the product of the settings."""
    return [(0, 0.0, 0.0, 0.0), *((i + 1, *p) for i, p in enumerate(product(evidence, popularity, diversity)))]


def static_scores(pool: DataFrame, trials: DataFrame, query: str = "query_id") -> DataFrame:
    """pool (query, item, rank, score, evidence_score, popularity_score) x trials, with base_score."""
    scaled = pool.withColumn("_r", min_max("score", query)).withColumn("_e", min_max("evidence_score", query))
    base = (1 - F.col("evidence_weight")) * F.col("_r") + F.col("evidence_weight") * F.col("_e") - F.col("popularity_penalty") * F.col("popularity_score")
    return scaled.crossJoin(F.broadcast(trials)).withColumn("base_score", F.round(base, 12)).drop("_r", "_e")


def greedy(scores: np.ndarray, similarity: np.ndarray, k: int, penalty: float) -> tuple[list[int], list[float]]:
    """Places in the order they are picked, with the score each had; ties go to the earlier place."""
    left, closest, picked, at = np.ones(len(scores), bool), np.zeros(len(scores)), [], []
    for _ in range(min(k, len(scores))):
        now = np.where(left, scores - penalty * closest, -np.inf)
        best = int(now.argmax())
        picked.append(best)
        at.append(float(now[best]))
        left[best] = False
        closest = np.maximum(closest, similarity[best])
    return picked, at


def rerank(scored: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """trial, query, item, pool_rank, base_score, rerank_score, rank of the first k of each trial and query."""
    cols = ["trial", query, item, F.col("rank").alias("pool_rank"), "base_score", "diversity_penalty"]
    plain = scored.where("diversity_penalty = 0").select(*cols)
    plain = ranked(plain, ["trial", query], k, F.col("base_score").desc(), F.col("pool_rank")).withColumn("rerank_score", F.col("base_score"))
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    schema = f"trial {kinds['trial']}, {query} {kinds[query]}, {item} {kinds[item]}, pool_rank {kinds['rank']}, base_score double, diversity_penalty double, rank int, rerank_score double"

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("pool_rank").combine_chunks()
        v = np.asarray(table["v"].combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        chosen, at = greedy(table["base_score"].to_numpy(), v @ v.T, k, table["diversity_penalty"][0].as_py())
        out = table.drop_columns(["v"]).take(pa.array(chosen, pa.int64()))
        return out.append_column("rank", pa.array(range(1, len(chosen) + 1), pa.int32())).append_column("rerank_score", pa.array(at))

    varied = scored.where("diversity_penalty > 0").select(*cols).join(vectors.select(item, F.col("v").cast("array<double>").alias("v")), item)
    varied = varied.select("trial", query, item, "pool_rank", "base_score", "diversity_penalty", "v").groupBy("trial", query).applyInArrow(pick, schema)
    return plain.unionByName(varied)


def list_similarity(ranked_lists: DataFrame, vectors: DataFrame, by: list[str], item: str = "item_id") -> DataFrame:
    """by, mean_intra_list_similarity: the mean cosine of all pairs in a list, from the norm of the sum of its unit
    vectors; null for lists of one."""
    unit = vectors.select(item, F.posexplode(l2_normalize(F.col("v"))).alias("_at", "_x"))
    sums = ranked_lists.select(*by, item).join(unit, item).groupBy(*by, "_at").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    total = sums.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_s"), F.sum("_q").alias("_q"), F.max("_n").alias("_n"))
    return total.select(*by, F.when(F.col("_n") > 1, (F.col("_s") - F.col("_q")) / (F.col("_n") * (F.col("_n") - 1))).alias("mean_intra_list_similarity"))


def select_trial(summary: DataFrame, maximum_drop: float) -> DataFrame:
    """Marks the trial with the widest coverage among those whose NDCG stays near trial 0; then NDCG, less similarity,
    less popularity, and the earlier trial decide."""
    floor = summary.where("trial = 0").select((F.col("ndcg") - maximum_drop).alias("ndcg_floor"))
    out = summary.crossJoin(F.broadcast(floor)).withColumn("meets_ndcg_constraint", F.round("ndcg", 12) >= F.round("ndcg_floor", 12))
    best = W.orderBy(F.col("meets_ndcg_constraint").desc(), F.round("catalog_coverage", 12).desc(), F.round("ndcg", 12).desc(), F.round("mean_intra_list_similarity", 12).asc_nulls_last(), F.round("mean_popularity", 12), "trial")
    return out.withColumn("is_selected", (F.row_number().over(best) == 1) & F.col("meets_ndcg_constraint"))
