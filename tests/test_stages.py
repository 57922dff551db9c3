"""All stages, one after the other, on a small taxonomy."""

import json

import pytest
from pyspark.sql import functions as F

from orrery import contracts as C
from orrery.plans import stages
from orrery.sources import tables


def test_from_taxonomy_to_audit(spark, tmp_path):
    at = str(tmp_path)
    codes = spark.range(4).select(F.format_string("1%d-1", F.col("id")).alias("onet_soc_code"))
    skill = spark.range(40).select(F.concat(F.lit("s"), "id").alias("skill_id"), F.concat(F.lit("Skill number "), "id").alias("skill_name"), F.when(F.col("id") % 3 == 0, "software").otherwise("knowledge").alias("skill_type"), F.lit("Does things").alias("description"), F.lit(None).cast("string").alias("category_name"))
    relation = codes.crossJoin(skill.drop("description", "category_name")).where("substring(onet_soc_code, 2, 1) = substring(skill_id, 2, 1) % 4 OR skill_type = 'software'")
    relation = relation.select("*", (1 + F.length("skill_id")).cast("double").alias("importance"), F.lit(3.0).alias("level"), F.lit(True).alias("hot_technology"), F.lit(False).alias("in_demand"), F.lit(None).cast("boolean").alias("not_relevant"))
    for name, f in (("occupations", codes), ("job_titles", codes.withColumn("job_title", F.lit("Lead"))), ("skills", skill), ("occupation_skills", relation)):
        f.write.parquet(f"{at}/{name}.parquet")
    run = lambda name, **fields: stages.run(spark, name, at, at, **fields)
    run("generate", n_candidates=40)
    made = run("features")
    assert made["outputs"]["candidate_tower_features"]["rows"] == 200
    texts = spark.read.parquet(f"{at}/candidate_tower_features.parquet")
    assert texts.where(F.col("tower_text").rlike("cand_|_claim_|_job_|\\\\bs[0-9]+\\\\b")).isEmpty()  # no ids in texts
    run("vectors")
    run("evaluate", cutoffs=(3, 5), splits=("train", "validation"), strategies=("reliability_weighted", "uniform_mean"))
    assert spark.read.parquet(f"{at}/retrieval_metrics.parquet").count() == 8
    assert run("pairs", hard_negatives=4, random_negatives=3)["measured"]["sealed_rows"] == 0
    fitted = run("train", epochs=2, output_dimension=16, batch_size=64, hard_negatives_per_example=2, random_negatives_per_example=2)
    assert fitted["measured"]["best_epoch"] in (0, 1, 2) and fitted["outputs"]["learned_skill_vectors"]["rows"] == 40
    assert set(tables.load_parameters(spark, f"{at}/fusion_parameters.parquet")) == set(fitted["measured"]["parameters"])
    learned = run("evaluate_learned", cutoffs=(3, 5))
    assert learned["measured"]["recall_at_max_k"] >= 0.99 and learned["outputs"]["baseline_comparison"]["rows"] == 12
    with pytest.raises(C.ContractError, match="recall"):
        stages.run(spark, "evaluate_learned", at, f"{at}/other", cutoffs=(3, 5), m=1, ef_construction=2, ef_search=1)
    assert run("pools", learned_k=8, pool_k=20)["measured"]["candidates_with_whole_head"] == 4
    run("rerank", candidate_pool_size=20, output_k=5, evidence_weights=(0.2,), popularity_penalties=(0.0, 0.1), diversity_penalties=(0.0, 0.05))
    assert spark.read.parquet(f"{at}/reranking_comparison.parquet").count() == 2
    pools = spark.read.parquet(f"{at}/hybrid_retrieval_predictions.parquet").withColumnsRenamed(stages.IDS)
    assert not stages.hybrid_pools(pools, "validation", 20).isEmpty()
    for broken in (pools.withColumn("engine", F.lit("other")), pools.where("rank <> 3"), pools.where("rank < 20"), pools.unionByName(pools), pools.withColumn("is_learned_protected", F.col("rank") % 2 == 0)):
        with pytest.raises(C.ContractError):
            stages.hybrid_pools(broken, "validation", 20)
    trials = spark.read.parquet(f"{at}/reranking_trials.parquet")
    assert trials.count() == 5 and trials.where("is_selected").count() == 1
    body = run("audit", retrieval_k=5, pool_k=20)
    assert body["measured"]["next_step"] in ("llm_judge", "hybrid_candidate_generation")
    assert json.loads((tmp_path / "audit.manifest.json").read_text())["outputs"]["coverage_summary"]["rows"] == 2
