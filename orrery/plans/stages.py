"""The engine's stages from folder to folder: read tables, compose operators, check contracts, write tables and a manifest.

Tables go by the names and columns of the data model; every stage is one function and one command of ``python -m orrery``.
Stages after the baseline refuse the test split when they read labels.
"""

from __future__ import annotations

import dataclasses
import math
import time
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from orrery import config as S, contracts as C
from orrery.functions import scoring, text as T
from orrery.functions.vectors import mean_vector
from orrery.operators import audit, features, fusion, hybrid, metrics, pairs, population, rerank, retrieval
from orrery.plans import learning
from orrery.sources import tables
from orrery.session import ship

#: The engine that pools are marked with.
HYBRID = "hybrid_rrf"
IDS = {"candidate_id": "query_id", "skill_id": "item_id"}


def _read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return list(tables.load_tables(spark, folder, list(names)).values())


def _write(folder: str, version: str, settings: S.Settings, outputs: dict[str, DataFrame], inputs: dict[str, DataFrame], measured: dict | None = None) -> dict:
    entries = {name: tables.write_table(frame, f"{folder}/{name}.parquet") for name, frame in outputs.items()}
    local = Path(folder.removeprefix("file:")) if "://" not in folder else Path.cwd()
    return tables.write_manifest(local / f"{version}.manifest.json", version, settings, {n: tables.fingerprint(f) for n, f in inputs.items()}, entries, measured)


def _plain(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed({k: v for k, v in IDS.items() if k in frame.columns})


def _named(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed({v: k for k, v in IDS.items() if v in frame.columns})


def generate(spark: SparkSession, source: str, target: str, settings: S.PopulationConfig) -> dict:
    """occupations, job_titles, occupation_skills -> the population's tables."""
    jobs, titles, relations = _read(spark, source, "occupations", "job_titles", "occupation_skills")
    strength = scoring.relevance(*(F.col(c) for c in ("importance", "level", "hot_technology", "in_demand", "not_relevant")), F.col("skill_type") == "software")
    scored = relations.withColumn("relevance_score", strength)
    tasks = _read(spark, source, "tasks")[0] if tables.exists(spark, f"{source}/tasks.parquet") else None
    p = population.generate(spark, settings, jobs.select("onet_soc_code"), titles, scored, tasks)
    owned = {"resumes": (p.resumes, "resume_id"), "job_history": (p.job_history, "job_history_id"), "projects": (p.projects, "project_id"), "courses": (p.courses, "course_id"), "self_reported_skills": (p.claims, "claim_id")}
    population.validate(p.candidates, p.truth, p.status, settings, owned)
    out = {"candidates": p.candidates, "resumes": p.resumes, "job_history": p.job_history, "projects": p.projects, "courses": p.courses, "self_reported_skills": p.claims, "candidate_skill_truth": p.truth, "source_status": p.status}
    return _write(target, "population", settings, out, {"occupations": jobs, "occupation_skills": relations})


def build_features(spark: SparkSession, source: str, target: str, settings: S.FeatureConfig) -> dict:
    """Tower texts and quality features; hidden ids and oracle columns never enter a text."""
    people, resumes, jobs, work, study, claims, status, skills = _read(spark, source, "candidates", "resumes", "job_history", "projects", "courses", "self_reported_skills", "source_status", "skills")
    last = resumes.withColumn("_n", F.row_number().over(W.partitionBy("candidate_id").orderBy(F.col("updated_at").desc_nulls_last(), "resume_id"))).where("_n = 1")
    until = F.coalesce(F.col("end_date").cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    col = F.col
    parts = {
        "resume": features.assembled_text(last, "candidate_id", [col("resume_id")], col("resume_text")),
        "job_history": features.assembled_text(jobs, "candidate_id", [until, col("start_date"), col("job_history_id")], T.job_line(col("job_title"), col("start_date"), col("end_date"), col("description")), newest_first=True),
        "projects": features.assembled_text(work, "candidate_id", [col("completed_at"), col("project_id")], T.project_line(col("project_title"), col("completed_at"), col("description")), newest_first=True),
        "courses": features.assembled_text(study, "candidate_id", [col("completed_at"), col("course_id")], T.course_line(col("course_name"), col("completed_at")), newest_first=True),
        "self_reported_skills": features.assembled_text(claims, "candidate_id", [col("claimed_at"), col("claim_id")], T.claim_line(col("raw_skill_name"), col("reported_proficiency")), newest_first=True),
    }
    texts = None
    for source_name, frame in parts.items():
        one = frame.withColumn("source", F.lit(source_name))
        texts = one if texts is None else texts.unionByName(one)
    grid = status.select("candidate_id", "source", "item_count", "updated_at", "age_days", "reliability_score").join(texts, ["candidate_id", "source"], "left")
    towers = features.tower_features(grid, settings.limits(), settings.stale_after_days, settings.high_volume_threshold).join(people.select("candidate_id", "split"), "candidate_id")
    catalog = skills.withColumn("skill_text", T.normalize(F.concat_ws(". ", "skill_name", "description", "category_name")))
    index = people.select("candidate_id", "primary_onet_soc_code", "years_experience", "split", "taxonomy_version")
    C.require(
        {
            "tower key": C.duplicate_keys(towers, ["candidate_id", "source"]), "five sources": towers.groupBy("candidate_id").agg(F.sort_array(F.collect_set("source")).alias("found")).where(F.col("found") != F.array(*map(F.lit, sorted(scoring.SOURCES)))),
            "text budget": towers.where(F.col("character_count") > F.coalesce(*(F.when(F.col("source") == k, F.lit(v + 2)) for k, v in settings.limits().items()))), "no hidden columns": towers.limit(1 if {"canonical_skill_id", "oracle_is_true_skill", "skill_id"} & set(towers.columns) else 0),
            "one row a skill": C.duplicate_keys(catalog, ["skill_id"]), "skills as given": C.both_or_neither(catalog, skills, "skill_id"),
            "missing towers are empty": C.outside(towers, F.col("is_available") | (F.col("tower_text") == "") & (F.col("reliability_score") == 0)), "present towers have text": C.outside(towers, ~F.col("is_available") | (F.col("tower_text") != "")),
        }
    )
    return _write(target, "features", settings, {"candidate_tower_features": towers, "skill_features": catalog, "candidate_index": index}, {"candidates": people, "source_status": status, "skills": skills})


def build_vectors(spark: SparkSession, source: str, target: str, settings: S.EmbeddingConfig) -> dict:
    """Encoded towers and skills, and candidates fused by reliability."""
    towers, skills, index = _read(spark, source, "candidate_tower_features", "skill_features", "candidate_index")
    make = lambda: features.HashingEncoder(settings.dimension)
    prefix = F.replace(F.lit(settings.candidate_prefix), F.lit("{source}"), F.replace("source", F.lit("_"), F.lit(" ")))
    said = towers.withColumn("_text", F.concat(prefix, "tower_text"))
    vectors = features.encode_texts(said, ["candidate_id", "source"], "_text", "is_available", make, settings.batch_size).join(towers.select("candidate_id", "source", "is_available", "reliability_score", "split"), ["candidate_id", "source"])
    items = features.encode_texts(skills.withColumn("_text", F.concat(F.lit(settings.skill_prefix), "skill_text")), ["skill_id"], "_text", None, make, settings.batch_size)
    fused = fusion.reliability_fusion(vectors, ["candidate_id"], "embedding").join(index.select("candidate_id", "split"), "candidate_id")
    return _write(target, "vectors", settings, {"tower_vectors": vectors, "skill_vectors": items, "candidate_vectors": fused}, {"towers": towers, "skills": skills})


def evaluate(spark: SparkSession, source: str, target: str, settings: S.RetrievalConfig) -> dict:
    """Predictions and metrics of fused candidates against the whole catalog, for each way to fuse; the baseline may look at
    any split."""
    people, items, truth = (_plain(f) for f in _read(spark, source, "candidate_vectors", "skill_vectors", "candidate_skill_truth"))
    asked = people.where(F.col("split").isin(*settings.splits))
    known = truth.join(asked.select("query_id"), "query_id", "left_semi")
    ranked, measured = [], []
    for strategy in settings.strategies:
        fused = asked
        if strategy == "uniform_mean":
            towers = _plain(_read(spark, source, "tower_vectors")[0]).where("is_available").join(asked.select("query_id"), "query_id", "left_semi")
            fused = mean_vector(towers, ["query_id"], "embedding")
        top = retrieval.cosine_top_k(fused, items, max(settings.cutoffs), vector="embedding")
        ranked.append(top.withColumn("strategy", F.lit(strategy)))
        measured.append(metrics.per_query(top, known, settings.cutoffs).withColumn("strategy", F.lit(strategy)))
    top, each = (reduce(DataFrame.unionByName, frames).join(asked.select("query_id", "split"), "query_id") for frames in (ranked, measured))
    flagged = top.join(truth.select("query_id", "item_id").distinct().withColumn("is_relevant", F.lit(True)), ["query_id", "item_id"], "left").fillna(False, ["is_relevant"])
    by = ["strategy", "split"]
    overall = metrics.averaged(each, by).join(metrics.catalog_coverage(top, by, settings.cutoffs, items.count()), [*by, "k"])
    return _write(target, "retrieval", settings, {"retrieval_predictions": _named(flagged), "retrieval_candidate_metrics": _named(each), "retrieval_metrics": overall}, {"candidates": people, "skills": items})


def mine_pairs(spark: SparkSession, source: str, target: str, settings: S.PairConfig) -> dict:
    people, items, truth = (_plain(f) for f in _read(spark, source, "candidate_vectors", "skill_vectors", "candidate_skill_truth"))
    asked = people.where(F.col("split").isin(*settings.splits))
    known = truth.join(asked.select("query_id", "split"), "query_id")
    most = known.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    good = pairs.positives(known, settings.splits, (settings.relevance_weight, settings.proficiency_weight, settings.minimum_weight))
    asked = asked.where(F.col("split") == settings.negative_split)
    top = retrieval.cosine_top_k(asked, items, most + settings.hard_negatives, vector="embedding")
    hard = pairs.hard_negatives(top, known, settings.hard_negatives)
    random = pairs.random_negatives(asked, items, known.select("query_id", "item_id").unionByName(hard.select("query_id", "item_id")), settings.random_negatives, str(settings.seed))
    bad = hard.unionByName(random, allowMissingColumns=True).join(asked.select("query_id", "split"), "query_id")
    C.require({"positives and negatives are apart": good.select("query_id", "item_id").intersect(bad.select("query_id", "item_id")), "hard negatives": C.short_groups(asked, hard, "query_id", settings.hard_negatives)})
    index = pairs.pair_counts(people.where(F.col("split").isin(*settings.splits)).select("query_id", "split"), good, bad)
    return _write(target, "pairs", settings, {"positive_pairs": _named(good), "negative_pairs": _named(bad), "training_candidate_index": _named(index)}, {"candidates": people, "skills": items, "truth": truth}, {"sealed_rows": good.where("split = 'test'").count()})


def build_pools(spark: SparkSession, source: str, target: str, settings: S.HybridConfig) -> dict:
    """Pools without labels, then their recall against the visible truth."""
    people, towers, items, index, relations, truth = (_plain(f) for f in _read(spark, source, "candidate_vectors", "tower_vectors", "skill_vectors", "candidate_index", "occupation_skills", "positive_pairs"))
    asked = people.where(F.col("split") == settings.split)
    learned = retrieval.cosine_top_k(asked, items, settings.learned_k, vector="embedding")
    order = F.array_position(F.array(*map(F.lit, scoring.SOURCES)), F.col("source")).cast("int").alias("tower_order")
    seen = towers.where("is_available").join(asked.select("query_id"), "query_id", "left_semi").select("query_id", order, F.col("reliability_score").alias("reliability"), "embedding")
    by_tower = retrieval.cosine_top_k(seen, items, settings.tower_k, ("query_id", "tower_order", "reliability"), vector="embedding")
    worth = F.round(scoring.occupation_score(*(F.col(c) for c in ("importance", "level", "hot_technology", "in_demand"))), 12)
    best = relations.where(~F.coalesce("not_relevant", F.lit(False))).groupBy("onet_soc_code", "item_id").agg(F.max(worth).alias("score"))
    best = retrieval.ranked(best, ["onet_soc_code"], settings.occupation_k, F.col("score").desc(), F.col("item_id"))
    jobs = index.join(asked.select("query_id"), "query_id", "left_semi").select("query_id", F.col("primary_onet_soc_code").alias("onet_soc_code")).join(best, "onet_soc_code")
    fused = hybrid.fuse(learned, by_tower, jobs, settings.rrf_constant, settings.tower_weight, settings.occupation_weight)
    pool = hybrid.fill_pools(fused, asked, items, settings.pool_k, settings.learned_k).withColumn("engine", F.lit(HYBRID)).withColumn("split", F.lit(settings.split))
    C.require({"pool size": C.incomplete_ranks(pool, "query_id", "rank", settings.pool_k)})
    visible = C.refuse_sealed(truth).where(F.col("split") == settings.split)
    stages = learned.select(F.lit(f"learned_top{settings.learned_k}").alias("stage"), "query_id", "item_id")
    for k in sorted({*(c for c in settings.evaluation_cutoffs if c < settings.pool_k), settings.pool_k}):
        stages = stages.unionByName(pool.where(F.col("rank") <= k).select(F.lit(f"hybrid_top{k}").alias("stage"), "query_id", "item_id"))
    kept = pool.where("is_learned_protected").groupBy("query_id").count().where(F.col("count") == settings.learned_k).count()
    return _write(target, "hybrid", settings, {"hybrid_retrieval_predictions": _named(pool), "hybrid_retrieval_metrics": hybrid.stage_metrics(stages, visible, items.count())}, {"candidates": people, "skills": items}, {"candidates_with_whole_head": kept})


def hybrid_pools(predictions: DataFrame, split: str, size: int) -> DataFrame:
    """The split's pools, which raise unless they are the hybrid engine's, complete, without repeats, and keep the learned
    head in its places."""
    pool = predictions.where(F.col("split") == split)
    head = F.count_if("is_learned_protected")
    heads = pool.groupBy("query_id").agg(head.alias("held"), F.max(F.when(F.col("is_learned_protected"), F.col("rank"))).alias("last"), F.max("rank").alias("most"))
    C.require(
        {
            "no pools": pool.groupBy().count().where(F.col("count") == 0), "hybrid engine": pool.where(~F.col("engine").eqNullSafe(F.lit(HYBRID))), "pool pairs": C.duplicate_keys(pool, ["query_id", "item_id"]),
            "pool ranks": heads.where(F.col("most") < size), "whole ranks": C.incomplete_ranks(pool.where(F.col("rank") <= size), "query_id", "rank", size), "protected head": heads.where((F.col("held") == 0) | (F.col("held") != F.col("last"))),
        }
    )
    return pool


def rerank_pools(spark: SparkSession, source: str, target: str, settings: S.RerankConfig) -> dict:
    """The grid of trials over pools, the selected one's lists, and what each part gave."""
    pool, towers, items, truth = (_plain(f) for f in _read(spark, source, "hybrid_retrieval_predictions", "tower_vectors", "skill_vectors", "positive_pairs"))
    truth = C.refuse_sealed(truth)
    pool = hybrid_pools(pool, settings.split, settings.candidate_pool_size)
    pool = pool.where(F.col("rank") <= settings.candidate_pool_size).select("query_id", "item_id", "rank", F.col("rrf_score").alias("score"))
    gates = towers.withColumn("gate_weight", fusion.initial_gates(F.col("reliability_score"), F.col("is_available"), "query_id")).where("is_available").withColumnRenamed("embedding", "v")
    catalog = items.withColumnRenamed("embedding", "v")
    popular = rerank.train_popularity(items, truth.where("split = 'train'"))
    base = pool.join(rerank.gated_evidence(pool, gates, catalog), ["query_id", "item_id"]).join(popular, "item_id").cache()
    grid = rerank.grid(settings.evidence_weights, settings.popularity_penalties, settings.diversity_penalties)
    trials = spark.createDataFrame(grid, "trial int, evidence_weight double, popularity_penalty double, diversity_penalty double")
    lists = rerank.rerank(rerank.static_scores(base, trials), catalog, settings.output_k).cache()
    visible = truth.where(F.col("split") == settings.split).crossJoin(F.broadcast(trials.select("trial"))).withColumn("q", F.struct("trial", "query_id"))
    each = metrics.per_query(lists.withColumn("q", F.struct("trial", "query_id")), visible, (settings.output_k,), query="q").withColumn("trial", F.col("q.trial"))
    summary = metrics.averaged(each, ["trial"]).join(metrics.catalog_coverage(lists, ["trial"], (settings.output_k,), items.count()), ["trial", "k"])
    summary = summary.join(lists.join(popular, "item_id").groupBy("trial").agg(F.avg("popularity_score").alias("mean_popularity")), "trial")
    summary = summary.join(rerank.list_similarity(lists, catalog, ["trial", "query_id"]).groupBy("trial").agg(F.avg("mean_intra_list_similarity").alias("mean_intra_list_similarity")), "trial")
    chosen = rerank.select_trial(summary, settings.maximum_ndcg_drop).join(trials, "trial")
    compared = chosen.where("trial = 0").withColumn("strategy", F.lit(f"retrieval_top{settings.output_k}")).unionByName(chosen.where("is_selected").withColumn("strategy", F.lit("selected_reranker")))
    best = lists.join(chosen.where("is_selected").select("trial"), "trial").join(base.select("query_id", "item_id", F.col("score").alias("retrieval_score"), "evidence_score", "popularity_score"), ["query_id", "item_id"])
    return _write(target, "reranking", settings, {"reranking_trials": chosen, "reranking_comparison": compared, "reranked_predictions": _named(best)}, {"pools": pool, "truth": truth})


def audit_coverage(spark: SparkSession, source: str, target: str, settings: S.AuditConfig) -> dict:
    """Coverage and concentration of the pool and of the reranked lists, and what should come next."""
    pool, lists, skills, truth = (_plain(f) for f in _read(spark, source, "hybrid_retrieval_predictions", "reranked_predictions", "skill_features", "positive_pairs"))
    visible = C.refuse_sealed(truth).where(F.col("split") == settings.split)
    part = lambda f, name, k: f.where(F.col("rank") <= k).select(F.lit(name).alias("stage"), "query_id", "item_id")
    stages = part(pool, "pool", settings.pool_k).unionByName(part(lists, "reranked", settings.retrieval_k))
    C.require({"same candidates": C.both_or_neither(visible, stages, "query_id")})
    summary = audit.coverage_summary(stages, visible, skills.count())
    found = {r["stage"]: r for r in summary.collect()}
    step = audit.decide(found["pool"]["truth_pair_recall"], found["pool"]["truth_item_coverage"], found["reranked"]["truth_item_coverage"], settings.gates())
    outputs = {"coverage_summary": summary, "coverage_by_skill_type": audit.coverage_by_type(stages, visible, skills, "skill_type"), "skill_prediction_frequency": _named(audit.frequencies(stages, skills.select("item_id", "skill_name", "skill_type")))}
    return _write(target, "audit", settings, outputs, {"pools": pool, "lists": lists, "truth": truth}, {"next_step": step, "sealed_rows": visible.where("split = 'test'").count(), "random_recall": min(settings.retrieval_k / max(1, skills.count()), 1.0), "finite": math.isfinite(found["pool"]["herfindahl_index"])})


def train(spark: SparkSession, source: str, target: str, settings: S.FusionConfig) -> dict:
    """Pairs and towers to a gated fusion model: its vectors of candidates and skills, gates, history and parameters."""
    vectors, found, items, index, positive, negative = (_plain(f) for f in _read(spark, source, "tower_vectors", "candidate_tower_features", "skill_vectors", "candidate_index", "positive_pairs", "negative_pairs"))
    items = items.select("item_id", F.col("embedding").cast("array<double>").alias("v"))
    width = items.select(F.size("v").alias("n")).unionByName(vectors.select(F.size("embedding").alias("n"))).where(F.col("n") != settings.input_dimension)
    checks = {"vector dimension": width, "skill key": C.duplicate_keys(items, ["item_id"])}
    for name, table in (("positive", positive), ("negative", negative)):
        checks |= {f"sealed {name} pairs": table.where("split = 'test'"), f"splits of {name} pairs": C.disagreeing(table, index, ["query_id"], "split"), f"skills of {name} pairs": C.orphans(table, items, "item_id", "item_id")}
    C.require(checks)
    towers = learning.aligned_towers(index, vectors, found, settings).cache()
    model, history = learning.train_fusion(towers, items, positive, negative, settings)
    encoded = fusion.encode_queries(towers, model).join(towers.select("query_id", "split"), "query_id")
    gates = encoded.select("query_id", "split", F.posexplode("gates").alias("_at", "gate_weight")).withColumn("source", F.array(*map(F.lit, scoring.SOURCES))[F.col("_at")]).drop("_at")
    gates = gates.join(vectors.select("query_id", "source", "is_available"), ["query_id", "source"])
    tables.save_parameters(spark, model.parameters, f"{target}/fusion_parameters.parquet")
    outputs = {
        "learned_candidate_vectors": _named(encoded.select("query_id", "split", F.col("v").alias("embedding"))), "learned_skill_vectors": _named(fusion.encode_items(items, model).withColumnRenamed("v", "embedding")),
        "gate_weights": _named(gates), "training_history": learning.history_table(spark, history),
    }
    best = next(h for h in history if h["is_best"])
    measured = {"best_epoch": best["epoch"], "best_validation": best, "sources": list(scoring.SOURCES), "examples": learning.EXAMPLES, "parameters": {k: {"shape": list(v.shape), "dtype": str(v.dtype)} for k, v in model.parameters.items()}}
    body = _write(target, "fusion", settings, outputs, {"towers": vectors, "positive_pairs": positive, "negative_pairs": negative}, measured)
    C.require({"gates sum to one": C.wrong_sums(spark.read.parquet(f"{target}/gate_weights.parquet"), "candidate_id", "gate_weight")})
    towers.unpersist()
    return body


def evaluate_learned(spark: SparkSession, source: str, target: str, settings: S.LearnedRetrievalConfig) -> dict:
    """Learned vectors under three engines (tiles, expressions, a saved hash index): metrics, agreement, seconds, and what was
    gained on the frozen baseline. Raises if the index finds fewer of the exact neighbors than the settings ask for."""
    people, items, truth, baseline = (_plain(f) for f in _read(spark, source, "learned_candidate_vectors", "learned_skill_vectors", "positive_pairs", "retrieval_metrics"))
    people, items = (f.withColumnRenamed("embedding", "v") for f in (people, items))
    asked, visible = people.where(F.col("split") == settings.split), C.refuse_sealed(truth).where(F.col("split") == settings.split)
    size, most = items.count(), max(settings.cutoffs)
    if most > size:
        raise C.ContractError(f"the largest cutoff {most} exceeds the catalog of {size}")
    C.require({"same candidates": C.both_or_neither(asked, visible, "query_id"), "known skills": C.orphans(visible, items, "item_id", "item_id"), "no candidates": asked.groupBy().count().where(F.col("count") == 0)})
    width = len(items.first()["v"])
    # buckets of about ef_construction items, searched until about ef_search items a table are met
    bits = max(0, math.floor(math.log2(max(1.0, size / settings.ef_construction))))
    folder, probes = f"{target}/skill_index", math.ceil(settings.ef_search / settings.ef_construction) + bits // 2
    began = time.perf_counter()
    retrieval.save_index(retrieval.build_index(items, width, tables=settings.m, bits=bits, probes=probes), folder)
    built = time.perf_counter() - began
    index = retrieval.load_index(spark, folder)
    engines = {
        "tiles_exact": (0.0, lambda: retrieval.cosine_top_k(asked, items, most)), "expressions_exact": (0.0, lambda: retrieval.cosine_top_k_native(asked, items, most)),
        "hash_index": (built, lambda: retrieval.search_index(index, asked, most)),
    }
    n, found, timed, measured = asked.count(), {}, [], []
    for engine, (build, search) in engines.items():
        began = time.perf_counter()
        path = f"{target}/learned_retrieval_predictions.parquet/engine={engine}"
        search().select("query_id", "item_id", "score", F.col("rank").cast("int").alias("rank")).write.mode("overwrite").parquet(path)
        took = time.perf_counter() - began
        found[engine] = spark.read.parquet(path)
        timed.append((engine, build, took, n, n / took))
        each = metrics.averaged(metrics.per_query(found[engine], visible, settings.cutoffs).withColumn("engine", F.lit(engine)), ["engine"])
        measured.append(each.join(metrics.catalog_coverage(found[engine].withColumn("engine", F.lit(engine)), ["engine"], settings.cutoffs, size), ["engine", "k"]))
    fidelity = None
    for engine in ("expressions_exact", "hash_index"):
        for k in settings.cutoffs:
            one = retrieval.neighbor_recall(found["tiles_exact"], found[engine], k).select(F.lit(engine).alias("engine"), F.lit("tiles_exact").alias("reference"), "k", "neighbor_recall")
            fidelity = one if fidelity is None else fidelity.unionByName(one)
    fidelity = fidelity.cache()
    recall = fidelity.where(f"engine = 'hash_index' AND k = {most}").first()["neighbor_recall"]
    if recall < settings.minimum_recall_at_max_k:
        raise C.ContractError(f"the index's recall at {most}, {recall:.4f}, is below {settings.minimum_recall_at_max_k}")
    old = baseline.where((F.col("split") == settings.split) & (F.col("strategy") == "reliability_weighted"))
    learned = reduce(DataFrame.unionByName, measured)
    gained = metrics.lift(old, learned.where("engine = 'tiles_exact'"), (*metrics.METRICS, "catalog_coverage"))
    C.require({"no common cutoffs": gained.groupBy().count().where(F.col("count") == 0)})
    outputs = {"learned_retrieval_metrics": learned, "ann_fidelity": fidelity, "search_benchmark": spark.createDataFrame(timed, "engine string, index_build_seconds double, search_seconds double, queries long, queries_per_second double"), "baseline_comparison": gained}
    return _write(target, "learned_retrieval", settings, outputs, {"candidates": people, "skills": items, "truth": truth}, {"recall_at_max_k": recall, "index": folder})


STAGES: dict[str, tuple[Callable[..., dict], type[S.Settings]]] = {
    "generate": (generate, S.PopulationConfig), "features": (build_features, S.FeatureConfig), "vectors": (build_vectors, S.EmbeddingConfig), "evaluate": (evaluate, S.RetrievalConfig),
    "pairs": (mine_pairs, S.PairConfig), "train": (train, S.FusionConfig), "evaluate_learned": (evaluate_learned, S.LearnedRetrievalConfig), "pools": (build_pools, S.HybridConfig), "rerank": (rerank_pools, S.RerankConfig), "audit": (audit_coverage, S.AuditConfig),
}


def run(spark: SparkSession, name: str, source: str, target: str, config_path: str | None = None, **fields) -> dict:
    """One stage with settings from a TOML file or fields."""
    stage, kind = STAGES[name]
    ship(spark)
    settings = kind.load(config_path) if config_path else kind()
    settings = dataclasses.replace(settings, **fields)
    settings.validate()
    return stage(spark, source, target, settings)
