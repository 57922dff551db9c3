"""A seeded synthetic population of candidates.

Every draw is a hash of the seed, the candidate, a stream name and a number, so tables are the same on any cluster and
partition. Distributions follow the documented rates; counts are Poisson by inversion, normals by Box-Muller, and draws
without replacement take the largest exponential keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from orrery.config import PopulationConfig
from orrery.functions import scoring as S, text as T

__all__ = ["PopulationConfig", "candidates", "true_skills", "availability", "job_history", "projects", "courses", "self_reports", "resumes", "source_status", "validate"]

#: Segment shares and how they scale missing sources; claim styles and their sizes.
SEGMENTS = {"complete": (0.55, 0.45), "partial": (0.30, 1.0), "sparse": (0.15, 2.25)}
STYLES = {"concise": (0.24, 3, 7), "typical": (0.66, 8, 30), "exhaustive": (0.10, 40, 100)}

#: Parts of an occupation's skills while they are drawn from; how many square roots of the wished number are let through beside it.
DEALT, SPARE = 32, 8


def uniform(seed: int, *names: Column | str | int) -> Column:
    """A number in (0, 1)."""
    h = F.xxhash64(F.lit(seed), *(n if isinstance(n, Column) else F.lit(n) for n in names))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def pick(u: Column, shares: dict[str, float]) -> Column:
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(name)


def poisson(u: Column, rate: Column | float, most: int = 120) -> Column:
    """The count whose cumulative probability first reaches u; rates here are under 60."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def walk(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["c"] >= u, s).otherwise(F.struct(p.alias("p"), (s["c"] + p).alias("c"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, walk, lambda s: s["k"])


def normal(seed: int, *names: Column | str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *names, "radius"))) * F.cos(2 * math.pi * uniform(seed, *names, "angle"))


def whole(u: Column, low: int, high: int) -> Column:
    return (low + F.floor(u * (high - low + 1))).cast("int")


def candidates(spark: SparkSession, config: PopulationConfig, occupations: DataFrame) -> DataFrame:
    """candidate_id, primary_onet_soc_code, profile_segment, skill_claim_style, years_experience, profile_created_at,
    split, taxonomy_version, generation_seed. Occupations are drawn with weight rank ** -0.75 in a shuffled order."""
    config.validate()
    seed = config.seed
    ranked = occupations.select("onet_soc_code").distinct().withColumn("_r", F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "onet_soc_code"), "onet_soc_code")))
    ranked = ranked.withColumn("_w", F.pow(F.col("_r").cast("double"), F.lit(-0.75)))
    upto = F.sum("_w").over(W.orderBy("_r"))
    ladder = ranked.withColumn("_hi", upto / F.sum("_w").over(W.partitionBy())).withColumn("_lo", F.coalesce(F.lag("_hi").over(W.orderBy("_r")), F.lit(0.0))).select("onet_soc_code", "_lo", "_hi")

    def years(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            draws = [np.random.Generator(np.random.PCG64([seed, int(i)])).gamma(2.2, 4.2) for i in b["index"]]
            yield b.assign(years_experience=np.clip(np.array(draws, float).astype(int), 0, 35).astype(np.int32))

    people = spark.range(config.n_candidates).withColumnRenamed("id", "index").mapInPandas(years, "index long, years_experience int")
    people = people.withColumn("candidate_id", T.numbered_id("cand_", F.col("index") + 1, 7)).withColumn("_u", uniform(seed, F.col("index"), "occupation"))
    people = people.join(F.broadcast(ladder), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return people.select(
        "candidate_id", F.col("onet_soc_code").alias("primary_onet_soc_code"), pick(uniform(seed, F.col("index"), "segment"), {k: v[0] for k, v in SEGMENTS.items()}).alias("profile_segment"),
        pick(uniform(seed, F.col("index"), "style"), {k: v[0] for k, v in STYLES.items()}).alias("skill_claim_style"), "years_experience",
        F.date_sub(F.lit(config.snapshot_date).cast("date"), whole(uniform(seed, F.col("index"), "created"), 30, 1460)).cast("timestamp_ntz").alias("profile_created_at"),
        S.golden_split(F.col("index"), config.train_fraction, config.validation_fraction).alias("split"), F.lit(config.taxonomy_version).alias("taxonomy_version"), F.lit(seed).cast("long").alias("generation_seed"),
    )


def true_skills(people: DataFrame, relations: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    """candidate_id, skill_id, skill_name, relevance_score, proficiency: weighted draws from the occupation's skills.

    Keys of draws are exponential with the relevance as rate, so about as many lie under a bound as the sum of relevances
    times the bound. Only keys under one that lets enough through are sorted; candidates for whom it lets too few through
    have all their skills sorted."""
    config = config or PopulationConfig()
    seed = config.seed
    wanted = people.withColumn("_n", F.greatest(F.lit(12), F.least(F.lit(config.max_true_skills), poisson(uniform(seed, F.col("candidate_id"), "skills"), 22 + 0.8 * F.col("years_experience")))))
    known = relations.groupBy(F.col("onet_soc_code").alias("primary_onet_soc_code"), "skill_id").agg(F.min("skill_name").alias("skill_name"), F.max("relevance_score").alias("relevance_score"))
    known = known.withColumn("_deal", F.pmod(F.xxhash64("skill_id"), F.lit(DEALT)).cast("int"))  # an occupation is many groups
    total = known.groupBy("primary_onet_soc_code").agg(F.sum("relevance_score").alias("_total"))
    bound = F.when(F.col("_total") > 0, (F.col("_n") + SPARE * F.sqrt("_n")) / F.col("_total"))
    wanted = wanted.join(total, "primary_onet_soc_code").withColumn("_bound", bound)

    def ranked(people: DataFrame, keep: Column) -> DataFrame:
        asked = people.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).hint("merge")  # no side is sent to all
        rows = known.join(asked, ["primary_onet_soc_code", "_deal"])
        rows = rows.withColumn("_key", -F.ln(uniform(seed, F.col("candidate_id"), F.col("skill_id"), "draw")) / F.col("relevance_score")).where(keep)
        return rows.withColumn("_r", F.row_number().over(W.partitionBy("candidate_id").orderBy("_key", "skill_id"))).where("_r <= _n")

    near = ranked(wanted, F.col("_key").isNull() | (F.col("_key") <= F.col("_bound"))).persist()
    enough = near.where("_r = _n").select("candidate_id")
    drawn = near.join(enough, "candidate_id", "left_semi").unionByName(ranked(wanted.join(enough, "candidate_id", "left_anti"), F.lit(True)))
    level = 1 + 3 * F.col("relevance_score") + F.least(F.col("years_experience") / 20.0, F.lit(1.0)) + 0.35 * normal(seed, F.col("candidate_id"), F.col("skill_id"), "level")
    return drawn.select("candidate_id", "skill_id", "skill_name", F.round("relevance_score", 4).alias("relevance_score"), F.round(S.clip(level, 1, 5), 4).alias("proficiency"))


def availability(people: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    """candidate_id, source, is_available; a candidate with nothing keeps the job history."""
    config = config or PopulationConfig()
    rate = F.coalesce(*(F.when(F.col("source") == s, F.lit(r)) for s, r in config.missing_rates().items()))
    scale = F.coalesce(*(F.when(F.col("profile_segment") == s, F.lit(v[1])) for s, v in SEGMENTS.items()))
    grid = people.select("candidate_id", "profile_segment", F.explode(F.array(*map(F.lit, S.SOURCES))).alias("source"))
    grid = grid.withColumn("_there", uniform(config.seed, F.col("candidate_id"), F.col("source"), "there") >= F.least(rate * scale, F.lit(0.92)))
    none = ~F.max("_there").over(W.partitionBy("candidate_id"))
    return grid.select("candidate_id", "source", (F.col("_there") | none & (F.col("source") == "job_history")).alias("is_available"))


def _items(people: DataFrame, there: DataFrame, source: str, count: Column) -> DataFrame:
    mine = there.where((F.col("source") == source) & F.col("is_available")).select("candidate_id")
    return people.join(mine, "candidate_id").withColumn("n", F.explode(F.sequence(F.lit(1), count)))


def _numbered(rows: DataFrame, by: str, order: str, number: str, size: str) -> DataFrame:
    """Rows numbered from 0 inside each group, with the group's size."""
    return rows.withColumn(number, F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).withColumn(size, F.count(F.lit(1)).over(W.partitionBy(by)))


def job_history(people: DataFrame, there: DataFrame, titles: DataFrame, config: PopulationConfig | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Jobs back from the snapshot: the last in the candidate's occupation, earlier ones in any of its major group (the
    first two characters of its code). The evidence is one of the job's tasks (onet_soc_code, task), else a sentence."""
    from orrery.operators.relational import chained_spans

    config = config or PopulationConfig()
    u = lambda name: uniform(config.seed, F.col("candidate_id"), F.col("n"), name)
    jobs = _items(people, there, "job_history", F.least(F.lit(4), 1 + poisson(uniform(config.seed, F.col("candidate_id"), "jobs"), 1.2)))
    jobs = jobs.withColumn("duration", whole(u("duration"), 365, 1460)).withColumn("gap", whole(u("gap"), 0, 120))
    jobs = chained_spans(jobs, "candidate_id", "n", "duration", "gap", config.snapshot_date)
    named = _numbered(titles.select("onet_soc_code", "job_title").distinct(), "onet_soc_code", "job_title", "_t", "_of")
    codes = named.select("onet_soc_code").distinct().withColumn("_major", F.substring("onet_soc_code", 1, 2))
    related = _numbered(codes, "_major", "onet_soc_code", "_c", "_codes").withColumnRenamed("onet_soc_code", "_related")
    jobs = jobs.withColumn("_major", F.substring("primary_onet_soc_code", 1, 2)).join(related.select("_major", "_codes").distinct(), "_major")
    jobs = jobs.withColumn("_c", F.floor(u("occupation") * F.col("_codes"))).join(related.drop("_codes"), ["_major", "_c"])
    jobs = jobs.withColumn("onet_soc_code", F.when(F.col("n") == 1, F.col("primary_onet_soc_code")).otherwise(F.col("_related")))
    jobs = jobs.join(named.select("onet_soc_code", "_of").distinct(), "onet_soc_code").withColumn("_t", F.floor(u("title") * F.col("_of")))
    jobs = jobs.join(named.drop("_of"), ["onet_soc_code", "_t"]).withColumn("_task", F.lit(None).cast("string"))
    if tasks is not None:
        listed = _numbered(tasks.select("onet_soc_code", "task").where("task IS NOT NULL").distinct(), "onet_soc_code", "task", "_k", "_tasks")
        jobs = jobs.drop("_task").join(listed.select("onet_soc_code", "_tasks").distinct(), "onet_soc_code", "left").withColumn("_k", F.floor(u("task") * F.col("_tasks")))
        jobs = jobs.join(listed.select("onet_soc_code", "_k", F.col("task").alias("_task")), ["onet_soc_code", "_k"], "left")
    evidence = F.coalesce("_task", F.concat(F.lit("Performed responsibilities related to "), "job_title", F.lit(".")))
    return jobs.select(F.concat(F.col("candidate_id"), T.numbered_id("_job_", F.col("n"), 2)).alias("job_history_id"), "candidate_id", "onet_soc_code", "job_title", "start_date", F.when(F.col("n") > 1, F.col("end_date")).alias("end_date"), evidence.alias("description"))


def _skilled(people: DataFrame, there: DataFrame, skills: DataFrame, source: str, rate: float, most: int, config: PopulationConfig) -> DataFrame:
    rows = _items(people, there, source, F.least(F.lit(most), 1 + poisson(uniform(config.seed, F.col("candidate_id"), source), rate)))
    order = W.partitionBy("candidate_id").orderBy(uniform(config.seed, F.col("candidate_id"), F.col("skill_id"), source))
    return rows.join(skills.withColumn("n", F.row_number().over(order)), ["candidate_id", "n"]).withColumn("completed_at", F.date_sub(F.lit(config.snapshot_date).cast("date"), whole(uniform(config.seed, F.col("candidate_id"), F.col("n"), source, "date"), 0, 2000)))


def projects(people: DataFrame, there: DataFrame, skills: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    rows = _skilled(people, there, skills, "projects", 1.3, 5, config or PopulationConfig())
    return rows.select(F.concat(F.col("candidate_id"), T.numbered_id("_project_", F.col("n"), 2)).alias("project_id"), "candidate_id", F.concat(F.lit("Project with "), "skill_name").alias("project_title"), F.concat(F.lit("Work that used "), "skill_name", F.lit(".")).alias("description"), "completed_at")


def courses(people: DataFrame, there: DataFrame, skills: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    rows = _skilled(people, there, skills, "courses", 2.0, 8, config or PopulationConfig())
    return rows.select(F.concat(F.col("candidate_id"), T.numbered_id("_course_", F.col("n"), 2)).alias("course_id"), "candidate_id", F.concat(F.lit("Course on "), "skill_name").alias("course_name"), "skill_id", "completed_at")


def resumes(people: DataFrame, there: DataFrame, skills: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    """Texts that name the first 18 skills; the stale share is dated more than two years back."""
    config = config or PopulationConfig()
    best = skills.withColumn("n", F.row_number().over(W.partitionBy("candidate_id").orderBy(F.col("relevance_score").desc(), "skill_id"))).where("n <= 18")
    named = best.groupBy("candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "skill_name"))), lambda s: s["skill_name"]), ", ").alias("_names"))
    mine = people.join(there.where("source = 'resume' AND is_available").select("candidate_id"), "candidate_id").join(named, "candidate_id")
    u = lambda name: uniform(config.seed, F.col("candidate_id"), "resume", name)
    age = F.when(u("stale") < config.stale_resume_rate, whole(u("old"), 731, 3650)).otherwise(whole(u("new"), 0, 730))
    return mine.select(F.concat("candidate_id", F.lit("_resume")).alias("resume_id"), "candidate_id", F.concat("years_experience", F.lit(" years of experience with "), "_names", F.lit(".")).alias("resume_text"), F.date_sub(F.lit(config.snapshot_date).cast("date"), age).alias("updated_at"))


def self_reports(people: DataFrame, skills: DataFrame, catalog: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    """Claims: most of true skills under the names people write, the rest noise from the catalog; a candidate's claims have
    one date."""
    from orrery.operators.pairs import prime_from, scattered
    from orrery.sources.tables import numbered

    config = config or PopulationConfig()
    seed = config.seed
    u = lambda name: uniform(seed, F.col("candidate_id"), name)
    size = F.coalesce(*(F.when(F.col("skill_claim_style") == s, whole(u("claims"), a, b)) for s, (_, a, b) in STYLES.items()))
    size = F.least(size, F.lit(config.max_self_reported_skills))
    noise = F.greatest(F.lit(config.noisy_claim_rate), F.when(F.col("skill_claim_style") == "exhaustive", 0.30).otherwise(0.0))
    asked = people.select("candidate_id", size.alias("_size"), noise.alias("_rate")).withColumn("_noise", F.bround(F.col("_size") * F.col("_rate")).cast("int"))
    true = skills.select("candidate_id", "skill_id", "skill_name", F.lit(True).alias("oracle_is_true_skill")).join(asked, "candidate_id")
    true = true.withColumn("_r", F.row_number().over(W.partitionBy("candidate_id").orderBy(uniform(seed, F.col("candidate_id"), F.col("skill_id"), "claim"), "skill_id"))).where("_r <= _size - _noise")
    # noise: each candidate's own permutation of the catalog, as far as makes sure that enough are no true skills
    catalog = numbered(catalog, "skill_id", "_no")
    size = catalog.count()
    prime = prime_from(size)
    tries = F.least(F.lit(prime), F.col("_noise") + config.max_true_skills + prime - size)
    drawn = asked.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), tries.cast("long")))).withColumn("_no", scattered(str(seed), F.col("candidate_id"), F.col("_i"), prime))
    false = drawn.where(F.col("_i") < tries).join(catalog, "_no").join(skills.select("candidate_id", "skill_id"), ["candidate_id", "skill_id"], "left_anti")
    false = false.withColumn("_r", F.row_number().over(W.partitionBy("candidate_id").orderBy("_i"))).where("_r <= _noise").withColumn("oracle_is_true_skill", F.lit(False))
    cols = ["candidate_id", "skill_id", "skill_name", "oracle_is_true_skill"]
    claims = true.select(*cols).unionByName(false.select(*cols))
    claims = claims.withColumn("_n", F.row_number().over(W.partitionBy("candidate_id").orderBy(uniform(seed, F.col("candidate_id"), F.col("skill_id"), "shuffle"), "skill_id")))
    written, kind = T.surface_name(F.col("skill_name"), [uniform(seed, F.col("candidate_id"), F.col("skill_id"), f"alias{i}") for i in range(4)])
    return claims.select(
        F.concat(F.col("candidate_id"), T.numbered_id("_claim_", F.col("_n"), 3)).alias("claim_id"), "candidate_id", written.alias("raw_skill_name"), F.col("skill_id").alias("canonical_skill_id"),
        whole(uniform(seed, F.col("candidate_id"), F.col("skill_id"), "proficiency"), 2, 5).alias("reported_proficiency"),
        F.date_sub(F.lit(config.snapshot_date).cast("date"), whole(u("claimed"), 0, 1460)).alias("claimed_at"), kind.alias("alias_type"), "oracle_is_true_skill",
    )


def source_status(people: DataFrame, items: DataFrame, config: PopulationConfig | None = None) -> DataFrame:
    """items (candidate_id, source, item_count, updated_at) on the complete grid, with age and reliability. Job history
    counts as fresh, for it is dated at the snapshot."""
    from orrery.operators.relational import complete_grid

    config = config or PopulationConfig()
    grid = complete_grid(people, list(S.SOURCES), items, "candidate_id", "source").withColumn("item_count", F.coalesce("item_count", F.lit(0)).cast("int"))
    age = F.when(F.col("item_count") > 0, F.when(F.col("source") == "job_history", F.lit(0)).otherwise(T.age_days(F.col("updated_at"), config.snapshot_date)))
    return grid.withColumn("age_days", age).withColumn("is_available", F.col("item_count") > 0).withColumn("reliability_score", S.reliability(F.col("source"), F.col("age_days"), F.col("item_count")))


def validate(people: DataFrame, truth: DataFrame, status: DataFrame, config: PopulationConfig, owned: dict[str, tuple[DataFrame, str]] | None = None) -> None:
    """Raises unless keys, counts and ranges hold; ``owned`` has tables of rows that belong to candidates, by name, with
    their keys."""
    from orrery import contracts as C

    rows = {}
    for name, (frame, key) in (owned or {}).items():
        rows |= {f"{name} key": C.duplicate_keys(frame, [key]), f"{name} candidates": C.orphans(frame, people, "candidate_id", "candidate_id")}
    C.require(
        rows
        | {
            "candidate count": people.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != config.n_candidates), "candidate key": C.duplicate_keys(people, ["candidate_id"]), "truth key": C.duplicate_keys(truth, ["candidate_id", "skill_id"]),
            "truth candidates": C.orphans(truth, people, "candidate_id", "candidate_id"), "status key": C.duplicate_keys(status, ["candidate_id", "source"]),
            "status grid": status.groupBy("candidate_id").count().where(F.col("count") != len(S.SOURCES)), "reliability range": C.outside(status, F.col("reliability_score").between(0, 1)), "proficiency range": C.outside(truth, F.col("proficiency").between(1, 5)),
        }
    )


@dataclass(frozen=True)
class Population:
    """The tables of one snapshot."""

    candidates: DataFrame
    truth: DataFrame
    resumes: DataFrame
    job_history: DataFrame
    projects: DataFrame
    courses: DataFrame
    claims: DataFrame
    status: DataFrame


def generate(spark: SparkSession, config: PopulationConfig, occupations: DataFrame, titles: DataFrame, relations: DataFrame, tasks: DataFrame | None = None) -> Population:
    """All tables; relations has onet_soc_code, skill_id, skill_name and relevance_score."""
    people = candidates(spark, config, occupations.join(relations.select("onet_soc_code").distinct(), "onet_soc_code", "left_semi"))
    truth, there = true_skills(people, relations, config), availability(people, config)
    jobs, work, study, texts = job_history(people, there, titles, config, tasks), projects(people, there, truth, config), courses(people, there, truth, config), resumes(people, there, truth, config)
    mine = there.where("source = 'self_reported_skills' AND is_available").select("candidate_id")
    claims = self_reports(people.join(mine, "candidate_id"), truth, relations.select("skill_id", "skill_name").distinct(), config)
    snap = F.lit(config.snapshot_date).cast("date")
    count = lambda f, source, when: f.groupBy("candidate_id").agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("item_count"), F.max(when).alias("updated_at"))
    items = count(texts, "resume", "updated_at").unionByName(count(work, "projects", "completed_at")).unionByName(count(jobs, "job_history", snap)).unionByName(count(study, "courses", "completed_at")).unionByName(count(claims, "self_reported_skills", "claimed_at"))
    return Population(people, truth, texts, jobs, work, study, claims, source_status(people, items, config))
