"""Stage settings: frozen dataclasses that check themselves and load from TOML."""

from __future__ import annotations

import dataclasses
import math
import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import ClassVar, Self


class Settings:
    """Loads its fields from any table of a TOML file; ``NAMES`` maps keys (with their table) to fields of another name.
    Unknown keys and wrong values raise."""

    NAMES: ClassVar[dict[str, str]] = {}

    @classmethod
    def load(cls, path: str | Path) -> Self:
        found: dict = {}
        fields = {f.name for f in dataclasses.fields(cls)}

        def gather(table: dict, at: str) -> None:
            for k, v in table.items():
                if isinstance(v, dict):
                    gather(v, f"{at}{k}.")
                    continue
                name = cls.NAMES.get(f"{at}{k}", k)
                _need(name in fields, f"unknown setting {at}{k}")
                found[name] = tuple(v) if isinstance(v, list) else v

        gather(tomllib.loads(Path(path).read_text()), "")
        out = cls(**found)
        out.validate()
        return out

    def validate(self) -> None:
        """Raises ValueError unless all fields are in range."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _cutoffs(cutoffs: tuple[int, ...]) -> None:
    _need(bool(cutoffs) and all(k > 0 for k in cutoffs) and list(cutoffs) == sorted(set(cutoffs)), "cutoffs must be positive, distinct and ascending")


def _unsealed(split: str) -> None:
    _need(split in ("train", "validation"), "split must be train or validation; test is sealed")


_SOURCES = ("resume", "projects", "job_history", "courses", "self_reported_skills")


@dataclass(frozen=True)
class PopulationConfig(Settings):
    NAMES: ClassVar[dict[str, str]] = {f"splits.{s}": f"{s}_fraction" for s in ("train", "validation", "test")} | {f"missingness.{s}": f"{s}_missing_rate" for s in _SOURCES}

    n_candidates: int = 10_000
    seed: int = 20_260_908
    snapshot_date: str = "2026-09-01"
    taxonomy_version: str = "onet-31.0+v1"
    train_fraction: float = 0.80
    validation_fraction: float = 0.10
    test_fraction: float = 0.10
    resume_missing_rate: float = 0.08
    projects_missing_rate: float = 0.22
    job_history_missing_rate: float = 0.04
    courses_missing_rate: float = 0.35
    self_reported_skills_missing_rate: float = 0.12
    stale_resume_rate: float = 0.22
    noisy_claim_rate: float = 0.12
    max_true_skills: int = 45
    max_self_reported_skills: int = 100

    def missing_rates(self) -> dict[str, float]:
        return {f.name.removesuffix("_missing_rate"): getattr(self, f.name) for f in dataclasses.fields(self) if f.name.endswith("_missing_rate")}

    def validate(self) -> None:
        _need(self.n_candidates > 0 and self.max_true_skills > 0 and self.max_self_reported_skills > 0, "counts must be positive")
        _need(math.isclose(self.train_fraction + self.validation_fraction + self.test_fraction, 1, abs_tol=1e-9), "fractions must sum to one")
        _need(all(0 <= r <= 1 for r in (*self.missing_rates().values(), self.stale_resume_rate, self.noisy_claim_rate)), "rates must lie in 0..1")


@dataclass(frozen=True)
class FeatureConfig(Settings):
    feature_version: str = "features-v1"
    taxonomy_version: str = "onet-31.0+v1"
    stale_after_days: int = 730
    high_volume_threshold: int = 40
    resume: int = 6000
    projects: int = 4000
    job_history: int = 6000
    courses: int = 3000
    self_reported_skills: int = 4000

    def limits(self) -> dict[str, int]:
        return {s: getattr(self, s) for s in _SOURCES}

    def validate(self) -> None:
        _need(self.stale_after_days > 0 and self.high_volume_threshold > 0 and min(self.limits().values()) > 0, "limits must be positive")


@dataclass(frozen=True)
class RetrievalConfig(Settings):
    evaluation_version: str = "retrieval-v1"
    cutoffs: tuple[int, ...] = (10, 30, 100)
    splits: tuple[str, ...] = ("validation",)
    strategies: tuple[str, ...] = ("reliability_weighted",)
    query_batch_size: int = 256

    def validate(self) -> None:
        _cutoffs(self.cutoffs)
        _need(bool(self.splits) and set(self.splits) <= {"train", "validation", "test"}, "unknown split")
        _need(bool(self.strategies) and set(self.strategies) <= {"reliability_weighted", "uniform_mean"}, "unknown strategy")
        _need(self.query_batch_size > 0, "the batch size must be positive")


@dataclass(frozen=True)
class EmbeddingConfig(Settings):
    NAMES: ClassVar[dict[str, str]] = {"text_prefixes.candidate": "candidate_prefix", "text_prefixes.skill": "skill_prefix"}

    embedding_version: str = "embeddings-v1"
    model_name: str = "hashing"
    model_revision: str = ""
    batch_size: int = 64
    device: str = "auto"
    normalize: bool = True
    dimension: int = 384
    candidate_prefix: str = "Candidate {source} evidence: "
    skill_prefix: str = "Skill: "

    def validate(self) -> None:
        _need(self.batch_size > 0 and self.dimension > 0, "sizes must be positive")
        _need(self.normalize, "vectors are normalized for cosine retrieval")
        _need("{source}" in self.candidate_prefix, "the candidates' prefix must name the source")


@dataclass(frozen=True)
class LearnedRetrievalConfig(Settings):
    """m, ef_construction and ef_search are the efforts of a graph index; here they set the hash tables of an index, and the
    nearest buckets that a search looks into beside its own."""

    NAMES: ClassVar[dict[str, str]] = {"hnsw.m": "m"}

    evaluation_version: str = "learned-retrieval-v1"
    split: str = "validation"
    cutoffs: tuple[int, ...] = (10, 30, 100)
    query_batch_size: int = 256
    threads: int = 1
    m: int = 32
    ef_construction: int = 200
    ef_search: int = 256
    minimum_recall_at_max_k: float = 0.99

    def validate(self) -> None:
        _unsealed(self.split)
        _cutoffs(self.cutoffs)
        _need(min(self.query_batch_size, self.threads, self.m, self.ef_construction, self.ef_search) > 0, "efforts must be positive")
        _need(0 < self.minimum_recall_at_max_k <= 1, "recall must lie in 0..1")


@dataclass(frozen=True)
class PairConfig(Settings):
    NAMES: ClassVar[dict[str, str]] = {"mining.positive_splits": "splits", "mining.hard_negatives_per_candidate": "hard_negatives", "mining.random_negatives_per_candidate": "random_negatives"}

    mining_version: str = "training-pairs-v1"
    hard_negatives: int = 30
    random_negatives: int = 10
    seed: int = 20260909
    splits: tuple[str, ...] = ("train", "validation")
    negative_split: str = "train"
    query_batch_size: int = 256
    relevance_weight: float = 0.7
    proficiency_weight: float = 0.3
    minimum_weight: float = 0.1

    def validate(self) -> None:
        _need(self.hard_negatives > 0 and self.random_negatives > 0, "counts must be positive")
        for s in (*self.splits, self.negative_split):
            _unsealed(s)
        _need(math.isclose(self.relevance_weight + self.proficiency_weight, 1, abs_tol=1e-9) and 0 < self.minimum_weight <= 1, "weights must sum to one, over a positive minimum")


@dataclass(frozen=True)
class HybridConfig(Settings):
    NAMES: ClassVar[dict[str, str]] = {"retrieval.pool_size": "pool_k"}

    retrieval_version: str = "hybrid-retrieval-v1"
    split: str = "validation"
    learned_k: int = 100
    pool_k: int = 200
    tower_k: int = 200
    occupation_k: int = 200
    evaluation_cutoffs: tuple[int, ...] = (30, 100, 200)
    rrf_constant: int = 60
    tower_weight: float = 0.75
    occupation_weight: float = 0.65

    def validate(self) -> None:
        _unsealed(self.split)
        _need(0 < self.learned_k <= self.pool_k and self.tower_k > 0 and self.occupation_k > 0, "the pool must hold the learned head")
        _cutoffs(self.evaluation_cutoffs)
        _need(self.rrf_constant > 0 and self.tower_weight >= 0 and self.occupation_weight >= 0, "weights must not be negative")


@dataclass(frozen=True)
class RerankConfig(Settings):
    reranker_version: str = "reranker-v1"
    split: str = "validation"
    candidate_pool_size: int = 100
    output_k: int = 30
    maximum_ndcg_drop: float = 0.02
    evidence_weights: tuple[float, ...] = (0.15, 0.30)
    popularity_penalties: tuple[float, ...] = (0.0, 0.05)
    diversity_penalties: tuple[float, ...] = (0.0, 0.03, 0.06)

    def validate(self) -> None:
        _unsealed(self.split)
        _need(0 < self.output_k <= self.candidate_pool_size, "output must fit the pool")
        _need(0 <= self.maximum_ndcg_drop <= 1, "the allowed drop must lie in 0..1")
        _need(all(g and min(g) >= 0 for g in (self.evidence_weights, self.popularity_penalties, self.diversity_penalties)) and max(self.evidence_weights) <= 1, "grids must hold shares and penalties")


@dataclass(frozen=True)
class FusionConfig(Settings):
    model_version: str = "fusion-v1"
    input_dimension: int = 384
    quality_dimension: int = 6
    dropout: float = 0.05
    device: str = "auto"
    cutoff: int = 30
    query_batch_size: int = 256
    stale_after_days: int = 730
    volume_scale: int = 40
    output_dimension: int = 128
    gate_hidden_dimension: int = 32
    epochs: int = 5
    batch_size: int = 512
    hard_negatives_per_example: int = 4
    random_negatives_per_example: int = 4
    learning_rate: float = 3e-4
    weight_decay: float = 1e-4
    temperature: float = 0.07
    gradient_clip_norm: float = 1.0
    patience: int = 2
    seed: int = 20260909

    def validate(self) -> None:
        _need(min(self.output_dimension, self.gate_hidden_dimension, self.epochs, self.batch_size, self.hard_negatives_per_example, self.random_negatives_per_example) > 0, "sizes must be positive")
        _need(0 <= self.dropout < 1 and self.cutoff > 0 and self.input_dimension > 0, "dropout must lie in 0..1, sizes must be positive")
        _need(self.learning_rate > 0 and self.temperature > 0 and self.gradient_clip_norm > 0 and self.weight_decay >= 0 and self.patience >= 0, "rates must be positive")


@dataclass(frozen=True)
class AuditConfig(Settings):
    audit_version: str = "coverage-audit-v1"
    split: str = "validation"
    retrieval_k: int = 30
    pool_k: int = 100
    minimum_pool_pair_recall: float = 0.75
    minimum_pool_truth_skill_coverage: float = 0.80
    minimum_reranked_truth_skill_coverage: float = 0.50

    def gates(self) -> tuple[float, float, float]:
        return self.minimum_pool_pair_recall, self.minimum_pool_truth_skill_coverage, self.minimum_reranked_truth_skill_coverage

    def validate(self) -> None:
        _unsealed(self.split)
        _need(0 < self.retrieval_k <= self.pool_k and all(0 <= g <= 1 for g in self.gates()), "k and gates must be in range")
