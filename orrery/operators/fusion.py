"""Fusion of source vectors: by reliability, and by gates that are learned with the projections.

The learned model projects sources with a shared matrix and a residual each, weighs them by a softmax of log reliability
plus a small network on quality features, and projects items with a matrix of their own. Training is minibatch AdamW in
NumPy on the driver over mined pairs; encoding runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orrery.functions.vectors import l2_normalize, mean_vector


def reliability_fusion(frame: DataFrame, keys: list[str], vector: str = "v", weight: str = "reliability_score") -> DataFrame:
    """Unit vectors: means by positive weight; the plain mean of all rows where no weight is positive. A negative weight
    raises."""
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("reliability must not be negative")).cast("double")).otherwise(F.col(weight).cast("double"))
    return mean_vector(frame, keys, vector, w).withColumn(vector, l2_normalize(F.col(vector)))


def initial_gates(reliability: Column, available: Column, key: str) -> Column:
    """The gates before training: shares of reliability among the sources that are there."""
    kept = F.when(available, F.greatest(reliability, F.lit(1e-6))).otherwise(F.lit(0.0))
    return kept / F.sum(kept).over(W.partitionBy(key))


def contrastive_loss(candidates: np.ndarray, positive: np.ndarray, negative: np.ndarray, weights: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """The weighted softmax loss with the positive in place 0, and its slope by logit."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    z = np.concatenate([(candidates * positive).sum(1)[:, None], np.einsum("bd,bnd->bn", candidates, negative)], 1) / temperature
    z -= z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    w = np.maximum(weights, 0)
    total = max(w.sum(), 1e-8)
    slope = p.copy()
    slope[:, 0] -= 1
    return float((-np.log(np.maximum(p[:, 0], 1e-300)) * w).sum() / total), slope * (w / total / temperature)[:, None]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x / n, n


def _unit_slope(y: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (d - y * (d * y).sum(-1, keepdims=True)) / n


@dataclass
class GatedFusion:
    """Parameters and the forward pass with its slopes."""

    sources: int
    inputs: int
    outputs: int
    qualities: int = 6
    hidden: int = 32
    seed: int = 20260909
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.parameters:
            return
        rng = np.random.Generator(np.random.PCG64(self.seed))
        square = np.linalg.qr(rng.standard_normal((max(self.inputs, self.outputs),) * 2))[0]
        limit = np.sqrt(6 / (self.qualities + self.sources + self.hidden))
        shared = square[: self.outputs, : self.inputs]
        self.parameters = {
            "shared": shared.copy(), "items": shared.copy(), "residual": np.zeros((self.sources, self.outputs, self.inputs)),
            "gate_in": rng.uniform(-limit, limit, (self.hidden, self.qualities + self.sources)), "gate_bias": np.zeros(self.hidden), "gate_out": np.zeros(self.hidden), "gate_last": np.zeros(1),
        }

    def encode_items(self, x: np.ndarray) -> np.ndarray:
        return _unit(x @ self.parameters["items"].T)[0]

    def encode(self, towers: np.ndarray, quality: np.ndarray, available: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and gates; every row needs a source."""
        if towers.ndim != 3 or towers.shape[1:] != (self.sources, self.inputs) or quality.shape != (len(towers), self.sources, self.qualities) or available.shape != towers.shape[:2]:
            raise ValueError("towers, quality and availability must agree with the model")
        if not available.any(1).all():
            raise ValueError("every row needs an available source")
        out = self._forward(towers, quality, available)
        return out["y"], out["g"]

    def _forward(self, x: np.ndarray, quality: np.ndarray, available: np.ndarray, kept: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        """kept: what dropout leaves of the gates' hidden units, with its scale."""
        p = self.parameters
        t, tn = _unit(np.einsum("bsi,soi->bso", x, p["shared"] + p["residual"]))
        f = np.concatenate([quality, np.broadcast_to(np.eye(self.sources), (len(x), self.sources, self.sources))], 2)
        a = f @ p["gate_in"].T + p["gate_bias"]
        cdf = 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (a + 0.044715 * a**3)))
        logit = np.where(available, np.log(np.maximum(quality[..., 0], 1e-6)) + (a * cdf * kept) @ p["gate_out"] + p["gate_last"], -np.inf)
        g = np.exp(logit - logit.max(1, keepdims=True))
        g /= g.sum(1, keepdims=True)
        y, yn = _unit((g[..., None] * t).sum(1))
        return {"t": t, "tn": tn, "f": f, "a": a, "cdf": cdf, "g": g, "y": y, "yn": yn}

    def step(self, x: np.ndarray, quality: np.ndarray, available: np.ndarray, positive: np.ndarray, negative: np.ndarray, weights: np.ndarray, temperature: float, dropout: float = 0.0, draws: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and slopes of one batch; positive and negative are raw item vectors."""
        kept = (draws.random((*quality.shape[:2], self.hidden)) >= dropout) / (1 - dropout) if dropout else 1.0
        p, s = self.parameters, self._forward(x, quality, available, kept)
        raw = np.concatenate([positive[:, None], negative], 1)
        items, n = _unit(raw @ p["items"].T)
        loss, dz = contrastive_loss(s["y"], items[:, 0], items[:, 1:], weights, temperature)
        d_items = _unit_slope(items, n, dz[..., None] * s["y"][:, None])
        dy = _unit_slope(s["y"], s["yn"], (dz[..., None] * items).sum(1))
        dg, dt = (s["t"] * dy[:, None]).sum(-1), s["g"][..., None] * dy[:, None]
        dt = _unit_slope(s["t"], s["tn"], dt)
        residual = np.einsum("bso,bsi->soi", dt, x)
        dl = s["g"] * (dg - (s["g"] * dg).sum(1, keepdims=True))
        act, a = s["a"] * s["cdf"] * kept, s["a"]
        inner = np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * a**2)
        da = dl[..., None] * p["gate_out"] * kept * (s["cdf"] + a * 2 * s["cdf"] * (1 - s["cdf"]) * inner)
        return loss, {
            "shared": residual.sum(0), "residual": residual, "items": np.einsum("bko,bki->oi", d_items, raw), "gate_out": (dl[..., None] * act).sum((0, 1)),
            "gate_last": np.array([dl.sum()]), "gate_in": np.einsum("bsh,bsf->hf", da, s["f"]), "gate_bias": da.sum((0, 1)),
        }


def train(model: GatedFusion, batches, score, epochs: int = 5, rate: float = 3e-4, decay: float = 1e-4, clip: float = 1.0, patience: int = 2, temperature: float = 0.07, dropout: float = 0.0, seed: int = 0) -> list[dict]:
    """AdamW with clipped slopes; keeps the parameters of the best validation score and stops when it stays away.
    ``batches(epoch)`` gives the arguments of ``step``; ``score(model)`` is the validation NDCG."""
    first = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    draws = np.random.Generator(np.random.PCG64([seed, 1]))
    second, best, kept, bad, t = {k: np.zeros_like(v) for k, v in model.parameters.items()}, -np.inf, None, 0, 0
    history = [{"epoch": 0, "train_loss": None, "ndcg": score(model), "is_best": False}]
    best, kept = history[0]["ndcg"], {k: v.copy() for k, v in model.parameters.items()}
    for epoch in range(1, epochs + 1):
        losses = []
        for batch in batches(epoch):
            loss, slopes = model.step(*batch, temperature, dropout, draws)
            size = np.sqrt(sum((g**2).sum() for g in slopes.values()))
            t += 1
            for k, g in slopes.items():
                g = g * min(1.0, clip / max(size, 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.parameters[k] -= rate * (first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8) + decay * model.parameters[k])
            losses.append(loss)
        now = score(model)
        history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), "ndcg": now, "is_best": False})
        if now > best + 1e-6:
            best, kept, bad = now, {k: v.copy() for k, v in model.parameters.items()}, 0
        else:
            bad += 1
            if bad > patience:
                break
    model.parameters = kept
    max(history, key=lambda h: (round(h["ndcg"], 6), -h["epoch"]))["is_best"] = True
    return history


def encode_queries(frame: DataFrame, model: GatedFusion, query: str = "query_id") -> DataFrame:
    """query, v, gates from rows of (query, towers array<array>, quality array<array>, available array<boolean>)."""
    kind = frame.schema[query].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cube = lambda c: np.stack([np.stack(x) for x in b[c]]).astype(float)  # noqa: B023, E731
                y, g = model.encode(cube("towers"), cube("quality"), np.stack(b["available"].to_numpy()).astype(bool))
                yield pd.DataFrame({query: b[query], "v": list(y), "gates": list(g)})

    return frame.select(query, "towers", "quality", "available").mapInPandas(run, f"{query} {kind}, v array<double>, gates array<double>")


def encode_items(frame: DataFrame, model: GatedFusion, item: str = "item_id") -> DataFrame:
    kind = frame.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({item: b[item], "v": list(model.encode_items(np.stack(b["v"].to_numpy()).astype(float)))})

    return frame.select(item, "v").mapInPandas(run, f"{item} {kind}, v array<double>")
