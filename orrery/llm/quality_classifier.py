"""Quality and toxicity by a document classifier and empirical-Bayes priors of hosts and paths.

Two logistic models (quality, toxicity) over hashed words and a few ratios are fitted on the driver to a bounded sample of
labelled documents: the ``SAMPLE`` labelled ids that are least by hash. Every document is scored. The scores are then
evidence on their host and path: grouped sums give a Beta posterior of each host around the global mean and of each path
around its host, with prior strengths from the spread between hosts (method of moments), so sparse sites shrink to the
mean above them. A document's log-odds move by what the posterior of its path says beyond the global mean, without the
document's own score, which is in its odds already.

Null text is empty, a null host or path is a group of its own, null ids are kept as they are; rows with one id (equal rows
too) are scored each by its own text. Texts are read whole, about a MB at a time. Other columns are dropped, whatever their
names; an empty table gives an empty one. Labels with a null are not used. Without labels of both kinds a model answers with the share of
positive labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import tokens

SAMPLE, BITS, RATIOS, EPOCHS = 8000, 17, 6, 200
SURE, MIN_STRENGTH, MAX_STRENGTH = 4.0, 2.0, 1000.0
U8 = np.uint64


#: Bytes as the models' words see them: A-Z in lower case, sentence marks as space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[np.frombuffer(b".,;:!?\"'()", np.uint8)] = 32


def features(w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Limits and slots of each document's distinct hashed words, and its ratios."""
    docs = len(w.counts)
    plain = tokens.split(_PLAIN[w.data], w.bounds)
    owner = np.repeat(np.arange(docs), plain.counts)
    slot = (plain.hashes >> U8(64 - BITS)).astype(np.int64)
    pairs = np.unique(owner << BITS | slot)
    limits = np.searchsorted(pairs >> BITS, np.arange(docs + 1))
    n = np.maximum(w.counts, 1)
    upto = lambda mark: np.concatenate([[0], np.cumsum(mark)])[w.bounds]
    per = lambda mark: np.diff(upto(mark))
    d = w.data
    capital, letter = per((d >= 65) & (d <= 90)), per((d >= 65) & (d <= 90) | (d >= 97) & (d <= 122) | (d >= 128))
    symbol = per(np.isin(d, np.frombuffer(b"#*$%&|<>!@^~=+", np.uint8)))
    ratios = np.stack([np.minimum(symbol / n, 3), capital / np.maximum(letter, 1), np.minimum(letter / n / 10, 3), np.diff(limits) / n, np.log1p(w.counts) / 10, per((d >= 48) & (d <= 57)) / np.maximum(np.diff(w.bounds), 1)], axis=1)
    return limits, pairs & ((1 << BITS) - 1), ratios


def fit(limits: np.ndarray, slots: np.ndarray, ratios: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic model: hashed words, ratios, bias. Words whose log-odds lie more than ``SURE`` standard errors
    from zero begin at half of them, all others stay at zero; then adaptive full-batch steps with a ridge."""
    size, n = (1 << BITS), len(label)
    weights = np.zeros(size + RATIOS + 1)
    rate = label.mean() if n else 0.5
    if not n or rate in (0.0, 1.0):
        weights[-1] = 0.0 if not n else np.log((rate * n + 0.5) / (n - rate * n + 0.5))
        return weights
    row = np.repeat(np.arange(n), np.diff(limits))
    good, bad = np.bincount(slots, label[row], size), np.bincount(slots, 1 - label[row], size)
    odds = np.log((good + 0.5) / (label.sum() - good + 0.5)) - np.log((bad + 0.5) / (n - label.sum() - bad + 0.5))
    spread = np.sqrt(1 / (good + 0.5) + 1 / (label.sum() - good + 0.5) + 1 / (bad + 0.5) + 1 / (n - label.sum() - bad + 0.5))
    tells = np.abs(odds) > SURE * spread
    weights[:size] = np.where(tells, odds / 2, 0)
    keep = tells[slots]
    row, slots = row[keep], slots[keep]
    dense = np.column_stack([ratios, np.ones(n)])
    weights[-1] = np.log(rate / (1 - rate))
    squares = np.full(len(weights), 1e-8)
    for _ in range(epochs):
        z = np.bincount(row, weights[slots], n) + dense @ weights[size:]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / n
        slope = np.concatenate([np.bincount(slots, error[row], size), error @ dense])
        slope[:-1] += 1e-5 * weights[:-1]
        squares += slope**2
        weights -= 0.3 * slope / np.sqrt(squares)
    return weights


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def shrunk(scored: DataFrame, score: str, levels: tuple[str, ...] = ("host", "path")) -> DataFrame:
    """Adds ``<score>_global`` and ``<score>_<level>``: posterior means by grouped aggregation, each level's prior being
    the mean of the level above; and ``<score>_others``, the last level's as it is without the row's own score."""
    top = scored.agg(F.avg(score).alias("m")).first()
    mean = min(max(top["m"] if top["m"] is not None else 0.5, 1e-6), 1 - 1e-6)
    above, table, strengths = F.lit(mean), None, []
    for i, level in enumerate(levels):
        keys, held, n = list(levels[: i + 1]), f"_s{i}", f"_n{i}"
        sums = scored.groupBy(*keys).agg(F.sum(score).alias(held), F.count(F.lit(1)).alias(n))
        if table is not None:
            sums = sums.join(table, [sums[k].eqNullSafe(table[k]) for k in keys[:-1]]).drop(*(table[k] for k in keys[:-1]))
            above = F.col(f"{score}_{levels[i - 1]}")
        spread = sums.agg(F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * F.pow(F.col(held) / F.col(n) - above, 2)).alias("v"), F.count(F.lit(1)).alias("groups"), F.avg(F.col(n)).alias("per")).first()
        strength = MAX_STRENGTH
        if spread["n"] and spread["groups"] > 1:
            between = max(spread["v"] / spread["n"] - mean * (1 - mean) / spread["per"], 0.0)
            strength = min(max(mean * (1 - mean) / between - 1 if between else MAX_STRENGTH, MIN_STRENGTH), MAX_STRENGTH)
        table = sums.withColumn(f"{score}_{level}", (F.col(held) + strength * above) / (F.col(n) + strength))
        strengths.append(strength)
    keys = list(levels)
    named = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    out = scored.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))
    others = F.lit(mean)
    for i, strength in enumerate(strengths):
        others = (F.col(f"_s{i}") - F.col(score) + strength * others) / (F.col(f"_n{i}") - 1 + strength)
    out = out.withColumns({f"{score}_global": F.lit(mean), f"{score}_others": F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0))})
    return out.drop(*(f"_{x}{i}" for x in "sn" for i in range(len(levels))))


def quality_classifier(documents: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The operator. key, quality and toxicity (the documents' own), their posteriors with host and path, and kept
    (posterior quality of 0.5 or more and toxicity below 0.5)."""
    picked = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(F.col(key).alias("_id"), "quality", "toxic")
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "quality", "toxic").limit(sample)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in tokens.chunks(batch[text]):
                limits, slots, ratios = features(w)
                yield pa.RecordBatch.from_pydict(
                    {
                        "quality": batch["quality"].slice(lo, hi - lo).cast(pa.float64()), "toxic": batch["toxic"].slice(lo, hi - lo).cast(pa.float64()),
                        "slots": pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(slots.astype(np.int32))), "ratios": pa.array(list(ratios), pa.list_(pa.float64())),
                    }
                )

    # the sample has at most ``sample`` rows, so it can be sent to every scan
    seen = documents.select(key, text).join(F.broadcast(picked), F.col(key) == F.col("_id")).select(text, "quality", "toxic")
    rows = seen.mapInArrow(gather, "quality double, toxic double, slots array<int>, ratios array<double>").toArrow().combine_chunks()
    n = rows.num_rows
    slots = [np.asarray(x.values.to_numpy(), np.int64) for x in rows["slots"]]
    limits = np.concatenate([[0], np.cumsum([len(x) for x in slots])]).astype(np.int64)
    flat, ratios = np.concatenate([*slots, np.empty(0, np.int64)]).astype(np.int64), np.array(rows["ratios"].to_pylist(), float).reshape(n, RATIOS)
    models = [fit(limits, flat, ratios, rows[c].to_numpy()) for c in ("quality", "toxic")]
    packed = [m.astype(np.float32) for m in models]
    kind = documents.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS
        for batch in batches:
            for lo, hi, w in tokens.chunks(batch[text]):
                at, words, dense = features(w)
                owner = np.repeat(np.arange(hi - lo), np.diff(at))
                out = [1 / (1 + np.exp(-(np.bincount(owner, m[words], hi - lo) + dense @ m[size:-1] + m[-1]))) for m in packed]
                yield pa.RecordBatch.from_arrays([batch[key].slice(lo, hi - lo), *(batch[c].slice(lo, hi - lo) for c in ("host", "path")), *map(pa.array, out)], names=[key, "host", "path", "quality", "toxicity"])

    given = documents.select(F.col(key), F.col(text), host.cast("string").alias("host"), path.cast("string").alias("path"))
    from orrery.llm.parts import cut_lineage

    scored = cut_lineage(given.mapInArrow(score, f"`{key}` {kind}, host string, path string, quality double, toxicity double"))
    for name in ("quality", "toxicity"):
        scored = shrunk(scored, name)
        odds = _logit(F.col(name)) + _logit(F.col(f"{name}_others")) - _logit(F.col(f"{name}_global"))
        scored = scored.withColumn(f"{name}_posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", (F.col("quality_posterior") >= 0.5) & (F.col("toxicity_posterior") < 0.5))
