"""Leakage-safe text and quality features on the complete grid of entities and sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T


def assembled_text(rows: DataFrame, key: str, order: list[Column], written: Column, newest_first: bool = False) -> DataFrame:
    """key, tower_text: each row's text normalized, empty ones dropped, in order, as one normalized text. ``newest_first``
    takes the order from the largest down, nulls last; else it rises, nulls first."""
    lines = rows.select(key, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), T.normalize(written).alias("line")).alias("s"))
    sorted_ = F.sort_array(F.collect_list("s"), asc=not newest_first)
    return lines.where("s.line <> ''").groupBy(key).agg(F.array_join(F.transform(sorted_, lambda s: s["line"]), " ").alias("tower_text"))


def tower_features(grid: DataFrame, limits: dict[str, int], stale_days: int = 730, crowd: int = 40) -> DataFrame:
    """grid (key, source, tower_text, item_count, age_days, reliability_score) with nulls where a source is missing."""
    known = F.when(F.col("source").isin(*limits), F.col("source")).otherwise(F.raise_error(F.lit("unknown source")).cast("string"))
    grid = grid.withColumn("source", known)
    text = T.normalize(F.col("tower_text"))
    cut = F.coalesce(*(F.when(F.col("source") == k, T.truncate(text, v)) for k, v in limits.items()))
    there = F.coalesce(F.col("item_count") > 0, F.lit(False)) & (text != "")
    out = grid.withColumn("is_available", there).withColumn("tower_text", F.when(there, cut).otherwise(""))
    out = out.withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return out.withColumns(
        {
            "reliability_score": F.when(F.col("is_available"), F.col("reliability_score")).otherwise(F.lit(0.0)),
            "character_count": F.length("tower_text"),
            "token_count": T.token_count(T.normalize(F.col("tower_text"))),
            "log1p_item_count": F.round(F.log1p(F.col("item_count").cast("double")), 6),
            "is_stale": F.col("is_available") & F.coalesce(F.col("age_days") > stale_days, F.lit(False)),
            "is_high_volume": F.col("is_available") & (F.col("item_count") > crowd),
        }
    )


class Encoder(Protocol):
    """Turns texts into rows of one dimension."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed hashed words and word pairs: needs no model and gives the same vectors everywhere."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            words = text.lower().split()
            for gram in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = xxhash.xxh64_intdigest(gram)
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        return out


def encode_texts(frame: DataFrame, keys: list[str], text: str, available: str | None, make: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """keys, embedding: unit vectors of available rows, zeros for the others."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    frame = frame.select(*keys, text, (F.col(available) if available else F.lit(True)).alias("_there"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for b in batches:
            out = np.zeros((len(b), encoder.dimension), np.float32)
            rows = np.flatnonzero(b["_there"].fillna(False).to_numpy(bool))
            texts = b[text].fillna("").to_numpy()
            for at in range(0, len(rows), batch):
                mine = rows[at : at + batch]
                got = np.asarray(encoder.encode(list(texts[mine])), np.float32)
                if got.shape != (len(mine), encoder.dimension):
                    raise ValueError("encoder returned a wrong shape")
                n = np.linalg.norm(got, axis=1, keepdims=True)
                out[mine] = np.divide(got, n, out=np.zeros_like(got), where=n > 0)
            yield b[keys].assign(embedding=list(out))

    return frame.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", embedding array<float>")
