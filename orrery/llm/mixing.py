"""Mixing sources to target weights.

Each source's words stand in one line (documents by a hash chunk, then id and size) that is cut into blocks of ``BLOCK``
words; only a source's last block is shorter. Targets share the words of all sources by weight; a target stops at
``REPEATS`` times its source and the rest is shared again by weight. A source gives whole passes over its blocks while its
target lasts, then part of a pass. Output shards of ``SLOTS`` slots draw multinomial source counts at the targets' shares;
a source's slots, counted through the shards, stop at its quota, and one more shard takes what the draws left over. Slot
j of a source takes block perm(j) of pass j // blocks, perm being a pseudorandom permutation (a Feistel network, walked
until it lands inside), so a pass repeats nothing. Blocks and slots meet in a join by source and index.

Null and empty texts have no words: they have a line and no place in it. Sources go by code point, null last; rows with one
id, equal ones and those without an id too, are documents of their own, told apart by their start. Draws depend on content
and seed only, so reruns agree. The list of sources (one row each) is held by the driver; nothing else is. Other columns
are dropped by ``mix_sources``, whatever their names, and kept by ``render``. An empty table gives an empty mix. A text is
read whole; a long one is cut into blocks like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from orrery.llm import tokens
from orrery.llm.parts import cut_lineage, row_name

BLOCK, SLOTS, REPEATS, WEIGHTS, SEED, CHUNK_DOCS, TASK_SLOTS = 128, 8192, 3, (5.0, 2.0, 1.0), 20240607, 4096, 1 << 18


def sizes(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, size (the number of words of every row), and the row's name by content."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [w.counts for _, _, w in tokens.chunks(batch[text], hashed=False)]
            size = pa.array(np.concatenate([*n, np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch[key], batch[source], size, batch["_a"], batch["_b"]], names=["key", "source", "size", "_a", "_b"])

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    return documents.select(key, source, text, *row_name(key, source, text)).mapInArrow(count, f"key {kinds[key]}, source {kinds[source]}, size long, _a long, _b long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> list[dict]:
    """Sources in order with their size, weight and target."""
    rows = [{"source": s, "source_size": n} for s, n in sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))]
    for i, r in enumerate(rows):
        r |= {"source_no": i, "weight": weights[i % len(weights)], "target": 0.0}
    rest, free = float(sum(r["source_size"] for r in rows)), [r for r in rows if r["source_size"]]
    while free:
        share = rest / sum(r["weight"] for r in free)
        over = [r for r in free if share * r["weight"] > repeats * r["source_size"]]
        for r in over or free:
            r["target"] = float(repeats * r["source_size"]) if over else share * r["weight"]
            rest -= r["target"]
        free = [r for r in free if r not in over] if over else []
    return rows


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at the given places."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key + k * 0x9E3779B97F4A7C15) % 2**64) for k in range(1, 7)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (tokens.mix(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _draws(spark: SparkSession, plan: list[dict], seed: int, slots: int, block: int) -> DataFrame:
    """shard, slot, source_no, pass, block for every slot of the mix."""
    for r in plan:
        r["blocks"] = -(-r["source_size"] // block)
        passes, rest = divmod(r["target"], r["source_size"]) if r["source_size"] else (0, 0.0)
        r["quota"] = int(passes) * r["blocks"] + min(r["blocks"], round(rest / block))
    total = sum(r["quota"] for r in plan)
    shares = np.array([r["quota"] for r in plan], float) / max(1, total)
    shards = total // slots

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                n = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(slots, shares)
                yield pd.DataFrame({"shard": int(shard), "source_no": np.arange(len(n)), "n": n})

    counts = spark.range(shards).mapInPandas(counted, "shard long, source_no long, n long")
    counts = counts.unionByName(spark.createDataFrame([(shards, r["source_no"], r["quota"]) for r in plan] or [(0, 0, 0)], "shard long, source_no long, n long"))
    line = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(line), F.lit(0)))
    quota, blocks = [r["quota"] for r in plan], [r["blocks"] for r in plan]

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, s, n, start in frame.itertuples(index=False):
                upto = min(start + n, quota[s])
                for a in range(start, upto, 1 << 16):
                    j = np.arange(a, min(a + (1 << 16), upto))
                    of_pass, at = j // blocks[s], j % blocks[s]
                    out = np.empty(len(j), np.int64)
                    for p in np.unique(of_pass):
                        mine = of_pass == p
                        name = int(tokens.mix(np.array([seed + 1_000_003 * s + 7919 * int(p)], np.uint64))[0])
                        out[mine] = permuted(at[mine], blocks[s], name)
                    yield pd.DataFrame({"shard": shard, "slot": j - start, "source_no": s, "pass": of_pass, "block": out})

    # a few rows that become many slots: so many tasks that each makes about TASK_SLOTS, whatever the rows weigh
    tasks = max(1, math.ceil(total / TASK_SLOTS))
    return counts.select("shard", "source_no", "n", "start").repartition(tasks, "source_no", "shard").mapInPandas(placed, "shard long, slot long, source_no long, pass long, block long")


def mix_sources(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The operator: (lines, mix). ``lines`` has a row a document: key, size, source_no, source_size, target, start (its
    place in its source's line). ``mix`` has the pieces of every slot: shard, slot, pass, source_no, block, key, start,
    size, word_start, words (a run of words of one document). Both have the row's name by content, _a and _b."""
    spark = documents.sparkSession
    sized = cut_lineage(sizes(documents, key, text, source))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    plan = targets([(r["source"], r["size"]) for r in totals], weights, repeats)
    draws = _draws(spark, plan, seed, slots, block)
    chunks = max(16, math.ceil(sum(r["docs"] for r in totals) / CHUNK_DOCS))
    facts = spark.createDataFrame([(r["source"], r["source_no"], r["source_size"], r["target"]) for r in plan], "source string, source_no long, source_size long, target double")
    known = sized.join(facts.withColumnRenamed("source", "_source"), F.col("source").cast("string").eqNullSafe(F.col("_source"))).drop("_source")
    known = known.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = known.groupBy("source_no", "chunk").agg(F.sum("size").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = W.partitionBy("source_no", "chunk").orderBy("key", "size", "_a", "_b").rowsBetween(W.unboundedPreceding, -1)
    lines = known.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["source_no", "chunk"])
    lines = cut_lineage(lines.select("key", "size", "source_no", "source_size", "target", (F.col("base") + F.col("within")).alias("start"), "_a", "_b"))
    whole = lines.where("size > 0").select("source_no", "key", "start", "size", "_a", "_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    cut = whole.withColumns({"word_start": first - F.col("start"), "words": last - first})
    return lines, draws.hint("merge").join(cut, ["source_no", "block"])


def render(documents: DataFrame, mix: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents' rows with the text that each pass of the mix takes of them: runs of words, cut from the text as they
    stand. Ids need not tell rows apart: rows equal in id, source and text are dealt the places that the mix takes of them."""
    runs = mix.groupBy("_a", "_b", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("word_start", "words"))).alias("runs"))
    runs = runs.groupBy("_a", "_b").agg(F.collect_list(F.struct("start", "runs")).alias("_taken"))
    rows = documents.select("*", *row_name(key, source, text)).join(runs, ["_a", "_b"])
    nth = F.row_number().over(W.partitionBy("_a", "_b").orderBy(F.xxhash64(*documents.columns)))
    rows = rows.withColumn("_start", F.get(F.array_sort(F.array_distinct("_taken.start")), nth - 1))
    rows = rows.select(*documents.columns, F.explode(F.filter("_taken", lambda t: t["start"] == F.col("_start"))["runs"]).alias("_runs"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for lo, hi, w in tokens.chunks(batch[text], hashed=False):
                raw = w.data.tobytes()
                for d in range(lo, hi):
                    base, upto = int(w.first[d - lo]), int(w.first[d - lo + 1])
                    parts: list[list[int]] = []
                    for run in batch["_runs"][d].as_py():
                        if parts and parts[-1][1] == run["word_start"]:
                            parts[-1][1] += run["words"]
                        else:
                            parts.append([run["word_start"], run["word_start"] + run["words"]])
                    if parts == [[0, upto - base]]:
                        out.append(raw[w.bounds[d - lo] : w.bounds[d - lo + 1]].decode())
                    else:
                        out.append("\n".join(raw[w.starts[base + a] : w.ends[base + b - 1]].decode() for a, b in parts))
            names = [c for c in batch.schema.names if c != "_runs"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch[c] for c in names], names=names)

    return rows.mapInArrow(taken, documents.schema)
