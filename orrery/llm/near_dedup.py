"""Near-duplicate detection: ProbMinHash signatures of weighted shingles, banding, exact verification, components.

A shingle is five consecutive words; its weight is 1 + ln(occurrences). ProbMinHash gives each shingle exponential
arrivals at rate weight, each at a random register; a register keeps the shingle that arrives first, and a document stops
once no next arrival can beat its slowest register. Registers of two documents agree with the probability Jaccard of
their weighted shingles. ``BANDS`` bands of ``ROWS`` registers name buckets. A document that repeats a shingle has bands of
a second signature too, with a weight of 1 for each distinct shingle. (Without repeats both are the same.) These agree with
the plain Jaccard of two documents, which is what is verified, however often one of them repeats a passage; so a pair with
a plain Jaccard of 0.8 shares no bucket with probability 3e-5.

Documents with the same words are one node. In each bucket all nodes are compared with the least one (no pairs inside the
bucket); links of ``THRESHOLD`` or more plain Jaccard of distinct shingles, counted exactly, are joined to components.
Nodes that are then still in different components of one bucket are paired by their rarest shingles (an exact prefix
filter) and compared too, so no link in a bucket is lost, a group of thousands of near copies costs one comparison a
member, and documents that only share a passage are not paired.

A document of one to four words has one shingle, all of it; without words (null, empty) it has none and stands alone. An
id names one document: rows that share an id share a class. A null id takes the class of a row with the same words,
else null, and is kept. Ties go to the least id. Other columns don't matter, whatever their names; an empty table gives an
empty one. Texts are read whole, about a MB at a time; a longer one is handled alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import tokens
from orrery.llm.parts import cut_lineage

SHINGLE, THRESHOLD, ROWS, BANDS, RARITY_SLOTS = 5, 0.8, 5, 26, 1 << 18
#: Words of 64 marks that a set carries into the join of rare shingles: a shingle flips one mark.
MARKS = 8
U8 = np.uint64


def shingles(words: tokens.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and number of occurrences of each distinct shingle, by document and hash."""
    counts = words.counts
    owner = np.repeat(np.arange(len(counts)), counts)
    grams = tokens.windows(words.hashes, size)
    inside = owner[: len(grams)] == owner[size - 1 :] if len(grams) else np.empty(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    doc = np.concatenate([owner[: len(grams)][inside], short])
    hashes = np.concatenate([grams[inside], tokens.whole(words, 3)[short]])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def prob_min_hash(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures, docs x registers: the shingle that came first to each register (0 for documents without any)."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, U8)
    has = np.zeros(docs, bool)
    has[doc] = True
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        draw = tokens.mix(hashes + U8(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> U8(32)).astype(np.float64) + 0.5) / 2.0**32) / weight
        place = doc * registers + ((draw & U8(0xFFFFFFFF)) * U8(registers) >> U8(32)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        winner[place[won]] = hashes[won]
        slowest = first.reshape(docs, registers).max(axis=1)
        live = time < slowest[doc]
        doc, hashes, weight, time = doc[live], hashes[live], weight[live], time[live]
    return winner.reshape(docs, registers)


def _bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Names of the bands of each signature."""
    docs, bands = len(signature), signature.shape[1] // rows
    signature = signature.reshape(docs, bands, rows)
    name = np.broadcast_to(np.arange(bands, dtype=U8) * U8(0x2545F4914F6CDD1D), (docs, bands)).copy()
    for r in range(rows):
        name = tokens.mix(name * U8(31) + signature[:, :, r])
    return name


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketches(documents: DataFrame, key: str, text: str, rows: int = ROWS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """key, k1, k2 (the words' digest), n (distinct shingles), bands array<long> (empty without words)."""
    kind = documents.schema[key].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in tokens.chunks(batch[text]):
                docs = hi - lo
                doc, hashes, n = shingles(words, size)
                distinct = np.bincount(doc, minlength=docs).astype(np.int32)
                some, again = distinct > 0, np.bincount(doc, n > 1, docs) > 0
                number = np.cumsum(again) - 1
                plain = again[doc]
                # the documents, then once more, with equal weights, those that repeat a shingle
                sets = (doc, hashes, 1 + np.log(n)), (number[doc[plain]], hashes[plain], np.ones(int(plain.sum())))
                name = np.concatenate([_bands(prob_min_hash(*x, size_, rows * bands), rows) for x, size_ in zip(sets, (docs, int(again.sum())), strict=True)])
                of = np.concatenate([np.flatnonzero(some), np.flatnonzero(again)])
                name = np.concatenate([name[:docs][some], name[docs:]])[np.argsort(of, kind="stable")]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((some.astype(np.int64) + again) * bands)]).astype(np.int32)), _signed(np.ascontiguousarray(name).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch[key].slice(lo, docs), _signed(tokens.whole(words, 1)), _signed(tokens.whole(words, 2)), pa.array(distinct), lists], names=[key, "k1", "k2", "n", "bands"]
                )

    return documents.select(key, text).mapInArrow(sketch, f"`{key}` {kind}, k1 long, k2 long, n int, bands array<long>")


def shingle_sets(documents: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """node, shingles binary: the sorted hashes of the distinct shingles of each row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in tokens.chunks(batch[text]):
                doc, hashes, _ = shingles(words, size)
                at = np.searchsorted(doc, np.arange(hi - lo + 1)) * 8
                yield pa.RecordBatch.from_arrays([batch[key].slice(lo, hi - lo), pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(hashes.tobytes())])], names=["node", "shingles"])

    return documents.select(key, text).mapInArrow(sets, f"node {documents.schema[key].dataType.simpleString()}, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) whose exact Jaccard is at least the threshold. The sets travel to the pairs; Spark splits the
    rows of an ``a`` that very many pairs hold."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["_a"], batch["_b"], strict=True)):
                p, q = np.frombuffer(x.as_buffer(), U8), np.frombuffer(y.as_buffer(), U8)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep[i] = both > 0 and both >= threshold * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "_a", "_b").mapInArrow(compare, f"a {kind}, b {kind}")


def _rarity(sets: DataFrame, slots: int = RARITY_SLOTS, slices: int = 16) -> np.ndarray:
    """Documents by hashed shingle: a table of fixed size, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, np.int64)
        for batch in batches:
            for x in batch["shingles"]:
                np.add.at(table, (np.frombuffer(x.as_buffer(), U8) % U8(slots)).astype(np.int64), 1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(slices, dtype=np.int32)), "counts": pa.array([c.tobytes() for c in np.split(table, slices)])})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
        return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()])})

    rows = sets.select("shingles").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    found = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    return np.concatenate([found.get(i, np.zeros(slots // slices, np.int64)) for i in range(slices)]).clip(max=2**31 - 1).astype(np.int32)


def prefix_pairs(placed: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of different components among the nodes of ``placed`` (node, component) that can be similar. In one
    order of all shingles, rarest first, two sets with a Jaccard of t share one of their first n - ceil(t n) + 1; so only
    nodes that meet in such a prefix are paired, if their marks leave room for t, and none with a link is lost. The order is by counts in a hashed table
    of fixed size, then hash; collisions only make it less sharp."""
    rarity = _rarity(sets)
    kind = placed.schema["node"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, sizes = [], [], []
            marks = np.zeros((batch.num_rows, 64 * MARKS), np.uint8)
            for i, x in enumerate(batch["shingles"]):
                own = np.frombuffer(x.as_buffer(), U8)
                first = own[np.lexsort((own, rarity[(own % U8(len(rarity))).astype(np.int64)]))][: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]
                marks[i] = np.bincount((own >> U8(40)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS) & 1
                at.append(np.full(len(first), i))
                found.append(first)
                sizes.append(np.full(len(first), len(own), np.int32))
            at = np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)
            marks = np.packbits(marks, axis=1).view(np.int64)[at]
            out = [batch["node"].take(pa.array(at)), pa.array(np.concatenate([*sizes, np.empty(0, np.int32)])), _signed(np.concatenate([*found, np.empty(0, U8)]))]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(np.ascontiguousarray(marks[:, k])) for k in range(MARKS))], names=["node", "n", "shingle", *(f"m{k}" for k in range(MARKS))])

    held = sets.mapInArrow(prefixes, f"node {kind}, n int, shingle long, " + ", ".join(f"m{k} long" for k in range(MARKS))).join(placed, "node")
    shared = held.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    held = held.join(shared, "shingle", "left_semi")
    a, b = (held.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in held.columns if c != "shingle")) for s in "ab")
    total, differ = F.col("n_a") + F.col("n_b"), sum((F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(MARKS)), F.lit(0))
    # shingles that only one of the two has: at least as many as marks differ, at most as many as the threshold leaves room for
    room = differ <= total - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * total - 1e-9)
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("component_a") < F.col("component_b")) & near & room)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) for every node of an edge (a, b): large-star and small-star steps until nothing
    changes. Minima are aggregated and joined back, so a node of many edges is never gathered in one place."""
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """The operator. One row a document: key, n_shingles, class_id (the least key of its class) and kept (true for it)."""
    documents = documents.select(key, text)
    sketch = cut_lineage(sketches(documents, key, text, rows, bands, size))
    some = sketch.where("n > 0")
    nodes = cut_lineage(some.groupBy("k1", "k2").agg(F.min(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("node"), "n", "bands"))).alias("first")).where("first is not null").select("k1", "k2", "first.*"))
    member = nodes.select("node", "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    hubs = member.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = cut_lineage(member.join(hubs, "bucket").select("bucket", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    near = F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")  # else the Jaccard is less in any case
    stars = cut_lineage(shared.where(F.col("node") != F.col("hub")).where(near).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    wanted = documents.join(shared.select(F.col("node").alias(key)).distinct(), key, "left_semi").dropDuplicates([key])
    sets = cut_lineage(shingle_sets(wanted, key, text, size))
    links = cut_lineage(verified(stars, sets, threshold))
    merged = components(links)
    placed = shared.select("bucket", "node").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rest = cut_lineage(placed.join(mixed, "bucket").select("node", "component").distinct())
    pairs = cut_lineage(prefix_pairs(rest, sets.join(rest.select("node"), "node", "left_semi"), threshold).join(stars, ["a", "b"], "left_anti"))
    more = cut_lineage(verified(pairs, sets, threshold))
    if not more.isEmpty():
        merged = components(links.unionByName(more))
    classes = nodes.select("k1", "k2", "node").join(merged, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class_id"))
    out = some.join(classes, ["k1", "k2"], "left").select(F.col(key), F.col("n").alias("n_shingles"), "class_id")
    out = out.unionByName(sketch.where("n = 0").select(F.col(key), F.col("n").alias("n_shingles"), F.col(key).alias("class_id")))
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col(key), F.lit(True)))
