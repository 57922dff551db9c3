"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning, in shards.

A shard is a few MB of documents: its terms, their postings and term counts, in one binary value. Query terms count once
(idf x saturated term count), with document frequencies and lengths of the whole corpus. A query set is taken in blocks
of bounded size, sent to all shards; a shard meets a group of queries at a time.

The pivot test of WAND holds for all documents of a shard at once. Lists whose terms many queries and documents share (of
little weight, and nearly all postings) are the ones to skip. The others are traversed first and give partial scores; of
the skipped ones each has its largest impact in every block of ``BLOCK_DOCS`` documents, and a query's sum of these bounds
what they can add. Documents of a shard and queries of a block are ordered by the common words they share, so neighbors are
alike and bounds tight. Only documents whose partial score and bound together reach the query's threshold are pivots: their
skipped lists are read. Others are never completed. All this is in single precision with a bound of its error; the pairs that
may reach the threshold are then scored exactly, so neither pruning nor rounding can change the result. Shards are met in
rounds, each a few times as large as the one before: what a round finds is a threshold for all tasks of the next. The tasks'
best are then merged.

Scores are rounded to ``DIGITS`` digits; equal ones go by the smaller key. Documents without a common term are not
answers; null and empty texts have no terms. A null key is indexed and ranks after others, and asks nothing. Rows with one
key, equal ones too, are rows of their own. Keys are integers; other columns are ignored, whatever their names; an empty
table or query set has no answers. Texts are read whole: a document longer than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from orrery.llm import tokens
from orrery.llm.parts import cut_lineage, NO_ID, gather, ids_of, pack, unpack

K1, B, TOP, DIGITS = 1.2, 0.75, 10, 9
SHARD_BYTES, BLOCK_DOCS, QUERY_WORDS, ROW_QUERIES, DENSE_TERMS = 12 << 20, 64, 4 << 20, 512, 1024
#: Where no more than this share of the queries ask for a block, it is read for them only.
FEW = 0.8
#: Terms and kinds by which documents are put beside similar ones. From how many shards the search goes in rounds.
COMMON, KINDS, FIRST = 256, 16, 8
U8, LAST = np.uint64, np.iinfo(np.int64).max


def alike(rows: int, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows that share many of the commonest terms (spherical k-means). Term i is in the
    rows ``row[first[i]:first[i + 1]]``. It decides the order of rows only: neighbors make the bounds of blocks tight."""
    n = np.diff(first)
    some = np.sort(np.argsort(-n, kind="stable")[:COMMON])
    has = np.zeros((rows, len(some)), np.float32)
    has[row[_spans(first, some)], np.repeat(np.arange(len(some)), n[some])] = 1
    much = has.sum(axis=1)
    if not len(some) or not much.any():
        return np.zeros(rows, np.int64)
    has *= np.log(1 + rows / n[some]).astype(np.float32)
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1e-9)
    many = has[much >= max(1, np.median(much))]
    centers = many[:1]
    near = many @ centers[0]
    for _ in range(KINDS - 1):  # each next one is the row least like those before
        centers = np.vstack([centers, many[near.argmin()]])
        near = np.maximum(near, many @ centers[-1])
    for _ in range(4):
        own = np.zeros((rows, KINDS), np.float32)
        own[np.arange(rows), (has @ centers.T).argmax(axis=1)] = 1
        centers = own.T @ has
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return (has @ centers.T).argmax(axis=1)


def build_index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row a shard: docs, words, keys, lengths, terms, first, posting documents and counts."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = ids_of(pa.Table.from_batches([batch]), key)
            for lo, hi, w in tokens.chunks(batch[text], SHARD_BYTES):
                owner = np.repeat(np.arange(hi - lo), w.counts)
                order = np.lexsort((owner, w.hashes))
                h, o = w.hashes[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(h)))
                terms, first = np.unique(h[at], return_index=True)
                first = np.append(first, len(at)).astype(np.int64)
                turn = np.lexsort((w.counts, alike(hi - lo, first, o[at])))
                place = np.empty(hi - lo, np.uint32)
                place[turn] = np.arange(hi - lo, dtype=np.uint32)
                blob = pack(keys[lo:hi][turn], w.counts[turn].astype(np.int64), terms, first, place[o[at]], count.astype(np.uint32))
                yield pa.RecordBatch.from_pydict({"docs": pa.array([hi - lo]), "words": pa.array([int(w.counts.sum())]), "shard": pa.array([blob])})

    return documents.select(key, text).mapInArrow(shards, "docs long, words long, shard binary")


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (words) and the sorted distinct term hashes of each query with a key."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in tokens.chunks(batch[text]):
                own = [np.unique(w.hashes[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch[key].slice(lo, hi - lo).cast(pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([pack(x) for x in own], pa.binary())], names=["query", "n", "terms"])

    return queries.where(F.col(key).isNotNull()).select(key, text).mapInArrow(terms, "query long, n long, terms binary")


def _frequencies(index: DataFrame, wanted: np.ndarray, slices: int = 16) -> np.ndarray:
    """Documents that hold each wanted term."""
    limits = np.linspace(0, len(wanted), slices + 1).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.uint32)
        for batch in batches:
            for x in batch["shard"]:
                _, _, terms, first, _, _ = _open(x)
                at, mine = _meet(terms, wanted)
                total[mine] += np.diff(first)[at].astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(slices, dtype=np.int32)), "n": pa.array([sparse(total[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)], pa.binary())})

    def sparse(n: np.ndarray) -> bytes:
        return pack(np.packbits(n > 0), n[n > 0])

    def dense(blob: bytes, size: int) -> np.ndarray:
        held, n = unpack(blob, np.uint8, np.uint32)
        out = np.zeros(size, np.int64)
        out[np.unpackbits(held, count=size).view(bool)] = n
        return out

    def add(table: pa.Table) -> pa.Table:
        k = table["slice"][0].as_py()
        return pa.table({"slice": table["slice"][:1], "n": pa.array([sum(dense(c.as_py(), limits[k + 1] - limits[k]) for c in table["n"]).tobytes()], pa.binary())})

    rows = index.mapInArrow(count, "slice int, n binary").groupBy("slice").applyInArrow(add, "slice int, n binary").collect()
    found = {r["slice"]: np.frombuffer(r["n"], np.int64) for r in rows}
    return np.concatenate([found.get(i, np.zeros(limits[i + 1] - limits[i], np.int64)) for i in range(slices)])


def _open(blob: pa.Scalar) -> list[np.ndarray]:
    return unpack(blob.as_buffer(), np.int64, np.int64, U8, np.int64, np.uint32, np.uint32)


def _meet(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of what they share."""
    if not len(terms) or not len(wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(terms) < len(wanted):
        return _meet(wanted, terms)[::-1]
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    mine = np.flatnonzero(terms[at] == wanted)
    return at[mine], mine


def _spans(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """All places first[i]:first[i + 1] for i in which, one after the other."""
    n = first[which + 1] - first[which]
    if not n.sum():
        return np.empty(0, np.int64)
    shift = np.repeat(first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return np.arange(n.sum()) + shift


class Postings:
    """Postings by term: for term i the rows ``row[first[i]:first[i + 1]]`` with their ``value`` (None: 1)."""

    def __init__(self, first: np.ndarray, row: np.ndarray, value: np.ndarray | None = None) -> None:
        self.first, self.row, self.value, self.n = first, row, value, np.diff(first)
        self.single = None if value is None else value.astype(np.float32)
        self._by_row: tuple[np.ndarray, np.ndarray, np.ndarray | None] | None = None

    def by_row(self, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The same by row: where each begins, terms (ascending) and values. Kept for the next call."""
        if self._by_row is None:
            order = np.argsort(self.row.astype(np.uint16) if rows <= 1 << 16 else self.row, kind="stable")
            term = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[order]
            self._by_row = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=rows))]), term, None if self.value is None else self.value[order]
        return self._by_row


def _add_products(out: np.ndarray, outer: Postings, inner: Postings, mine: np.ndarray, its: np.ndarray, steps: tuple[int, int]) -> None:
    """Adds the products of terms mine[i] of outer and its[i] of inner to their cells. The k-th outer postings of all terms
    that have so many meet all inner ones at once; terms go by falling numbers of them, so these are a prefix."""
    if not len(mine):
        return
    kind = np.int32 if len(out) < 1 << 31 else np.int64
    n = outer.n[mine]
    by = np.argsort(-n.astype(np.int16 if n.max() < 1 << 15 else np.int64), kind="stable")
    n, begin, its = n[by], outer.first[mine[by]], its[by]
    met, at = inner.n[its], _spans(inner.first, its)
    row, upto = inner.row[at].astype(kind) * kind(steps[1]), np.concatenate([[0], np.cumsum(met)])
    value = None if inner.single is None else inner.single[at]
    for k, c in enumerate(np.searchsorted(-n, -np.arange(n[0]))):
        at, e = begin[:c] + k, upto[c]
        cell = np.repeat(outer.row[at].astype(kind) * kind(steps[0]), met[:c])
        cell += row[:e]
        if outer.single is None:
            np.add.at(out, cell, np.float32(1) if value is None else value[:e])
        else:
            add = np.repeat(outer.single[at], met[:c])
            np.add.at(out, cell, add if value is None else add * value[:e])


def halves(left: Postings, right: Postings, mine: np.ndarray, its: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In single precision: rows x columns sums of left x right over the terms that are traversed; for those that may be
    skipped dense factors, rows x terms and terms x columns, and each term's largest value in every block of columns. Terms
    mine of left are terms its of right."""
    a, b = left.n[mine], right.n[its]
    work = a * b
    heavy = work > rows * columns // 250  # about where a dense column costs less than its single products
    some = np.flatnonzero(heavy)
    if len(some) > DENSE_TERMS:
        some = np.sort(some[np.argpartition(work[some], -DENSE_TERMS)[-DENSE_TERMS:]])
        heavy[:] = False
        heavy[some] = True
    x, y, most = (np.zeros(shape, np.float32) for shape in ((rows, len(some)), (len(some), columns), (len(some), columns // BLOCK_DOCS)))
    at, r = _spans(left.first, mine[some]), _spans(right.first, its[some])
    x[left.row[at], np.repeat(np.arange(len(some)), a[some])] = 1 if left.single is None else left.single[at]
    term, column, value = np.repeat(np.arange(len(some)), b[some]), right.row[r], right.single[r]
    y[term, column] = value
    np.maximum.at(most.reshape(-1), term * most.shape[1] + column // BLOCK_DOCS, value)
    out = np.zeros((rows, columns), np.float32)
    light, less = (work > 0) & ~heavy, a <= b
    few, many = np.flatnonzero(light & less), np.flatnonzero(light & ~less)
    _add_products(out.reshape(-1), left, right, mine[few], its[few], (columns, 1))
    _add_products(out.reshape(-1), right, left, its[many], mine[many], (1, columns))
    return out, x, y, most


def _exact(left: Postings, right: Postings, mine: np.ndarray, its: np.ndarray, rows: int, columns: int, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Scores of pairs, ordered by q, in double precision: terms are added in their order, so equal texts score the same."""
    first, term, weight = left.by_row(rows)
    start, their, value = right.by_row(columns)
    n, out, weights = start[d + 1] - start[d], np.empty(len(q)), np.zeros(len(left.n) + 1)
    name = np.full(len(right.n), len(left.n), np.int32)  # the last one is no term of left
    name[its] = mine
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1, [len(q)]])
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if s == e:
            continue
        at, upto = _spans(start, d[s:e]), np.concatenate([[0], np.cumsum(n[s:e])])
        met, add = name[their[at]], value[at]
        run = np.flatnonzero(np.diff(q[s:e], prepend=-1))
        for who, lo, hi in zip(q[s:e][run], upto[run], upto[np.append(run[1:], e - s)], strict=True):
            own = slice(first[who], first[who + 1])
            weights[term[own]] = 1 if weight is None else weight[own]
            add[lo:hi] *= weights[met[lo:hi]]
            weights[term[own]] = 0
        out[s:e] = np.bincount(np.repeat(np.arange(e - s), n[s:e]), add, e - s)
    return out


def _reach(left: Postings, right: Postings, mine: np.ndarray, its: np.ndarray, rows: int, columns: int, least: np.ndarray, top: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """All pairs (by row) that reach the row's least score, with their scores, and the share of pairs whose skipped lists
    were not read. With ``top``, rows without a least score give the best ``top`` and all that may tie with them."""
    wide = -(-columns // BLOCK_DOCS) * BLOCK_DOCS
    score, x, y, most = halves(left, right, mine, its, rows, wide)
    # no sum of n products that are not negative is off by more than this in single precision
    slack = 1 + (np.bincount(left.row, minlength=rows) + 16) * 2.0**-23
    need = np.nextafter(((least - 10.0 ** (1 - DIGITS)) / slack).astype(np.float32), np.float32(-np.inf))
    skipped = 0.0
    if x.shape[1]:
        bound, read = x @ most, 0
        for i, a in enumerate(range(0, columns, BLOCK_DOCS)):
            block = score[:, a : a + BLOCK_DOCS]
            pivot = block[:, : columns - a] >= (need - bound[:, i])[:, None]
            read += np.count_nonzero(pivot)
            ask = np.flatnonzero(pivot.any(axis=1))
            if len(ask) > FEW * rows:
                block += x @ y[:, a : a + BLOCK_DOCS]
            elif len(ask):
                block[ask] += x[ask] @ y[:, a : a + BLOCK_DOCS]
        skipped = 1 - read / (rows * columns)
    if top:
        without = np.flatnonzero(~np.isfinite(need))
        if len(without) and wide > top:
            need[without] = np.partition(score[without], -top, axis=1)[:, -top] / slack[without] ** 3
        need = np.maximum(need, np.finfo(np.float32).tiny)  # documents without a common term are no answers
    q, d = np.divmod(np.flatnonzero(score >= need[:, None]), wide)
    if not top:
        q, d = q[d < columns], d[d < columns]
    return q, d, _exact(left, right, mine, its, rows, columns, q, d), skipped


def pivots_scored(left: Postings, right: Postings, rows: int, columns: int, least: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores, rows x columns, of all pairs that may reach the row's least score (-inf for the rest), and the share of pairs
    whose skipped lists were not read."""
    score = np.full((rows, columns), -np.inf)
    q, d, s, skipped = _reach(left, right, np.arange(len(left.n)), np.arange(len(left.n)), rows, columns, least)
    score[q, d] = s
    return score, skipped


def _search(index: DataFrame, held, top: int, floors=None) -> DataFrame:
    """The best of each task for each query: query, key, score. held: a broadcast of query keys, wanted terms, their
    weights, queries by group and the mean length; floors: one of scores that each query's last place is known to have."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            queries, wanted, idf, groups, mean_length = held.value
            n = len(queries)
            if best is None:
                best, keys = np.full((n, top), -np.inf), np.zeros((n, top), np.int64)
                known = np.full(n, -np.inf) if floors is None else floors.value
            for x in batch["shard"]:
                ids, lengths, terms, start, doc, count = _open(x)
                at, mine = _meet(terms, wanted)
                norm = K1 * (1 - B + B * lengths / mean_length)
                held_by = _spans(start, at)
                doc, count, holders = doc[held_by], count[held_by], np.diff(start)[at]
                shard = Postings(np.concatenate([[0], np.cumsum(holders)]), doc, np.repeat(idf[mine], holders) * (count * (K1 + 1) / (count + norm[doc])))
                order, place = np.where(ids == NO_ID, LAST, ids), np.full(len(wanted), -1, np.int32)
                place[mine] = np.arange(len(mine))
                for g, own, group in groups:
                    size = min(ROW_QUERIES, n - g)
                    least = np.maximum(best[g : g + size, -1], known[g : g + size])
                    # all that may tie with the last place stay, so that rounded scores and keys decide
                    met = np.flatnonzero(place[own] >= 0)
                    q, d, score, _ = _reach(group, shard, met, place[own[met]], size, len(ids), least, top)
                    if not len(q):
                        continue
                    who, q = np.unique(q, return_inverse=True)
                    all_q = np.concatenate([q, np.repeat(np.arange(len(who)), top)])
                    all_s = np.concatenate([np.round(score, DIGITS), best[who + g].ravel()])
                    all_k = np.concatenate([order[d], keys[who + g].ravel()])
                    by = np.lexsort((all_k, -all_s, all_q))
                    rank = np.arange(len(by)) - np.searchsorted(all_q[by], all_q[by])
                    keep = by[rank < top]
                    best[who + g], keys[who + g] = all_s[keep].reshape(-1, top), all_k[keep].reshape(-1, top)
        if best is not None:
            q, r = np.nonzero(np.isfinite(best))
            found = keys[q, r]
            yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(found, mask=found == LAST), pa.array(best[q, r])], names=["query", "key", "score"])

    return index.mapInArrow(search, "query long, key long, score double")


def _grouped(n: int, term: np.ndarray, row: np.ndarray) -> list[tuple[int, np.ndarray, Postings]]:
    """For ``ROW_QUERIES`` queries at a time their first number, terms and postings; rows are numbered inside their group.
    term (ascending) and row: those of all n queries."""
    groups = []
    for g in range(0, n, ROW_QUERIES):
        mark = np.flatnonzero((row >= g) & (row < g + ROW_QUERIES))
        own, first = np.unique(term[mark], return_index=True)
        groups.append((g, own, Postings(np.append(first, len(mark)), (row[mark] - g).astype(np.int32))))
    return groups


def _floors(found: list[DataFrame], names: np.ndarray, top: int) -> np.ndarray:
    """The ``top``-th best score that each query has already, -inf where it has fewer answers."""
    scores = reduce(DataFrame.unionByName, found).groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    known = scores.where(F.size("s") >= top).select("query", F.element_at("s", top).alias("floor")).orderBy("query").toArrow()
    out = np.full(len(names), -np.inf)
    at, mine = _meet(known["query"].to_numpy(), names) if known.num_rows else (np.empty(0, np.int64),) * 2
    out[mine] = known["floor"].to_numpy()[at]
    return out


def top_k(documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """The operator: query, rank (from 1), key, score for the ``top`` best documents of each query."""
    spark = documents.sparkSession
    index = cut_lineage(build_index(documents, key, text).withColumn("mark", F.xxhash64("docs", "words")))
    shards = index.select("docs", "words", "mark").toArrow()
    docs, words, marks = sum(shards["docs"].to_pylist()), sum(shards["words"].to_pylist()), sorted(shards["mark"].to_pylist())
    rounds = [index]
    if len(marks) >= FIRST:  # each round has some times the shards of the one before; what it finds is a floor for the next
        ends = [marks[round(len(marks) ** power)] for power in (1 / 3, 2 / 3)]
        early = cut_lineage(index.where(F.col("mark") < ends[1]))
        rounds = [early.where(F.col("mark") < ends[0]), early.where(F.col("mark") >= ends[0]), index.where(F.col("mark") >= ends[1])]
    asked = cut_lineage(query_terms(queries, key, text))
    many = asked.agg(F.sum("n")).first()[0] or 0
    blocks, found = -(-many // QUERY_WORDS) if docs else 0, []
    for b in range(blocks):
        block = asked.where((F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) & (F.col("n") > 0)).orderBy("query").toArrow()
        if not block.num_rows:
            continue
        (hashes,), row = gather((x.as_buffer() for x in block["terms"]), U8)
        order = np.lexsort((row, hashes))
        wanted, first = np.unique(hashes[order], return_index=True)
        row, first = row[order].astype(np.int32), np.append(first, len(order))
        n = _frequencies(index, wanted)
        idf = np.log(1 + (docs - n + 0.5) / (n + 0.5))
        turn = np.lexsort((block["n"].to_numpy(), alike(block.num_rows, first, row)))
        place = np.empty(len(turn), np.int32)
        place[turn] = np.arange(len(turn), dtype=np.int32)
        names, term = block["query"].to_numpy(), np.repeat(np.arange(len(wanted), dtype=np.int32), np.diff(first))
        groups = _grouped(len(names), term, place[row])
        held, mine = spark.sparkContext.broadcast((names[turn], wanted, idf, groups, max(words / docs, 1e-9))), []
        for some in rounds:
            floors = spark.sparkContext.broadcast(_floors(mine, names, top)[turn]) if mine else None
            mine.append(cut_lineage(_search(some, held, top, floors)))
            if floors:
                floors.unpersist()
        found += mine
        held.unpersist()
    if not found:
        found = [spark.createDataFrame([], "query long, key long, score double")]
    rank = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    merged = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    return merged.select("query", "rank", F.col("key").alias(key), "score")
