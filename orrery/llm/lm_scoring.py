"""Language-model scoring: logistic mixing of hashed-context bit predictors, beside a smoothed unigram base.

A document is its lower-cased (A-Z) words joined by one space, and an end byte. Each byte is eight binary decisions. For
every order 1..4 there are counts of how often a 0 and a 1 followed the last bytes and the bits so far in the training
documents: orders 1 (exact) and 2 (hashed) in tables of fixed size, as these contexts are few whatever the corpus, orders 3
and 4 exact, in as many slices as the corpus needs. A decision's log-odds in all orders are mixed with weights that a gate chooses (the bit's
number, and how much the two longest contexts have been seen), and the result is refined by an adaptive map from (bit's
number, log-odds) to the observed rate.

Parts of the corpus send their distinct five-byte strings, with training counts, to slices by the three bytes before the
last; so a slice has all that orders 3 and 4 need to know of its strings. Weights and map are learned online, in small
steps over every counted string of a slice, with the string's own occurrence left out of the counts; the slices' weights
are averaged. Then each slice scores its distinct strings once and answers every part that sent them. What reaches the
driver are tables of fixed size; what is counted grows with the corpus.

Last, each word with the byte that ends it is mixed with a whole-word predictor, its share of the training words. That
predictor's weight is the share of training words that don't occur just once, which is how often a next word is known.
Over both stands the document's own memory (``recalled``), weighted in each state by how often it was right in training
documents, so scores adapt to what a document repeats.

The unigram base needs the corpus count of every token: parts send their distinct words' hashes to buckets and hear the
counts that other parts add. Null and empty texts have the end token only. Rows with one id are scored each by its text;
whether a row trains goes by its id, a null id by the empty string; equal rows get equal scores. Other columns are
dropped, whatever their names; an empty table gives an empty one. Texts are read whole, about a MB at a time, and a longer
one alone, in numbers of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import parts, tokens
from orrery.llm.parts import cut_lineage

#: Orders in tables of fixed size, with the bits of their slots, and orders that are counted exactly.
ORDERS, SLOT_BITS, EXACT = (1, 2), (16, 20), (3, 4)
INPUTS = len(ORDERS) + len(EXACT) + 1
END, GATES, RATE, STEP_STRINGS, BUCKETS, MEMORY = 10, 9 * 8, 0.02, 2048, 33, 9
WORDS, STRINGS = range(2)
U8 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])


def lowered(texts: pa.Array) -> Iterator[tuple[int, int, tokens.Words]]:
    """The lower-cased words of documents lo:hi, a chunk at a time."""
    data, bounds = tokens.buffers(texts)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + tokens.CHUNK_BYTES, side="right")) - 1)
        part = bounds[lo : hi + 1]
        yield lo, hi, tokens.split(_LOWER[data[part[0] : part[-1]]], part - part[0])
        lo = hi


def strings(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """The five-byte string that ends at each byte of the documents (end bytes before the first), and its document."""
    data, bounds = tokens.joined(w, np.ones(len(w.starts), bool))
    data = np.insert(data, bounds[1:], END)
    size = np.diff(bounds) + 1
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    code = data.astype(U8)
    for k in range(1, 5):
        before = np.full(len(data), END, U8)
        before[k:] = data[:-k]
        before[place < k] = END
        code |= before << U8(8 * k)
    return code, doc


def slots(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the tables of fixed size, strings x bits x orders, and the bits."""
    symbol = (code & U8(255)).astype(np.int64)
    bits = (symbol[:, None] >> np.arange(7, -1, -1)) & 1
    node = (symbol[:, None] | 256) >> np.arange(8, 0, -1)
    out = np.empty((len(code), 8, len(ORDERS)), np.int64)
    for i, (order, width) in enumerate(zip(ORDERS, SLOT_BITS, strict=True)):
        context = (code >> U8(8)) & U8((1 << 8 * order) - 1)
        if 8 * order + 8 <= width:  # a slot for each
            out[:, :, i] = _OFFSETS[i] + (context.astype(np.int64)[:, None] << 8 | node)
            continue
        name = tokens.mix(context * U8(0x9E3779B97F4A7C15) + U8(order))
        out[:, :, i] = _OFFSETS[i] + (tokens.mix(name[:, None] + node.astype(U8) * U8(0xD6E8FEB86659FD93)) >> U8(64 - width)).astype(np.int64)
    return out, bits


def inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each order with a bias, and the gate, from counts strings x bits x orders."""
    odds = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -9, 9)
    seen = zeros + ones
    level = (seen >= 1).astype(np.int64) + (seen >= 16)
    gate = (level[:, :, -1] * 3 + level[:, :, -2]) * 8 + np.arange(8)
    return np.concatenate([odds, np.full((*odds.shape[:2], 1), 0.3)], axis=2), gate


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def refine(refined: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The mean of the mixed probability and the map's, which is interpolated between its points."""
    at = (np.clip(z, -7.999, 7.999) + 8) * (BUCKETS - 1) / 16
    low = at.astype(np.int64)
    part, bit = at - low, np.arange(8)
    return 0.5 * squash(z) + 0.5 * (refined[bit, low] * (1 - part) + refined[bit, low + 1] * part)


def exact_counts(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones, strings x bits x orders, after the contexts of the exact orders and the bits so far. code: all strings
    of a slice in rising order, each once, with its count."""
    zeros, ones = (np.empty((len(code), 8, len(EXACT)), np.float32) for _ in range(2))
    for i, order in enumerate(EXACT):
        own = code & U8((1 << 8 * (order + 1)) - 1)
        by = np.argsort(own, kind="stable")
        own, count = own[by], n[by].astype(float)
        for b in range(8):
            node, bit = own >> U8(8 - b), (own >> U8(7 - b)) & U8(1)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(first, len(own)))
            zeros[by, b, i] = np.repeat(np.add.reduceat(count * (bit == 0), first), size)
            ones[by, b, i] = np.repeat(np.add.reduceat(count * (bit == 1), first), size)
    return zeros, ones


def all_counts(code: np.ndarray, table: np.ndarray, exact: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zeros and ones of all orders, and the bits."""
    place, bits = slots(code)
    return np.concatenate([table[0][place], exact[0]], axis=2), np.concatenate([table[1][place], exact[1]], axis=2), bits


def log10_strings(code: np.ndarray, table: np.ndarray, exact: tuple[np.ndarray, np.ndarray], weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last byte after the others."""
    zeros, ones, bits = all_counts(code, table, exact)
    x, gate = inputs(zeros, ones)
    p = np.clip(refine(refined, (x * weights[gate]).sum(axis=2)), 1e-6, 1 - 1e-6)
    return np.log10(np.where(bits == 1, p, 1 - p)).sum(axis=1)


def per_word(code: np.ndarray, doc: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word with the byte that ends it (a space or the end byte), and each end byte of an empty document: log10
    of its probability, its document, and whether there is a word."""
    byte = code & U8(255)
    ends = np.flatnonzero((byte == U8(32)) | (byte == U8(END)))
    first = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    return np.add.reduceat(worth, first) if len(ends) else np.empty(0), doc[ends], ends > first


def either(p: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of p + 10**rest, which holds where 10**rest underflows."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(p), rest * np.log(10)) / np.log(10)


def recalled(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the state of the document's own memory, and whether the memory names the word.

    The memory tells which word came after the last earlier place of the word before. State 0 has no such place; others go
    by how often the word before has come up (1 to 4) and by whether the memory was right one word earlier."""
    n = len(w.hashes)
    gate, hit = np.zeros(n, np.int64), np.zeros(n, bool)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    if len(at):
        key = tokens.mix(w.hashes[at - 1] + owner[at].astype(U8) * U8(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        again = np.append(False, key[1:] == key[:-1])
        group = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
        seen = np.minimum(np.arange(len(key)) - group, 4)
        gate[place[again]] = seen[again]
        hit[place[1:][again[1:]]] = w.hashes[place[:-1][again[1:]]] == w.hashes[place[1:][again[1:]]]
        right = np.append(False, hit[:-1]) & (gate > 0)
        gate[right] += 4
    return gate, hit


class _Sums:
    """Counts of keys, merged whenever many have come together."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 4_000_000:
            self.keys, self.counts = ([x] for x in self.all())
            self.held = len(self.keys[0]) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([*self.keys, np.empty(0, U8)])
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate([*self.counts, np.empty(0, np.int64)]).astype(np.int64)[order]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def slice_of(code: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each string, by the three bytes before its last."""
    return (tokens.mix((code >> U8(8)) & U8(0xFFFFFF)) % U8(slices)).astype(np.int64)


def _summed(payloads: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A slice's strings, in rising order, with the sums of their counts."""
    sums = _Sums()
    for b in payloads:
        sums.add(*parts.unpack(b.as_py(), U8, np.uint32))
    return sums.all()


def count_slices(asked: DataFrame) -> DataFrame:
    """_bucket, payload: the strings of each slice with their training counts."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"_bucket": table["_bucket"][:1], "payload": pa.array([parts.pack(*_summed(table["payload"]))], pa.binary())})

    return asked.groupBy("_bucket").applyInArrow(parts.freed(add), "_bucket int, payload binary")


def bit_counts(counted: DataFrame, pieces: int = 16) -> np.ndarray:
    """2 x the slots of the tables of fixed size: zeros and ones, gathered in ``pieces`` runs."""
    size = int(_OFFSETS[-1])
    limits = np.linspace(0, size, pieces + 1).astype(np.int64)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size)
        for batch in batches:
            for b in batch["payload"]:
                code, n = parts.unpack(b.as_py(), U8, np.int64)
                for a in range(0, len(code), 100_000):
                    place, bits = slots(code[a : a + 100_000])
                    np.add.at(total, (place + size * bits[:, :, None]).ravel(), np.broadcast_to(n[a : a + 100_000, None, None], place.shape).ravel().astype(float))
        rows = []
        for i in range(pieces):
            part = total.reshape(2, size)[:, limits[i] : limits[i + 1]]
            at = np.flatnonzero(part.any(axis=0))
            rows.append(parts.pack(at.astype(np.uint32), part[0, at], part[1, at]))
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(rows, pa.binary())], names=["piece", "payload"])

    def add(table: pa.Table) -> pa.Table:
        i = table["piece"][0].as_py()
        total = np.zeros((2, limits[i + 1] - limits[i]))
        for b in table["payload"]:
            at, zeros, ones = parts.unpack(b.as_py(), np.uint32, float, float)
            total[0, at] += zeros
            total[1, at] += ones
        return pa.table({"piece": table["piece"][:1], "payload": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    rows = counted.mapInArrow(tables, "piece int, payload binary").groupBy("piece").applyInArrow(add, "piece int, payload binary").collect()
    out = np.zeros((2, size), np.float32)
    for r in rows:
        out[:, limits[r["piece"]] : limits[r["piece"] + 1]] = np.frombuffer(r["payload"], np.float32).reshape(2, -1)
    return out


def _left_out(code: np.ndarray, table: np.ndarray, exact: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    zeros, ones, bits = all_counts(code, table, exact)
    one = bits[:, :, None]
    return (*inputs(np.maximum(zeros - (1 - one), 0), np.maximum(ones - one, 0)), bits)


def learn_mixer(counted: DataFrame, tables) -> tuple[np.ndarray, np.ndarray]:
    """Gated weights and the refining map; tables is a broadcast of the bit counts."""

    def trained(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        code, n = parts.unpack(payload.as_py(), U8, np.int64)
        code, n = code[n > 0], n[n > 0]
        return code, n, exact_counts(code, n) if len(code) else (np.empty((0, 8, len(EXACT))),) * 2

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables.value
        for batch in batches:
            for b in batch["payload"]:
                code, n, exact = trained(b)
                order = np.argsort(tokens.mix(code + U8(99)))
                weights, squares = np.full((GATES, INPUTS), 0.3), np.full((GATES, INPUTS), 1e-4)
                for a in range(0, len(code), STEP_STRINGS):
                    mine = order[a : a + STEP_STRINGS]
                    x, gate, bits = _left_out(code[mine], table, (exact[0][mine], exact[1][mine]))
                    error = (bits - squash((x * weights[gate]).sum(axis=2))) * np.sqrt(n[mine])[:, None]
                    slope = np.stack([np.bincount(gate.ravel(), (error * x[:, :, k]).ravel(), GATES) for k in range(INPUTS)], axis=1)
                    squares += slope**2
                    weights += 10 * RATE * slope / np.sqrt(squares)
                yield pa.RecordBatch.from_pydict({"n": pa.array([int(n.sum())]), "payload": pa.array([weights.tobytes()], pa.binary())})

    # each slice's weights count by its strings; the sums of many slices are made where they lie
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros((GATES, INPUTS)), 0
        for batch in online(batches):
            for n, b in zip(batch["n"].to_pylist(), batch["payload"], strict=True):
                total, of = total + n * np.frombuffer(b.as_buffer()).reshape(GATES, INPUTS), of + n
        yield pa.RecordBatch.from_pydict({"n": pa.array([of]), "payload": pa.array([total.tobytes()], pa.binary())})

    found = sorted((r["n"], bytes(r["payload"])) for r in counted.mapInArrow(summed, "n long, payload binary").toLocalIterator() if r["n"])
    of = sum(n for n, _ in found)
    weights = sum(np.frombuffer(b).reshape(GATES, INPUTS) for _, b in found) / of if of else np.full((GATES, INPUTS), 1 / (INPUTS - 1))

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = tables.value, np.zeros((2, 8, BUCKETS))
        for batch in batches:
            for b in batch["payload"]:
                code, n, exact = trained(b)
                for a in range(0, len(code), 50_000):
                    x, gate, bits = _left_out(code[a : a + 50_000], table, (exact[0][a : a + 50_000], exact[1][a : a + 50_000]))
                    z = (x * weights[gate]).sum(axis=2)
                    at = np.arange(8) * BUCKETS + np.rint((np.clip(z, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(np.int64)
                    each = np.broadcast_to(n[a : a + 50_000, None], z.shape)
                    sums[0] += np.bincount(at.ravel(), each.ravel(), 8 * BUCKETS).reshape(8, BUCKETS)
                    sums[1] += np.bincount(at.ravel(), (each * bits).ravel(), 8 * BUCKETS).reshape(8, BUCKETS)
        yield pa.RecordBatch.from_pydict({"payload": pa.array([sums.tobytes()], pa.binary())})

    middle = squash(np.linspace(-8, 8, BUCKETS))
    sums = np.zeros((2, 8, BUCKETS))
    for r in counted.mapInArrow(rates, "payload binary").toLocalIterator():
        sums += np.frombuffer(r["payload"]).reshape(sums.shape)
    return weights, (sums[1] + 32 * middle) / (sums[0] + 32)


def worth(code: np.ndarray, n: np.ndarray, table: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of all strings of a slice."""
    exact = exact_counts(code, n) if len(code) else (np.empty((0, 8, len(EXACT))),) * 2
    steps = range(0, len(code), 20_000)
    return np.concatenate([*(log10_strings(code[a : a + 20_000], table, (exact[0][a : a + 20_000], exact[1][a : a + 20_000]), weights, refined) for a in steps), np.empty(0)])


def _value(tables, weights: np.ndarray, refined: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """A slice's answers: to each part the worth of the strings that it sent, in the order in which it sent them."""

    def value(table: pa.Table) -> pa.Table:
        code, n = _summed(table["payload"])
        found = worth(code, n, tables.value, weights, refined).astype(np.float32)
        rows = []
        for p, b in zip(table["_part"].to_pylist(), table["payload"], strict=True):
            sent, _ = parts.unpack(b.as_py(), U8, np.uint32)
            rows.append((table["_bucket"][0].as_py(), p, parts.pack(found[np.searchsorted(code, sent)])))
        return _sent(rows, STRINGS)

    return value


def _distinct(chunks: list[tuple[int, int, tokens.Words]], trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A part's strings, in rising order, with their training counts."""
    sums = _Sums()
    for lo, _, w in chunks:
        code, doc = strings(w)
        mine = trains[lo + doc]
        held, other = np.unique(code[mine], return_counts=True), np.unique(code[~mine])
        sums.add(held[0], held[1].astype(np.int64))
        sums.add(other, np.zeros(len(other), np.int64))
    return sums.all()


class Places:
    """Where each of some sorted distinct strings stands, by a table of hashes; strings that share a slot are searched for."""

    def __init__(self, code: np.ndarray) -> None:
        self.code, self.shift = code, U8(64 - max(10, (8 * len(code)).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self.slot(code)] = np.arange(len(code), dtype=np.int32)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * U8(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        if not len(code):
            return np.empty(0, np.int64)
        at = self.table[self.slot(code)]
        other = np.flatnonzero(self.code[at] != code)
        at[other] = np.searchsorted(self.code, code[other])
        return at


def _ask(text: str, buckets: int, slices: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        me, table = table["_part"][0].as_py(), parts.unpacked(table)
        trains, sums, ends, memory = table["_trains"].to_numpy(), _Sums(), 0, np.zeros((2, MEMORY), np.int64)
        chunks = list(lowered(table[text]))
        for lo, hi, w in chunks:
            mine = np.repeat(trains[lo:hi], w.counts).astype(np.int64)
            gate, hit = recalled(w)
            memory += np.stack([np.bincount(gate[mine > 0], hit[mine > 0], MEMORY), np.bincount(gate[mine > 0], minlength=MEMORY)]).astype(np.int64)
            names, which = np.unique(w.hashes, return_inverse=True)
            sums.add(names, np.bincount(which, mine, len(names)).astype(np.int64))
            ends += int(trains[lo:hi].sum())
        names, counts = sums.all()
        rows = [(b, me, parts.pack(names[x], counts[x].astype(np.uint32), np.zeros(0, np.int64))) for b, x in parts.by_bucket((names % U8(buckets)).astype(np.int64))]
        rows.append((0, me, parts.pack(np.empty(0, U8), np.empty(0, np.uint32), np.array([ends, *memory.ravel()]))))
        code, n = _distinct(chunks, trains)
        asked = [(b, me, parts.pack(code[x], n[x].astype(np.uint32))) for b, x in parts.by_bucket(slice_of(code, slices))]
        return pa.concat_tables([_sent(rows, WORDS), _sent(asked, STRINGS)])

    return ask


def _sent(rows: list[tuple[int, int, bytes]], kind: int) -> pa.Table:
    return pa.table({"_kind": pa.array([kind] * len(rows), pa.int32()), "_bucket": pa.array([r[0] for r in rows], pa.int32()), "_part": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


_SENT = "_kind int, _bucket int, _part int, payload binary"


def _answer(table: pa.Table) -> pa.Table:
    """To each part the corpus counts of its words where other parts add to its own; to part -1 the totals of the bucket:
    tokens, distinct words, end tokens, words that occur once, and how often the documents' memory was right and was asked."""
    part, blobs = table["_part"].to_numpy(), table["payload"]
    each = [parts.unpack(b.as_py(), U8, np.uint32, np.int64) for b in blobs]
    names, counts = np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]).astype(np.int64)
    who = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
    keys, which = np.unique(names, return_inverse=True)
    total = np.bincount(which, counts, len(keys)).astype(np.int64)
    rest = sum((e[2] for e in each if len(e[2])), np.zeros(1 + 2 * MEMORY, np.int64))
    ends = int(rest[0])
    more = np.flatnonzero(total[which] > counts)
    out = [(0, int(part[w]), parts.pack(names[more[x]], total[which[more[x]]])) for w, x in parts.by_bucket(who[more])]
    out.append((0, -1, parts.pack(np.empty(0, U8), np.array([total.sum() + ends, (total > 0).sum(), ends, (total == 1).sum(), *rest[1:]], np.int64))))
    return _sent(out, WORDS)


def lm_scores(documents: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator. key, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte."""
    docs, n = parts.in_parts(documents.select(key, text, (~F.coalesce(held_out, F.lit(False))).alias("_trains")), key, text)
    kind = docs.schema[key].dataType.simpleString()
    docs, many = parts.packed(docs), max(1, n // 4)
    asked = cut_lineage(docs.groupBy("_part").applyInArrow(parts.freed(_ask(text, many, many)), _SENT))
    counted = cut_lineage(count_slices(asked.where(F.col("_kind") == STRINGS)))
    tables = documents.sparkSession.sparkContext.broadcast(bit_counts(counted))  # of fixed size, whatever the corpus
    weights, refined = learn_mixer(counted, tables)
    told = asked.where(F.col("_kind") == WORDS).groupBy("_bucket").applyInArrow(parts.freed(_answer), _SENT)
    told = cut_lineage(told.unionByName(asked.where(F.col("_kind") == STRINGS).groupBy("_bucket").applyInArrow(parts.freed(_value(tables, weights, refined)), _SENT)))
    totals = np.zeros(4 + 2 * MEMORY, np.int64)
    for r in told.where("_part = -1").select("payload").toLocalIterator():
        totals += parts.unpack(r["payload"], U8, np.int64)[1]
    train, ends, words = int(totals[0]), int(totals[2]), int(totals[0] - totals[2])
    right, asked = totals[4:].reshape(2, MEMORY)
    recall = (right + 0.5) / (asked + 5) * (np.arange(MEMORY) > 0)
    known_share = min(1 - int(totals[3]) / words, 0.999) if words else 0.0
    end_rate = min(ends / words, 0.5) if words else 0.5
    scale = np.log10(train + 0.1 * (totals[1] + (ends > 0) + 1))

    def score(table: pa.Table, heard: pa.Table) -> pa.Table:
        table, of = parts.unpacked(table), heard["_kind"].to_numpy()
        words_heard, strings_heard = (heard.filter(pa.array(of == k)) for k in (WORDS, STRINGS))
        known, total = (x for x in parts.gather((b.as_py() for b in words_heard["payload"]), U8, np.int64)[0])
        order = np.argsort(known)
        known, total = known[order], total[order]
        trains, sums = table["_trains"].to_numpy(), _Sums()
        chunks = list(lowered(table[text]))
        named, _ = _distinct(chunks, trains)
        each = np.empty(len(named))
        answers = dict(zip(strings_heard["_bucket"].to_pylist(), strings_heard["payload"], strict=True))
        places = Places(named)
        for b, x in parts.by_bucket(slice_of(named, many)):
            each[x] = parts.unpack(answers[b].as_py(), np.float32)[0]
        for lo, hi, w in chunks:
            names, which = np.unique(w.hashes, return_inverse=True)
            sums.add(names, np.bincount(which, np.repeat(trains[lo:hi], w.counts).astype(np.int64), len(names)).astype(np.int64))
        own, own_counts = sums.all()
        if len(known):
            own_counts[np.searchsorted(own, known)] = total
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for lo, hi, w in chunks:
            size = hi - lo
            owner = np.repeat(np.arange(size), w.counts)
            c = own_counts[np.searchsorted(own, w.hashes)] if len(w.hashes) else np.empty(0, np.int64)
            base = np.bincount(owner, np.log10(c + 0.1) - scale, size) + np.log10(ends + 0.1) - scale
            code, doc = strings(w)
            units, unit_doc, has_word = per_word(code, doc, each[places.of(code)])
            last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
            whole = np.zeros(len(units))
            whole[has_word] = c / max(words, 1) * np.where(last, end_rate, 1 - end_rate)
            mixed_units = either(known_share * whole, np.log10(1 - known_share) + units)
            gate, hit = recalled(w)
            mixed_units[has_word] = either(recall[gate] * hit * np.where(last, end_rate, 1 - end_rate), np.log10(1 - recall[gate]) + mixed_units[has_word])
            mixed = np.bincount(unit_doc, mixed_units, size)
            for out, x in zip(columns, (w.counts + 1, np.bincount(owner, c > 0, size).astype(np.int64) + (ends > 0), base, mixed, np.bincount(doc, minlength=size)), strict=True):
                out.append(x)
        n_tokens, n_known, base, mixed, size = (np.concatenate([*c, np.empty(0)]) for c in columns)
        return pa.table(
            {
                key: table[key], "held_out": pa.array(~trains), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "train_tokens": pa.array(np.full(len(base), train, np.int64)),
                "base_score": pa.array(base.astype(float)), "score": pa.array(mixed.astype(float)), "bits_per_byte": pa.array(-mixed.astype(float) * np.log2(10) / np.maximum(size, 1)),
            }
        )

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return docs.groupBy("_part").cogroup(told.where("_part >= 0").groupBy("_part")).applyInArrow(parts.freed(score), schema)
