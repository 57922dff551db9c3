import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import lm_scoring as L, parts

SCHEMA = "doc_id long, text string, score string, held_out string"


def fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def corpus():
    rng = random.Random(6)
    syllables = ["ba", "tion", "É", "Re", "st", "o", "ing"]
    rows = [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.choice([0, 1, 30, 200]))), "x", "y") for i in range(200)]
    return rows + [(500, None, None, None), (501, "", None, None), (502, "Ends\n\n", None, None), (None, "null id", None, None), (3, rows[3][1], "x", "y")]


def test_base_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parts.in_parts, "__defaults__", (3000,))
    rows = corpus()
    got = L.lm_scores(spark.createDataFrame(rows, SCHEMA), fold()).collect()
    counts, ends = Counter(w for i, t, *_ in rows if not held(i) for w in words(t)), sum(not held(r[0]) for r in rows)
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    scale = math.log10(total + 0.1 * (distinct + 1))
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + 1, total, round(sum(math.log10(counts[w] + 0.1) - scale for w in words(t)) + math.log10(ends + 0.1) - scale, 6)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    same = Counter((r["doc_id"], round(r["score"], 9)) for r in got)
    assert same[3, round(next(r["score"] for r in got if r["doc_id"] == 3), 9)] == 2
    assert all(r["score"] < 0 for r in got)


def plain_strings(texts):
    found = Counter()
    for t in texts:
        b = b"\n" * 4 + " ".join(words(t)).encode() + b"\n"
        found.update(b[i : i + 5] for i in range(len(b) - 4))
    return found


def test_probabilities_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 30, (2, int(L._OFFSETS[-1]))).astype(np.float32)
    weights, refined = rng.normal(0.3, 0.1, (L.GATES, L.INPUTS)), rng.uniform(0.1, 0.9, (8, L.BUCKETS))
    code = np.uint64(0x6162636400) | np.arange(256, dtype=np.uint64)
    assert (10 ** L.worth(code, rng.integers(0, 9, 256), table, weights, refined)).sum() == pytest.approx(1, abs=1e-4)


def test_places_of_strings():
    code = np.unique(np.random.default_rng(0).integers(0, 2**40, 5000).astype(np.uint64))
    ask = np.random.default_rng(1).choice(code, 20_000)
    assert (code[L.Places(code).of(ask)] == ask).all() and len(L.Places(code[:0]).of(ask[:0])) == 0


def test_counts_and_worth_against_brute_force():
    """Counts of every order bit by bit, and the mixture's value, from plain dictionaries."""
    found = plain_strings(t for _, t, *_ in corpus()[:60])
    found["zzzzz".encode()] = 0  # asked for, never seen in training
    code = np.array(sorted(int.from_bytes(x, "big") for x in found), np.uint64)
    n = np.array([found[int(c).to_bytes(5, "big")] for c in code])
    seen = Counter()
    for x, count in found.items():
        for order in (1, 2, 3, 4):
            for b in range(8):
                seen[order, x[4 - order : 4], b, x[4] >> (8 - b), x[4] >> (7 - b) & 1] += count
    node = lambda order, x, b, bit: seen[order, x[4 - order : 4], b, x[4] >> (8 - b), bit]
    zeros, ones = L.exact_counts(code, n)
    table = np.zeros((2, int(L._OFFSETS[-1])), np.float32)
    place, bits = L.slots(code)
    for k in (0, 1):
        np.add.at(table[k], place[bits == k].ravel(), np.repeat(np.broadcast_to(n[:, None], bits.shape)[bits == k], 2))
    rng = np.random.default_rng(2)
    weights, refined = rng.normal(0.3, 0.1, (L.GATES, L.INPUTS)), rng.uniform(0.1, 0.9, (8, L.BUCKETS))
    got = L.worth(code, n, table, weights, refined)
    for i in rng.choice(len(code), 60, replace=False):
        x, total = int(code[i]).to_bytes(5, "big"), 0.0
        for b in range(8):
            assert all(table[k][place[i, b, 0]] == node(1, x, b, k) and table[k][place[i, b, 1]] >= node(2, x, b, k) for k in (0, 1))
            c0, c1 = ([node(order, x, b, bit) for order in (1, 2, 3, 4)] for bit in (0, 1))
            assert (zeros[i, b].tolist(), ones[i, b].tolist()) == (c0[2:], c1[2:])
            for k, c in enumerate((c0, c1)):
                c[1] = table[k][place[i, b, 1]]  # order 2 is hashed
            odds = [min(max(math.log((q + 0.4) / (p + 0.4)), -9), 9) for p, q in zip(c0, c1)] + [0.3]
            level = [(p + q >= 1) + (p + q >= 16) for p, q in zip(c0, c1)]
            z = sum(w * o for w, o in zip(weights[(level[3] * 3 + level[2]) * 8 + b], odds))
            at = (min(max(z, -7.999), 7.999) + 8) * (L.BUCKETS - 1) / 16
            p = 0.5 / (1 + math.exp(-z)) + 0.5 * (refined[b, int(at)] * (1 - at % 1) + refined[b, int(at) + 1] * (at % 1))
            p = min(max(p, 1e-6), 1 - 1e-6)
            total += math.log10(p if x[4] >> (7 - b) & 1 else 1 - p)
        assert got[i] == pytest.approx(total, abs=1e-4)


def test_scores_against_brute_force(spark, monkeypatch):
    """Whole scores from plain dictionaries; weights and map as they were learned."""
    monkeypatch.setattr(parts.in_parts, "__defaults__", (3000,))
    kept = {}
    learn = L.learn_mixer
    monkeypatch.setattr(L, "learn_mixer", lambda counted, tables: kept.setdefault("model", (*learn(counted, tables), tables.value))[:2])
    rows = [r for r in corpus() if r[0] is not None]
    got = L.lm_scores(spark.createDataFrame(rows, SCHEMA), fold()).collect()
    weights, refined, table = kept["model"]
    train = [t for i, t, *_ in rows if not held(i)]
    found, every = plain_strings(train), plain_strings(t for _, t, *_ in rows)
    assert table.sum() == 8 * 2 * sum(found.values())
    code = np.array(sorted(int.from_bytes(x, "big") for x in every), np.uint64)
    value = dict(zip((int(c).to_bytes(5, "big") for c in code), L.worth(code, np.array([found[int(c).to_bytes(5, "big")] for c in code]), table, weights, refined)))
    counts = Counter(w for t in train for w in words(t))
    total, ends = sum(counts.values()), len(train)
    known, end_rate = min(1 - sum(c == 1 for c in counts.values()) / total, 0.999), min(ends / total, 0.5)

    def memory(own):
        """State and answer of the document's memory at each word."""
        last, often, out, right = {}, Counter(), [], False
        for j, w in enumerate(own):
            state, hit = 0, False
            if j:
                before = own[j - 1]
                if often[before]:
                    state, hit = min(often[before], 4) + 4 * right, last[before] == w
                often[before] += 1
                last[before] = w
            out.append((state, hit))
            right = hit
        return out

    asked, hits = Counter(), Counter()
    for t in train:
        for state, hit in memory(words(t)):
            asked[state] += 1
            hits[state] += hit
    want = {}
    for i, t, *_ in rows:
        own, score = words(t), 0.0
        raw = b"\n" * 4 + " ".join(own).encode() + b"\n"
        units, unit = [], 0.0
        for k in range(4, len(raw)):
            unit += value[raw[k - 4 : k + 1]]
            if raw[k] in b" \n":
                units.append(unit)
                unit = 0.0
        for j, unit in enumerate(units):
            if j < len(own):
                stop = end_rate if j == len(own) - 1 else 1 - end_rate
                unit = L.either(np.array([known * counts[own[j]] / total * stop]), np.array([math.log10(1 - known) + unit]))[0]
                state, hit = memory(own)[j]
                trust = (hits[state] + 0.5) / (asked[state] + 5) * (state > 0)
                unit = L.either(np.array([trust * hit * stop]), np.array([math.log10(1 - trust) + unit]))[0]
            else:  # an empty document: the whole-word predictor says that a word comes
                unit += math.log10(1 - known)
            score += unit
        want.setdefault(i, set()).add(round(score, 2))
    wrong = [(r["doc_id"], r["score"], want[r["doc_id"]]) for r in got if not any(abs(r["score"] - x) < 0.02 for x in want[r["doc_id"]])]
    assert not wrong and len(got) == len(rows)


def test_mixing_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = L.lm_scores(docs, fold()).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.avg("bits_per_byte")).first()
    assert r[1] > r[0] and r[2] < 3, r


def test_all_bytes_of_long_words_count(spark):
    rng = random.Random(8)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (1_000, 10_000, 100_000)]
    ids = [i for i in range(2000, 2100) if held(i)][:3]
    rows = [r for r in corpus()[:60] if not held(r[0])] + [(i, t, "", "") for i, t in zip(ids, noise)]
    got = {r["doc_id"]: r for r in L.lm_scores(spark.createDataFrame(rows, SCHEMA), fold()).collect()}
    short, middle, long = (got[i] for i in ids)
    assert middle["score"] == pytest.approx(10 * short["score"], rel=0.1) and long["score"] == pytest.approx(10 * middle["score"], rel=0.1)
    assert all(r["bits_per_byte"] > 3 for r in (short, middle, long))
    assert L.either(np.array([0.0, 0.25, 0.5]), np.array([-5000.0, -5000.0, math.log10(0.25)])) == pytest.approx([-5000, math.log10(0.25), math.log10(0.75)])


def test_empty_table(spark):
    assert L.lm_scores(spark.createDataFrame([], SCHEMA), fold()).count() == 0
