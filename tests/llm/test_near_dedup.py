import itertools
import random
import re

import numpy as np

from orrery.llm.near_dedup import components, near_dedup, prob_min_hash

SCHEMA = "doc_id long, text string, bucket string, component int"


def brute(rows, threshold=0.8):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sorted(sets), 2):
        a, b = sets[x], sets[y]
        if a and b and len(a & b) >= threshold * len(a | b):
            p, q = sorted((root(x), root(y)))
            parent[q] = p
    return {i: root(i) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    rows, passage = [], [word() for _ in range(60)]
    for base in range(25):
        text = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, rng.choice([" ", "\n"]).join(copy), "x", 1))
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(12 + i % 9)]), "x", 1) for i in range(40)]
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "one two", None, None), (2003, "one\ttwo", None, None), (2004, " ".join(["again"] * 300), None, None)]
    return rows + rows[:3]


def test_classes_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
        assert all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in got)


def test_copies_that_repeat_a_passage(spark):
    rng, rows = random.Random(8), []
    for i in range(40):
        text = [f"d{i}w{j}" for j in range(204)]
        footer = [f"d{i}f{j}" for j in range(rng.choice([30, 38]))]
        rows += [(10 * i, " ".join(text), "x", 1), (10 * i + 1, " ".join(text + footer * 60), "x", 1)]
    want = brute(rows)
    assert sum(i != c for i, c in want.items()) == 40
    got = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = near_dedup(spark.createDataFrame([(None, text, "", 1), (5, text, "", 1), (None, "a b c", "", 1)], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in got) == [("5", "5", True), ("None", "5", True), ("None", "None", True)]
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    names = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = np.arange(0, 200), np.arange(100, 300)
    w = rng.uniform(1, 4, 300)
    v = np.where(np.arange(300) % 2, w, 2 * w)
    doc = np.concatenate([np.zeros(200, int), np.ones(200, int)])
    s = prob_min_hash(doc, np.concatenate([names[x], names[y]]), np.concatenate([w[x], v[y]]), 2, 20_000)
    p, q = np.zeros(300), np.zeros(300)
    p[x], q[y] = w[x], v[y]
    want = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in np.flatnonzero((p > 0) & (q > 0)))
    assert abs((s[0] == s[1]).mean() - want) < 0.015


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}
