import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from orrery.llm import search

SCHEMA = "doc_id long, text string, query string, score int"


def brute(rows, asked, top=10):
    docs = [(i, Counter(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows]
    df = Counter(w for _, c in docs for w in c)
    mean = sum(sum(c.values()) for _, c in docs) / len(docs)
    out = []
    for q, t, *_ in asked:
        words, scored = set(re.findall(r"[^\x20\x09-\x0D]+", t or "")), []
        for i, c in docs:
            length = sum(c.values())
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in words if w in c)
            if s > 0:
                scored.append((-round(s, 9), i is None, i or 0, i))
        out += [(q, r + 1, x[3], round(-x[0], 6)) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("words,row_queries", [(1 << 20, 512), (150, 4)])
def test_against_brute_force(spark, monkeypatch, words, row_queries):
    monkeypatch.setattr(search, "QUERY_WORDS", words)
    monkeypatch.setattr(search, "ROW_QUERIES", row_queries)
    monkeypatch.setattr(search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(search, "DENSE_TERMS", 8)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.choice([0, 3, 20, 60]))), "x", 1) for i in range(150)]
    rows += [(500 + i, rows[3][1], None, None) for i in range(15)] + [(600, None, None, None), (None, "w1 w2 w299", None, None), (7, rows[7][1], "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = search.top_k(docs, docs.where("doc_id % 10 = 0")).collect()
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0])
    assert sorted([(r["query"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got], key=repr) == want


def test_pivots_hold_all_that_reach_the_threshold(monkeypatch):
    monkeypatch.setattr(search, "DENSE_TERMS", 40)
    rng = np.random.default_rng(0)
    held = np.concatenate([np.full(20, 0.9), np.full(180, 0.05)])[:, None]
    x, y = (rng.random((200, n)) * (rng.random((200, n)) < held) * np.where(held > 0.5, 0.3, 3) for n in (30, 400))
    y *= np.where(np.arange(400) // 64 % 2, 0.1, 1)  # some blocks have small impacts only

    def postings(m):
        t, r = np.nonzero(m)
        return search.Postings(np.searchsorted(t, np.arange(201)), r, m[t, r])

    want = x.T @ y
    for few in (0.0, 1.0):
        monkeypatch.setattr(search, "FEW", few)
        for rank in (1, 10, 400):
            least = np.sort(want, axis=1)[:, -rank] if rank < 400 else np.full(30, -np.inf)
            got, skipped = search.pivots_scored(postings(x), postings(y), 30, 400, least)
            reach = want >= least[:, None]
            assert np.allclose(got[reach], want[reach]) and (got[np.isfinite(got)] <= want[np.isfinite(got)] + 1e-9).all()
            assert (skipped > 0.5) if rank == 1 else (skipped == 0) == (rank == 400)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1), (2, None, "", 1)], SCHEMA)
    assert search.top_k(docs.where("false"), docs).count() == 0
    assert search.top_k(docs, docs.where("doc_id = 2")).count() == 0


def test_later_rounds_begin_with_floors(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 1000)
    monkeypatch.setattr(search, "ROW_QUERIES", 16)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary[100 * (i % 2) :], [1 / (j + 1) for j in range(200 - 100 * (i % 2))], k=rng.choice([5, 30, 80]))), "x", 1) for i in range(240)]
    plain, seen = search._search, []

    def spied(index, held, top, floors=None):
        seen.append((held.value[0], None if floors is None else floors.value))
        return plain(index, held, top, floors)

    monkeypatch.setattr(search, "_search", spied)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = search.top_k(docs, docs.where("doc_id % 10 = 0")).collect()
    want = brute(rows, [r for r in rows if r[0] % 10 == 0])
    assert sorted([(r["query"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got], key=repr) == want
    last = {q: s for q, rank, _, s in want if rank == 10}
    assert [f is None for _, f in seen] == [True, False, False]
    for names, floors in seen[1:]:
        assert np.isfinite(floors).mean() > 0.9
        assert all(f <= last[q] + 1e-6 for q, f in zip(names.tolist(), floors.tolist()) if np.isfinite(f))
    assert (seen[2][1] >= seen[1][1]).all()


def test_only_pairs_that_reach_are_scored_and_none_is_lost_to_rounding():
    rng = np.random.default_rng(1)
    m, y = rng.random((5000, 20)) < 0.7, rng.random((5000, 300)) * (rng.random((5000, 300)) < 0.5)
    left = search.Postings(np.searchsorted(np.nonzero(m)[0], np.arange(5001)), np.nonzero(m)[1])
    t, d = np.nonzero(y)
    right = search.Postings(np.searchsorted(t, np.arange(5001)), d, y[t, d])
    want, every = m.T.astype(float) @ y, np.arange(5000)
    for least in (np.sort(want, axis=1)[:, -5], np.full(20, -np.inf)):
        q, d, score, _ = search._reach(left, right, every, every, 20, 300, least, 5)
        best = np.sort(want, axis=1)[:, -5]
        found = set(zip(q.tolist(), d.tolist()))
        assert found >= set(zip(*(x.tolist() for x in np.nonzero(want >= best[:, None])))) and len(found) <= 20 * 20
        assert np.allclose(score, want[q, d], rtol=1e-12)


def test_alike_rows_are_told_apart():
    rng = np.random.default_rng(2)
    m = np.zeros((400, 90), bool)
    m[:200, :60], m[200:, 60:] = rng.random((200, 60)) < 0.3, rng.random((200, 30)) < 0.6
    t, r = np.nonzero(m)
    kinds = search.alike(90, np.searchsorted(t, np.arange(401)), r)
    assert not set(kinds[:60]) & set(kinds[60:])
    assert (search.alike(3, np.zeros(1, np.int64), np.empty(0, np.int64)) == 0).all()
