import math
import re
from collections import Counter

import numpy as np
import pytest

from orrery.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"


def plus(terms):
    most = max(terms)
    return most + math.log(sum(math.exp(x - most) for x in terms))


def sums(word, probability, longest):
    """Logs of the forward sums of all segmentations."""
    total = [0.0]
    for end in range(1, len(word) + 1):
        fits = [(s, probability.get(word[s:end], 0.0)) for s in range(max(0, end - longest), end)]
        total.append(plus([total[-1] + L.UNKNOWN, *(total[s] + math.log(p) for s, p in fits if p)]))
    return total


def brute(word, probability):
    return sums(word, probability, max(map(len, probability)))[-1]


def expected(word, probability):
    """Expected pieces of a word, from forward sums and those of what is left."""
    longest, back = max(map(len, probability)), {x[::-1]: p for x, p in probability.items()}
    ahead, behind = sums(word, probability, longest), sums(word[::-1], back, longest)[::-1]
    out = {}
    for end in range(1, len(word) + 1):
        for s in range(max(0, end - longest), end):
            if p := probability.get(word[s:end], 0.0):
                out[word[s:end]] = out.get(word[s:end], 0.0) + math.exp(ahead[s] + math.log(p) + behind[end] - ahead[-1])
    return out


def as_words(words):
    n = np.array([len(w) for w in words])
    ends = np.cumsum(n)
    return np.frombuffer(b"".join(words), np.uint8), ends - n, ends


@pytest.mark.parametrize("block", [4096, 64])
def test_forward_and_expected_counts_sum_all_segmentations(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    vocabulary = [b" a", b"a", b"ab", b"b", b" ", b"ba", b"bab", b"\xc3\xa9", b"abcdefghijkl", b"ba" * 20 + b"b"]
    p = np.random.default_rng(2).uniform(0.01, 0.3, (len(vocabulary), 2))
    words = [b"abab", b"b", "abbaé".encode(), b"zzz", b"abcdefghijkl", b"ab" * 40, b"z" * 100, b"a" * 48, b"b" * 49, ("é" * 80 + "zab" * 33).encode(), b"abba" * 1200]
    data, starts, ends = as_words(words)
    v = L.Vocabulary(vocabulary)
    tables = [{x: p[k, i] for k, x in enumerate(vocabulary)} for i in range(2)]
    got = L.scores(data, starts, ends, v, p)
    counts = L.counts_of(data, starts, ends, v, p[:, :1], np.ones((len(words), 1)))
    for i in range(2):
        assert np.allclose(got[:, i], [brute(b" " + w, tables[i]) for w in words])
    want = Counter()
    for w in words:
        want.update(expected(b" " + w, tables[0]))
    assert np.allclose(counts[:, 0], [want[x] for x in vocabulary])


def test_whole_predictions_against_brute_force(spark):
    """Learning and answers, words without a piece and sentences without spaces included."""
    styled, run = "".join(map(chr, range(0x1D400, 0x1D41A))), "日本語の文には空白がありませんので長い語になります" * 3
    train = [(1, "the international relationship of the others", "en"), (2, "le château de la forêt, particulièrement", "fr"), (3, run, "ja"), (4, "the " + styled, "en"), (5, "die schöne Straße " * 3, "de"), (6, "the the of", "en")]
    ask = [(11, "international things"), (12, run[9:60]), (13, styled + " forêt"), (14, "x" * 500 + " schöne"), (15, "de la"), (16, styled), (17, "of the")]
    pieces = L.pieces()
    flat = dict.fromkeys(pieces, 1 / len(pieces))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    languages = sorted({k for _, _, k in train})
    found = {k: Counter() for k in languages}
    for _, t, k in train:
        for w in words(t):
            found[k].update(expected(b" " + w.encode(), flat))
    size = {k: sum(found[k].values()) + L.SMOOTH * len(pieces) for k in languages}
    model = {k: {x: (found[k][x] + L.SMOOTH) / size[k] for x in pieces} for k in languages}
    docs = spark.createDataFrame([(i, t, k, "") for i, t, k in train] + [(i, t, None, "") for i, t in ask], SCHEMA).coalesce(1)
    got = {r["doc_id"]: r for r in L.language_id(docs, docs.where("doc_id < 10")).collect()}
    for i, t in [(i, t) for i, t, _ in train] + ask:
        logs = [sum(brute(b" " + w.encode(), model[k]) for w in words(t)) for k in languages]
        assert got[i]["lang_pred"] == languages[logs.index(max(logs))]
        assert got[i]["score"] == pytest.approx(math.exp(max(logs) - plus(logs)), abs=1e-3)  # the model is sent in single precision


def test_learns_and_answers(spark):
    say = {"en": "the thing with others that nothing", "fr": "le château où était la forêt", "de": "schöne nächte über straßen zwischen"}
    rows = [(i, " ".join([say[k]] * 3), k, "x") for i, k in enumerate([*say] * 4)]
    extra = [(100, None, "en", ""), (101, "", "en", ""), (102, "12 34 !?", "en", ""), (103, "other things", None, ""), (104, "e" * 200_000, "en", ""), (None, "nächte zwischen", None, ""), (0, rows[0][1], "en", "")]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    got = L.language_id(docs, docs.where("doc_id < 9")).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == k and 0 <= by_id[i]["score"] <= 1 for i, _, k, _ in rows)
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by_id[None]["lang_pred"] == "de"
    none = L.language_id(docs, docs.where("false")).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert L.language_id(docs.where("false"), docs.where("doc_id < 9")).count() == 0


def test_learns_and_answers(spark):
    say = {"en": "the thing with others that nothing", "fr": "le château où était la forêt", "de": "schöne nächte über straßen zwischen"}
    rows = [(i, " ".join([say[k]] * 3), k, "x") for i, k in enumerate([*say] * 4)]
    extra = [(100, None, "en", ""), (101, "", "en", ""), (102, "12 34 !?", "en", ""), (103, "other things", None, ""), (104, "e" * 200_000, "en", ""), (None, "nächte zwischen", None, ""), (0, rows[0][1], "en", "")]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    got = L.language_id(docs, docs.where("doc_id < 9")).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == k and 0 <= by_id[i]["score"] <= 1 for i, _, k, _ in rows)
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by_id[None]["lang_pred"] == "de"
    none = L.language_id(docs, docs.where("false")).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert L.language_id(docs.where("false"), docs.where("doc_id < 9")).count() == 0


def test_uncovered_bytes_stay_finite(spark):
    styled = "".join(map(chr, range(0x1D400, 0x1D40C)))  # 12 letters, 48 bytes that no piece covers
    data, starts, ends = as_words([styled.encode()])
    v, table = L.Vocabulary(L.pieces()), dict.fromkeys(L.pieces(), 1)
    flat = np.full((v.size, 1), 1 / v.size)
    space = math.log(1 / v.size + math.exp(L.UNKNOWN))
    assert not any(styled.encode()[a:b] in table for a in range(48) for b in range(a + 1, 49))
    assert np.allclose(L.scores(data, starts, ends, v, flat), space + 48 * L.UNKNOWN)
    counts = L.counts_of(data, starts, ends, v, flat, np.ones((1, 1)))
    assert np.isfinite(counts).all() and 0.99 < counts[L.pieces().index(b" ")] <= 1
    say = {"en": "the thing with others that nothing", "fr": "le château où était la forêt"}
    train = [(1, say["en"], "en", ""), (2, styled, "fr", ""), (3, say["fr"], "fr", ""), (4, say["en"] + " " + styled, "en", "")]
    score = [(10, "the thing with", None, ""), (11, styled, None, ""), (12, styled * 3 + " où était", None, ""), (13, "le château", None, ""), (14, "that nothing", None, "")]
    docs = spark.createDataFrame(train + score, SCHEMA).coalesce(1)
    got = {r["doc_id"]: r for r in L.language_id(docs, docs.where("doc_id < 9")).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1, 3, 10, 12, 13, 14)] == ["en", "fr", "en", "fr", "fr", "en"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    got = L.language_id(docs, docs.where("doc_id % 3 <> 1")).join(docs, "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9
