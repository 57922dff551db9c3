import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import tokens
from orrery.llm.mixing import mix_sources, permuted, render, targets

SCHEMA = "doc_id long, text string, source string, block string"


def corpus(n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "é", None])
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 5, 80, 300]))), source, "clash"))
    return rows + [(1000, None, "a", None), (1001, "", "empty", None), rows[1], rows[1], (None, "x y z", "c", None)]


def test_targets_share_and_stop():
    rows = targets([("b", 100), ("a", 10), (None, 5), ("c", 1000)])
    assert [r["source"] for r in rows] == ["a", "b", "c", None]
    assert sum(r["target"] for r in rows) == pytest.approx(1115)
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in rows)
    assert rows[0]["target"] == 30 and rows[1]["target"] == 300 and rows[3]["target"] == 15
    assert targets([("z", 0)])[0]["target"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 99)) == list(range(n))


def test_taken_words(spark):
    rows = corpus()
    lines, mix = mix_sources(spark.createDataFrame(rows, SCHEMA), slots=64, block=16)
    pieces = mix.collect()
    by_doc, by_source = Counter(), Counter()
    for r in pieces:
        by_doc[r["source_no"], r["start"]] += r["words"]
        by_source[r["source_no"]] += r["words"]
        assert 0 <= r["word_start"] and r["word_start"] + r["words"] <= r["size"]
    got = lines.collect()
    assert len(got) == len(rows)
    for r in got:
        assert by_doc[r["source_no"], r["start"]] <= 3 * r["size"] or not r["size"]
        assert abs(by_source[r["source_no"]] - r["target"]) <= 32
    words = Counter()
    for i, t, s, _ in rows:
        words[s] += len((t or "").split())
    assert sorted({(r["source_no"], r["source_size"]) for r in got}) == [(i, words[s]) for i, s in enumerate(sorted(words, key=lambda s: (s is None, s or "")))]
    slots = Counter((r["shard"], r["source_no"], r["slot"], r["block"]) for r in pieces)
    assert len({(a, b, c) for a, b, c, _ in slots}) == len(slots)
    again = mix_sources(spark.createDataFrame(list(reversed(rows)), SCHEMA).repartition(3), slots=64, block=16)[1].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, pieces))


def test_mix_against_brute_force(spark):
    """Every slot's block from the plan, one draw at a time; every block's words from the lines."""
    rows, slots, block, seed = corpus(), 64, 16, 20240607
    lines, mix = mix_sources(spark.createDataFrame(rows, SCHEMA), slots=slots, block=block)
    plan = targets(list({s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in {r[2] for r in rows}}.items()))
    blocks = [-(-r["source_size"] // block) for r in plan]
    quota = []
    for r, b in zip(plan, blocks):
        passes = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        quota.append(passes * b + (min(b, round((r["target"] - passes * r["source_size"]) / block)) if r["source_size"] else 0))
    total, upto, want = sum(quota), [0] * len(plan), set()
    for shard in range(total // slots + 1):
        n = np.random.Generator(np.random.PCG64([seed, shard])).multinomial(slots, np.array(quota) / total) if shard < total // slots else quota
        for s, count in enumerate(n):
            for j in range(upto[s], min(upto[s] + count, quota[s])):
                of = j // blocks[s]
                name = int(tokens.mix(np.array([seed + 1_000_003 * s + 7919 * of], np.uint64))[0])
                want.add((shard, j - upto[s], s, of, int(permuted(np.array([j % blocks[s]]), blocks[s], name)[0])))
            upto[s] += count
    pieces = mix.collect()
    assert {(r["shard"], r["slot"], r["source_no"], r["pass"], r["block"]) for r in pieces} == want
    at = {(r["source_no"], r["start"]): r["size"] for r in lines.collect() if r["size"]}
    for s in range(len(plan)):  # documents stand one after the other
        ends = sorted((a, a + n) for (x, a), n in at.items() if x == s)
        assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])][: len(ends)]
    got = Counter((r["source_no"], r["block"], r["start"], r["word_start"], r["words"]) for r in pieces)
    times = Counter((s, b) for _, _, s, _, b in want)
    cut = Counter()
    for (s, a), n in at.items():
        for b in range(a // block, (a + n - 1) // block + 1):
            low, high = max(a, b * block), min(a + n, (b + 1) * block)
            if times[s, b]:
                cut[s, b, a, low - a, high - low] = times[s, b]
    assert got == cut


def test_rendered_text_has_the_taken_words(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 1000][:400]
    docs = spark.createDataFrame(rows, SCHEMA)
    _, mix = mix_sources(docs, block=16)
    took = {r["key"]: r["n"] for r in mix.groupBy("key").agg(F.sum("words").alias("n")).collect()}
    out = Counter()
    for r in render(docs, mix).collect():
        out[r["doc_id"]] += len(r["text"].split())
    assert out == took


def test_rows_with_one_id_are_rendered_by_their_own_text(spark):
    rows = [(i % 4, " ".join(f"w{i}_{j}" for j in range(20 + 37 * (i % 5))), "ab"[i % 2], "clash") for i in range(40)]
    rows += [rows[0], rows[0], (None, "n1 n2 n3", "a", ""), (None, "n4 n5", "a", ""), (7, "s t", "a", ""), (7, "s t", "b", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    _, mix = mix_sources(docs, block=16)
    taken = mix.groupBy("source_no").agg(F.sum("words")).collect()
    got, words, by_source = render(docs, mix).collect(), Counter(), Counter()
    whole = {}
    for i, t, s, _ in rows:
        whole.setdefault((i, s), []).append(t.split())
    for r in got:
        found = r["text"].split()
        assert any(set(found) <= set(t) for t in whole[r["doc_id"], r["source"]])
        words.update((r["doc_id"], r["source"], w) for w in found)
        by_source["ab".index(r["source"])] += len(found)
    assert by_source == dict(map(tuple, taken))
    copies = Counter((i, s, w) for i, t, s, _ in rows for w in t.split())
    assert all(n <= 3 * copies[w] for w, n in words.items())


def test_empty_table(spark):
    lines, mix = mix_sources(spark.createDataFrame([], SCHEMA))
    assert lines.count() == 0 and mix.count() == 0
