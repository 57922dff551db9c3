import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm.packing import best_fit, best_fit_packing

SCHEMA = "doc_id long, text string, piece string"


def test_every_token_lies_once_in_some_sequence(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "naïve", "<|endoftext|>", "x1", "?!", "\n\n"]) for _ in range(rng.choice([0, 3, 50, 400, 3000]))), "clash") for i in range(60)]
    rows += [(102, " ".join(f"w{i}" for i in range(60_000)), None), (100, None, None), (101, "", None), (7, rows[7][1], None), (None, "no id", None)]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*reference.encode(t or "", add_special_tokens=False).ids, 2])
    got = best_fit_packing(spark.createDataFrame(rows, SCHEMA), with_ids=True).collect()
    sequences = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(w[r["start"] : r["start"] + r["length"]] == r["ids"] for w in want[r["doc_id"]])
        if r["length"] < 1024:
            assert r["piece"] == 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(len(w) for ws in want.values() for w in ws)
    short = [r["length"] for r in got if r["length"] < 1024]
    least = max(-(-sum(short) // 1024), sum(n > 512 for n in short))  # no two over half go together
    assert len(sequences) <= len(got) - len(short) + least + 2


def test_query_and_pipeline_have_the_ids_of_the_tokenizer_as_loaded(spark, tmp_path):
    import importlib

    from orrery.llm.registry import queries

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b", "x<|endoftext|", "<|endoftext|>naïve " * 700, "no token"]
    want = {}
    for i, t in enumerate(texts):
        ids = [*reference.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for p, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if p == 0 else a + 1024
            want[i, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert 50256 in reference.encode(texts[0], add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["best_fit_packing"]
    for got in (queries()["op3_best_fit_packing"](spark, str(tmp_path)), stage(spark, docs, "")):
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got.collect()} == want


def test_constraints_hold():
    lengths = np.sort(np.random.default_rng(1).integers(1, 1024, 3000))[::-1].copy()
    for most_pieces, most_cost in ((1024, 1024**2), (2, 1024**2), (1024, 400_000)):
        where, at = best_fit(lengths, 1024, most_pieces, most_cost)
        for b in range(where.max() + 1):
            mine = where == b
            assert lengths[mine].sum() <= 1024 and mine.sum() <= most_pieces
            assert (lengths[mine].astype(float) ** 2).sum() <= most_cost or mine.sum() == 1
            assert sorted(at[mine]) == [0, *np.cumsum(lengths[mine][np.argsort(at[mine])])[:-1]]
    assert where.max() + 1 >= lengths.sum() / 1024


def brute(lengths, capacity, weights):
    """Bins as lists of pieces; every open bin is tried for every piece."""
    bins, out = [], []
    for n in lengths:
        norms = []
        for b, held in enumerate(bins):
            left = [capacity[0] - sum(held) - n, capacity[1] - len(held) - 1, capacity[2] - sum(x * x for x in held) - n * n]
            if min(left) >= 0:
                norms.append((round(sum(w * (x / c) ** 2 for w, x, c in zip(weights, left, capacity)), 12), b))
        if not norms:
            bins.append([])
        out.append(min(norms)[1] if norms else len(bins) - 1)
        bins[out[-1]].append(n)
    return out


def test_least_norm_under_all_capacities_against_brute_force():
    lengths = np.sort(np.random.default_rng(3).integers(1, 600, 400))[::-1].copy()
    found = {}
    for capacity in ((1024, 1024, 1024**2), (1024, 3, 1024**2), (1024, 1024, 400_000)):
        for weights in ((1.0, 0.3, 0.3), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)):
            where, _ = best_fit(lengths, *capacity, weights)
            assert where.tolist() == brute(lengths.tolist(), capacity, weights)
            found.setdefault(capacity, []).append(tuple(where))
    assert len(set(found[1024, 1024, 1024**2])) == 3  # the weights decide
    assert len({bins[0] for bins in found.values()}) == 3  # and each capacity binds


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, rows):
    assert best_fit_packing(spark.createDataFrame(rows, SCHEMA)).count() == 0
