import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import tokens
from orrery.llm.quality_classifier import features, fit, quality_classifier, shrunk


def test_shrinks_sparse_groups_toward_the_level_above(spark):
    rows = [("a", "x", 0.9)] * 40 + [("a", "y", 0.1)] + [("b", None, 0.2)] * 40 + [(None, None, 0.5)]
    got = {(r["host"], r["path"]): r for r in shrunk(spark.createDataFrame(rows, "host string, path string, q double"), "q").collect()}
    mean = np.mean([r[2] for r in rows])
    assert got["a", "x"]["q_global"] == pytest.approx(mean)
    assert 0.5 < got["a", "y"]["q_path"] < got["a", "y"]["q_host"] < got["a", "x"]["q_path"] < 0.9
    assert 0.2 < got["b", None]["q_path"] < mean
    assert abs(got[None, None]["q_host"] - mean) < 0.05


def plain_shrunk(rows):
    """Posteriors of (host, path, score) rows, one group at a time."""
    mean = sum(x for _, _, x in rows) / len(rows)
    groups = lambda k: {key: [r[2] for r in rows if r[:k] == key] for key in {r[:k] for r in rows}}
    hosts, paths = groups(1), groups(2)

    def strength(of, above):
        v = sum(len(x) * (sum(x) / len(x) - above(key)) ** 2 for key, x in of.items()) / len(rows)
        between = max(v - mean * (1 - mean) / (len(rows) / len(of)), 0)
        return min(max(mean * (1 - mean) / between - 1 if between else 1000, 2), 1000) if len(of) > 1 else 1000

    k1 = strength(hosts, lambda key: mean)
    host = {key: (sum(x) + k1 * mean) / (len(x) + k1) for key, x in hosts.items()}
    k2 = strength(paths, lambda key: host[key[:1]])
    out = []
    for h, p, x in rows:
        a, b = hosts[h,], paths[h, p]
        rest = (sum(a) - x + k1 * mean) / (len(a) - 1 + k1)
        out.append((h, p, x, (sum(b) + k2 * host[h,]) / (len(b) + k2), (sum(b) - x + k2 * rest) / (len(b) - 1 + k2)))
    return out


def test_posteriors_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(h, p, round(float(min(max(rng.gauss(0.2 + 0.15 * (i % 5), 0.1), 0), 1)), 3)) for i, h in enumerate(["a", "b", "c", None, "d"]) for p in ("x", "y", None) for _ in range(rng.choice([1, 2, 30]))]
    got = shrunk(spark.createDataFrame(rows, "host string, path string, q double"), "q").collect()
    key = lambda r: (str(r[0]), str(r[1]), *r[2:])
    want = sorted(plain_shrunk(rows), key=key)
    for a, b in zip(sorted([(r["host"], r["path"], r["q"], r["q_path"], r["q_others"]) for r in got], key=key), want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9)


def test_scores_against_brute_force():
    """Features and models of a few texts, word by word."""
    texts = ["Good words, good words. One 2 #3", "", "BAD bad!! ***", "good Ünder 77 7", "one (two) three"]
    w = tokens.split(*tokens.buffers(pa.array(texts)))
    limits, slots, ratios = features(w)
    for i, t in enumerate(texts):
        plain = "".join(c.lower() if c.isascii() else c for c in re.sub(r"[.,;:!?\"'()]", " ", t)).split()
        own = {int(tokens.split(*tokens.buffers(pa.array([x]))).hashes[0] >> np.uint64(47)) for x in plain}
        assert own == set(slots[limits[i] : limits[i + 1]].tolist())
        raw, n = t.encode(), max(1, len(t.split()))
        letters, capitals = sum(b > 127 or chr(b).isalpha() for b in raw), sum(65 <= b <= 90 for b in raw)
        want = [min(sum(c in b"#*$%&|<>!@^~=+" for c in raw) / n, 3), capitals / max(letters, 1), min(letters / n / 10, 3), len(own) / n, math.log1p(len(t.split())) / 10, sum(48 <= b <= 57 for b in raw) / max(len(raw), 1)]
        assert ratios[i] == pytest.approx(want)
    label = np.array([1.0, 0, 0, 1, 1])
    model = fit(limits, slots, ratios, label)
    odds = [sum(model[s] for s in slots[limits[i] : limits[i + 1]]) + ratios[i] @ model[-7:-1] + model[-1] for i in range(len(texts))]
    assert [z > 0 for z in odds] == [bool(y) for y in label]
    assert model[: 1 << 17].any() == 0  # five documents tell no word apart by ``SURE`` standard errors


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_classifier(docs, labels.where("doc_id % 4 <> 0"), F.col("source"), F.col("lang")).where("doc_id % 4 = 0").collect()
    truth = {r["doc_id"]: r for r in labels.where("doc_id % 4 = 0").collect()}
    held = [r for r in got if r["doc_id"] in truth]
    assert len(held) > 300
    assert np.mean([(r["quality_posterior"] >= 0.5) == truth[r["doc_id"]]["quality"] for r in held]) > 0.95
    assert np.mean([(r["toxicity_posterior"] >= 0.5) == truth[r["doc_id"]]["toxic"] for r in held]) > 0.95


def test_learns_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (None, "the of and", "en", "src0", 0)], docs.schema)
    got = quality_classifier(docs.unionByName(extra).withColumn("host", F.lit("clash")), labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == docs.count() + 3 and all(0 <= r["quality_posterior"] <= 1 and r["kept"] is not None for r in got)
    truth = {r["doc_id"]: r for r in labels.collect()}
    assert np.mean([(r["quality_posterior"] >= 0.5) == truth[r["doc_id"]]["quality"] for r in got if r["doc_id"] in truth]) > 0.95


def test_without_labels_and_without_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier(docs, labels, F.lit("h"), F.lit(None)).collect()
    assert [r["quality"] for r in got] == [0.5, 0.5]
    assert quality_classifier(docs.where("false"), labels, F.lit("h"), F.lit("p")).count() == 0
