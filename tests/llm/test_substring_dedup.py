import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import tokens
from orrery.llm.substring_dedup import common_prefixes, plan_trees, substring_dedup

SCHEMA = "doc_id long, text string, lang string, kind string"


def brute(rows, window):
    """Straight from the rule: rows by (id, text), those without an id before all others by a digest of their words."""
    digest = lambda t: int(tokens.whole(tokens.split(*tokens.buffers(pa.array([t], pa.string()))), 1)[0] >> np.uint64(33))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1]) if r[0] is None else 0, r[1] is not None, r[1] or ""))
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen, out = set(), []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(20, 60))] for _ in range(5)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 40))]
        rows.append((i * 7 % 101 if i % 9 else None, rng.choice([" ", "\n", "\t  "]).join(text), "en", "x"))
    rows += [(1000 + i, " ".join(passages[0]), None, None) for i in range(30)]
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "one", None, None), (2003, " ".join(["same"] * 500), "a", "b")]
    return rows


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 12)])
def test_against_brute_force(spark, seed, window, monkeypatch):
    from orrery.llm import parts

    monkeypatch.setattr(parts.in_parts, "__defaults__", (2000,))
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_texts_spans_and_carried_columns(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"start\n{passage}  end", "en", "k"), (2, f"other {passage}\nrest  é", "de", "k"), (3, "untouched\n\n text ", "fr", None)]
    got = {r["doc_id"]: r for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), carry=("lang",), with_text=True).collect()}
    assert got[1]["kept_text"] == rows[0][1] and got[3]["kept_text"] == rows[2][1]
    assert got[2]["kept_text"] == "other rest  é" and got[2]["removed_spans"] == [1, 25] and got[2]["lang"] == "de"


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_prefixes_of_every_length(spark, monkeypatch, most):
    from orrery.llm import parts, substring_dedup as S

    monkeypatch.setattr(parts.in_parts, "__defaults__", (4000,))
    monkeypatch.setattr(S.plan_trees, "__defaults__", (most,))
    rows = corpus(5)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 20)


def test_common_prefixes():
    labels = tuple(np.array(x, np.uint64) for x in ([1, 1, 1, 1, 2], [5, 5, 5, 6, 6], [7, 7, 8, 8, 8]))
    assert common_prefixes(labels, (7, 7, 6)).tolist() == [20, 14, 7, 0]


def test_very_long_text(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(400)}" for _ in range(150_000)]
    rows = [(1, " ".join(long), "en", "x"), (2, " ".join(long[5000:5100] + ["end"]), "en", "x")]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 20)


def test_tree_plan_splits_heavy_prefixes():
    base, span, labels = plan_trees(np.array([5, 5, 100, 5, 0, 7, 1000]), 20)
    assert span.tolist() == [1, 1, 5, 1, 1, 1, 50] and labels.tolist() == [1, 1, 2, 1, 1, 1, 3]
    assert base[0] == base[1] and base[2] > base[0] and base[3] >= base[2] + 5
