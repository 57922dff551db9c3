import random
import re
from collections import Counter

from pyspark.sql import functions as F

from orrery.llm.quality_rules import RULES, STOP_WORDS, passing, quality_rules

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "and", "Straße", "é", "a|b", "$$$", "naïve", "x" * 30, "👍", "own", "words"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t\t", "\r\n", "\x0b"]) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))), "clash", "clash") for i in range(80)]
    return rows + [(100, None, None, None), (101, "", None, None), (102, " \n\n ", None, None), (None, "same " * 200, None, None), (5, rows[5][1], None, None), (103, " ".join(f"w{i} the" for i in range(20_000)), None, None)]


def test_counts_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_text": F.lit("x"), "__words": F.lit(1), "-at": F.lit(2)})
    found = quality_rules(docs)
    assert {"_text", "__words", "-at"} < set(found.columns) and len(found.columns) == len(set(found.columns))
    got = found.collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_each_rule_rejects_what_it_names(spark):
    clean = " ".join(f"the w{i} of" for i in range(60))
    junk = [" ".join(f"the w{i}###" for i in range(60)), " ".join(f"the ÉW{i}!! ÉTÉ" for i in range(60)), " ".join(f"w{i}" for i in range(200)), " ".join("y" * 40 + str(i) + " the" for i in range(60)), clean + "\nof" * 200]
    kept = quality_rules(spark.createDataFrame([(i, t) for i, t in enumerate([clean, *junk])], "doc_id long, text string")).where("kept").collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert len({r.measure for r in RULES}) == len(RULES) and all(w == w.lower() for ws in STOP_WORDS.values() for w in ws)


def test_passing_keeps_columns_and_needs_no_user_function(spark):
    good = " ".join(f"the w{i} of" for i in range(60))
    docs = spark.createDataFrame([(1, good, "a", None), (2, "no", "b", None), (1, good, "a", None), (3, good + " é" * 100_000, "", "")], SCHEMA).withColumns({"extra": F.lit(1), "_kept": F.lit(2)})
    out = passing(docs)
    assert out.columns == docs.columns and [(r["doc_id"], r["n_words"], r["kept"], r["_kept"]) for r in out.collect()] == [(1, "a", None, 2)] * 2
    assert passing(docs.where("false")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
