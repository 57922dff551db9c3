import importlib
import zlib

from test_near_dedup import brute as classes
from test_substring_dedup import brute as cuts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def documents():
    import random

    rng = random.Random(11)
    stop = "the of and to in a is that".split()
    word = lambda: rng.choice(stop) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(80, 400))]
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0, "x"))
        if i % 6 == 0:
            text[5] = "changed"
            rows.append((1000 + i, " ".join(text), "en", "s1", 0, "x"))
        if i % 5 == 0:
            rows.append((2000 + i, " ".join([word() for _ in range(90)] + passage), "en", None, 0, "x"))
    return rows + [(3000, "too short", "en", "s1", 0, "x"), (3001, None, None, None, None, None), (3002, " ".join(["#$%"] * 80), "en", "s0", 0, "x")]


def test_each_stage_on_its_input(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = stages["quality_rules"](spark, docs, "").collect()
    assert kept[0].asDict().keys() == set(pipeline.COLUMNS)
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows if r[0] < 3000}
    one = spark.createDataFrame(kept, docs.drop("extra").schema).cache()
    single = stages["near_dedup"](spark, one, "").collect()
    assert {r["doc_id"] for r in single} == set(classes([tuple(r) for r in kept]).values())
    two = spark.createDataFrame(single, one.schema).cache()
    cut = {r["doc_id"]: len(r["text"].split()) for r in stages["substring_dedup"](spark, two, "").collect()}
    assert cut == {i: n - gone for i, n, gone, _ in cuts([tuple(r) for r in single], 20) if n > gone}


def test_mix_and_packing_against_brute_force(spark):
    """Words of the mix are those that its runs name, near the targets; pieces are the tokenizer's ids, gapless."""
    import re
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from orrery.llm.mixing import targets

    pipeline = importlib.import_module("corpus_pipeline")
    stages, split = dict(pipeline.STAGES), lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    rows = [r[:5] for r in documents() if r[1] and r[0] < 3000] + [(None, "no id <|endoftext|> here", "en", "s1", 0), (7000, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows + rows[:2], SCHEMA.removesuffix(", extra string"))
    mixed = stages["mix_sources"](spark, docs, "").collect()
    sizes, taken, by_doc, held = Counter(), Counter(), Counter(), Counter()
    for i, t, _, s, _ in rows + rows[:2]:
        sizes[s] += len(split(t))
        held[i] += len(split(t))
    texts = {i: split(t) for i, t, *_ in rows}
    for r in mixed:
        own, at = texts[r["doc_id"]], 0
        got = split(r["text"])
        assert r["n_chars"] == len(r["text"])
        while at < len(got):  # runs of the document's own words
            run = max((k for j in range(len(own)) for k in [next((n for n, (x, y) in enumerate(zip(own[j:], got[at:])) if x != y), min(len(own) - j, len(got) - at))]), default=0)
            assert run > 0
            at += run
        taken[r["source"]] += len(got)
        by_doc[r["doc_id"]] += len(got)
    plan = {r["source"]: r["target"] for r in targets(list(sizes.items()))}
    assert all(abs(taken[s] - t) <= 256 for s, t in plan.items()) and all(by_doc[i] <= 3 * n for i, n in held.items())
    one = spark.createDataFrame(mixed, docs.schema)
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, sequences = Counter(), Counter(), {}
    for r in mixed:
        ids = [*reference.encode(r["text"], add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for p, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first if p == 0 else a + 1024]
            want[r["doc_id"], p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    for r in stages["best_fit_packing"](spark, one, "").collect():
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_one_row_stays_of_each_class_when_ids_repeat(spark):
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["near_dedup"]
    rows = [r[:5] for r in documents()[:6]]
    other = (rows[0][0], rows[0][1] + " end", "en", "s9", 0)
    null = (None, " ".join(f"n{i}" for i in range(30)), "en", "s1", 0)
    docs = spark.createDataFrame(rows + rows[:3] + [other, null, null], SCHEMA.removesuffix(", extra string"))
    got = sorted(map(tuple, stage(spark, docs, "").collect()), key=str)
    assert sorted(str(r[0]) for r in got) == sorted([*{str(i) for i in classes(rows).values()}, "None"])
    assert all(r in [*rows, other, null] for r in got)


def test_stages_take_empty_tables_and_extra_columns(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([r[:6] for r in documents()[:8]], SCHEMA).withColumnRenamed("extra", "n_words")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0
        out = stage(spark, docs.withColumn("kept", docs["n_words"]), "")
        assert name == "best_fit_packing" or out.columns == list(pipeline.COLUMNS)
        assert not out.isEmpty()


def test_run(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].asDict())
