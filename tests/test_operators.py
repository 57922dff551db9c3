import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery import contracts as C
from orrery.config import AuditConfig, FusionConfig, HybridConfig, PairConfig, PopulationConfig, RerankConfig, RetrievalConfig
from orrery.operators import audit, features, fusion, hybrid, metrics, pairs, population, relational as R, rerank, retrieval, taxonomy
from orrery.operators.truth import ClassTruth, matching
from orrery.sources import tables


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_ties_go_by_item(spark):
    q = frame(spark, "query_id string, v array<double>", ("q", [1.0, 0.0]))
    i = frame(spark, "item_id int, v array<double>", (2, [0.0, 1.0]), (1, [1.0, 0.0]), (0, [2.0, 0.0]))
    for got in (retrieval.cosine_top_k(q, i, 3, tile_rows=1), retrieval.cosine_top_k_native(q, i, 3)):
        assert [(r["item_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 0.0)]


def test_tiles_agree_with_one_product(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((30, 8)), rng.standard_normal((70, 8))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "query_id long, v array<double>")
    i = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(b)], "item_id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit(a) @ unit(b).T), axis=1)[:, :5]
    got = retrieval.cosine_top_k(q, i, 5, tile_rows=16).orderBy("query_id", "rank").toPandas()
    assert (got["item_id"].to_numpy().reshape(30, 5) == want).all()
    assert retrieval.neighbor_recall(retrieval.cosine_top_k(q, i, 5), retrieval.ann_top_k(q, i, 5, 8), 5).first()["neighbor_recall"] > 0.9


def _vectors(spark, name, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, v array<double>")


def test_many_pairs_are_not_scored_one_by_one(spark):
    rng = np.random.default_rng(3)
    q, i = _vectors(spark, "query_id", rng.standard_normal((20, 4))), _vectors(spark, "item_id", rng.integers(-1, 2, (90, 4)).astype(float))
    few, many = retrieval.cosine_top_k_native(q, i, 7), retrieval.cosine_top_k_native(q, i, 7, most_pairs=1000)
    pairwise = lambda f: any(x in f._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
    assert pairwise(few) and not pairwise(many)
    assert sorted(map(str, many.select("query_id", "rank", "item_id").collect())) == sorted(map(str, few.select("query_id", "rank", "item_id").collect()))


def test_approximate_search_lists_no_pairs(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((15, 6)), rng.standard_normal((200, 6))
    q, i = _vectors(spark, "query_id", a), _vectors(spark, "item_id", b)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for tables, bits, probes in ((3, 3, 1), (2, 8, 0)):
        got = retrieval.ann_top_k(q, i, 8, 6, tables=tables, bits=bits, probes=probes)
        assert "[table" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x) and "bucket" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
        held, asked = ({(r[k], r["table"], r["bucket"]) for r in retrieval.lsh_buckets(f, [k], "v", 6, tables, bits, p).collect()} for f, k, p in ((i, "item_id", 0), (q, "query_id", probes)))
        shared = {(x, y) for x, t, c in asked for y, u, d in held if (t, c) == (u, d)}
        score = np.round(unit(a) @ unit(b).T, 12)
        want = {x: [y for y in np.argsort(-score[x], kind="stable") if (x, y) in shared][:8] for x in range(15)}
        found = {x: [] for x in range(15)}
        for r in got.orderBy("query_id", "rank").collect():
            found[r["query_id"]].append(r["item_id"])
        assert found == want


def test_a_tile_is_scored_in_blocks(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(retrieval, "BLOCK_ITEMS", 64)
    rng = np.random.default_rng(6)
    b = retrieval._unit(rng.integers(-1, 2, (1000, 5)).astype(float))
    b[3] = np.nan
    a = retrieval._unit(rng.integers(-1, 2, (40, 5)).astype(float))
    score = np.nan_to_num(np.round(np.einsum("nd,md->nm", a, b), 12), nan=-2.0)
    for keep in (1, 9, 100, 2000):
        row, place, _ = retrieval._top(a, b, b.astype(np.float32), keep)
        assert (place.reshape(40, -1) == np.argsort(-score, axis=1, kind="stable")[:, :keep]).all() and (row == np.repeat(np.arange(40), min(keep, 1000))).all()
    monkeypatch.undo()
    b = retrieval._unit(rng.standard_normal((40_000, 8)))
    single = b.astype(np.float32)
    tracemalloc.start()
    retrieval._top(b[:256], b, single, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all scores at once are 82 MB in double precision


def test_metrics_by_hand(spark):
    p = frame(spark, "query_id string, item_id string, rank int", ("c", "s1", 1), ("c", "s3", 2), ("c", "s2", 3))
    t = frame(spark, "query_id string, item_id string, relevance_score double", ("c", "s1", 1.0), ("c", "s2", 0.5), ("d", "s9", 0.0))
    got = {(r["query_id"], r["k"]): r for r in metrics.per_query(p, t, (1, 3)).collect()}
    assert (got["c", 1]["precision"], got["c", 1]["recall"], got["c", 1]["mrr"]) == (1.0, 0.5, 1.0)
    assert got["c", 3]["precision"] == pytest.approx(2 / 3) and got["c", 3]["recall"] == 1.0 and 0 < got["c", 3]["ndcg"] < 1
    assert got["d", 3]["hit_count"] == 0 and got["d", 3]["ndcg"] == 0.0 and got["d", 3]["mrr"] == 0.0
    with pytest.raises(Exception, match="no truth"):
        metrics.per_query(p, t.where("query_id = 'd'"), (1,)).collect()


def test_lift_over_zero_is_null(spark):
    row = lambda x: frame(spark, "k int, precision double, recall double, ndcg double, hit_rate double, mrr double", (1, x, 0.5, 0.5, 0.5, 0.5))
    got = {r["metric"]: r for r in metrics.lift(row(0.0), row(0.25)).collect()}
    assert got["precision"]["relative_lift"] is None and got["precision"]["absolute_lift"] == 0.25 and got["recall"]["relative_lift"] == 0.0


def test_reliability_fusion(spark):
    f = frame(spark, "id string, v array<double>, reliability_score double", ("a", [1.0, 0.0], 1.0), ("a", [0.0, 1.0], 3.0), ("b", [1.0, 1.0], 2.0), ("c", [0.0, 2.0], 0.0), ("c", [0.0, 0.0], 0.0))
    got = {r["id"]: r["v"] for r in fusion.reliability_fusion(f, ["id"]).collect()}
    assert got["a"] == pytest.approx([0.31622776, 0.9486833]) and got["b"] == pytest.approx([0.70710677] * 2) and got["c"] == [0.0, 1.0]
    with pytest.raises(Exception, match="negative"):
        fusion.reliability_fusion(f.withColumn("reliability_score", F.lit(-1.0)), ["id"]).collect()


def test_initial_gates_match_the_model(spark):
    f = frame(spark, "q string, r double, a boolean", ("x", 0.8, True), ("x", 0.2, True), ("x", 0.5, False))
    assert sorted(r["g"] for r in f.select(fusion.initial_gates(F.col("r"), F.col("a"), "q").alias("g")).collect()) == pytest.approx([0.0, 0.2, 0.8])
    model = fusion.GatedFusion(3, 4, 2)
    quality = np.zeros((1, 3, 6))
    quality[0, :, 0] = [0.8, 0.2, 0.5]
    y, g = model.encode(np.ones((1, 3, 4)), quality, np.array([[True, True, False]]))
    assert g[0] == pytest.approx([0.8, 0.2, 0.0]) and np.linalg.norm(y) == pytest.approx(1)
    with pytest.raises(ValueError, match="available"):
        model.encode(np.ones((1, 3, 4)), quality, np.zeros((1, 3), bool))


def test_slopes_and_training():
    rng = np.random.default_rng(0)
    model = fusion.GatedFusion(2, 5, 3, hidden=4)
    for p in model.parameters.values():
        p += rng.normal(0, 0.1, p.shape)
    quality = rng.uniform(0.2, 1, (6, 2, 6))
    batch = (rng.standard_normal((6, 2, 5)), quality, np.ones((6, 2), bool), rng.standard_normal((6, 5)), rng.standard_normal((6, 3, 5)), rng.uniform(0.1, 1, 6))
    loss, slopes = model.step(*batch, 0.5)
    for name, p in model.parameters.items():
        flat = p.reshape(-1)
        for at in range(0, flat.size, max(1, flat.size // 4)):
            keep = flat[at]
            flat[at] = keep + 1e-6
            up = model.step(*batch, 0.5)[0]
            flat[at] = keep
            assert (up - loss) / 1e-6 == pytest.approx(slopes[name].reshape(-1)[at], abs=2e-3), name
    history = fusion.train(model, lambda e: [batch], lambda m: -m.step(*batch, 0.5)[0], epochs=5, rate=0.01)
    assert history[-1]["train_loss"] < history[1]["train_loss"] and sum(h["is_best"] for h in history) == 1
    with pytest.raises(ValueError):
        fusion.contrastive_loss(np.ones((1, 2)), np.ones((1, 2)), np.ones((1, 1, 2)), np.ones(1), 0.0)


def test_pairs(spark):
    p = frame(spark, "query_id int, item_id int, rank int, score double", *((1, i, i, 1.0 / i) for i in range(1, 7)))
    t = frame(spark, "query_id int, item_id int", (1, 1), (1, 3))
    hard = pairs.hard_negatives(p, t, 2).orderBy("retrieval_rank").collect()
    assert [(r["item_id"], r["retrieval_rank"]) for r in hard] == [(2, 2), (4, 4)]
    items = spark.range(200).select(F.col("id").cast("int").alias("item_id"))
    asked = frame(spark, "query_id int", (1,), (2,))
    drawn = pairs.random_negatives(asked, items, t, 5, "s")
    assert drawn.groupBy("query_id").count().where("count = 5").count() == 2 and drawn.join(t, ["query_id", "item_id"]).isEmpty()
    assert sorted(drawn.collect()) == sorted(pairs.random_negatives(asked.repartition(3), items, t, 5, "s").collect())


def test_random_negatives_find_the_last_free_items(spark):
    items = spark.range(1000).select(F.col("id").cast("int").alias("item_id"))
    asked = frame(spark, "query_id int", (1,), (2,), (3,))
    taken = asked.where("query_id < 3").crossJoin(items).where("item_id >= 20 OR query_id = 2 AND item_id >= 10")
    drawn = pairs.random_negatives(asked, items, taken, 10, "s")
    got = {r["query_id"]: sorted(r["items"]) for r in drawn.groupBy("query_id").agg(F.collect_set("item_id").alias("items")).collect()}
    assert {q: len(x) for q, x in got.items()} == {1: 10, 2: 10, 3: 10} and got[2] == list(range(10)) and max(got[1]) < 20
    with pytest.raises(Exception, match="too few items"):
        pairs.random_negatives(asked, items, taken, 11, "s").collect()
    assert [pairs.prime_from(n) for n in (0, 1, 2, 3, 4, 90, 1000)] == [2, 2, 2, 3, 5, 97, 1009]


def test_newest_evidence_comes_first_and_undated_last(spark):
    rows = frame(spark, "k int, day string, id string, line string", (1, "2020", "a", "old"), (1, None, "b", "undated"), (1, "2022", "c", "new"), (1, "2022", "d", "newer id"))
    got = features.assembled_text(rows, "k", [F.col("day"), F.col("id")], F.col("line"), newest_first=True).first()
    assert got["tower_text"] == "newer id new old undated"


def test_evidence_needs_every_gate_and_vector(spark):
    pool, towers, items = frame(spark, "query_id int, item_id int", (1, 1), (1, 2)), frame(spark, "query_id int, v array<double>, gate_weight double", (1, [1.0, 0.0], 1.0)), frame(spark, "item_id int, v array<double>", (1, [2.0, 0.0]))
    assert rerank.gated_evidence(pool.where("item_id = 1"), towers, items).first()["evidence_score"] == 1.0
    with pytest.raises(Exception, match="no gate or vector"):
        rerank.gated_evidence(pool, towers, items).collect()


def test_pools_keep_the_head_and_fill_up(spark):
    learned = frame(spark, "query_id int, item_id int, rank int, score double", (1, 10, 1, 0.9), (1, 11, 2, 0.8), (1, 12, 3, 0.1))
    towers = frame(spark, "query_id int, item_id int, tower_order int, reliability double, rank int, score double", (1, 13, 0, 1.0, 1, 0.7), (1, 13, 1, 1.0, 1, 0.6), (1, 12, 0, 0.5, 2, 0.3))
    jobs = frame(spark, "query_id int, item_id int, rank int, score double", (1, 13, 1, 0.5))
    fused = hybrid.fuse(learned, towers, jobs)
    r = {x["item_id"]: x for x in fused.collect()}
    assert r[13]["channel_count"] == 3 and r[13]["tower_hit_count"] == 2 and r[13]["best_tower_score"] == 0.7
    assert r[12]["rrf_score"] == pytest.approx(1 / 63 + 0.75 * 0.5 / 62)
    pool = hybrid.fill_pools(fused, frame(spark, "query_id int", (1,), (2,)), frame(spark, "item_id int", *((i,) for i in range(10, 20))), 6, 2)
    got = {(x["query_id"], x["rank"]): x for x in pool.collect()}
    assert [got[1, k]["item_id"] for k in range(1, 7)] == [10, 11, 13, 12, 14, 15]
    assert [got[1, k]["is_learned_protected"] for k in (1, 2, 3)] == [True, True, False] and got[1, 5]["is_fallback"]
    assert [got[2, k]["item_id"] for k in range(1, 7)] == list(range(10, 16))


def test_greedy_diversity():
    scores, near = np.array([1.0, 0.99, 0.5]), np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1.0]])
    assert rerank.greedy(scores, near, 3, 0.0)[0] == [0, 1, 2]
    assert rerank.greedy(scores, near, 3, 0.6)[0] == [0, 2, 1]
    assert rerank.greedy(np.array([0.5, 0.5]), np.eye(2), 2, 0.1)[0] == [0, 1]


def test_list_similarity_is_the_mean_of_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((4, 3))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id int, v array<double>")
    lists = frame(spark, "q int, item_id int", *((1, i) for i in range(4)), (2, 0))
    got = {r["q"]: r["mean_intra_list_similarity"] for r in rerank.list_similarity(lists, items, ["q"]).collect()}
    assert got[1] == pytest.approx((u @ u.T)[np.triu_indices(4, 1)].mean()) and got[2] is None


def test_audit(spark):
    stages = frame(spark, "stage string, query_id int, item_id int", ("s", 1, 1), ("s", 1, 2), ("s", 2, 1), ("s", 2, 3))
    truth = frame(spark, "query_id int, item_id int", (1, 1), (1, 4), (2, 3), (3, 1))
    r = audit.coverage_summary(stages, truth, 5).first()
    assert (r["truth_pair_recall"], r["mean_query_recall"], r["truth_item_coverage"]) == (0.5, pytest.approx(0.5), pytest.approx(2 / 3))
    assert r["herfindahl_index"] == pytest.approx(0.375) and r["top_1pct_prediction_share"] == 0.5
    assert r["normalized_entropy"] == pytest.approx(-(0.5 * np.log(0.5) + 0.5 * np.log(0.25)) / np.log(5))
    assert audit.concentration(stages, 1).first()["normalized_entropy"] == 0.0
    kinds = frame(spark, "item_id int, kind string", (1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None))
    by = {x["kind"]: x for x in audit.coverage_by_type(stages, truth, kinds, "kind").collect()}
    assert by["a"]["truth_item_coverage"] == pytest.approx(2 / 3) and by["b"]["truth_item_coverage"] is None and set(by) == {"a", "b"}
    assert audit.decide(1, 1, 1) == "llm_judge" and audit.decide(0.7, 1, 1) == "hybrid_candidate_generation"


def test_near_ids_are_found_by_key(spark):
    from orrery.plans import queries

    for name in ("baseline_lift", "strategy_comparison"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Join" in x and ("item_id" in x and "query_id" in x and (" <= " in x or " < " in x)) for x in plan.split("\n")), name


def test_a_label_is_ranked_once_for_all_its_queries(spark):
    from orrery.plans import queries

    plan = queries._channels(spark, "/root/testdata/sf0.001")[2]._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Window")]
    assert "Join" in above and "Join" not in plan[plan.index("Window") :]


def test_random_negatives_draw_few(spark):
    items = spark.range(40_000).select(F.col("id").alias("item_id"))
    asked = frame(spark, "query_id long", *((n,) for n in range(50)))
    most = items.where("item_id % 4 <> 0")
    truth = ClassTruth(asked.selectExpr("query_id", "query_id % 2 AS c"), most.selectExpr("item_id", "item_id % 2 AS c"), ("c",))
    drawn = pairs.random_negatives(asked, items, (truth, frame(spark, "query_id long, item_id long", (0, 0))), 10, "s")
    rows = drawn.collect()
    assert len({(r["query_id"], r["item_id"]) for r in rows}) == 500 and (0, 0) not in {(r["query_id"], r["item_id"]) for r in rows}
    assert not any(r["item_id"] % 4 and r["item_id"] % 2 == r["query_id"] % 2 for r in rows)
    few = asked.where("query_id < 5")
    listed = truth.pairs().select("query_id", "item_id")
    one, two = (sorted(pairs.random_negatives(few, items, t, 10, "s").collect()) for t in (truth, listed))
    assert one == two


def _classes(spark, queries, items, labels):
    q = spark.range(queries).selectExpr("id AS query_id", f"id % {labels} AS _label", "explode(array(0L, 1L)) AS _part")
    q = q.selectExpr("*", "(1 + (query_id + _part) % 2) / 2.0D AS relevance_score", "1.0D + _part AS proficiency", "IF(query_id % 3 = 0, 'test', 'train') AS split")
    return ClassTruth(q, spark.range(items).selectExpr("id AS item_id", f"(id DIV 2) % {labels} AS _label", "id % 2 AS _part"))


def test_truth_by_classes_is_the_truth_of_its_pairs(spark):
    truth = _classes(spark, 30, 41, 3)
    listed = truth.pairs()
    assert listed.count() == listed.select("query_id", "item_id").distinct().count() == sum((j // 2) % 3 == i % 3 for i in range(30) for j in range(41))
    p = spark.range(30).selectExpr("id AS query_id", "explode(sequence(1, 12)) AS rank").selectExpr("query_id", "(query_id * 7 + rank * 5) % 47 AS item_id", "rank", "1.0D / rank AS score")
    stages = p.selectExpr("'all' AS stage", "query_id", "item_id").union(p.where("rank < 3").selectExpr("'head'", "query_id", "item_id"))
    items, made = truth.items.select("item_id"), lambda t: t.pairs() if isinstance(t, ClassTruth) else t
    for f in (
        lambda t: metrics.per_query(p, t, (2, 9, 40)), lambda t: pairs.hard_negatives(p, t, 4), lambda t: pairs.pair_counts(spark.range(33).selectExpr("id AS query_id"), t, p),
        lambda t: audit.coverage_summary(stages, t, 41), lambda t: hybrid.stage_metrics(stages, t, 41), lambda t: rerank.train_popularity(items, matching(t, "split = 'train' AND relevance_score > 0.5")),
        lambda t: audit.coverage_by_type(stages, t, items.selectExpr("item_id", "item_id % 4 AS kind"), "kind"), lambda t: made(pairs.positives(t)).select(*listed.columns, "sample_weight"),
    ):
        got, want = ([[round(x, 9) if isinstance(x, float) else x for x in r] for r in f(t).collect()] for t in (truth, listed))
        assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_a_large_class_makes_no_pairs(spark):
    truth = _classes(spark, 40_000, 60_000, 1)  # 2.4e9 pairs
    p = frame(spark, "query_id long, item_id long, rank int, score double", (0, 1, 1, 0.5), (0, 70_000, 2, 0.4))
    m = metrics.per_query(p, truth, (1,)).where("query_id = 0").first()
    assert (m["truth_count"], m["hit_count"], m["ndcg"]) == (60_000, 1, 1.0)
    assert [r["item_id"] for r in pairs.hard_negatives(p, truth, 5).collect()] == [70_000]
    assert audit.stage_recall(p.selectExpr("'s' AS stage", "*"), truth).first()["truth_pair_recall"] == pytest.approx(1 / 2.4e9)
    assert rerank.train_popularity(truth.items, truth).agg(F.min("popularity_score")).first()[0] == 1.0


def test_relational(spark):
    left, right = frame(spark, "k int, a int", (1, 1), (2, 2)), frame(spark, "k int, b int", (1, 1), (1, 2))
    with pytest.raises(C.ContractError, match="not unique"):
        R.left_validated(left, right, ["k"])
    raw = frame(spark, "c string, e string, s string, v double, o int", ("x", "e", "IM", None, 0), ("x", "e", "IM", 4.0, 1), ("x", "e", "IM", 2.0, 2), ("x", "e", "LV", 5.0, 3), ("y", "e", "IM", None, 4))
    got = R.rated_pivot(raw, ["c", "e"], "s", "v", {"IM": "im", "LV": "lv"}, [F.col("o")]).collect()
    assert [tuple(r) for r in got] == [("x", "e", 4.0, 5.0)]
    jobs = frame(spark, "c int, s date, e date, id int", (1, pd.Timestamp("2018-01-01").date(), pd.Timestamp("2019-01-01").date(), 1), (1, pd.Timestamp("2017-01-01").date(), None, 2))
    assert [r["id"] for r in R.open_first(jobs, "c", "e", "s", "id").orderBy("position").collect()] == [2, 1]


def test_contracts(spark):
    f = frame(spark, "k int, v double", (1, 0.5), (1, 2.0), (None, None))
    with pytest.raises(C.ContractError, match="key: 1 violations.*range: 2 violations"):
        C.require({"key": C.duplicate_keys(f, ["k"]), "range": C.outside(f, F.col("v").between(0, 1))})
    C.require({"key": C.duplicate_keys(f.where("v < 1"), ["k"])})
    with pytest.raises(C.ContractError, match="lacks columns: z"):
        C.require_columns(f, {"k", "z"}, "f")
    with pytest.raises(Exception, match="sealed"):
        C.refuse_sealed(frame(spark, "split string", ("test",))).collect()
    ranks = lambda *r: frame(spark, "q int, rank int", *((1, x) for x in r))
    assert C.incomplete_ranks(ranks(1, 2, 3), "q", "rank", 3).isEmpty()
    for bad in ((1, 2), (1, 2, 2), (2, 3, 4)):
        assert C.incomplete_ranks(ranks(*bad), "q", "rank", 3).count() == 1


def test_settings_have_names_of_their_files(tmp_path):
    file = tmp_path / "x.toml"
    file.write_text('[splits]\ntrain = 0.7\nvalidation = 0.2\ntest = 0.1\n[missingness]\nresume = 0.3\n')
    assert (PopulationConfig.load(file).train_fraction, PopulationConfig.load(file).resume_missing_rate) == (0.7, 0.3)
    file.write_text("[mining]\nhard_negatives_per_candidate = 7\n")
    assert PairConfig.load(file).hard_negatives == 7
    file.write_text("[mining]\nhard_negative = 7\n")
    with pytest.raises(ValueError, match="unknown setting mining.hard_negative"):
        PairConfig.load(file)


def test_saved_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(300)], "item_id int, v array<double>")
    asked = items.where("item_id < 20").withColumnRenamed("item_id", "query_id")
    made = retrieval.build_index(items, 16, tables=4, bits=4, probes=1)
    retrieval.save_index(made, str(tmp_path))
    exact = retrieval.cosine_top_k(asked, items, 5)
    few, many = (retrieval.load_index(spark, str(tmp_path), probes) for probes in (0, 4))
    recall = [retrieval.neighbor_recall(exact, retrieval.search_index(i, asked, 5), 5).first()["neighbor_recall"] for i in (few, retrieval.load_index(spark, str(tmp_path)), many)]
    assert recall[0] <= recall[1] <= recall[2] and recall[2] > 0.8
    assert sorted(retrieval.search_index(made, asked, 5).collect()) == sorted(retrieval.search_index(retrieval.load_index(spark, str(tmp_path)), asked, 5).collect())
    with pytest.raises(ValueError):
        retrieval.load_index(spark, str(tmp_path), -1)


def test_best_of_a_row_keeps_the_order_of_ties():
    scores = np.round(np.random.default_rng(0).random((50, 80)), 1)
    for keep in (1, 7, 80, 100):
        assert (retrieval._best(scores, keep) == np.argsort(-scores, axis=1, kind="stable")[:, :keep]).all()


def test_configs(tmp_path):
    file = tmp_path / "x.toml"
    file.write_text('[a]\nsplit = "validation"\n[search]\nevidence_weights = [0.1, 0.2]\ncandidate_pool_size = 50\n')
    assert RerankConfig.load(file).evidence_weights == (0.1, 0.2) and RerankConfig.load(file).candidate_pool_size == 50
    for bad in (HybridConfig(split="test"), PairConfig(splits=("test",)), AuditConfig(split="test"), RetrievalConfig(cutoffs=(3, 1)), FusionConfig(temperature=0), PopulationConfig(n_candidates=0), PopulationConfig(train_fraction=0.9), RerankConfig(output_k=500)):
        with pytest.raises(ValueError):
            bad.validate()


def test_features_and_encoding(spark):
    grid = frame(spark, "id int, source string, tower_text string, item_count int, age_days int, reliability_score double", (1, "resume", "word " * 100, 41, 900, 0.5), (1, "courses", None, None, None, None), (2, "resume", "  ", 3, 1, 0.7))
    got = {(r["id"], r["source"]): r for r in features.tower_features(grid, {"resume": 80, "courses": 80}).collect()}
    assert got[1, "resume"]["is_stale"] and got[1, "resume"]["is_high_volume"] and got[1, "resume"]["character_count"] <= 82
    for missing in (got[1, "courses"], got[2, "resume"]):
        assert not missing["is_available"] and missing["tower_text"] == "" and missing["reliability_score"] == 0.0 and not missing["is_stale"]
    with pytest.raises(Exception, match="unknown source"):
        features.tower_features(grid, {"resume": 80}).collect()
    rows = features.encode_texts(frame(spark, "id int, t string, ok boolean", (1, "a b", True), (2, "a b", False), (3, None, True)), ["id"], "t", "ok", lambda: features.HashingEncoder(8)).collect()
    assert np.linalg.norm(rows[0]["embedding"]) == pytest.approx(1) and not any(rows[1]["embedding"]) and not any(rows[2]["embedding"])


def _sheets(spark):
    rated = frame(spark, "`O*NET-SOC Code` string, `Element ID` string, `Element Name` string, `Scale ID` string, `Data Value` string, `Recommend Suppress` string, `Not Relevant` string, Date string, `Domain Source` string, _row int",
                  (" 11-1 ", "2.A.1", "Reading", "IM", "4.0", None, "N", "07/2020", "Analyst", 0), ("11-1", "2.A.1", "Reading", "LV", "5.0", "N", "N", "08/2020", "Analyst", 1), ("11-1", "2.A.2", "Math", "IM", "3", "Y", "N", "08/2020", "Analyst", 2), ("11-1", "2.A.2", "Math", "LV", "3", "Y", None, "x", "Analyst", 3))
    software = frame(spark, "`O*NET-SOC Code` string, Example string, `Hot Technology` string, `In Demand` string, `Commodity Code` string, `Commodity Title` string", ("11-1", "Excel", "Y", "N", "43", "Sheets"), ("11-1", "SAP", None, "Y", "44", "ERP"))
    return rated, software


def test_taxonomy(spark):
    rated, software = _sheets(spark)
    reading, soft = taxonomy.rated_skills(rated, "essential", "_row"), taxonomy.software_skills(software)
    r = reading.collect()
    assert len(r) == 1 and (r[0]["skill_id"], r[0]["importance"], r[0]["level"]) == ("onet:2.A.1", 4.0, 5.0) and str(r[0]["source_date"])[:7] == "2020-08"
    relation = taxonomy.relations([reading], soft)
    told = frame(spark, "`Element ID` string, Description string", ("2.A.1", " Reads. "))
    catalog = taxonomy.skills([reading], soft, told)
    jobs = taxonomy.occupations(frame(spark, "`O*NET-SOC Code` string, Title string, Description string", ("11-1", "Chief", "Leads"), ("11-2", "Other", None)), frame(spark, "`O*NET-SOC Code` string, `Job Zone` string, Date string, `Domain Source` string", ("11-1 ", "5", "01/2020", "A")))
    work = taxonomy.tasks(frame(spark, "`Task ID` string, `O*NET-SOC Code` string, Task string, `Task Type` string, `Incumbents Responding` string, Date string, `Domain Source` string", ("1", "11-1", "Lead", None, "n/a", "01/2020", "A")))
    taxonomy.validate(jobs, work, catalog, relation)
    flags = {x["onet_soc_code"]: x for x in taxonomy.with_data_flags(jobs, work, relation).collect()}
    assert flags["11-1"]["has_skill_data"] and flags["11-1"]["job_zone"] == 5 and not flags["11-2"]["has_task_data"]
    assert work.first()["task_type"] == "Unspecified" and work.first()["incumbents_responding"] is None
    two = frame(spark, "`O*NET-SOC Code` string, Example string, `Hot Technology` string, `In Demand` string, `Commodity Code` string, `Commodity Title` string", ("11-1", "SAP", None, "Y", "44", "ERP"), ("11-1", "sap", None, "Y", "44", "ERP"))
    with pytest.raises(C.ContractError, match="skills key"):
        taxonomy.validate(jobs, work, taxonomy.skills([reading], taxonomy.software_skills(two), told), relation.limit(0))
    titles = taxonomy.job_titles(frame(spark, "`O*NET-SOC Code` string, `Alternate Title` string, `Short Title` string, `Source(s)` string", ("11-1", "Boss", "CEO", "01"), ("11-1", "BOSS", None, "02")), frame(spark, "`O*NET-SOC Code` string, `Reported Job Title` string, `Shown in My Next Move` string", ("11-1", "President", "Y")))
    assert titles.count() == 3


def test_population(spark):
    config = PopulationConfig(n_candidates=60, seed=12345)
    relations = spark.range(4).select(F.format_string("1%d-1", F.col("id")).alias("onet_soc_code")).crossJoin(spark.range(30).select(F.concat(F.lit("s"), "id").alias("skill_id"), F.concat(F.lit("Skill and "), "id").alias("skill_name"), ((F.col("id") + 1) / 31.0).alias("relevance_score")))
    jobs = relations.select("onet_soc_code").distinct()
    titles = jobs.crossJoin(frame(spark, "job_title string", ("Lead",), ("Clerk",)))
    p = population.generate(spark, config, jobs, titles, relations)
    population.validate(p.candidates, p.truth, p.status, config)
    again = population.generate(spark, config, jobs.repartition(3), titles, relations.repartition(5))
    for name in ("candidates", "truth", "claims", "status", "job_history"):
        assert sorted(map(str, getattr(p, name).collect())) == sorted(map(str, getattr(again, name).collect())), name
    assert p.claims.where("oracle_is_true_skill").count() > p.claims.where("NOT oracle_is_true_skill").count() > 0
    assert p.truth.join(p.claims.where("NOT oracle_is_true_skill").withColumnRenamed("canonical_skill_id", "skill_id"), ["candidate_id", "skill_id"]).isEmpty()
    assert p.job_history.where("end_date < start_date").isEmpty() and p.candidates.select("split").distinct().count() >= 2


def test_skills_under_the_bound_are_those_of_all(spark, monkeypatch):
    config = PopulationConfig(n_candidates=25, seed=7)
    relations = spark.range(900).selectExpr("CONCAT('1', id % 3, '-1') AS onet_soc_code", "CONCAT('s', id) AS skill_id", "'x' AS skill_name", "0.03D + (id % 40) / 41 AS relevance_score").where("onet_soc_code < '12' OR skill_id < 's2'")
    people = population.candidates(spark, config, relations)
    near = population.true_skills(people, relations, config)
    assert "_bound" in near._jdf.queryExecution().optimizedPlan().toString() or "_deal" in near._jdf.queryExecution().optimizedPlan().toString()
    few = sorted(map(str, near.collect()))
    monkeypatch.setattr(population, "SPARE", -100)  # nothing is let through, so all are sorted
    assert few == sorted(map(str, population.true_skills(people, relations, config).collect())) and len(few) > 300


def test_relations_are_dealt_by_their_rows(spark, monkeypatch):
    from orrery.plans import queries

    monkeypatch.setattr(queries, "LINES", 1000)
    plan = queries._relations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert sum("Repartition" in x and f", {-(-lines // 1000)}" in x for x in plan.split("\n")) == 3


def test_sources(spark, tmp_path):
    f = frame(spark, "id int, x double", (1, 1.5), (2, None))
    entry = tables.write_table(f, f"{tmp_path}/a.parquet")
    assert entry["rows"] == 2 and entry["content"] == tables.fingerprint(f.repartition(2))["content"] != tables.fingerprint(f.limit(1))["content"]
    with pytest.raises(FileNotFoundError, match="b.parquet.*c.parquet"):
        tables.load_tables(spark, str(tmp_path), ["a", "b", "c"])
    assert tables.load_tables(spark, str(tmp_path), ["a"])["a"].count() == 2
    (tmp_path / "s.csv").write_text("A,B\n1,x\n")
    assert tables.inspect(tables.read_source(spark, str(tmp_path / "s.csv"))) == {"A": "1", "B": "x"}
    np.save(tmp_path / "m.npy", np.eye(2, dtype=np.float32))
    index = tables.numbered(f, "id")
    assert [r["embedding"] for r in tables.read_matrix(spark, str(tmp_path / "m.npy"), index).orderBy("id").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(ValueError, match="number"):
        tables.read_matrix(spark, str(tmp_path / "m.npy"), index.limit(1))
    body = tables.write_manifest(tmp_path / "m.json", "v1", PopulationConfig(), {"a": entry}, {}, {"sealed_rows": 0})
    assert body["config"]["seed"] == 20_260_908 and len(tables.file_sha256(tmp_path / "m.json")) == 64
    tables.save_parameters(spark, {"w": np.ones((2, 3))}, f"{tmp_path}/model")
    assert tables.load_parameters(spark, f"{tmp_path}/model")["w"].shape == (2, 3)


def test_streamed_status(spark, tmp_path):
    from orrery.streaming.status import item_counts

    frame(spark, "u int, s string, ts timestamp", (1, "a", pd.Timestamp("2024-01-01 10:00").to_pydatetime()), (1, "a", pd.Timestamp("2024-01-01 12:00").to_pydatetime()), (1, "b", pd.Timestamp("2024-01-02 12:00").to_pydatetime())).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u int, s string, ts timestamp").parquet(f"{tmp_path}/in")
    q = item_counts(stream, "u", "s", "ts").writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert sorted((r["s"], r["item_count"]) for r in spark.table("status").collect()) == [("a", 2), ("b", 1)]
