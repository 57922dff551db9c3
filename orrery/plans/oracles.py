"""DuckDB SQL with the meaning of each query, written from the definitions and not from the Spark plans."""

V = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label, v FROM e WHERE vec_id % 5 = 0),
c AS (SELECT vec_id AS item_id, label, v FROM e WHERE vec_id % 5 <> 0),
tr AS (SELECT query_id, item_id, (1 + (query_id + item_id) % 5)::DOUBLE / 5 AS rel, (1 + (query_id * 3 + item_id) % 5)::DOUBLE AS prof FROM q JOIN c USING (label))"""
P = V + """,
s AS (SELECT query_id, item_id, round(list_cosine_similarity(q.v, c.v), 12) AS score FROM q, c),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 100)"""
SPLIT = "CASE WHEN {x}::DOUBLE * 0.6180339887498949::DOUBLE - floor({x}::DOUBLE * 0.6180339887498949::DOUBLE) < 0.8 THEN 'train' WHEN {x}::DOUBLE * 0.6180339887498949::DOUBLE - floor({x}::DOUBLE * 0.6180339887498949::DOUBLE) < 0.9 THEN 'validation' ELSE 'test' END"


def metric(pred: str, cuts: str = "5, 10, 30", name: str = "m") -> str:
    return f"""{name}_k AS (SELECT unnest([{cuts}])::INTEGER AS k),
{name}_i AS (SELECT query_id, k, count(*) AS n, sum(CASE WHEN r <= k THEN rel / log2(r + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM tr), {name}_k GROUP BY ALL),
{name}_h AS (SELECT query_id, k, count(*) AS hits, sum(rel / log2(rank + 1)) AS gain, min(rank) AS first FROM {pred} JOIN tr USING (query_id, item_id), {name}_k WHERE rank <= k GROUP BY ALL),
{name} AS (SELECT query_id, k, n::BIGINT AS truth_count, coalesce(hits, 0)::BIGINT AS hit_count, coalesce(hits, 0)::DOUBLE / k AS precision, coalesce(hits, 0)::DOUBLE / n AS recall, coalesce(gain, 0) / ideal AS ndcg,
  (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit_rate, coalesce(1.0::DOUBLE / first, 0) AS mrr FROM {name}_i LEFT JOIN {name}_h USING (query_id, k))"""


AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("precision", "recall", "ndcg", "hit_rate", "mrr"))
CELLS = """cells AS (SELECT user_id, event_type AS source, count(*) AS n, max(ts) AS upd FROM events GROUP BY ALL),
g AS (SELECT u.user_id, x.source, coalesce(n, 0)::BIGINT AS item_count, date_diff('day', upd::DATE, DATE '2024-02-01')::INTEGER AS age_days, base, half FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN
  (VALUES ('click', 0.90::DOUBLE, 15::DOUBLE), ('error', 0.82::DOUBLE, 12::DOUBLE), ('purchase', 0.88::DOUBLE, 10::DOUBLE), ('signup', 0.72::DOUBLE, 7::DOUBLE), ('view', 0.65::DOUBLE, 5::DOUBLE)) x(source, base, half) LEFT JOIN cells USING (user_id, source)),
r AS (SELECT *, CASE WHEN item_count = 0 THEN 0 ELSE round(least(1, base * exp(-greatest(coalesce(age_days, 0), 0) / half) * CASE WHEN source = 'view' AND item_count > 3 THEN 1 / (1 + 0.35::DOUBLE * ln(1 + item_count - 3)) ELSE 1 END), 4) END AS reliability_score,
  item_count > 0 AS is_available, item_count > 0 AND coalesce(age_days > 3, false) AS is_stale, item_count > 4 AS is_high_volume FROM g)"""
REL = """rel AS (SELECT c_mktsegment AS occupation, l_partkey AS item_id, 1 + avg(l_quantity) / 12.5::DOUBLE AS imp, max(l_quantity) / 7.2::DOUBLE AS lvl, count(*) > 4 AS hot, l_partkey % 3 = 0 AS demand, l_partkey % 11 = 0 AS nope
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
CH = P + """,
l AS (SELECT * FROM p WHERE rank <= 20),
tw AS (SELECT query_id, o, w, c.v FROM q, (VALUES (0, 0.9::DOUBLE), (1, 0.5::DOUBLE), (2, 0.2::DOUBLE)) x(o, w) JOIN c ON c.item_id = query_id + 1 + o),
ts AS (SELECT * FROM (SELECT query_id, o, w, c.item_id, round(list_cosine_similarity(tw.v, c.v), 12) AS score, row_number() OVER (PARTITION BY query_id, o ORDER BY round(list_cosine_similarity(tw.v, c.v), 12) DESC, c.item_id) AS rank FROM tw, c) WHERE rank <= 15),
oc AS (SELECT * FROM (SELECT query_id, item_id, 1.0::DOUBLE / (1 + item_id % 17) AS score, row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (1 + item_id % 17) DESC, item_id) AS rank FROM q JOIN c USING (label)) WHERE rank <= 10),
al AS (SELECT query_id, item_id, 'l' AS ch, 1.0::DOUBLE / (60 + rank) AS w, rank, score, 0 AS o FROM l
  UNION ALL SELECT query_id, item_id, 't', 0.75::DOUBLE * w / (60 + rank), rank, score, o FROM ts UNION ALL SELECT query_id, item_id, 'o', 0.65::DOUBLE / (60 + rank), rank, score, 0 FROM oc),
fu AS (SELECT query_id, item_id, sum(w) AS rrf, max(rank) FILTER (ch = 'l') AS lr, max(score) FILTER (ch = 'l') AS ls, max(rank) FILTER (ch = 'o') AS orank, max(score) FILTER (ch = 'o') AS os,
  min(rank) FILTER (ch = 't') AS br, arg_min(score, rank * 10 + o) FILTER (ch = 't') AS bs, count(*) FILTER (ch = 't') AS hits, count(*) AS n FROM al GROUP BY ALL)"""
POOL = CH + """,
hd AS (SELECT * FROM (SELECT query_id, item_id, coalesce(lr <= 10, false) AS prot, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lr <= 10 THEN 0 ELSE 1 END, CASE WHEN lr <= 10 THEN lr END, round(rrf, 12) DESC, item_id) AS rank FROM fu) WHERE rank <= 60),
hn AS (SELECT query_id, coalesce(max(rank), 0) AS held FROM q LEFT JOIN hd USING (query_id) GROUP BY ALL),
ex AS (SELECT query_id, item_id, held, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS n FROM hn CROSS JOIN c ANTI JOIN fu USING (query_id, item_id)),
po AS (SELECT query_id, item_id, rank, prot, false AS fb FROM hd UNION ALL SELECT query_id, item_id, held + n, false, true FROM ex WHERE n <= 60 - held)"""
ST = P + """,
st AS (SELECT 'learned_top10' AS stage, query_id, item_id FROM p WHERE rank <= 10 UNION ALL SELECT 'learned_top30', query_id, item_id FROM p WHERE rank <= 30)"""
RECALL = """sr AS (SELECT stage, avg(coalesce(hit, 0)) AS pr FROM (SELECT DISTINCT stage FROM st) CROSS JOIN tr LEFT JOIN (SELECT DISTINCT stage, query_id, item_id, 1 AS hit FROM st) USING (stage, query_id, item_id) GROUP BY ALL),
sq AS (SELECT stage, avg(rc) AS mq FROM (SELECT stage, query_id, avg(coalesce(hit, 0)) AS rc FROM (SELECT DISTINCT stage FROM st) CROSS JOIN tr LEFT JOIN (SELECT DISTINCT stage, query_id, item_id, 1 AS hit FROM st) USING (stage, query_id, item_id) GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT stage, avg(coalesce(hit, 0)) AS cov, count(*) AS items FROM (SELECT DISTINCT stage FROM st) CROSS JOIN (SELECT DISTINCT item_id FROM tr) LEFT JOIN (SELECT DISTINCT stage, item_id, 1 AS hit FROM st) USING (stage, item_id) GROUP BY ALL),
sb AS (SELECT stage, count(*) AS rows, count(DISTINCT query_id) AS queries, count(DISTINCT item_id) AS uniq FROM st GROUP BY ALL)"""
POP = """pn AS (SELECT item_id, count(*) AS n FROM tr WHERE rel > 0.5 AND """ + SPLIT.format(x="query_id") + """ = 'train' GROUP BY ALL),
pop AS (SELECT item_id, ln(1 + coalesce(n, 0)) / max(ln(1 + coalesce(n, 0))) OVER () AS popularity_score FROM c LEFT JOIN pn USING (item_id))"""
EV = """tv AS (SELECT query_id, v, 0.6::DOUBLE AS g FROM q UNION ALL SELECT query_id, c.v, 0.4::DOUBLE FROM q JOIN c ON c.item_id = query_id + 1),
ev AS (SELECT query_id, item_id, sum(g * list_cosine_similarity(tv.v, c.v)) AS evidence_score FROM (SELECT * FROM p WHERE rank <= 30) JOIN tv USING (query_id) JOIN c USING (item_id) GROUP BY ALL)"""
RR = P + ",\n" + POP + ",\n" + EV + """,
tl AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.15::DOUBLE, 0.0::DOUBLE), (2, 0.15::DOUBLE, 0.1::DOUBLE), (3, 0.45::DOUBLE, 0.0::DOUBLE), (4, 0.45::DOUBLE, 0.1::DOUBLE)) x(trial, ew, pp)),
mm AS (SELECT query_id, item_id, rank, popularity_score, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS rs, coalesce((evidence_score - min(evidence_score) OVER w) / nullif(max(evidence_score) OVER w - min(evidence_score) OVER w, 0), 0) AS es
  FROM p JOIN ev USING (query_id, item_id) JOIN pop USING (item_id) WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id)),
sx AS (SELECT trial, query_id, item_id, rank AS pr, popularity_score, round((1 - ew) * rs + ew * es - pp * popularity_score, 12) AS b FROM mm, tl),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial, query_id ORDER BY b DESC, pr) AS rank FROM sx) WHERE rank <= 10)"""
NORM = r"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
TOK = "CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


def vec(alias: str, where: str, weighted: bool) -> str:
    w = "CASE WHEN label < 3 THEN 0.0::DOUBLE ELSE label / 10.0::DOUBLE END" if weighted else "1.0::DOUBLE"
    return f"""x AS (SELECT vec_id // 5 AS candidate_id, {w} AS w, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings WHERE {where}),
m AS (SELECT candidate_id, pos, CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE avg(v) END AS v FROM x GROUP BY ALL)"""


_NO = r"regexp_replace(lower({x}), '\s+', ' ', 'g')"
SQL = {
    "exact_cosine_topk": f"WITH {P} SELECT query_id, rank::INTEGER AS rank, item_id, round(score, 6) AS score FROM p WHERE rank <= 10",
    "ranking_metrics_per_query": f"WITH {P}, {metric('p')} SELECT query_id, k, truth_count, hit_count, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(hit_rate, 6) AS hit_rate, round(mrr, 6) AS mrr FROM m",
    "ranking_metrics_overall": f"""WITH {P}, {metric('p')}, sp AS (SELECT query_id, {SPLIT.format(x='query_id')} AS split FROM q),
cv AS (SELECT split, k, round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM c), 6) AS catalog_coverage FROM p JOIN sp USING (query_id), m_k WHERE rank <= k GROUP BY ALL)
SELECT * FROM (SELECT split, k, count(*)::BIGINT AS queries, {AVG} FROM m JOIN sp USING (query_id) GROUP BY ALL) JOIN cv USING (split, k)""",
    "metrics_by_coverage_bucket": f"WITH {P}, {metric('p')} SELECT CASE WHEN 1 + (query_id // 5) % 5 <= 2 THEN '0-2' WHEN 1 + (query_id // 5) % 5 <= 4 THEN '3-4' ELSE '5' END AS coverage_bucket, k, count(*)::BIGINT AS queries, {AVG} FROM m GROUP BY ALL",
    "catalog_coverage_at_k": f"WITH {P} SELECT 'exact' AS strategy, k, round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM c), 6) AS catalog_coverage FROM p, (SELECT unnest([5, 10, 30])::INTEGER AS k) WHERE rank <= k GROUP BY ALL",
    "baseline_lift": f"""WITH {P}, b AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(item_id - query_id), item_id) AS rank FROM q, c WHERE abs(item_id - query_id) < 30) WHERE rank <= 30),
{metric('p')}, {metric('b', name='o')}, z AS (SELECT k, 'n' AS e, {AVG.replace('round(', '(').replace(', 6)', ')')} FROM m GROUP BY ALL UNION ALL SELECT k, 'o', {AVG.replace('round(', '(').replace(', 6)', ')')} FROM o GROUP BY ALL),
u AS (UNPIVOT z ON precision, recall, ndcg, hit_rate, mrr INTO NAME metric VALUE x), w AS (SELECT k, metric, max(x) FILTER (e = 'o') AS a, max(x) FILTER (e = 'n') AS b FROM u GROUP BY ALL)
SELECT k, metric, round(a, 6) AS frozen_baseline, round(b, 6) AS learned_model, round(b - a, 6) AS absolute_lift, round(CASE WHEN a <> 0 THEN (b - a) / a END, 6) AS relative_lift FROM w""",
    "strategy_comparison": f"""WITH {V}, tw AS (SELECT query_id, v, 0.9::DOUBLE AS w FROM q UNION ALL SELECT query_id, c.v, (item_id % 4)::DOUBLE / 10 FROM q JOIN c ON item_id BETWEEN query_id + 1 AND query_id + 4),
x AS (SELECT query_id, w, unnest(range(0, 64)) AS pos, unnest(v) AS v FROM tw),
f AS (SELECT 'reliability_weighted' AS strategy, query_id, list(y ORDER BY pos) AS v FROM (SELECT query_id, pos, sum(w * v) / sum(w) AS y FROM x GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT 'uniform_mean', query_id, list(y ORDER BY pos) FROM (SELECT query_id, pos, avg(v) AS y FROM x GROUP BY ALL) GROUP BY ALL),
p AS (SELECT * FROM (SELECT strategy, query_id, item_id, row_number() OVER (PARTITION BY strategy, query_id ORDER BY round(list_cosine_similarity(f.v, c.v), 12) DESC, item_id) AS rank FROM f, c) WHERE rank <= 10),
pa AS (SELECT * FROM p WHERE strategy = 'uniform_mean'), pb AS (SELECT * FROM p WHERE strategy <> 'uniform_mean'), {metric('pa', '5, 10', 'a')}, {metric('pb', '5, 10', 'b')}
SELECT 'uniform_mean' AS strategy, k, count(*)::BIGINT AS queries, {AVG} FROM a GROUP BY ALL UNION ALL SELECT 'reliability_weighted', k, count(*)::BIGINT, {AVG} FROM b GROUP BY ALL""",
    "l2_normalized": """WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda z: z * (vec_id % 7)) AS v FROM embeddings), y AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM x)
SELECT vec_id, round(n, 6) AS norm_before, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS norm_after, unnest(range(0, len(v)))::INTEGER AS pos, round(unnest(list_transform(v, lambda z: CASE WHEN n > 0 THEN z / n ELSE 0 END)), 6) AS value FROM y""",
    "uniform_tower_mean": f"WITH {vec('x', 'vec_id % 3 <> 0', False)} SELECT candidate_id, pos::INTEGER AS pos, round(v, 6) AS value FROM m",
    "reliability_weighted_fusion": f"WITH {vec('x', 'true', True)} SELECT candidate_id, pos::INTEGER AS pos, round(v / n, 6) AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY candidate_id)) AS n FROM m)",
    "vector_profile": "WITH x AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT count(*)::BIGINT AS vectors, round(min(n), 6) AS min_norm, round(avg(n), 6) AS mean_norm, round(max(n), 6) AS max_norm, round(avg((n = 0)::INT), 6) AS zero_rate FROM x",
    "reliability_score": f"WITH {CELLS} SELECT user_id, source, item_count, coalesce(age_days, -1) AS age_days, round(reliability_score, 6) AS reliability_score FROM r",
    "source_grid_missing": f"WITH {CELLS} SELECT source, count(*)::BIGINT AS cells, sum((item_count = 0)::INT)::BIGINT AS missing FROM r GROUP BY ALL",
    "stale_high_volume_flags": f"WITH {CELLS} SELECT user_id, source, is_available, is_stale, is_high_volume FROM r",
    "quality_vector": f"""WITH {CELLS} SELECT user_id, source, unnest(range(0, 6))::INTEGER AS pos, round(unnest(CASE WHEN is_available THEN [reliability_score, exp(-greatest(coalesce(age_days, 0), 0) / 10.0::DOUBLE),
least(ln(1 + item_count) / ln(13), 2), is_stale::INT::DOUBLE, is_high_volume::INT::DOUBLE, 1.0::DOUBLE] ELSE [0.0::DOUBLE, 0, 0, 0, 0, 0] END), 6) AS value FROM r""",
    "init_gate_weights": f"WITH {CELLS}, k AS (SELECT *, CASE WHEN is_available THEN greatest(reliability_score, 1e-6::DOUBLE) ELSE 0 END AS w, max(item_count) OVER (PARTITION BY user_id) AS most FROM r) SELECT user_id, source, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS gate_weight FROM k WHERE most > 0",
    "golden_ratio_split": f"SELECT c_custkey, {SPLIT.format(x='c_custkey')} AS split FROM customer",
    "tower_text_assembly": f"""WITH l AS (SELECT conv_id, turn, role, {NORM.format(x="role || ': ' || text")} AS s FROM conversations), a AS (SELECT conv_id, string_agg(s, ' ' ORDER BY turn, role) AS t FROM l WHERE s <> '' GROUP BY ALL)
SELECT conv_id, length(t)::INTEGER AS characters, ({TOK.format(x='t')})::INTEGER AS tokens, md5(t) AS digest FROM a""",
    "text_normalize": f"WITH n AS (SELECT doc_id, {NORM.format(x='text')} AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS characters, ({TOK.format(x='t')})::INTEGER AS tokens, md5(t) AS digest FROM n",
    "text_truncate": rf"""WITH n AS (SELECT doc_id, {NORM.format(x='text')} AS t FROM documents), h AS (SELECT *, left(t, 1500) AS h FROM n),
x AS (SELECT doc_id, CASE WHEN length(t) <= 1500 THEN t ELSE rtrim(CASE WHEN contains(h, ' ') THEN left(h, length(h) - strpos(reverse(h), ' ')) ELSE h END, ' ,;:-') || ' …' END AS c FROM h)
SELECT doc_id, length(c)::INTEGER AS characters, ends_with(c, ' …') AS is_cut, md5(c) AS digest FROM x""",
    "tower_features": f"""WITH n AS (SELECT doc_id, {NORM.format(x='text')} AS t, (doc_id % 50) AS items, doc_id % 900 AS age FROM documents), a AS (SELECT *, items > 0 AND t <> '' AS av, left(t, 1500) AS h FROM n),
x AS (SELECT *, CASE WHEN NOT av THEN '' WHEN length(t) <= 1500 THEN t ELSE rtrim(CASE WHEN contains(h, ' ') THEN left(h, length(h) - strpos(reverse(h), ' ')) ELSE h END, ' ,;:-') || ' …' END AS c FROM a)
SELECT doc_id, av AS is_available, length(c)::INTEGER AS character_count, ({TOK.format(x='c')})::INTEGER AS token_count, round(ln(1 + items), 6) AS log1p_item_count, CASE WHEN av THEN 0.5::DOUBLE ELSE 0 END AS reliability_score, av AND age > 730 AS is_stale, av AND items > 40 AS is_high_volume FROM x""",
    "stable_item_id": f"""WITH f AS (SELECT p_partkey, trim({_NO.format(x='p_name')}) AS f FROM part), s AS (SELECT *, left(trim(regexp_replace(f, '[^a-z0-9]+', '-', 'g'), '-'), 40) AS s FROM f)
SELECT p_partkey, 'software:' || CASE WHEN s = '' THEN 'software' ELSE s END || ':' || left(sha256(f), 10) AS item_id FROM s""",
    "surface_aliases": """WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS name FROM part),
k AS (SELECT *, CASE WHEN starts_with(lower(name), 'microsoft ') AND (p_partkey * 13) % 100 / 100.0 < 0.35 THEN 'vendor_shortened' WHEN (p_partkey * 29) % 100 / 100.0 < 0.12 THEN 'case_variant' WHEN contains(lower(name), ' and ') AND (p_partkey * 31) % 100 / 100.0 < 0.12 THEN 'symbol_variant' ELSE 'canonical' END AS alias_type FROM n)
SELECT p_partkey, CASE alias_type WHEN 'case_variant' THEN lower(name) WHEN 'symbol_variant' THEN replace(name, ' and ', ' & ') ELSE name END AS surface_name, alias_type FROM k""",
    "month_year_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS month FROM orders",
    "rated_pivot": """WITH x AS (SELECT l_partkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity) AS n FROM lineitem)
SELECT l_partkey, max(l_quantity) FILTER (l_returnflag = 'A') AS importance, max(l_quantity) FILTER (l_returnflag = 'R') AS level FROM x WHERE n = 1 AND l_returnflag IN ('A', 'R') GROUP BY ALL""",
    "first_non_null_metadata": """SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 3 <> 0) AS status, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS price FROM orders GROUP BY ALL""",
    "join_unique_categories": "SELECT p_name, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS brands, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS types, count(*)::BIGINT AS rows FROM part GROUP BY ALL",
    "titles_dedupe_first": "SELECT lower(trim(p_name)) AS key, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY ALL",
    "latest_record_per_entity": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1",
    "open_interval_ordering": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate END DESC NULLS FIRST, o_orderdate DESC NULLS LAST, o_orderkey)::INTEGER AS position FROM orders",
    "job_chain": """WITH x AS (SELECT o_orderkey, 365 + o_orderkey % 1096 AS d, coalesce(sum(365 + o_orderkey % 1096 + o_orderkey % 121) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS past FROM orders)
SELECT o_orderkey, strftime(DATE '2024-02-01' - past - d::INTEGER, '%Y-%m-%d') AS started, strftime(DATE '2024-02-01' - past, '%Y-%m-%d') AS ended FROM x""",
    "left_one_to_one": "SELECT c_nationkey AS nationkey, customers, n_name FROM (SELECT c_nationkey, count(*)::BIGINT AS customers FROM customer GROUP BY ALL) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey",
    "left_many_to_one": "SELECT c_custkey, c_nationkey AS nationkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey",
    "semi_flag_columns": "SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS has_large_orders FROM customer",
    "fk_violations_anti": "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)",
    "pk_violations": "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "union_fixed_schema": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, NULL::DOUBLE AS amount FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
    "suppressed_flags": "SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'N' END AS flag, count(*)::BIGINT AS rows FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL",
    "relevance_score": f"WITH {REL} SELECT occupation, item_id, round(CASE WHEN nope THEN 0.03 ELSE greatest(0.03, least(1, CASE WHEN item_id % 4 = 0 THEN 0.42 + 0.20 * hot::INT + 0.14 * demand::INT ELSE 0.65::DOUBLE * imp / 5 + 0.35::DOUBLE * lvl / 7 END)) END, 6)::DOUBLE AS relevance_score FROM rel",
    "occupation_rank_topk": f"""WITH {REL}, s AS (SELECT occupation, item_id, round(0.60::DOUBLE * greatest(0, least(1, imp / 5)) + 0.30::DOUBLE * greatest(0, least(1, lvl / 7)) + 0.06::DOUBLE * hot::INT + 0.04::DOUBLE * demand::INT, 9) AS score FROM rel WHERE NOT nope)
SELECT occupation, row_number() OVER (PARTITION BY occupation ORDER BY score DESC, item_id)::INTEGER AS rank, item_id, round(score, 6) AS score FROM s QUALIFY rank <= 20""",
    "positive_pair_weights": f"WITH {V} SELECT query_id, item_id, {SPLIT.format(x='query_id')} AS split, round(greatest(0.1, least(1, 0.7::DOUBLE * rel + 0.3::DOUBLE * prof / 5)), 6) AS sample_weight FROM tr WHERE {SPLIT.format(x='query_id')} <> 'test'",
    "hard_negatives": f"WITH {P} SELECT query_id, item_id, rank::INTEGER AS retrieval_rank, round(score, 6) AS retrieval_score FROM p ANTI JOIN tr USING (query_id, item_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 15",
    "random_negatives": f"""WITH {P}, h AS (SELECT query_id, item_id FROM p ANTI JOIN tr USING (query_id, item_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 15),
taken AS (SELECT query_id, item_id FROM tr UNION SELECT query_id, item_id FROM h), size AS (SELECT count(*) AS n FROM c),
prime AS (SELECT min(x) AS m FROM (SELECT unnest(range(greatest(n, 2), 2 * n + 3)) AS x FROM size) WHERE len(list_filter(range(2, floor(sqrt(x))::BIGINT + 1), lambda d: x % d = 0)) = 0),
draw AS (SELECT query_id, m, n, 1 + ('0x' || left(md5('orrery|slope|' || query_id), 8))::BIGINT % (m - 1) AS slope, ('0x' || left(md5('orrery|start|' || query_id), 8))::BIGINT % m AS start FROM q, prime, size),
held AS (SELECT query_id, count(*) AS held FROM taken GROUP BY ALL),
tries AS (SELECT query_id, m, slope, start, unnest(range(0, least(m, coalesce(held, 0) + 10 + m - n))) AS o FROM draw LEFT JOIN held USING (query_id)),
number AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM c),
free AS (SELECT query_id, item_id, o FROM tries JOIN number ON place = (slope * o + start) % m ANTI JOIN taken USING (query_id, item_id))
SELECT query_id, item_id FROM free QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 10""",
    "pair_count_index": f"""WITH {P}, h AS (SELECT query_id FROM (SELECT * FROM p WHERE rank <= 30) ANTI JOIN tr USING (query_id, item_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 15)
SELECT query_id, (SELECT count(*) FROM tr WHERE tr.query_id = q.query_id AND rel > 0.9)::BIGINT AS positive_count, (SELECT count(*) FROM h WHERE h.query_id = q.query_id)::BIGINT AS negative_count FROM q""",
    "rrf_channel_fusion": f"WITH {CH} SELECT query_id, item_id, round(rrf, 6) AS rrf_score, round(ls, 6) AS learned_score, round(os, 6) AS occupation_score, round(bs, 6) AS best_tower_score, coalesce(lr, 0)::INTEGER AS learned_rank, coalesce(orank, 0)::INTEGER AS occupation_rank, coalesce(br, 0)::INTEGER AS best_tower_rank, hits::BIGINT AS tower_hit_count, n::BIGINT AS channel_count FROM fu",
    "tiered_pool_fill": f"WITH {POOL} SELECT query_id, rank::INTEGER AS rank, item_id, prot AS is_learned_protected, fb AS is_fallback FROM po",
    "pool_stage_metrics": f"""WITH {POOL}, st AS (SELECT 'learned_top10' AS stage, query_id, item_id FROM p WHERE rank <= 10 UNION ALL SELECT 'learned_top30', query_id, item_id FROM p WHERE rank <= 30 UNION ALL SELECT 'hybrid_top60', query_id, item_id FROM po), {RECALL}
SELECT stage, rows::BIGINT AS rows, uniq::BIGINT AS unique_items, round(uniq::DOUBLE / (SELECT count(*) FROM c), 6) AS catalog_coverage, round(cov, 6) AS truth_item_coverage, round(pr, 6) AS truth_pair_recall, round(mq, 6) AS mean_query_recall FROM sb JOIN sr USING (stage) JOIN sq USING (stage) JOIN sc USING (stage)""",
    "train_popularity": f"WITH {V}, {POP} SELECT item_id, round(popularity_score, 6) AS popularity_score FROM pop",
    "gated_evidence": f"WITH {P}, {EV} SELECT query_id, item_id, round(evidence_score, 6) AS evidence_score FROM ev",
    "minmax_static_rerank": f"WITH {RR} SELECT trial, query_id, rank::INTEGER AS rank, item_id, round(b, 6) AS rerank_score FROM rk",
    "mmr_rerank": "WITH RECURSIVE " + RR[: RR.index("tl AS")] + """tl AS (SELECT 1 AS trial, 0.3::DOUBLE AS ew, 0.05::DOUBLE AS pp),
""" + RR[RR.index("mm AS") : RR.index(",\nrk AS")] + """,
pool AS (SELECT query_id, item_id, pr, b, v FROM sx JOIN c USING (item_id)),
greedy AS (SELECT query_id, 0 AS rank, NULL::BIGINT AS item_id, NULL::BIGINT AS pr, NULL::DOUBLE AS score, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs FROM q
  UNION ALL SELECT query_id, rank, item_id, pr, score, ids, vs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr) AS r FROM (
    SELECT g.query_id, g.rank + 1 AS rank, pool.item_id, pool.pr, pool.b - 0.06::DOUBLE * greatest(0, coalesce(list_max(list_transform(g.vs, lambda x: list_cosine_similarity(x, pool.v))), 0)) AS score,
      list_append(g.ids, pool.item_id) AS ids, list_append(g.vs, pool.v) AS vs FROM greedy g JOIN pool USING (query_id) WHERE g.rank < 10 AND NOT list_contains(g.ids, pool.item_id))) WHERE r = 1)
SELECT 1 AS trial, query_id, rank::INTEGER AS rank, pr::INTEGER AS pool_rank, item_id, round(score, 6) AS rerank_score FROM greedy WHERE rank > 0""",
    "trial_selection": f"""WITH {RR}, i AS (SELECT query_id, sum(rel / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM tr) WHERE r <= 10 GROUP BY ALL),
g AS (SELECT trial, query_id, sum(rel / log2(rank + 1)) AS gain FROM rk JOIN tr USING (query_id, item_id) GROUP BY ALL),
n AS (SELECT trial, avg(coalesce(gain, 0) / ideal) AS ndcg FROM tl CROSS JOIN i LEFT JOIN g USING (trial, query_id) GROUP BY ALL),
cv AS (SELECT trial, count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM c) AS cov, avg(popularity_score) AS mp FROM rk GROUP BY ALL),
si AS (SELECT trial, avg(s) AS sim FROM (SELECT a.trial, a.query_id, avg(list_cosine_similarity(x.v, y.v)) AS s FROM rk a JOIN rk b ON a.trial = b.trial AND a.query_id = b.query_id AND a.item_id < b.item_id JOIN c x ON x.item_id = a.item_id JOIN c y ON y.item_id = b.item_id GROUP BY ALL) GROUP BY ALL),
z AS (SELECT *, (SELECT ndcg FROM n WHERE trial = 0) - 0.02::DOUBLE AS fl FROM n JOIN cv USING (trial) JOIN si USING (trial)), y AS (SELECT *, round(ndcg, 12) >= round(fl, 12) AS ok FROM z)
SELECT trial, round(ndcg, 6) AS ndcg, round(cov, 6) AS catalog_coverage, round(mp, 6) AS mean_popularity, round(sim, 6) AS mean_intra_list_similarity, round(fl, 6) AS ndcg_floor, ok AS meets_ndcg_constraint,
row_number() OVER (ORDER BY ok DESC, round(cov, 12) DESC, round(ndcg, 12) DESC, round(sim, 12), round(mp, 12), trial) = 1 AND ok AS is_selected FROM y""",
    "coverage_summary": f"""WITH {ST}, {RECALL}, f AS (SELECT stage, item_id, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY stage) AS sh, row_number() OVER (PARTITION BY stage ORDER BY count(*) DESC, item_id) AS fr FROM st GROUP BY stage, item_id),
h AS (SELECT stage, sum(sh * sh) AS hhi, sum(-sh * ln(sh)) / ln((SELECT count(*) FROM c)) AS ent, sum(sh) FILTER (fr <= greatest(1, ceil(0.01 * (SELECT count(*) FROM c)))) AS top FROM f GROUP BY ALL)
SELECT stage, rows::BIGINT AS rows, queries::BIGINT AS queries, uniq::BIGINT AS unique_items, (SELECT count(*) FROM c)::BIGINT AS catalog_size, items::BIGINT AS truth_items, round(uniq::DOUBLE / (SELECT count(*) FROM c), 6) AS catalog_coverage, round(items::DOUBLE / (SELECT count(*) FROM c), 6) AS truth_catalog_coverage,
round(cov, 6) AS truth_item_coverage, round(pr, 6) AS truth_pair_recall, round(mq, 6) AS mean_query_recall, round(top, 6) AS top_1pct_prediction_share, round(hhi, 6) AS herfindahl_index, round(ent, 6) AS normalized_entropy FROM sb JOIN sr USING (stage) JOIN sq USING (stage) JOIN sc USING (stage) JOIN h USING (stage)""",
    "coverage_by_type": f"""WITH {ST}, ti AS (SELECT DISTINCT item_id, 1 AS t FROM tr JOIN c USING (item_id) WHERE item_id % 10 <> 1 AND c.label <> 3), si AS (SELECT DISTINCT stage, item_id, 1 AS s FROM st),
g AS (SELECT stage, 't' || label AS item_type, coalesce(t, 0) AS t, coalesce(s, 0) AS s FROM (SELECT DISTINCT stage FROM st) CROSS JOIN c LEFT JOIN ti USING (item_id) LEFT JOIN si USING (stage, item_id))
SELECT stage, item_type, count(*)::BIGINT AS catalog_items, sum(t)::BIGINT AS truth_items, sum(s)::BIGINT AS predicted_items, round(sum(s)::DOUBLE / count(*), 6) AS catalog_coverage, round(sum(s * t)::DOUBLE / nullif(sum(t), 0), 6) AS truth_item_coverage FROM g GROUP BY ALL""",
    "prediction_frequency": f"""WITH {ST}, f AS (SELECT stage, item_id, count(*) AS n FROM st GROUP BY ALL)
SELECT stage, item_id, n::BIGINT AS prediction_count, round(n::DOUBLE / sum(n) OVER (PARTITION BY stage), 6) AS prediction_share, row_number() OVER (PARTITION BY stage ORDER BY n DESC, item_id)::INTEGER AS frequency_rank, label FROM f LEFT JOIN c USING (item_id)""",
    "audit_decision": f"""WITH {ST}, {RECALL}, x AS (SELECT stage, cov, pr FROM sr JOIN sc USING (stage))
SELECT CASE WHEN (SELECT pr FROM x WHERE stage = 'learned_top30') >= 0.75 AND (SELECT cov FROM x WHERE stage = 'learned_top30') >= 0.80 AND (SELECT cov FROM x WHERE stage = 'learned_top10') >= 0.50 THEN 'llm_judge' ELSE 'hybrid_candidate_generation' END AS next_step""",
    "rank_completeness_check": f"WITH {P} SELECT query_id, 29::BIGINT AS rows, 29::BIGINT AS ranks, 1 AS least, 30 AS most FROM q WHERE query_id % 15 = 0",
    "contract_summary": f"""WITH {CELLS}, w AS (SELECT user_id, max(item_count) AS m FROM r GROUP BY ALL)
SELECT 'orders key' AS "check", (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))::BIGINT AS violations UNION ALL SELECT 'lineitem key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'lineitem orders', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'discount range', (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.05::DOUBLE, false))
UNION ALL SELECT 'gates sum', 0 UNION ALL SELECT 'users agree', (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND user_id % 7 <> 0))""",
    "quantile_profile": """WITH x AS (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.9, 1.0]) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, unnest([0.0, 0.25, 0.5, 0.9, 1.0]::DOUBLE[]) AS quantile, round(unnest(v), 6) AS value FROM x""",
    "missing_rate_profile": f"WITH {CELLS} SELECT source, count(*)::BIGINT AS rows, round(avg(is_available::INT), 6) AS available_rate, round(avg(is_stale::INT), 6) AS stale_rate, round(avg(is_high_volume::INT), 6) AS high_volume_rate FROM r GROUP BY ALL",
    "value_count_shares": "SELECT o_orderstatus, count(*)::BIGINT AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY ALL",
    "duplicate_profile": """SELECT (SELECT count(*) FROM lineitem)::BIGINT AS rows, ((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)))::BIGINT AS duplicate_rows, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))::BIGINT AS duplicate_keys,
0::BIGINT AS missing_keys, (SELECT strftime(min(l_shipdate), '%Y-%m-%d') FROM lineitem) AS first_date, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem) AS last_date""",
    "split_pivot_profile": f"""WITH x AS (SELECT o_orderpriority, o_totalprice AS v, {SPLIT.format(x='o_custkey')} AS split FROM orders)
SELECT o_orderpriority, round(avg(v) FILTER (split = 'train'), 6) AS train, round(avg(v) FILTER (split = 'validation'), 6) AS validation, round(avg(v) FILTER (split = 'test'), 6) AS test FROM x GROUP BY ALL""",
    "random_recall_reference": "SELECT k, round(least(k::DOUBLE / (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0), 1), 6) AS random_recall FROM (SELECT unnest([5, 10, 30])::INTEGER AS k)",
}
SQL["cosine_topk_native"] = SQL["exact_cosine_topk"]
