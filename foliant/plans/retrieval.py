"""Retrieval over `embeddings`: a page is a vector, its deck is `label`; queries are the rows whose id is divisible by EVERY."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import retrieve as R

from .tables import table

EVERY, SHARES = 100, 32


def _pages(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("label"), F.col("label").alias("deck"), F.col("embedding").alias("v"))


def _queries(pages):
    return pages.where(f"label % {EVERY} = 0").select(F.col("label").alias("query"), "deck", F.col("v").alias("qv"))


def r1_l2_normalize(spark, sf):
    unit = R.l2_normalize(F.col("v"))
    return _pages(spark, sf).select("label", F.round(R.dot(unit, unit), 6).alias("norm2"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def r2_mean_pool(spark, sf):
    pooled = R.mean_pool(_pages(spark, sf).withColumn("mask", (F.col("label") % 3 != 0).cast("int")), "deck", "v", "mask")
    return pooled.select("deck", F.posexplode("v").alias("dim", "x")).select("deck", "dim", F.round("x", 6).alias("x"))


def r3_dense_topk(spark, sf):
    pages = _pages(spark, sf)
    return R.dense_topk(_queries(pages).drop("deck"), pages.drop("deck"), 10).select("query", "label", "score", "rank")


def r4_deck_topk(spark, sf):
    pages = _pages(spark, sf)
    return R.dense_topk(_queries(pages), pages, 5, scope=["deck"]).select("query", "label", "deck", "score", "rank")


def _multi(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.expr("vec_id div 4").alias("label"), F.struct("vec_id", "embedding").alias("t"))
    return rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["embedding"]).alias("v"))


def r5_maxsim_topk(spark, sf):
    pages = _multi(spark, sf)
    queries = pages.where(f"label % {EVERY} = 0").select(F.col("label").alias("query"), F.col("v").alias("qv"))
    return R.maxsim_topk(queries, pages, 8).select("query", "label", "score", "rank")


def r5_maxsim_long(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.expr("vec_id div 4").alias("label"), F.col("vec_id").alias("tok"), F.col("embedding").alias("v"))
    queries = rows.where(f"label % {EVERY} = 0").select(F.col("label").alias("query"), F.col("tok").alias("qtok"), F.col("v").alias("qv"))
    scored = R.maxsim_long(queries, rows)
    return R.top_k(scored, "query", "score", "label", 8)


def r6_existing_topk(spark, sf):
    pages = _pages(spark, sf)
    there = table(spark, sf, "documents").select(F.col("doc_id").alias("label")).where("label % 2 = 0")
    return R.dense_topk(_queries(pages).drop("deck"), pages.drop("deck"), 5, existing=there).select("query", "label", "score", "rank")


def r7_first_unseen(spark, sf):
    """Episodes that have seen none, one, two or all three of their pages."""
    pages = _pages(spark, sf)
    ranked = R.dense_topk(_queries(pages).drop("deck"), pages.drop("deck"), 3).withColumnRenamed("query", "episode")
    seen = ranked.where(f"rank <= episode div {EVERY} % 4").select("episode", "label")
    return R.first_unseen(ranked, seen, _queries(pages).select(F.col("query").alias("episode")))


def _gold(pages):
    """Few decks hold all pages, so a deck's pages are dealt into SHARES, which each meet a copy of the queries."""
    q = pages.where(f"label % {EVERY} = 0").select(F.col("label").alias("query"), "deck", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    return q.join(pages.select("label", "deck", F.pmod(F.xxhash64("label"), F.lit(SHARES)).cast("int").alias("share")), ["deck", "share"]).select("query", "label", F.when(F.col("deck") < 5, "single").otherwise("multi").alias("hop"))


def r8_recall_report(spark, sf):
    """Flat against deck-scoped retrieval; gold pages are those of the query's deck."""
    pages = _pages(spark, sf)
    flat = R.dense_topk(_queries(pages).drop("deck"), pages.drop("deck"), 20)
    deck = R.dense_topk(_queries(pages), pages, 20, scope=["deck"])
    gold = _gold(pages)
    reports = [R.recall_report(r, gold, (1, 5, 20), "hop").withColumn("scope", F.lit(name)) for name, r in (("flat", flat), ("deck", deck))]
    return reports[0].unionByName(reports[1])


def j11_score_pairs(spark, sf):
    pages = _pages(spark, sf)
    flat = R.score_pairs(_queries(pages).drop("deck", "qv"), pages.select("label", "deck"))
    deck = R.score_pairs(_queries(pages).drop("qv"), pages.select("label", "deck"), ["deck"])
    count = lambda df, scope: df.groupBy("query").agg(F.count("*").alias("pages"), F.sum("label").alias("labels")).withColumn("scope", F.lit(scope))
    return count(flat, "flat").unionByName(count(deck, "deck"))


def r9_index_stats(spark, sf):
    return R.index_stats(_multi(spark, sf))


def r10_augment_index(spark, sf):
    pages = _pages(spark, sf)
    out = R.augment_index(pages.where("label % 3 <> 0").drop("deck"), pages.where("label % 2 = 0").drop("deck"))
    return out.select("label", "part", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def r11_check_index(spark, sf):
    pages = _pages(spark, sf).drop("v")
    return R.check_index(pages.where("label % 7 <> 0"), pages.where("label % 5 <> 0"))


def r12_gold_rank(spark, sf):
    pages = _pages(spark, sf)
    ranked = R.dense_topk(_queries(pages).drop("deck"), pages.drop("deck"), 20)
    return R.gold_rank(ranked.where("label <> query"), _gold(pages))


QUERIES = {f.__name__: f for f in (r1_l2_normalize, r2_mean_pool, r3_dense_topk, r4_deck_topk, r5_maxsim_topk, r5_maxsim_long, r6_existing_topk, r7_first_unseen, r8_recall_report, j11_score_pairs, r9_index_stats, r10_augment_index, r11_check_index, r12_gold_rank)}

_E = """
e AS (SELECT vec_id AS label, label AS deck, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT label, deck, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM e),
s AS (SELECT q.label AS query, q.deck AS qdeck, p.label, p.deck, round(list_inner_product(q.v, p.v), 6) AS score FROM u q JOIN u p ON q.label % 100 = 0)
"""
_TOP = "row_number() OVER (PARTITION BY query ORDER BY score DESC, label)::INT AS rank"
_FLAT = f"flat AS (SELECT query, label, score, {_TOP} FROM s QUALIFY rank <= 20), decks AS (SELECT query, label, score, {_TOP} FROM s WHERE deck = qdeck QUALIFY rank <= 20)"
_GOLD = "gold AS (SELECT q.label AS query, p.label, CASE WHEN q.deck < 5 THEN 'single' ELSE 'multi' END AS hop FROM e q JOIN e p ON q.deck = p.deck AND q.label % 100 = 0)"
_REPORT = """
SELECT '{scope}' AS scope, slice, k, round(avg(hits / gold), 4) AS recall, round(avg((hits = gold)::INT::DOUBLE), 4) AS all_gold, round(avg((hits > 0)::INT::DOUBLE), 4) AS any_gold, count(*) AS n
FROM (SELECT g.query, k, unnest(['all', hop]) AS slice, count(DISTINCT g.label) AS gold, count(DISTINCT r.label) AS hits FROM gold g CROSS JOIN (VALUES (1), (5), (20)) AS t(k)
 LEFT JOIN {ranked} r ON r.query = g.query AND r.label = g.label AND r.rank <= k GROUP BY g.query, hop, k) GROUP BY slice, k
"""
_MULTI = """
m AS (SELECT vec_id // 4 AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v, vec_id AS tok FROM embeddings),
best AS (SELECT q.label AS query, p.label, q.tok, max(list_inner_product(q.v, p.v)) AS b FROM m q JOIN m p ON q.label % 100 = 0 GROUP BY 1, 2, 3),
s AS (SELECT query, label, round(sum(b), 6) AS score FROM best GROUP BY 1, 2)
"""
_R5 = f"WITH {_MULTI} SELECT query, label, score, {_TOP} FROM s QUALIFY rank <= 8"
ORACLE_SQL = {
    "r1_l2_normalize": f"WITH {_E} SELECT label, round(list_inner_product(v, v), 6) AS norm2, round(list_sum(v), 6) AS total FROM u",
    "r2_mean_pool": """
SELECT deck, dim, round(sum(x * m) / greatest(sum(m), 1), 6) AS x FROM (SELECT label AS deck, (vec_id % 3 <> 0)::INT AS m, unnest(embedding)::DOUBLE AS x,
(unnest(range(len(embedding))))::INT AS dim FROM embeddings) GROUP BY deck, dim""",
    "r3_dense_topk": f"WITH {_E} SELECT query, label, score, {_TOP} FROM s QUALIFY rank <= 10",
    "r4_deck_topk": f"WITH {_E} SELECT query, label, deck, score, {_TOP} FROM s WHERE deck = qdeck QUALIFY rank <= 5",
    "r5_maxsim_topk": _R5,
    "r5_maxsim_long": _R5,
    "r6_existing_topk": f"WITH {_E} SELECT query, label, score, {_TOP} FROM s WHERE label IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) QUALIFY rank <= 5",
    "r7_first_unseen": f"""
WITH {_E}, t AS (SELECT query, label, {_TOP} FROM s QUALIFY rank <= 3) SELECT q.label AS episode, (SELECT arg_min(t.label, t.rank) FROM t WHERE t.query =
q.label AND t.rank > q.label // 100 % 4) AS label FROM e q WHERE q.label % 100 = 0""",
    "r8_recall_report": f"WITH {_E}, {_FLAT}, {_GOLD} {_REPORT.format(scope='flat', ranked='flat')} UNION ALL {_REPORT.format(scope='deck', ranked='decks')}",
    "j11_score_pairs": """
SELECT q.vec_id AS query, count(*) AS pages, sum(p.vec_id)::BIGINT AS labels, 'flat' AS scope FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 GROUP BY
1 UNION ALL SELECT q.vec_id, count(*), sum(p.vec_id)::BIGINT, 'deck' FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 100 = 0 GROUP BY
1""",
    "r9_index_stats": "SELECT count(*) AS pages, avg(n) AS mean_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM (SELECT vec_id // 4, count(*) AS n FROM embeddings GROUP BY 1)",
    "r10_augment_index": f"WITH {_E} SELECT label, CASE WHEN label % 3 <> 0 THEN 0 ELSE 1 END AS part, round(list_sum(v), 6) AS total FROM u WHERE label % 3 <> 0 OR label % 2 = 0",
    "r11_check_index": """
SELECT label AS deck, count(*) FILTER (vec_id % 7 <> 0) AS entries, count(*) FILTER (vec_id % 5 <> 0) AS vectors, count(*) FILTER ((vec_id % 7 <> 0) <> (vec_id
% 5 <> 0)) AS unmatched FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 5 <> 0 GROUP BY 1""",
    "r12_gold_rank": f"""
WITH {_E}, {_FLAT}, {_GOLD} SELECT g.query, min(f.rank) AS best_rank, coalesce(min(f.rank) BETWEEN 2 AND 5, false) AS near_miss FROM gold g LEFT JOIN flat f ON
f.query = g.query AND f.label = g.label AND f.label <> f.query GROUP BY g.query""",
}
