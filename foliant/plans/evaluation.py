"""Evaluation over documents joined with their labels: quality is the verdict, unlabelled documents are unjudged."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import evaluate as A

from .tables import table


def _preds(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    out = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return out.select("*", (F.col("quality") == 1).alias("ok"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("hop"), F.when(F.col("doc_id") % 7 == 0, "limit").otherwise("answer").alias("ended"))


def _steps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _r(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def a1_eval_summary(spark, sf):
    p = _preds(spark, sf).withColumn("turns", F.col("doc_id") % 9).withColumn("crops", F.col("doc_id") % 3)
    out = A.eval_summary(p, "ended", {"turns": "turns", "crops": "crops"}, F.col("doc_id") % 2 == 0, F.col("doc_id") % 6 == 0, F.col("doc_id") % 5)
    return _r(out.withColumn("ends", F.to_json("ends")), "mean_turns", "mean_crops", "any_turns", "any_crops", "coverage", "mean_non_gold")


def a2_accuracy_by_hop(spark, sf):
    return _r(A.accuracy_by(_preds(spark, sf), "hop", "ok"), "accuracy")


def a3_judge_summary(spark, sf):
    return _r(A.judge_summary(_preds(spark, sf), "ok", F.col("toxic") == 1), "accuracy")


def a4_accuracy_by_multilabel(spark, sf):
    p = _preds(spark, sf).withColumn("cats", F.array("lang", F.concat(F.lit("s"), F.col("doc_id") % 3), "lang"))
    return _r(A.accuracy_by_multilabel(p, "cats", "ok"), "accuracy")


def a5_accuracy_splits(spark, sf):
    return _r(A.accuracy_splits(_preds(spark, sf), "lang", ["de", "en", "it"], "ok"), "accuracy")


def a6_crosstab(spark, sf):
    return _r(A.crosstab(_preds(spark, sf), "hop", "source", "ok"), "accuracy")


def a7_judge_totals(spark, sf):
    return A.judge_totals(_preds(spark, sf), "source", "ok", F.col("doc_id") % 13 == 0)


def a8_trace_stats(spark, sf):
    return _r(A.trace_stats(_steps(spark, sf), "user_id", "event_type", 70), "mean_length", "at_limit", "share")


def a9_accuracy_by_termination(spark, sf):
    return _r(A.accuracy_by(_preds(spark, sf), "ended", "ok"), "accuracy")


def a10_top_errors(spark, sf):
    return A.top_errors(_steps(spark, sf).withColumn("message", F.concat(F.lit("m"), F.col("k") % 30)), "event_type", "message")


def a11_examples(spark, sf):
    return A.examples(_preds(spark, sf), "source", "doc_id", 3).select("doc_id", "source", "rank")


def a12_summary_v1(spark, sf):
    return _r(A.summary_v1(_preds(spark, sf), "n_chars", "ended", ["answer", "limit", "error"]), "mean_iterations")


def a13_summary_baseline(spark, sf):
    out = A.summary_baseline(_steps(spark, sf), "user_id", {"search": F.col("event_type") == "view", "summarise": F.col("event_type") == "click"})
    return _r(out, "mean_steps", "search_mean", "summarise_mean")


def a14_corpus_stats(spark, sf):
    p = _preds(spark, sf).withColumn("n_ev", F.col("doc_id") % 4 + 1).withColumn("arith", F.when(F.col("doc_id") % 3 == 0, "None").when(F.col("doc_id") % 3 == 1, "a+b"))
    return A.corpus_stats(p, "lang", "source", "n_ev", "arith").withColumn("evidence_sizes", F.to_json("evidence_sizes"))


def a15_upper_median(spark, sf):
    return A.upper_median(_preds(spark, sf), "n_chars", "lang")


def a17_run_totals(spark, sf):
    p = _preds(spark, sf).withColumn("kept", F.coalesce("ok", F.lit(False))).withColumn("reasons", F.array_compact(F.array(F.when(F.col("ok").isNull(), "judge: missing"), F.when(F.col("n_chars") < 500, "short: text"))))
    p = p.withColumn("tags", F.create_map(F.lit("crop"), F.col("doc_id") % 2, F.lit("revisit"), F.col("doc_id") % 3))
    return A.run_totals(p, "kept", "lang", "reasons", "tags")


def a18_subset_summary(spark, sf):
    return A.subset_summary(_preds(spark, sf), "lang", "n_chars", {"de": 10_000, "en": 100, "it": 5})


def a19_merge_summary(spark, sf):
    return A.merge_summary(_preds(spark, sf).withColumn("key", F.col("doc_id") % 300), "key", "source")


def a25_validate_summary(spark, sf):
    return _r(A.validate_summary(_steps(spark, sf), "event_type", "user_id", "value", "k"), "mean_score", "tool_calls")


def a30_passk(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("ok"))
    return _r(A.passk(o, "o_custkey", "ok"), "pass_k", "pass_1")


def a31_paired_flips(spark, sf):
    p = _preds(spark, sf).where("ok IS NOT NULL")
    return A.paired_flips(p, p.withColumn("ok", F.col("doc_id") % 3 != 0), "doc_id", "lang", "ok")


def a34_progress(spark, sf):
    """Every document is expected."""
    return _r(A.progress(table(spark, sf, "labels"), table(spark, sf, "documents").count(), "doc_id", "doc_id"), "percent")


def a35_pack_stats(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("t"))
    return A.pack_stats(c, "t")


def a36_episode_outcomes(spark, sf):
    s = _steps(spark, sf).withColumn("ok", F.col("k") % 2 == 0).withColumn("src", F.col("user_id") % 4).withColumn("value", F.when(F.col("k") % 5 != 0, F.col("value")))
    return _r(A.episode_outcomes(s, "user_id", "event_id", F.col("event_type") != "error", "src", "ok", "value"), "success", "reward")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "a" and k[1].isdigit()}

_P = "WITH p AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, quality = 1 AS ok, CASE WHEN d.doc_id % 4 <> 0 THEN lang END AS hop, CASE WHEN d.doc_id % 7 = 0 THEN 'limit' ELSE 'answer' END AS ended FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_S = "WITH s AS (SELECT event_id, user_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events)"
_ACC = "count(*) AS judged, sum(ok::INT)::BIGINT AS correct, round(avg(ok::INT), 9) AS accuracy FROM p WHERE ok IS NOT NULL GROUP BY 1"
_ALL = "count(*) AS n, sum(coalesce(ok::INT, 0))::BIGINT AS correct, round(avg(coalesce(ok::INT, 0)), 9) AS accuracy"
ORACLE_SQL = {
    "a1_eval_summary": f"""
{_P} SELECT count(*) AS n, round(avg(doc_id % 9), 9) AS mean_turns, round(avg(doc_id % 3), 9) AS mean_crops, round(avg((doc_id % 9 > 0)::INT), 9) AS any_turns,
round(avg((doc_id % 3 > 0)::INT), 9) AS any_crops, round(avg((doc_id % 6 = 0)::INT) FILTER (doc_id % 2 = 0), 9) AS coverage, round(avg(doc_id % 5) FILTER
(doc_id % 2 = 0), 9) AS mean_non_gold, '{{\"answer\":' || count(*) FILTER (ended = 'answer') || ',\"limit\":' || count(*) FILTER (ended = 'limit') || '}}' AS
ends FROM p""",
    "a2_accuracy_by_hop": f"{_P} SELECT coalesce(hop, 'None') AS hop, {_ACC}",
    "a3_judge_summary": f"{_P} SELECT count(ok) AS judged, sum(ok::INT)::BIGINT AS correct, count(*) FILTER (toxic = 1) AS errors, round(avg(ok::INT), 9) AS accuracy FROM p",
    "a4_accuracy_by_multilabel": f"{_P} SELECT category, {_ALL} FROM (SELECT ok, unnest([lang, 's' || doc_id % 3]) AS category FROM p) GROUP BY 1",
    "a5_accuracy_splits": f"""
{_P}, s AS (SELECT lang AS split, count(*) AS n, sum(coalesce(ok::INT, 0)) AS c FROM p WHERE lang IN ('de', 'en') GROUP BY 1 UNION ALL SELECT 'it', 0, 0) SELECT
split, n::BIGINT AS n, c::BIGINT AS correct, round(CASE WHEN n > 0 THEN c / n END, 9) AS accuracy FROM (SELECT * FROM s UNION ALL SELECT 'overall', sum(n),
sum(c) FROM s)""",
    "a6_crosstab": f"{_P} SELECT coalesce(hop, 'unknown') AS hop, source, {_ALL} FROM p GROUP BY 1, 2 UNION ALL SELECT coalesce(hop, 'unknown'), 'all', {_ALL} FROM p GROUP BY 1",
    "a7_judge_totals": f"""
{_P} SELECT s AS source, count(*) AS seen, count(ok) FILTER (doc_id % 13 <> 0) AS judged, sum(ok::INT) FILTER (doc_id % 13 <> 0)::BIGINT AS correct, count(*)
FILTER (doc_id % 13 = 0) AS torn FROM (SELECT *, unnest([source, 'all']) AS s FROM p) GROUP BY 1""",
    "a8_trace_stats": f"""
{_S}, l AS (SELECT count(*) AS n FROM s GROUP BY user_id), w AS (SELECT count(*) AS trajectories, round(avg(n), 9) AS mean_length, round(avg((n >= 70)::INT), 9)
AS at_limit FROM l) SELECT event_type, count(*) AS steps, round(count(*) / sum(count(*)) OVER (), 9) AS share, any_value(trajectories) AS trajectories,
any_value(mean_length) AS mean_length, any_value(at_limit) AS at_limit FROM s, w GROUP BY 1""",
    "a9_accuracy_by_termination": f"{_P} SELECT ended, {_ACC}",
    "a10_top_errors": f"""
{_S} SELECT event_type, 'm' || k % 30 AS message, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, 'm' || k % 30)::INT AS rank
FROM s GROUP BY 1, 2 QUALIFY rank <= 10""",
    "a11_examples": f"{_P} SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank FROM p QUALIFY rank <= 3",
    "a12_summary_v1": f"""
{_P} SELECT d.decision, (SELECT count(*) FROM p WHERE ended = d.decision) AS n, (SELECT round(avg(n_chars), 9) FROM p) AS mean_iterations, (SELECT
median(n_chars) FROM p) AS median_iterations FROM (VALUES ('answer'), ('limit'), ('error')) AS d(decision)""",
    "a13_summary_baseline": f"""
{_S}, p AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM s GROUP BY user_id) SELECT
count(*) AS trajectories, round(avg(n), 9) AS mean_steps, sum(v)::BIGINT AS search_total, sum(c)::BIGINT AS summarise_total, round(avg(v), 9) AS search_mean,
round(avg(c), 9) AS summarise_mean FROM p""",
    "a14_corpus_stats": f"""
{_P} SELECT lang, count(*) AS questions, count(DISTINCT source) AS decks, count(*) FILTER (doc_id % 4 > 0) AS multi, count(*) FILTER (doc_id % 3 = 1) AS
arithmetic, '{{' || (SELECT string_agg('\"' || e || '\":' || n, ',' ORDER BY e) FROM (SELECT doc_id % 4 + 1 AS e, count(*) AS n FROM p q WHERE q.lang = p.lang GROUP BY 1)) || '}}'
AS evidence_sizes FROM p GROUP BY lang""",
    "a15_upper_median": f"{_P} SELECT lang, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median FROM p GROUP BY lang",
    "a17_run_totals": f"""{_P}, k AS (SELECT *, coalesce(ok, false) AS kept FROM p), x AS (SELECT 'processed' AS kind, 'all' AS name FROM k UNION ALL SELECT 'kept', 'all' FROM k WHERE kept UNION ALL SELECT 'kept_hop', lang FROM k WHERE kept UNION ALL SELECT 'reason', 'judge' FROM k WHERE ok IS NULL UNION ALL SELECT 'reason', 'short' FROM k WHERE NOT kept AND n_chars < 500 UNION ALL SELECT 'tag', 'crop' FROM k WHERE kept AND doc_id % 2 > 0 UNION ALL SELECT 'tag', 'revisit' FROM k WHERE kept AND doc_id % 3 > 0) SELECT kind, name, count(*) AS n FROM x GROUP BY 1, 2""",
    "a18_subset_summary": f"""
{_P} SELECT w.lang, w.wanted, count(p.doc_id) AS available, coalesce(sum(n_chars), 0)::BIGINT AS calls, greatest(w.wanted - count(p.doc_id), 0) AS shortfall
FROM (VALUES ('de', 10000), ('en', 100), ('it', 5)) AS w(lang, wanted) LEFT JOIN p ON p.lang = w.lang GROUP BY 1, 2""",
    "a19_merge_summary": f"{_P} SELECT source, count(*) AS n, (SELECT count(*) - count(DISTINCT doc_id % 300) FROM p) AS duplicates FROM p GROUP BY 1",
    "a25_validate_summary": f"""
{_S}, t AS (SELECT event_type, user_id, max(k) AS k FROM s GROUP BY 1, 2) SELECT event_type, round(avg(value), 9) AS mean_score, (SELECT round(avg(k), 9) FROM t
WHERE t.event_type = s.event_type) AS tool_calls, (SELECT count(*) FROM t WHERE t.event_type = s.event_type) AS trajectories FROM s GROUP BY 1""",
    "a30_passk": """
WITH q AS (SELECT o_custkey, sum((o_orderstatus = 'F')::INT) AS k, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT count(*) AS questions, round(avg((k >
0)::INT), 9) AS pass_k, round(avg(k / n), 9) AS pass_1 FROM q) SELECT k::BIGINT AS k, count(*) AS n, any_value(questions) AS questions, any_value(pass_k) AS
pass_k, any_value(pass_1) AS pass_1 FROM q, w GROUP BY 1""",
    "a31_paired_flips": f"""
{_P} SELECT lang, count(*) AS pairs, count(*) FILTER (NOT ok AND doc_id % 3 <> 0) AS fixed, count(*) FILTER (ok AND doc_id % 3 = 0) AS broken FROM p WHERE ok IS
NOT NULL GROUP BY 1""",
    "a34_progress": "SELECT count(*) AS done, max(doc_id) AS last, round(100 * count(*) / (SELECT count(*) FROM documents), 9) AS percent FROM labels",
    "a35_pack_stats": "SELECT c::INT AS images, count(*) AS rows FROM (SELECT count(turn) AS c FROM conversations GROUP BY conv_id) GROUP BY 1",
    "a36_episode_outcomes": f"""
{_S}, l AS (SELECT user_id % 4 AS src, arg_max(k, event_id) AS k, arg_max(CASE WHEN k % 5 <> 0 THEN value ELSE 0 END, event_id) AS v FROM s WHERE event_type <>
'error' GROUP BY user_id, 1) SELECT g AS src, count(*) AS episodes, round(avg((k % 2 = 0)::INT), 9) AS success, round(avg(v), 9) AS reward FROM (SELECT *,
unnest([src::VARCHAR, 'all']) AS g FROM l) GROUP BY 1""",
}
