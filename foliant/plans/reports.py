"""Fuller reports, rows of phases, rendered notes: documents are questions, events steps, orders trajectories with their lines as tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import memory as M
from foliant.operators import reports as R
from foliant.operators import rollouts as W

from foliant.sources.scratch import written

from .rollouts import _RW, _rows
from .tables import table


def _steps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _qa(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.withColumns({"hop": F.when(F.col("doc_id") % 3 == 0, "multi").otherwise("single"), "n_evidence": F.col("doc_id") % 4 + 1, "num_pages": F.col("doc_id") % 7 + 3})


def a14_corpus_histograms(spark, sf):
    """Page files of a split are pages whose number gives it."""
    names = F.array(*map(F.lit, ("en", "de", "es")))
    pages = table(spark, sf, "pages").select(F.element_at(names, (F.col("page_id") % 3 + 1).cast("int")).alias("lang"))
    return R.corpus_histograms(_qa(spark, sf), pages, "lang", "source", "hop", "n_evidence", "num_pages")


def a18_subset_counts(spark, sf):
    """Selected are users with even numbers; their events are the calls."""
    users = _steps(spark, sf).select("user_id").distinct().where("user_id % 2 = 0")
    selected = users.withColumn("hop", F.when(F.col("user_id") % 3 == 0, "multi").otherwise("single"))
    return R.subset_counts(selected, _steps(spark, sf).where("k % 10 < 2"), "user_id", "hop", "event_type")


def a19_merge_counts(spark, sf):
    d = _qa(spark, sf).withColumns({"calls": F.col("n_evidence") * 2, "sample": F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 211), "deck": F.col("doc_id") % 97})
    reasons = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "duplicate_sample_id"), F.when(F.col("doc_id") % 3 == 0, "duplicate_deck_question")))
    return R.merge_counts(d.where("doc_id % 4 > 0"), d.where("doc_id % 4 = 0").withColumn("reasons", reasons), "source", "hop", "calls", "reasons", {"sample": ["sample"], "deck": ["deck", "lang"]})


def a20_training_metrics(spark, sf):
    rows = _rows(spark, sf).withColumn("steps", F.size("x"))
    lengths = {"response": (F.col("steps"), 4), "prompt": (F.col("traj") % 50, 49)}
    out = R.training_metrics(rows, "traj", "traj", "x", "y", "x", "y", "x", "mask", lengths, {"length": F.col("steps")})
    return out.withColumns({c: F.round(F.col(c).cast("double"), 9) + F.lit(0.0) for c in out.columns if c != "episodes"})


def a36_episode_report(spark, sf):
    steps = _steps(spark, sf).withColumn("src", (F.col("user_id") % 4).cast("string")).withColumn("won", F.col("k") % 2 == 0)
    terms = {"answer_reward": F.when(F.col("k") % 5 > 0, F.col("value"))}
    ends = {"end_answer": F.col("event_type") == "click", "end_timeout": F.col("event_type") == "view"}
    out = R.episode_report(steps, "user_id", "event_id", F.col("event_type") != "error", "src", "won", terms, ends, {"n_crop": F.col("k") % 3})
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("src", "episodes")})


def w17_step_penalty(spark, sf):
    rows = _rows(spark, sf).withColumns({"step": F.lit(1.0), "valid": F.when(F.col("traj") % 4 > 1, True).when(F.col("traj") % 4 == 1, False)})
    out = R.step_penalty(rows, "x", "mask", "step", "valid", 0.5)
    return out.select("traj", (F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"), "step")


def w17_valid_ratio(spark, sf):
    return R.valid_action_ratio(_steps(spark, sf).withColumn("valid", F.when(F.col("k") % 4 > 0, F.col("k") % 4 > 1)), "valid").withColumn("valid_action_ratio", F.round("valid_action_ratio", 9))


def n3_skipped_text_only(spark, sf):
    image = F.when((F.col("user_id") % 4 > 0) & (F.col("k") % 3 == 0), F.array(F.col("k").cast("string")))
    return R.skipped_text_only(_steps(spark, sf).withColumn("images", image), "user_id", "images")


def n4_page_visits(spark, sf):
    return R.page_visits(_steps(spark, sf).withColumn("view", F.when(F.col("k") % 9 > 0, F.concat(F.lit("P"), (F.col("k") % 5).cast("string")))), "user_id", "event_id", "view")


def _noted(spark, sf):
    """A user's pages are action types, with the values of k as facts."""
    s = _steps(spark, sf).where("k % 5 = 0")
    facts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col("k").cast("string").alias("t")))), lambda x: x["t"])
    page = s.groupBy("user_id", "event_type").agg(facts.alias("facts"))
    block = F.struct(
        F.col("event_type").alias("id"), F.when(F.col("event_type") > "d", F.lit("a page")).alias("descriptor"), F.concat(F.lit('find "'), "event_type", F.lit('"')).alias("query"), "facts",
        F.when(F.col("event_type") == "click", F.array(F.lit("N1"), F.lit("N2"))).otherwise(F.array().cast("array<string>")).alias("linked"),
    )
    return page.groupBy("user_id").agg(F.array_sort(F.collect_list(block)).alias("pages"))


def n7_render_pages(spark, sf):
    return _noted(spark, sf).select("user_id", R.render_pages(F.col("pages")).alias("lines"))


def n7_forced_notes(spark, sf):
    node = lambda i, status, answer, pages: F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("id", "status", "question", "answer"), (i, status, f"q{i}", answer), strict=True)), pages.alias("pages"))
    ids = F.transform("pages", lambda p: p["id"])
    nodes = F.array(node("N0", "open", None, F.array().cast("array<string>")), node("N1", "resolved", "42", ids))
    return _noted(spark, sf).select("user_id", R.forced_notes(nodes, F.lit("N0"), F.col("pages")).alias("lines"))


def n8_phase_rows(spark, sf):
    """Clicks decide, views and errors are pages analysed; the first four users are the warm-up."""
    s = _steps(spark, sf).withColumns({
        "kind": F.when(F.col("event_type") == "click", "decide").when(F.col("event_type").isin("view", "error"), "analyse").otherwise("search"),
        "verdict": F.when(F.col("k") % 4 == 0, "yes").when(F.col("k") % 4 == 1, "partial").when(F.col("k") % 4 == 2, "no"), "hop": F.when(F.col("user_id") % 2 == 0, "multi").otherwise("single"),
    })
    return R.phase_rows(s, "user_id", "event_id", "kind", "verdict", "hop", 4, 8)


def _traces(spark, sf):
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "analyse").when(F.col("event_type") == "error", "error").otherwise("decide")
    return _steps(spark, sf).withColumns({
        "kind": kind, "verdict": F.when(F.col("k") % 4 == 0, "Yes").when(F.col("k") % 4 == 1, "partial").otherwise("maybe"), "page": F.concat(F.lit("p"), F.col("k").cast("string")),
        "query": F.when((F.col("event_type") == "click") | (F.col("k") % 6 == 0), F.concat(F.lit("q"), F.col("k").cast("string"))), "summary": F.when(F.col("k") % 5 > 0, F.concat(F.lit(" s"), F.col("k").cast("string"))),
    })


def m5_clean_traces(spark, sf):
    return R.clean_traces(_traces(spark, sf), "user_id", "event_id", "kind", "verdict", "page", "query", "summary")[0]


def m5_clean_counts(spark, sf):
    return R.clean_traces(_traces(spark, sf), "user_id", "event_id", "kind", "verdict", "page", "query", "summary")[1]


def _facts_folded(spark, sf):
    """Clicks note a fact of the page in view, purchases update its first one."""
    s, empty = _steps(spark, sf), F.array().cast("array<string>")
    no_text = [F.lit(None).cast("string").alias(c) for c in ("op", "node", "answered", "answer", "next")]
    turns = s.select(
        "user_id", "event_id", F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string")).alias("view"), F.when(F.col("event_type") == "click", F.array("event_type")).otherwise(empty).alias("added"),
        F.when(F.col("event_type") == "purchase", F.array(F.struct(F.lit(1).alias("n"), F.lit("u").alias("text")))).alias("updated"), *no_text, empty.alias("pages"),
    )
    updates = F.aggregate("facts", F.lit(0).cast("long"), lambda a, f: a + f["revision"])
    return M.fold_memory(turns, "user_id", "event_id").withColumn("n_updates", updates)


def m3_fold_facts(spark, sf):
    """Facts, updates and refused turns of each user."""
    return _facts_folded(spark, sf).select("user_id", F.size("facts").cast("long").alias("n_facts"), "n_updates", F.size("errors").cast("long").alias("n_refused"))


def m7_replay_facts(spark, sf):
    """What was stored lost its facts where their updates are odd in number; the replay tells the others."""
    folded = written(_facts_folded(spark, sf))
    stored = folded.withColumn("facts", F.when(F.col("n_updates") % 2 == 1, F.slice("facts", 1, 0)).otherwise(F.col("facts")))
    return M.replay_check(folded, stored, "user_id", ["nodes", "facts", "active"]).select("user_id")


def m4_fold_accepts(spark, sf):
    """Accepted and rejected pages of the root: the last accepted answer and its fact stay, pages add up, an answer that is missing is refused."""
    k = F.col("k")
    d = _steps(spark, sf).select(
        "user_id", "event_id", F.when(k % 3 > 0, "ACCEPT").otherwise("REJECT").alias("decision"), F.when(k % 5 > 0, k.cast("string")).alias("answer"),
        F.array(F.struct(F.concat(F.lit("f"), k.cast("string")).alias("text"), F.lit(None).cast("array<double>").alias("box"))).alias("facts"), F.array(F.concat(F.lit("P"), (k % 6).cast("string"))).alias("refs"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("answered", "string"), ("remaining", "string"), ("region", "array<double>"))),
    )
    out = M.fold_graph(d, "user_id", "event_id").withColumn("root", F.get("nodes", F.lit(0)))
    return out.select("user_id", F.size("nodes").alias("n_nodes"), "refused", "root.answer", F.array_join("root.facts.text", ",").alias("facts"), F.array_join("root.refs", ",").alias("refs"))


def w8_distinct_groups(spark, sf):
    """Texts that are alike or share no letter: groups are the texts in the order of their first sight."""
    s = _steps(spark, sf).withColumn("text", F.element_at(F.array(*(F.lit(x * 9) for x in "abcdefg")), F.col("k") % 7 + 1))
    return W.similar_groups(s, "user_id", "event_id", "text").select("event_id", "group")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "amnw" and k[1].isdigit()}

_S = "s AS (SELECT event_id, user_id, event_type, value, (props->>'$.k')::INT AS k FROM events)"
_QA = """d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'multi' ELSE 'single' END AS hop, doc_id % 4 + 1 AS n_evidence, doc_id % 7 + 3 AS num_pages FROM documents)"""
_CLEAN = f"""
WITH {_S}, t AS (SELECT *, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'analyse' WHEN 'error' THEN 'error' ELSE 'decide' END AS kind,
 CASE WHEN event_type = 'click' OR k % 6 = 0 THEN 'q' || k END AS own, CASE WHEN k % 5 > 0 THEN 's' || k END AS text FROM s),
f AS (SELECT *, coalesce(own, last_value(CASE WHEN kind = 'search' THEN coalesce(own, '') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), '') AS q FROM t),
c AS (SELECT user_id, event_id, kind, CASE WHEN kind = 'analyse' THEN ['yes', 'partial', 'no', 'no'][k % 4 + 1] END AS verdict, CASE WHEN kind = 'analyse' THEN 'p' || k END AS page,
 CASE WHEN kind = 'analyse' THEN q END AS query, CASE WHEN kind = 'analyse' THEN CASE WHEN q <> '' THEN '[query: ' || q || '] ' || text ELSE text END END AS summary FROM f WHERE kind <> 'error')"""
_PAGES = f"""
WITH {_S}, p AS (SELECT user_id, event_type AS id, CASE WHEN event_type > 'd' THEN 'a page' END AS descriptor, list(k::VARCHAR ORDER BY event_id) AS facts FROM s WHERE k % 5 = 0 GROUP BY 1, 2)"""


def _three(name, of):
    return ", ".join(f"round({f}({of}), 9) + 0 AS {name}_{n}" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min")))


ORACLE_SQL = {
    "a14_corpus_histograms": f"""
WITH {_QA} SELECT lang, 'hop' AS kind, hop AS name, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT lang, 'num_evidence', n_evidence::VARCHAR, count(*) FROM d GROUP BY ALL
UNION ALL SELECT lang, 'pages_per_deck', num_pages::VARCHAR, count(*) FROM d GROUP BY ALL UNION ALL SELECT lang, 'decks', 'all', count(*) FROM (SELECT DISTINCT lang, source FROM d) GROUP BY ALL
UNION ALL SELECT ['en', 'de', 'es'][page_id % 3 + 1], 'page_files', 'all', count(*) FROM pages GROUP BY ALL""",
    "a18_subset_counts": f"""
WITH {_S}, u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'multi' ELSE 'single' END AS hop FROM s WHERE user_id % 2 = 0), c AS (SELECT * FROM s JOIN u USING (user_id) WHERE k % 10 < 2)
SELECT 'selected' AS kind, hop AS name, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'calls_by_hop', hop, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'calls_by_step', event_type, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'calls_per_trajectory', m::VARCHAR, count(*) FROM (SELECT u.user_id, count(c.event_id) AS m FROM u LEFT JOIN c USING (user_id) GROUP BY 1) GROUP BY ALL""",
    "a19_merge_counts": f"""
WITH {_QA}, k AS (SELECT * FROM d WHERE doc_id % 4 > 0), x AS (SELECT * FROM d WHERE doc_id % 4 = 0)
SELECT 'rows_by_source' AS kind, source AS name, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'rows_by_hop', hop, count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'calls_by_source', source, sum(2 * n_evidence)::BIGINT FROM k GROUP BY ALL UNION ALL SELECT 'calls_by_hop', hop, sum(2 * n_evidence)::BIGINT FROM k GROUP BY ALL
UNION ALL SELECT 'skipped', 'duplicate_sample_id', count(*) FROM x WHERE doc_id % 2 = 0 UNION ALL SELECT 'skipped', 'duplicate_deck_question', count(*) FROM x WHERE doc_id % 3 = 0
UNION ALL SELECT 'duplicates', 'sample', (SELECT count(*) - count(DISTINCT doc_id % 211) FROM k WHERE doc_id % 5 > 0)
UNION ALL SELECT 'duplicates', 'deck', (SELECT count(*) FROM k WHERE lang IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT doc_id % 97, lang FROM k WHERE lang IS NOT NULL))""",
    "a20_training_metrics": f"""
WITH {_RW}, r AS (SELECT traj, sum(x) AS score, sum(y) AS reward, count(*)::DOUBLE AS length, (traj % 50)::DOUBLE AS prompt FROM l GROUP BY traj), t AS (SELECT x, y FROM l WHERE m > 0)
SELECT {_three('score', 'score')}, {_three('reward', 'reward')}, {_three('response', 'length')}, {_three('prompt', 'prompt')}, {_three('length', 'length')},
 round(avg((length = 4)::INT), 9) AS response_clip_ratio, round(avg((prompt = 49)::INT), 9) AS prompt_clip_ratio, count(*) AS episodes, a.* FROM r,
 (SELECT {_three('advantage', 'x')}, {_three('return', 'y')}, {_three('value', 'x')}, round(1 - var_samp(y - x) / (var_samp(y) + 1e-5), 9) AS explained_variance FROM t) a GROUP BY ALL""",
    "a36_episode_report": f"""
WITH {_S}, l AS (SELECT user_id % 4 AS src, arg_max(k, event_id) AS k, arg_max(value, event_id) AS v, arg_max(event_type, event_id) AS e FROM s WHERE event_type <> 'error' GROUP BY user_id)
SELECT CASE WHEN grouping(src) = 1 THEN 'all' ELSE src::VARCHAR END AS src, count(*) AS episodes, round(avg((k % 2 = 0)::INT), 9) AS won, round(avg(CASE WHEN k % 5 > 0 THEN v ELSE 0 END), 9) AS answer_reward,
 round(avg((e = 'click')::INT), 9) AS end_answer, round(avg((e = 'view')::INT), 9) AS end_timeout, round(avg(k % 3), 9) AS n_crop, round(avg((k % 3 > 0)::INT), 9) AS n_crop_rate FROM l GROUP BY ROLLUP (src)""",
    "w17_step_penalty": f"""
WITH {_RW} SELECT traj, round(sum(x) - CASE WHEN traj % 4 < 2 AND max(m) > 0 THEN 0.5 ELSE 0 END, 6) + 0 AS total, CASE WHEN traj % 4 < 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS step FROM l GROUP BY traj""",
    "w17_valid_ratio": f"WITH {_S} SELECT round(avg((k % 4 > 1)::INT), 9) AS valid_action_ratio FROM s",
    "n3_skipped_text_only": f"""
WITH {_S}, u AS (SELECT user_id, bool_or(user_id % 4 > 0 AND k % 3 = 0) AS has FROM s GROUP BY 1) SELECT count(*) AS samples, count(*) FILTER (has) AS packed, count(*) FILTER (NOT has) AS skipped_text_only FROM u""",
    "n4_page_visits": f"""
WITH {_S}, v AS (SELECT user_id, 'P' || k % 5 AS page, event_id FROM s WHERE k % 9 > 0)
SELECT user_id, page, (row_number() OVER w)::INT AS visit, event_id, row_number() OVER w > 1 AS revisit FROM v WINDOW w AS (PARTITION BY user_id, page ORDER BY event_id)""",
    "n7_render_pages": f"""{_PAGES},
b AS (SELECT user_id, id, id || coalesce(': ' || descriptor, '') || '   (found by: "find \\"' || id || '\\"")' || CASE WHEN id = 'click' THEN '   -> answers N1, N2' ELSE '' END || chr(10) ||
 array_to_string(list_transform(facts, lambda f, i: CASE WHEN i = len(facts) THEN '└─ ' ELSE '├─ ' END || 'F' || i || ': ' || f), chr(10)) AS t FROM p)
SELECT user_id, 'Page memory:' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY id) AS lines FROM b GROUP BY 1""",
    "n7_forced_notes": f"""{_PAGES},
b AS (SELECT user_id, id, id || ': ' || coalesce(descriptor, '(no description)') || '   (found by: "find "' || id || '"")' || chr(10) || array_to_string(list_transform(facts, lambda f: '  - ' || f), chr(10)) AS t FROM p)
SELECT user_id, array_to_string(['Question tree:', 'N0 [open, ACTIVE]: qN0', 'N1 [resolved]: qN1  = 42   (pages: ' || string_agg(id, ', ' ORDER BY id) || ')', '', 'Page notes:'], chr(10)) || chr(10) ||
 string_agg(t, chr(10) ORDER BY id) AS lines FROM b GROUP BY 1""",
    "n8_phase_rows": f"""
WITH {_S}, t AS (SELECT user_id, event_id, event_type, k, dense_rank() OVER (ORDER BY user_id) AS place, coalesce(['yes', 'partial', 'no', NULL][k % 4 + 1], 'no') AS said,
 max(CASE WHEN event_type IN ('view', 'error') AND k % 4 < 2 THEN event_id END) OVER (PARTITION BY user_id) AS last FROM s)
SELECT CASE WHEN place <= 4 THEN 'warmup' ELSE 'joint' END AS phase, user_id, event_id, 'judge' AS task, said AS target, 0 AS nth FROM t WHERE place <= 12 AND event_type IN ('view', 'error')
UNION ALL SELECT 'joint', user_id, event_id, 'decide', NULL, 0 FROM t WHERE place BETWEEN 5 AND 12 AND event_type = 'click'
UNION ALL SELECT 'joint', user_id, event_id, 'update', CASE WHEN user_id % 2 = 0 AND event_id = last THEN 'yes' ELSE said END, 1 FROM t WHERE place BETWEEN 5 AND 12 AND event_type IN ('view', 'error')""",
    "m5_clean_traces": f"{_CLEAN} SELECT * FROM c",
    "m5_clean_counts": f"""{_CLEAN}
SELECT 'input' AS kind, kind AS name, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'output', kind, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'verdict', verdict, count(*) FROM c WHERE kind = 'analyse' GROUP BY ALL""",
    "m3_fold_facts": f"""
WITH {_S}, f AS (SELECT *, coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS facts FROM s)
SELECT user_id, count(*) FILTER (event_type = 'click') AS n_facts, count(*) FILTER (event_type = 'purchase' AND facts > 0) AS n_updates,
 count(*) FILTER (event_type = 'purchase' AND facts = 0) AS n_refused FROM f GROUP BY 1""",
    "m7_replay_facts": f"""
WITH {_S}, f AS (SELECT *, coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS facts FROM s)
SELECT user_id FROM f GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND facts > 0) % 2 = 0""",
    "m4_fold_accepts": f"""
WITH {_S}, a AS (SELECT * FROM s WHERE k % 3 > 0 AND k % 5 > 0), p AS (SELECT user_id, 'P' || k % 6 AS page, min(event_id) AS first FROM a GROUP BY 1, 2)
SELECT user_id, 1 AS n_nodes, (SELECT count(*) FROM s t WHERE t.user_id = u.user_id AND k % 3 > 0 AND k % 5 = 0)::INT AS refused, (SELECT arg_max(k::VARCHAR, event_id) FROM a WHERE a.user_id = u.user_id) AS answer,
 coalesce((SELECT 'f' || arg_max(k, event_id) FROM a WHERE a.user_id = u.user_id), '') AS facts, coalesce((SELECT string_agg(page, ',' ORDER BY first) FROM p WHERE p.user_id = u.user_id), '') AS refs
FROM (SELECT DISTINCT user_id FROM s) u""",
    "w8_distinct_groups": f"""
WITH {_S}, f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, k % 7) AS first FROM s) SELECT event_id, (dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1)::INT AS "group" FROM f""",
}
