"""Curation over orders (rollouts of a customer), events (trace steps) and documents (candidate questions)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import balance as B
from foliant.operators import curate as C

from foliant.sources.scratch import shared_folder

from .tables import table



def _steps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.withColumn("hop", F.when(F.col("doc_id") % 3 == 0, "multi").otherwise("single"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("traj"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def f1_check_contiguous(spark, sf):
    return C.check_contiguous(table(spark, sf, "conversations"), "conv_id", "turn", 0)


def f2_check_evidence(spark, sf):
    qa = _steps(spark, sf).select("event_id", F.col("k").alias("deck"), F.array_compact(F.array(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5), F.when(F.col("k") % 3 > 0, F.lit(2)))).alias("ev"))
    pages = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("deck")).agg(F.count("*").alias("num_pages"))
    return C.check_evidence(qa, pages, "deck", "ev").select("event_id", "num_pages")


def f3_check_unique(spark, sf):
    return C.check_unique(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def f4_expect(spark, sf):
    line = table(spark, sf, "lineitem")
    return C.expect(line, {"quantity": F.col("l_quantity").between(1, 49), "discount": F.col("l_discount") <= 0.09, "flag": F.col("l_returnflag").isin("A", "N", "R"), "tax": F.nullif(F.col("l_tax"), F.lit(0.0)) > 0.01})


def f5_check_boxes(spark, sf):
    s = _steps(spark, sf)
    facts = s.select("event_id", F.col("k").alias("page"), F.array(F.col("k") - 5, F.lit(2), F.col("k") + 10, F.col("event_id") % 90).alias("box"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("page"), F.lit(100).alias("w"), F.lit(80).alias("h")).where("page % 4 <> 0")
    return C.check_boxes(facts, pages, ["page"]).select("event_id", "reason")


def f6_leakage(spark, sf):
    return C.leakage(_steps(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("k")), "k")


def f9_keep_filter(spark, sf):
    s = _steps(spark, sf)
    errors = F.array_compact(F.array(F.when(F.col("k") % 5 == 0, "search"), F.when(F.col("k") % 10 == 0, "act"), F.when(F.col("k") % 15 == 0, "search")))
    out = C.keep_filter(s, F.col("event_type") != "error", errors, F.when(F.col("k") % 7 == 0, " ").otherwise("x"), F.when(F.col("k") % 4 > 0, F.col("k") % 4 == 1), F.when(F.col("k") % 9 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.col("k") % 6 > 0)
    return out.select("event_id", F.array_join("reasons", "; ").alias("reasons"), "kept")


def f10_until_api_error(spark, sf):
    return C.until_api_error(_steps(spark, sf), "event_id", (F.col("k") == 99) & (F.col("user_id") % 10 == 3)).select("event_id")


def f11_audit_score(spark, sf):
    k = F.col("k")
    flags = {"not_answered": k % 11 == 0, "judge_missing": k % 3 == 0, "few_accepts": k % 5 == 0, "trace_error": k % 13 == 0, "many_steps": F.when(k % 2 == 0, k > 50)}
    out = C.audit_score(_steps(spark, sf), flags, k % 4, k % 7)
    return out.select("event_id", "score", F.array_join("flags", ",").alias("flags"))


def f12_trajectory_tags(spark, sf):
    return C.trajectory_tags(_steps(spark, sf), "user_id", {"revisit": F.col("event_type") == "view", "crop": F.col("k") > 90})


def f13_check_trajectories(spark, sf):
    c = table(spark, sf, "conversations").withColumn("terminal", F.col("role") == "assistant")
    return C.check_trajectories(c, "conv_id", "turn", "terminal")


def f14_check_traj_advantage(spark, sf):
    return C.check_traj_advantage(_steps(spark, sf).withColumn("v", F.when(F.col("user_id") % 3 == 0, F.col("value")).otherwise(F.col("user_id") + F.col("k") * 1e-9)), "user_id", "v")


def f15_drop_constant_groups(spark, sf):
    o = _orders(spark, sf).withColumn("reward", (F.col("o_orderstatus") == "F").cast("int"))
    return C.drop_constant_groups(o, "uid", "reward", 500).select("uid", "traj")


def f16_think_quality(spark, sf):
    """All rules at the stated thresholds, over turns that announce an action and take one."""
    c = table(spark, sf, "conversations")
    said = F.element_at(F.array(*map(F.lit, ("Let me crop it.", "I'll zoom in.", "I should search again.", "Let me revisit it.", "Done."))), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    act = F.element_at(F.array(*map(F.lit, ("crop", "search", "revisit", "answer"))), (F.col("turn") % 4 + 1).cast("int"))
    return C.think_quality(c.select("conv_id", F.concat_ws("\n", "text", said).alias("think"), act.alias("act")), "conv_id", "think", "act")


def f17_grounded_filter(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    out = C.grounded_filter(p, F.lower(F.substring_index("p_type", " ", 2)), F.array(F.col("p_type"), F.col("p_name")), F.array(F.col("p_partkey") % 3), F.array(F.col("p_partkey") % 2))
    return out.select("p_partkey", "grounded")


def f18_rl_gate(spark, sf):
    o = _orders(spark, sf).select("uid", F.col("o_orderpriority").alias("answer"), (F.col("o_orderstatus") == "F").alias("ok"), (F.col("traj") % 3 > 0).alias("att"), (F.col("uid") % 12).alias("words"), (F.col("uid") % 10 == 0).alias("guess"))
    return C.rl_gate(o, "uid", "answer", "ok", "att", "words", "guess", 1, 6)


def f19_crop_label(spark, sf):
    o = _orders(spark, sf).select("uid", (F.col("traj") % 2 == 0).alias("cropped"), (F.col("o_orderstatus") == "F").alias("ok"))
    return C.crop_label(o, "uid", "cropped", "ok")


def f20_clean_verdicts(spark, sf):
    k = F.col("k")
    reply = F.when(k % 5 == 0, "no json").when(k % 5 == 1, F.concat(F.lit('ok {"correct": '), (k % 2 == 0).cast("string"), F.lit(', "score": 1} end'))).when(k % 5 == 2, '{"score": 0}').otherwise('{"correct": false}')
    return C.clean_verdicts(_steps(spark, sf).select("event_id", reply.alias("reply")), "reply").drop("reply")


def d1_balanced_split(spark, sf):
    """Half and a tenth of each class, whatever its size; more than there is would be an error."""
    docs = _docs(spark, sf)
    sizes = {hop: (n // 2, n // 10) for hop, n in docs.groupBy("hop").count().collect()}  # two classes
    return C.balanced_split(docs, "hop", sizes, "s", "doc_id").select("doc_id", "hop", "split")


def d2_packed_select(spark, sf):
    return C.packed_select(_docs(spark, sf), "source", "hop", "doc_id", 60, 70).select("doc_id", "source", "hop")


def d3_slice_ordered(spark, sf):
    return C.slice_ordered(_docs(spark, sf), ["n_chars", "doc_id"], 100, 50)


def d4_interleave(spark, sf):
    d = _docs(spark, sf).select("doc_id", "hop")
    return C.interleave(d.where("hop = 'multi'"), d.where("hop = 'single'"), ["doc_id"])


def d5_shortest_select(spark, sf):
    return C.shortest_select(_docs(spark, sf), "hop", ["n_chars", "doc_id"], 40, 100).select("doc_id", "hop", "n_chars")


def d6_dedup_best(spark, sf):
    return C.dedup_best(_orders(spark, sf), "uid", [F.desc("o_totalprice"), F.col("traj")]).select("uid", "traj")


def d7_dedup_latest(spark, sf):
    s = _steps(spark, sf).withColumn("key", F.when(F.col("k") % 50 > 0, F.concat_ws("-", "user_id", F.col("k") % 10)))
    return C.dedup_latest(s, "key", "k", "event_id").select("key", "event_id")


def d9_merge_shards(spark, sf):
    d = _docs(spark, sf)
    return C.merge_shards(d.where("doc_id % 2 = 0").unionByName(d.where("doc_id % 2 = 1")).select("doc_id", "lang"), d.select("doc_id", (F.col("doc_id") * 2).alias("ordinal")), "doc_id", "ordinal")


def d10_stratified_sample(spark, sf):
    return C.stratified_sample(_docs(spark, sf), "lang", "de", 10, 30, "s", "doc_id").select("doc_id", "lang")


def d11_weighted_resample(spark, sf):
    """Three draws for each document."""
    docs = _docs(spark, sf)
    return C.weighted_resample(docs, "n_chars", "doc_id", 3 * docs.count(), "s").select("draw", "doc_id")


def d12_repeat_rows(spark, sf):
    return C.repeat_rows(_steps(spark, sf).withColumn("times", F.col("k") % 3), "times").select("event_id", "copy")


def d13_pad_to_multiple(spark, sf):
    return C.pad_to_multiple(_docs(spark, sf), 768, ["doc_id"]).select("doc_id", "padding")


def d14_question_minibatches(spark, sf):
    return C.question_minibatches(_orders(spark, sf), "uid", "traj").select("traj", "batch")


def _costs(spark, sf):
    """Every 97th document costs a thousand times its length, which is beyond most budgets."""
    cost = F.coalesce("n_chars", F.lit(0)) * F.when(F.col("doc_id") % 97 == 0, 1000).otherwise(1)
    return table(spark, sf, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), cost.alias("cost"))


def d15_balance_ranks(spark, sf):
    return B.balance_ranks(_costs(spark, sf), "n_chars", "doc_id", 8).select("doc_id", "rank")


def d16_micro_batches(spark, sf):
    """All rows with their batch and its sum, rows above the budget on their own."""
    out = B.micro_batches(_costs(spark, sf), "cost", "doc_id", 400_000)
    sums = out.groupBy("batch").agg(F.sum("cost").alias("batch_cost"))
    return out.join(sums, "batch").select("doc_id", "batch", "batch_cost")


def _rounds(spark, sf):
    """Round n has the orders whose number leaves n - 1 modulo 5; a customer's orders of it are a group."""
    o = _orders(spark, sf).withColumn("reward", (F.col("o_orderstatus") == "F").cast("int"))
    return lambda n: o.where(F.col("traj") % 5 == n - 1)


def f15_accumulate_groups(spark, sf):
    """Rounds until a quarter of all orders is useful."""
    target = table(spark, sf, "orders").count() // 4
    return C.accumulate_groups(spark, _rounds(spark, sf), f"{shared_folder(spark)}/foliant/{uuid.uuid4().hex}", "uid", "reward", target, 5).select("uid", "traj", "round")


def f15_last_try(spark, sf):
    """The target is out of reach: the second round is the last, and all its groups are taken."""
    return C.accumulate_groups(spark, _rounds(spark, sf), f"{shared_folder(spark)}/foliant/{uuid.uuid4().hex}", "uid", "reward", table(spark, sf, "orders").count(), 2).select("uid", "traj", "round")


def f13_answered(spark, sf):
    """Every third turn of an assistant says nothing here."""
    c = table(spark, sf, "conversations").withColumn("terminal", F.col("role") == "assistant")
    return C.check_trajectories(c.withColumn("said", F.when((F.col("turn") % 3 == 2) & F.col("terminal"), "  ").otherwise(F.col("text"))), "conv_id", "turn", "terminal", "said")


def f14_masked(spark, sf):
    """Values differ only where the mask is 0, but for every fifth user."""
    k = F.col("k")
    rows = _steps(spark, sf).withColumn("m", (k % 4 > 0).cast("int")).withColumn("v", F.when((k % 4 == 0) | (F.col("user_id") % 5 == 0), F.col("value")).otherwise(F.col("user_id").cast("double")))
    return C.check_traj_advantage(rows, "user_id", "v", mask="m")


def d22_smoke_set(spark, sf):
    """The first twenty documents of one language, in order."""
    return C.smoke_set(_docs(spark, sf), F.col("lang") == "en", ["doc_id"], 20).select("doc_id")


def d17_sqrt_quota_sample(spark, sf):
    """From a cap of 1, multi-hop questions first."""
    return C.sqrt_quota_sample(_docs(spark, sf), "lang", "source", 120, 1, "s", "doc_id", F.col("hop") == "multi").select("doc_id", "lang")


def d18_waterfill_quota(spark, sf):
    sizes = _docs(spark, sf).groupBy(F.concat_ws("/", "lang", F.col("doc_id") % 7).alias("stratum")).agg(F.count("*").alias("size"))
    return C.waterfill_quota(sizes, "size", 400).select("stratum", "size", F.round("quota", 6).alias("quota"))


def d19_round_robin(spark, sf):
    return C.round_robin(_docs(spark, sf), "source", 130, "s", "doc_id").select("doc_id", "source", "round")


def _mixed_ids(spark, sf):
    return _docs(spark, sf).select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("id"))


def d20_sort_samples(spark, sf):
    return C.sort_samples(_mixed_ids(spark, sf), "id")


def d21_top_up(spark, sf):
    d = _docs(spark, sf)
    return C.top_up(d.where("doc_id % 20 = 0"), d.where("doc_id % 20 > 9"), "lang", [F.desc("n_chars"), F.col("doc_id")], "doc_id").select("replaced", "doc_id", "lang")


def d22_preview(spark, sf):
    return C.preview(table(spark, sf, "benchmark").select("item_id", "text"), 20, "s", "text").select("item_id")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "fd" and k[1].isdigit()}

_S = "WITH s AS (SELECT event_id, user_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events)"
_D = "WITH d AS (SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'multi' ELSE 'single' END AS hop FROM documents)"
_O = "WITH o AS (SELECT o_custkey AS uid, o_orderkey AS traj, o_orderstatus = 'F' AS ok, o_orderpriority AS answer FROM orders)"
_SEED = "md5('s-' || {})"
_ERR = "CASE WHEN k % 10 = 0 THEN 'act,search' WHEN k % 5 = 0 THEN 'search' END"
ORACLE_SQL = {
    "f1_check_contiguous": "SELECT conv_id, count(DISTINCT turn) AS pages, min(turn) = 0 AND max(turn) = count(DISTINCT turn) - 1 AS contiguous FROM conversations GROUP BY 1",
    "f2_check_evidence": f"""
{_S}, p AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT event_id, n AS num_pages FROM s LEFT JOIN p ON conv_id = k WHERE n IS NULL OR
(event_id % 5 = 0 AND k % 3 = 0) OR event_id % 5 > n OR (k % 3 > 0 AND 2 > n)""",
    "f3_check_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING n > 1",
    "f4_expect": """
SELECT 'quantity' AS rule, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 49) AS violations FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER
(l_discount > 0.09) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem UNION ALL SELECT 'tax', count(*)
FILTER (l_tax <= 0.01) FROM lineitem""",
    "f5_check_boxes": f"""
{_S}, p AS (SELECT page_id FROM pages WHERE page_id % 4 <> 0) SELECT event_id, CASE WHEN page_id IS NULL THEN 'page' ELSE 'box' END AS reason FROM s LEFT JOIN p
ON page_id = k WHERE page_id IS NULL OR k < 5 OR k > 90 OR event_id % 90 > 80 OR event_id % 90 <= 2""",
    "f6_leakage": f"{_S} SELECT count(*) AS rows, count(DISTINCT k) AS keys FROM s WHERE k IN (SELECT doc_id FROM labels)",
    "f9_keep_filter": f"""
{_S}, r AS (SELECT event_id, list_filter([CASE WHEN event_type = 'error' THEN 'not ended by answer' END, 'error steps: ' || {_ERR}, CASE WHEN k % 7 = 0 THEN
'empty answer' END, CASE WHEN k % 4 = 0 THEN 'judge: missing' WHEN k % 4 <> 1 THEN 'judge: incorrect' END, CASE WHEN k % 9 = 0 THEN 'reference pages: missing'
WHEN k % 6 = 0 THEN 'reference pages: not covered' END], lambda x: x IS NOT NULL) AS r FROM s) SELECT event_id, coalesce(array_to_string(r, '; '), '') AS
reasons, len(r) = 0 AS kept FROM r""",
    "f10_until_api_error": f"{_S} SELECT event_id FROM s WHERE event_id < coalesce((SELECT min(event_id) FROM s WHERE k = 99 AND user_id % 10 = 3), 1e18)",
    "f11_audit_score": f"""
{_S} SELECT event_id, greatest(0, 100 - 80 * (k % 11 = 0)::INT - 15 * (k % 3 = 0)::INT - 20 * (k % 5 = 0)::INT - 60 * (k % 13 = 0)::INT - 10 * (k % 2 = 0 AND k
> 50)::INT - CASE WHEN k % 4 >= 2 THEN 12 * (k % 4) ELSE 0 END - 8 * greatest(k % 7 - 3, 0))::BIGINT AS score, coalesce(array_to_string(list_filter([CASE WHEN k
% 11 = 0 THEN 'not_answered' END, CASE WHEN k % 3 = 0 THEN 'judge_missing' END, CASE WHEN k % 5 = 0 THEN 'few_accepts' END, CASE WHEN k % 13 = 0 THEN
'trace_error' END, CASE WHEN k % 2 = 0 AND k > 50 THEN 'many_steps' END], lambda x: x IS NOT NULL), ','), '') AS flags FROM s""",
    "f12_trajectory_tags": f"{_S} SELECT user_id, count(*) FILTER (event_type = 'view') AS revisit, count(*) FILTER (k > 90) AS crop FROM s GROUP BY 1",
    "f13_check_trajectories": """
SELECT conv_id, count(*) AS steps, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete, arg_max(role = 'assistant', turn)
AS ends FROM conversations GROUP BY 1""",
    "f14_check_traj_advantage": f"""
{_S}, v AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN value ELSE user_id + k * 1e-9::DOUBLE END AS v FROM s) SELECT user_id, max(v) - min(v) <= 1e-6 + 1e-5
* abs(min(v)) AS same FROM v GROUP BY 1""",
    "f15_drop_constant_groups": f"{_O} SELECT uid, traj FROM o WHERE uid IN (SELECT uid FROM o GROUP BY uid HAVING count(DISTINCT ok) > 1 ORDER BY uid LIMIT 500)",
    "f16_think_quality": r"WITH c AS (SELECT conv_id, text || chr(10) || ['Let me crop it.', 'I''ll zoom in.', 'I should search again.', 'Let me revisit it.', 'Done.'][(conv_id + turn) % 5 + 1] AS text, ['crop', 'search', 'revisit', 'answer'][turn % 4 + 1] AS role, ['crop', 'crop', 'search', 'revisit'][(conv_id + turn) % 5 + 1] AS v FROM conversations), t AS (SELECT conv_id, role, text, v, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: trim(x)), lambda x: length(x) >= 25) AS s, len(regexp_extract_all(lower(text), '\b(maybe|perhaps|might be|probably|i guess|not sure|actually|wait|hmm|alternatively)\b')) AS h FROM c) SELECT conv_id, bool_or(len(list_distinct(s)) < len(s)) AS repeats, bool_or(h >= 5) AS hedges, max(length(text)) > 1500 OR count(*) FILTER (role <> 'crop') >= 7 AS overlong, bool_or(coalesce(v <> role, false)) AS mismatch FROM t GROUP BY 1",
    "f17_grounded_filter": "SELECT p_partkey, p_partkey % 3 = p_partkey % 2 AS grounded FROM part",
    "f18_rl_gate": f"""
{_O}, a AS (SELECT uid, answer, count(*) AS n, sum(ok::INT) AS c, sum((ok AND traj % 3 > 0)::INT) AS t FROM o GROUP BY 1, 2) SELECT uid, sum(c)::BIGINT AS k
FROM a GROUP BY uid HAVING sum(c) BETWEEN 1 AND 6 AND sum(t) >= 1 AND 2 * sum(t) >= sum(c) AND uid % 10 <> 0 AND NOT bool_or(c > 0 AND c < n) AND uid % 12 <= 8""",
    "f19_crop_label": f"""{_O}, t AS (SELECT uid, count(*) FILTER (traj % 2 = 0 AND ok) AS cc, count(*) FILTER (traj % 2 = 0 AND NOT ok) AS cw, count(*) FILTER (traj % 2 = 1 AND ok) AS nc, count(*) FILTER (traj % 2 = 1 AND NOT ok) AS nw FROM o GROUP BY 1)
 SELECT *, CASE WHEN cc > 0 AND nc = 0 THEN 'crop' WHEN nc > 0 AND cc = 0 THEN 'no_crop' END AS label, CASE WHEN cc > 0 AND nc = 0 THEN CASE WHEN nw >= 2 THEN 'strong' ELSE 'weak' END WHEN nc > 0 AND cc = 0 THEN CASE WHEN cw >= 2 THEN 'strong' ELSE 'weak' END END AS confidence FROM t""",
    "f20_clean_verdicts": f"""
{_S} SELECT event_id, CASE WHEN k % 5 = 0 THEN 'unreadable' WHEN k % 5 = 2 THEN 'no verdict' WHEN k % 5 = 1 AND k % 2 <> 0 THEN 'contradiction' END AS
judge_error, CASE WHEN k % 5 = 1 AND k % 2 = 0 THEN true WHEN k % 5 IN (3, 4) THEN false END AS correct FROM s""",
    "d1_balanced_split": f"""
{_D}, p AS (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY {_SEED.format('doc_id')}, doc_id) AS i, count(*) OVER (PARTITION BY hop) AS n FROM d)
SELECT doc_id, hop, CASE WHEN i <= n // 2 THEN 'train' ELSE 'val' END AS split FROM p WHERE i <= n // 2 + n // 10""",
    "d2_packed_select": f"""
{_D}, k AS (SELECT *, count(*) FILTER (hop = 'multi') OVER (PARTITION BY source) AS m, count(*) FILTER (hop = 'single') OVER (PARTITION BY source) AS s FROM d),
m AS (SELECT * FROM k WHERE hop = 'multi' ORDER BY m DESC, s DESC, source, doc_id LIMIT 60), n AS (SELECT * FROM k WHERE hop = 'single' ORDER BY (source NOT IN
(SELECT source FROM m))::INT, s DESC, source, doc_id LIMIT 70) SELECT doc_id, source, hop FROM m UNION ALL SELECT doc_id, source, hop FROM n""",
    "d3_slice_ordered": f"{_D} SELECT * FROM d ORDER BY n_chars, doc_id LIMIT 50 OFFSET 100",
    "d4_interleave": f"""
{_D}, i AS (SELECT doc_id, hop, CASE hop WHEN 'multi' THEN 'a' ELSE 'b' END AS side, row_number() OVER (PARTITION BY hop ORDER BY doc_id) AS i FROM d) SELECT
doc_id, hop, side, row_number() OVER (ORDER BY i, side) AS place FROM i""",
    "d5_shortest_select": f"""
{_D} (SELECT doc_id, hop, n_chars FROM d WHERE hop = 'multi' ORDER BY n_chars, doc_id LIMIT 40) UNION ALL (SELECT doc_id, hop, n_chars FROM d WHERE hop =
'single' ORDER BY n_chars, doc_id LIMIT 60)""",
    "d6_dedup_best": "SELECT o_custkey AS uid, o_orderkey AS traj FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "d7_dedup_latest": f"""
{_S}, x AS (SELECT *, CASE WHEN k % 50 > 0 THEN user_id || '-' || k % 10 ELSE '__missing_' || event_id END AS key FROM s) SELECT key, event_id FROM x QUALIFY
row_number() OVER (PARTITION BY key ORDER BY k DESC, event_id DESC) = 1""",
    "d9_merge_shards": "SELECT doc_id, lang, doc_id * 2 AS ordinal FROM documents",
    "d10_stratified_sample": f"""
{_D}, a AS (SELECT doc_id, lang FROM d WHERE lang = 'de' ORDER BY {_SEED.format('doc_id')}, doc_id LIMIT 10) SELECT * FROM a UNION ALL (SELECT doc_id, lang FROM
d WHERE lang <> 'de' ORDER BY {_SEED.format('doc_id')}, doc_id LIMIT 20)""",
    "d11_weighted_resample": """
WITH p AS (SELECT doc_id, coalesce(sum(w) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS lo FROM (SELECT
doc_id, pow(abs(n_chars), 2) + 1e-8 AS w FROM documents)), u AS (SELECT draw, ('0x' || substr(md5('s-' || draw), 1, 12))::BIGINT / pow(16, 12) AS u FROM (SELECT
unnest(range(3 * count(*))) AS draw FROM documents)) SELECT draw, doc_id FROM u ASOF JOIN p ON u.u >= p.lo""",
    "d12_repeat_rows": f"{_S} SELECT event_id, c::INT AS copy FROM s, unnest(range(1, k % 3 + 1)) AS t(c)",
    "d13_pad_to_multiple": """
WITH n AS (SELECT count(*) AS n, (-count(*) % 768 + 768) % 768 AS short FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM
documents) SELECT doc_id, false AS padding FROM documents UNION ALL SELECT doc_id, true FROM r, n, unnest(range(1 + short // n)) AS t(x) WHERE i + x * n <=
short""",
    "d14_question_minibatches": "SELECT o_orderkey AS traj, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS batch FROM orders",
    "d17_sqrt_quota_sample": f"""
{_D}, z AS (SELECT lang, 120.0::DOUBLE * sqrt(count(*)) / sum(sqrt(count(*))) OVER () AS share FROM d GROUP BY 1), q AS (SELECT lang, floor(share) +
(row_number() OVER (ORDER BY share - floor(share) DESC, lang) <= 120 - sum(floor(share)) OVER ())::INT AS q FROM z), c AS (SELECT *, row_number() OVER
(PARTITION BY lang, source ORDER BY hop <> 'multi', {_SEED.format('doc_id')}, doc_id) AS c FROM d), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER
BY c, hop <> 'multi', {_SEED.format('doc_id')}, doc_id) AS i FROM c) SELECT doc_id, i.lang FROM i JOIN q ON i.lang = q.lang WHERE i <= q""",
    "d18_waterfill_quota": f"""
{_D}, z AS (SELECT lang || '/' || doc_id % 7 AS stratum, count(*) AS size FROM d GROUP BY 1), l AS (SELECT size, (400 - coalesce((SELECT sum(size) FROM z b
WHERE b.size < a.size), 0)) / (SELECT sum(sqrt(size)) FROM z b WHERE b.size >= a.size) AS level FROM z a) SELECT stratum, size, round(least(size,
coalesce((SELECT arg_min(level, size) FROM l WHERE level <= sqrt(size)), 1e18) * sqrt(size)), 6)::DOUBLE AS quota FROM z""",
    "d19_round_robin": f"""
{_D}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_SEED.format('doc_id')}, doc_id)::INT AS round FROM d) SELECT doc_id, source, round FROM
r ORDER BY round, {_SEED.format('source')}, doc_id LIMIT 130""",
    "d20_sort_samples": """
WITH i AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS id, doc_id FROM documents) SELECT id, row_number() OVER (ORDER BY
doc_id % 10 = 0, CASE WHEN doc_id % 10 > 0 THEN doc_id END, id) AS place FROM i""",
    "d21_top_up": f"""
{_D}, r AS (SELECT doc_id AS replaced, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM d WHERE doc_id % 20 = 0), p AS (SELECT doc_id,
lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS i FROM d WHERE doc_id % 20 > 9) SELECT replaced, doc_id, r.lang FROM r JOIN p ON
r.lang = p.lang AND r.i = p.i""",
    "d22_preview": f"SELECT item_id FROM benchmark ORDER BY {_SEED.format('text')}, text LIMIT 20",
    "d15_balance_ranks": """
WITH RECURSIVE o AS (SELECT doc_id, coalesce(n_chars, 0) AS c, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS i FROM documents),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0 AS best, list_transform(range(1, 9), lambda k: 0::BIGINT) AS loads,
 list_transform(range(1, 9), lambda k: n // 8 + (k <= n % 8)::BIGINT) AS room FROM (SELECT count(*) AS n FROM documents)
UNION ALL SELECT i, doc_id, b, list_transform(range(1, 9), lambda k: loads[k] + CASE WHEN k = b THEN c ELSE 0 END), list_transform(range(1, 9), lambda k: room[k] - (k = b)::BIGINT)
 FROM (SELECT *, list_position(x, list_min(x)) AS b FROM (SELECT o.*, loads, room, list_transform(range(1, 9), lambda k: CASE WHEN room[k] > 0 THEN loads[k] ELSE 9e18::BIGINT END) AS x
  FROM r JOIN o ON o.i = r.i + 1)))
SELECT doc_id, (best - 1)::INT AS rank FROM r WHERE i > 0""",
    "d16_micro_batches": """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(n_chars, 0) * CASE WHEN doc_id % 97 = 0 THEN 1000 ELSE 1 END AS c FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY c DESC, doc_id) AS i, count(*) OVER () AS n, ceil(sum(c) OVER () / 400000.0)::BIGINT AS least FROM d WHERE c <= 400000),
r AS (SELECT m, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0 AS best, list_transform(range(m), lambda k: 0::BIGINT) AS loads
 FROM (SELECT unnest(range(l, l + 4)) AS m FROM (SELECT greatest(1, any_value(least)) AS l FROM o))
UNION ALL SELECT m, i, doc_id, b, list_transform(range(1, m + 1), lambda k: loads[k] + CASE WHEN k = b THEN c ELSE 0 END)
 FROM (SELECT r.m, o.i, o.doc_id, o.c, loads, list_position(loads, list_min(loads)) AS b FROM r JOIN o ON o.i = r.i + 1)),
chosen AS (SELECT min(m) AS m FROM r WHERE i = (SELECT max(n) FROM o) AND list_max(loads) <= 400000),
p AS (SELECT doc_id, (best - 1)::INT AS batch FROM r JOIN chosen USING (m) WHERE i > 0
 UNION ALL SELECT doc_id, (m + row_number() OVER (ORDER BY doc_id) - 1)::INT FROM d, chosen WHERE c > 400000)
SELECT doc_id, batch, (sum(c) OVER (PARTITION BY batch))::BIGINT AS batch_cost FROM p JOIN d USING (doc_id)""",
    **{
        name: f"""
WITH o AS (SELECT o_custkey AS uid, o_orderkey AS traj, o_orderkey % 5 + 1 AS round, o_orderstatus = 'F' AS ok FROM orders),
u AS (SELECT *, min(ok) OVER g <> max(ok) OVER g AS useful FROM o WINDOW g AS (PARTITION BY round, uid)),
n AS (SELECT round, sum(sum(useful::INT)) OVER (ORDER BY round) AS total FROM u GROUP BY round),
s AS (SELECT least({most}, coalesce((SELECT min(round) FROM n WHERE total >= (SELECT count(*) {target} FROM orders)), {most})) AS stop)
SELECT uid, traj, round::INT AS round FROM u, s WHERE round <= stop AND (useful OR round = {most})"""
        for name, most, target in (("f15_accumulate_groups", 5, "// 4"), ("f15_last_try", 2, ""))
    },
    "f13_answered": """
SELECT conv_id, count(*) AS steps, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete, arg_max(role = 'assistant', turn) AS ends,
 bool_and(trim(coalesce(text, '')) <> '' AND NOT (turn % 3 = 2 AND role = 'assistant')) AS answered FROM conversations GROUP BY 1""",
    "f14_masked": f"""
{_S}, v AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN value ELSE user_id::DOUBLE END AS v FROM s WHERE k % 4 > 0),
c AS (SELECT user_id, max(v) - min(v) <= 1e-6 + 1e-5 * abs(min(v)) AS same FROM v GROUP BY 1)
SELECT user_id, coalesce(same, true) AS same FROM (SELECT DISTINCT user_id FROM s) LEFT JOIN c USING (user_id)""",
    "d22_smoke_set": "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20",
}
