"""Rollout analytics: customers are question groups, orders rollouts, line items steps; events are trace steps of a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import rollouts as W

from .tables import table


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("traj"), (F.col("o_totalprice") / 1000).alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("traj"), "ts", "event_id", F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("long").alias("page"))


def _lines(spark, sf):
    """Line items dealt by order, in as many parts as a shuffle has: lists and sets of an order's lines are made there only."""
    return table(spark, sf, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")


def _rows(spark, sf):
    """Token-level rows: an order's lines as arrays in a fixed order."""
    line = _lines(spark, sf).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("s"))
    held = line.groupBy(F.col("l_orderkey").alias("traj")).agg(F.array_sort(F.collect_list("s")).alias("a"))
    return held.select("traj", F.transform("a", lambda s: s["l_discount"]).alias("x"), F.transform("a", lambda s: s["l_tax"]).alias("y"), F.transform("a", lambda s: (s["l_quantity"] > 10).cast("double")).alias("mask"))


def _six(df, *names, digits=6):
    """Rounded, and without negative zeros."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def w1_discounted_returns(spark, sf):
    out = W.discounted_returns(_events(spark, sf), "traj", ["ts", "event_id"], "value", 0.9)
    return _six(out.select("event_id", F.col("return").alias("ret")), "ret")


def w1_returns_undiscounted(spark, sf):
    out = W.discounted_returns(_events(spark, sf), "traj", ["ts", "event_id"], "value", 1)
    return _six(out.select("event_id", F.col("return").alias("ret")), "ret")


def w2_grpo(spark, sf):
    return _six(W.grpo(_orders(spark, sf), "uid", "score").select("traj", "advantage"), "advantage")


def w2_grpo_trajectory_votes(spark, sf):
    """One vote per trajectory (an order) of a customer, whose steps are line items."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    steps = line.join(orders.hint("shuffle_hash"), "o_orderkey").withColumn("first", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    out = W.grpo(steps, "o_custkey", "l_extendedprice", traj="o_orderkey", order="first")
    return _six(out.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "advantage"), "advantage")


def w3_grpo_passk(spark, sf):
    o = _orders(spark, sf)
    many = o.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid")
    return _six(W.grpo_passk(o.join(many, "uid", "left_semi"), "uid", "score", "traj").select("traj", "advantage"), "advantage")


def w4_rloo(spark, sf):
    return _six(W.rloo(_orders(spark, sf), "uid", "score").select("traj", "advantage"), "advantage")


def w5_rfpp_baseline(spark, sf):
    o = _orders(spark, sf).withColumn("mask", (F.col("status") != "P").cast("int"))
    return _six(W.rfpp_baseline(o, "uid", "score", "mask").select("traj", "advantage"), "advantage")


def w6_reinforce_returns(spark, sf):
    rows = _rows(spark, sf).withColumn("r", W.reinforce_returns(F.col("x"), F.col("mask"), 0.95))
    return _six(rows.select("traj", F.posexplode("r").alias("i", "ret")), "ret", digits=12)


def w6_gae(spark, sf):
    rows = _rows(spark, sf).withColumn("a", W.gae(F.col("x"), F.col("y"), 0.99, 0.95))
    return _six(rows.select("traj", F.posexplode("a").alias("i", "adv")), "adv")


def w6_reinforce_whitened(spark, sf):
    return _six(W.reinforce_advantages(_rows(spark, sf), "traj", "x", "mask", 0.95), "advantage")


def w6_gae_whitened(spark, sf):
    return _six(W.gae_advantages(_rows(spark, sf), "traj", "x", "y", "mask", 0.99, 0.95), "advantage")


def w6_remax(spark, sf):
    returns, advantage = W.remax_returns(F.col("x"), F.col("mask"), F.element_at("y", 1))
    rows = _rows(spark, sf).withColumn("p", F.arrays_zip(returns.alias("ret"), advantage.alias("adv")))
    return _six(rows.select("traj", F.posexplode("p").alias("i", "p")).select("traj", "i", "p.ret", "p.adv"), "ret", "adv")


def w7_gigpo_steps(spark, sf):
    out = W.gigpo_steps(_events(spark, sf), "traj", "page", "value")
    return _six(out.select("event_id", "step_advantage"), "step_advantage")


def w7_gigpo(spark, sf):
    """Episode scores are a user's clicks; both parts by deviation."""
    e = _events(spark, sf).withColumn("uid", F.col("traj") % 10).withColumn("episode", (F.col("traj") % 7).cast("double"))
    return _six(W.gigpo(e, "uid", "page", "episode", "value", 0.5, True).select("event_id", "advantage"), "advantage")


def w9_ra_search_steps(spark, sf):
    e = _events(spark, sf).withColumn("uid", F.col("traj") % 10)
    e = e.withColumn("anchor", F.array(F.col("page") % 3, F.col("event_id") % 2)).withColumn("after", F.array(F.col("page") % 3, F.col("event_id") % 2, F.col("page") % 5))
    search = (F.col("action") == "view") & (F.col("page") % 4 > 0)
    return _six(W.ra_search_steps(e, "uid", "traj", ["ts", "event_id"], "anchor", "after", search).select("event_id", "step_advantage"), "step_advantage")


def w9_ra_steps(spark, sf):
    e = _events(spark, sf).withColumn("uid", F.col("traj") % 10).withColumn("anchor", F.array_sort(F.array_distinct(F.array(F.col("page") % 3, F.col("event_id") % 2))))
    e = e.withColumn("action", F.when(F.col("action") == "view", "search").when(F.col("action") == "click", "update_graph").otherwise("answer")).withColumn("kind", F.when(F.col("page") % 4 > 0, "analyse").otherwise("decide"))
    e = e.withColumn("env", F.col("value") / 1000).withColumn("judged", F.when(F.col("action") == "update_graph", (F.col("page") % 3) / 2).otherwise(0.0))
    out = W.ra_steps(e, "uid", "traj", "event_id", "anchor", "action", "kind", "page", "env", "judged", weight=0.5)
    return _six(out.select("event_id", "local_score", "step_advantage"), "local_score", "step_advantage")


def w10_scatter_spans(spark, sf):
    rows = _rows(spark, sf)
    spans = _lines(spark, sf).select(F.col("l_orderkey").alias("traj"), F.col("l_partkey").alias("span"), F.pmod("l_suppkey", F.lit(3)).cast("int").alias("lo"), (F.pmod("l_suppkey", F.lit(3)) + F.pmod("l_partkey", F.lit(4))).cast("int").alias("hi"), (F.col("l_partkey") / 100).alias("advantage")).distinct()
    return _six(W.scatter_spans(spans, rows, "traj"), "advantage")


def w11_judgement_reward(spark, sf):
    e = _events(spark, sf)
    verdict = F.when(F.col("event_id") % 3 == 0, "yes").when(F.col("event_id") % 3 == 1, "partial").otherwise("no")
    return e.select("event_id", W.judgement_reward(F.col("page") % 2 == 0, verdict).alias("reward"))


def w12_lookahead_reward(spark, sf):
    e = _events(spark, sf).withColumn("reward", F.when(F.col("page") % 2 == 0, 0.5).otherwise(0.0)).withColumn("correct", F.col("event_id") % 3 == 0)
    return W.lookahead_reward(e, "traj", ["ts", "event_id"], "reward", "correct").select("event_id", "raised")


def w13_post_gold(spark, sf):
    e = _events(spark, sf)
    gold = e.select("traj", "page").where("page % 5 = traj % 5").distinct()
    return W.post_gold(e, gold, "traj", "event_id", "page", F.col("action") == "click")


def w14_warned_searches(spark, sf):
    return W.warned_searches(_events(spark, sf), "traj", ["ts", "event_id"], F.col("action") == "click", F.col("page") % 7 == 0)


def w15_terminal_reward(spark, sf):
    o = _orders(spark, sf)
    weights = {"coverage": 0.5, "full": 0.2, "precision": 0.1, "grounding": 0.3, "cost": 0.1, "max_turns": 8.0, "late": 0.05, "decay": 0.5}
    t = F.col("traj")
    r = W.terminal_reward(F.col("status") == "F", t % 3, F.lit(2), t % 4 + 2, (t % 5) / 5, t % 8, t % 6, t % 7 > 0, weights)
    return o.select("traj", F.round(r, 6).alias("reward"))


def w16_step_rewards(spark, sf):
    kind = F.when(F.col("action") == "error", "format").when(F.col("page") % 11 == 0, "edit")
    reward, ends = W.step_rewards(kind, F.col("page"), 90, -0.1)
    return _events(spark, sf).select("event_id", reward.alias("reward"), ends.alias("ends"))


def w17_action_penalty(spark, sf):
    rows = W.action_penalty(_rows(spark, sf).withColumn("valid", F.col("traj") % 4 != 0), "x", "mask", "valid", 0.5)
    return rows.select("traj", (F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"))


def w18_kl_rewards(spark, sf):
    rows = _rows(spark, sf)
    out = rows
    for kind in ("k1", "abs", "k2", "k3"):
        r, kl = W.kl_rewards(F.col("x"), F.col("y"), F.col("x"), F.col("mask"), 0.1, kind)
        out = out.withColumn(f"{kind}_reward", F.round(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), 9) + F.lit(0.0)).withColumn(f"{kind}_kl", F.round(kl, 9) + F.lit(0.0))
    return out.drop("x", "y", "mask")


def w19_traj_log_ratio(spark, sf):
    rows = _rows(spark, sf).withColumn("uid", F.col("traj") % 100)
    return _six(W.traj_log_ratio(rows, "uid", "x", "y", "mask"), "log_ratio")


def w20_expected_update(spark, sf):
    e = _events(spark, sf).withColumn("n_gold", F.lit(3))
    return W.expected_update(e, "traj", ["ts", "event_id"], F.col("page") % 10 == 0, "page", "n_gold").select("event_id", "expected")


def a20_batch_metrics(spark, sf):
    line = table(spark, sf, "lineitem")
    out = W.batch_metrics(line, "l_orderkey", ["l_discount", "l_tax"], "l_quantity", 50)
    return _six(out, *[c for c in out.columns if c != "episodes"], digits=9)


def a21_reward_metrics(spark, sf):
    out = W.reward_metrics(table(spark, sf, "lineitem"), "l_orderkey", ["l_discount", "l_tax"], F.col("l_quantity") > 5, F.col("l_returnflag") == "R")
    return _six(out, *out.columns)


def a22_validation_metrics(spark, sf):
    return _six(W.validation_metrics(_orders(spark, sf), "priority", "uid", "score"), "mean_at_n", "std_at_n")


def a23_bootstrap(spark, sf):
    """1,000 draws at every size of a group; held against a23_expected_extremes in the tests."""
    return W.bootstrap_extremes(_orders(spark, sf), "uid", "score", None, 1000, "boot")


def a23_expected_extremes(spark, sf):
    return _six(W.expected_extremes(_orders(spark, sf), "uid", "score", 4), "best_mean", "worst_mean")


def a24_majority_value(spark, sf):
    return _six(W.majority_value(_orders(spark, sf), "uid", "priority", "score", "traj"), "score")


def a26_throughput(spark, sf):
    out = W.throughput(table(spark, sf, "documents"), "n_chars", 12.5, 4)
    return _six(out, "per_second_device", "ms_per_token")


def a27_reduce_metrics(spark, sf):
    maps = table(spark, sf, "lineitem").select(F.create_map(F.lit("discount"), F.col("l_discount"), F.concat(F.lit("flag_"), "l_returnflag"), F.col("l_tax")).alias("m"))
    return _six(W.reduce_metrics(maps, "m"), "mean")


def a28_masked_agg(spark, sf):
    modes = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-sum-norm")
    parts = [W.masked_agg(_rows(spark, sf), "x", "mask", m).withColumn("mode", F.lit(m)) for m in modes]
    return _six(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "value")


def a29_masked_whiten(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    return _six(W.masked_whiten(line, F.col("l_discount"), F.col("l_returnflag") != "R", "white").drop("l_discount", "l_returnflag"), "white")


def a32_group_sizes(spark, sf):
    return _six(W.group_sizes(_events(spark, sf), "traj", "page"), "share")


def a33_balance_report(spark, sf):
    return _six(W.balance_report(table(spark, sf, "documents").withColumn("part", F.col("doc_id") % 16), "part", "n_chars"), "mean")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "wa" and k[1].isdigit()}

_EV = "e AS (SELECT user_id AS traj, ts, event_id, event_type AS action, value, (props->>'$.k')::BIGINT AS page FROM events)"
_OR = "o AS (SELECT o_custkey AS uid, o_orderkey AS traj, o_totalprice / 1000 AS score, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
_RW = """l AS (SELECT l_orderkey AS traj, l_discount AS x, l_tax AS y, (l_quantity > 10)::INT::DOUBLE AS m,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)::INT - 1 AS i FROM lineitem)"""
_WHITE = "s AS (SELECT sum({0} * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM {1}), v AS (SELECT any_value(mean) AS mean, sum(({0} - mean) * ({0} - mean) * m) / (sum(m) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM {1}, s)"
_KL = {"k1": "(y - x)", "abs": "abs(y - x)", "k2": "0.5 * (y - x) * (y - x)", "k3": "(exp(x - y) - (x - y) - 1)"}
ORACLE_SQL = {
    "w1_discounted_returns": f"""
WITH RECURSIVE {_EV}, p AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY ts DESC, event_id DESC) AS i FROM e), r AS (SELECT traj, i, event_id,
value::DOUBLE AS ret FROM p WHERE i = 1 UNION ALL SELECT p.traj, p.i, p.event_id, p.value + 0.9::DOUBLE * r.ret FROM r JOIN p ON p.traj = r.traj AND p.i = r.i +
1) SELECT event_id, round(ret, 6) AS ret FROM r""",
    "w1_returns_undiscounted": f"WITH {_EV} SELECT event_id, round(sum(value) OVER (PARTITION BY traj ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS ret FROM e",
    "w2_grpo": f"""
WITH {_OR} SELECT traj, round((score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE
stddev_samp(score) OVER w END + 1e-6), 6) AS advantage FROM o WINDOW w AS (PARTITION BY uid)""",
    "w2_grpo_trajectory_votes": """
WITH k AS (SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS uid, l_extendedprice AS x, row_number() OVER (PARTITION BY
l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT uid,
count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM k WHERE f GROUP BY uid) SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, round((x - CASE WHEN n = 1
THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 6) AS advantage FROM k JOIN g USING (uid)""",
    "w3_grpo_passk": f"""
WITH {_OR}, k AS (SELECT *, row_number() OVER s AS rn, lead(score) OVER s AS nxt, stddev_samp(score) OVER w AS sd, count(*) OVER w AS n FROM o WINDOW s AS
(PARTITION BY uid ORDER BY score DESC, traj), w AS (PARTITION BY uid)) SELECT traj, CASE WHEN rn = 1 THEN round((score - nxt) / (sd + 1e-6), 6) ELSE 0 END AS
advantage FROM k WHERE n > 1""",
    "w4_rloo": f"""
WITH {_OR}, k AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m FROM o WINDOW w AS (PARTITION BY uid)) SELECT traj, round(CASE WHEN n = 1 THEN score
ELSE (score - m) * n / (n - 1) END, 6) AS advantage FROM k""",
    "w5_rfpp_baseline": f"""
WITH {_OR}, k AS (SELECT traj, (status <> 'P')::INT AS m, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS c FROM o WINDOW w AS
(PARTITION BY uid)), s AS (SELECT sum(c * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM k), v AS (SELECT any_value(mean) AS mean, sum((c - mean) * (c - mean) *
m) / (sum(m) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM k, s) SELECT traj, round((c - mean) / sqrt(var + 1e-8), 6) AS advantage FROM k, v""",
    "w6_reinforce_returns": f"""
WITH RECURSIVE {_RW}, r AS (SELECT traj, i, x * m AS ret FROM l WHERE (traj, i) IN (SELECT traj, max(i) FROM l GROUP BY traj) UNION ALL SELECT l.traj, l.i, (l.x
+ 0.95::DOUBLE * r.ret) * l.m FROM r JOIN l ON l.traj = r.traj AND l.i = r.i - 1) SELECT traj, i, round(ret, 12) + 0 AS ret FROM r""",
    "w6_gae": f"""
WITH RECURSIVE {_RW}, d AS (SELECT traj, i, x + 0.99::DOUBLE * coalesce(lead(y) OVER (PARTITION BY traj ORDER BY i), 0) - y AS d FROM l), r AS (SELECT traj, i,
d AS adv FROM d WHERE (traj, i) IN (SELECT traj, max(i) FROM l GROUP BY traj) UNION ALL SELECT d.traj, d.i, d.d + 0.99::DOUBLE * 0.95::DOUBLE * r.adv FROM r
JOIN d ON d.traj = r.traj AND d.i = r.i - 1) SELECT traj, i, round(adv, 6) AS adv FROM r""",
    "w6_reinforce_whitened": f"""
WITH RECURSIVE {_RW}, r AS (SELECT traj, i, m, x AS ret, x * m AS run FROM l WHERE (traj, i) IN (SELECT traj, max(i) FROM l GROUP BY traj) UNION ALL SELECT
l.traj, l.i, l.m, l.x + 0.95::DOUBLE * r.run, (l.x + 0.95::DOUBLE * r.run) * l.m FROM r JOIN l ON l.traj = r.traj AND l.i = r.i - 1),
{_WHITE.format('ret', 'r')} SELECT traj, i, round((ret - mean) / sqrt(var + 1e-8) * m, 6) + 0 AS advantage FROM r, v""",
    "w6_gae_whitened": f"""
WITH RECURSIVE {_RW}, d AS (SELECT traj, i, m, x + 0.99::DOUBLE * coalesce(lead(y) OVER (PARTITION BY traj ORDER BY i), 0) - y AS d FROM l), r AS (SELECT traj,
i, m, d AS adv FROM d WHERE (traj, i) IN (SELECT traj, max(i) FROM l GROUP BY traj) UNION ALL SELECT d.traj, d.i, d.m, d.d + 0.99::DOUBLE * 0.95::DOUBLE * r.adv
FROM r JOIN d ON d.traj = r.traj AND d.i = r.i - 1), {_WHITE.format('adv', 'r')} SELECT traj, i, round((adv - mean) / sqrt(var + 1e-8), 6) AS advantage FROM r,
v""",
    "w6_remax": f"""
WITH {_RW}, r AS (SELECT *, sum(x * m) OVER (PARTITION BY traj ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret, first_value(y) OVER
(PARTITION BY traj ORDER BY i) AS b FROM l) SELECT traj, i, round(ret, 6) AS ret, round(ret - b * m, 6) + 0 AS adv FROM r""",
    "w7_gigpo_steps": f"""
WITH {_EV} SELECT event_id, round(CASE WHEN count(*) OVER w = 1 THEN 0 ELSE (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) END, 6) AS
step_advantage FROM e WINDOW w AS (PARTITION BY traj, page)""",
    "w7_gigpo": f"""
WITH {_EV}, k AS (SELECT *, traj % 10 AS uid, (traj % 7)::DOUBLE AS ep FROM e) SELECT event_id, round((ep - CASE WHEN count(*) OVER q = 1 THEN 0 ELSE avg(ep)
OVER q END) / (CASE WHEN count(*) OVER q = 1 THEN 1 ELSE stddev_samp(ep) OVER q END + 1e-6) + 0.5::DOUBLE * CASE WHEN count(*) OVER w = 1 THEN 0 ELSE (value -
avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) END, 6) AS advantage FROM k WINDOW q AS (PARTITION BY uid), w AS (PARTITION BY uid, page)""",
    "w9_ra_search_steps": f"""
WITH {_EV}, a AS (SELECT event_id, ts, traj, traj % 10 AS uid, action = 'view' AND page % 4 > 0 AS s, list_sort(list_distinct([page % 3, event_id % 2])) AS
anchor, (NOT list_contains([page % 3, event_id % 2], page % 5))::INT::DOUBLE AS up FROM e), f AS (SELECT *, s AND row_number() OVER (PARTITION BY traj, anchor,
s ORDER BY ts, event_id) = 1 AS f FROM a) SELECT event_id, round(CASE WHEN f AND count(*) OVER w >= 2 THEN (up - avg(up) OVER w) / (stddev_pop(up) OVER w +
1e-6) ELSE 0 END, 6) + 0 AS step_advantage FROM f WINDOW w AS (PARTITION BY uid, anchor, f)""",
    "w9_ra_steps": f"""WITH {_EV}, a AS (SELECT event_id, traj, traj % 10 AS uid, page, value / 1000 AS env, CASE action WHEN 'view' THEN 'search' WHEN 'click' THEN 'update_graph' ELSE 'answer' END AS action, page % 4 > 0 AS an, list_sort(list_distinct([page % 3, event_id % 2])) AS anchor FROM e),
 n AS (SELECT *, lead(anchor) OVER (PARTITION BY traj ORDER BY event_id) AS nxt, CASE WHEN action = 'update_graph' THEN page ELSE -1 END AS seen, action = 'search' OR (action = 'update_graph' AND an) AS act FROM a),
 s AS (SELECT *, CASE WHEN action = 'search' THEN CASE WHEN nxt IS NOT NULL AND list_has_all(nxt, anchor) AND len(nxt) > len(anchor) THEN 1 ELSE -1 END ELSE 0 END + CASE WHEN action = 'update_graph' AND an THEN 0.5::DOUBLE * (page % 3) / 2 ELSE 0 END + env AS ls, act AND row_number() OVER (PARTITION BY traj, anchor, action, seen, act ORDER BY event_id) = 1 AS f FROM n)
 SELECT event_id, round(ls, 6) + 0 AS local_score, round(CASE WHEN f AND count(*) OVER w >= 2 THEN (ls - avg(ls) OVER w) / (stddev_pop(ls) OVER w + 1e-6) ELSE 0 END, 6) + 0 AS step_advantage FROM s WINDOW w AS (PARTITION BY uid, anchor, action, seen, f)""",
    "w10_scatter_spans": f"""
WITH {_RW}, s AS (SELECT DISTINCT l_orderkey AS traj, l_partkey AS span, l_suppkey % 3 AS lo, l_suppkey % 3 + l_partkey % 4 AS hi FROM lineitem) SELECT l.traj,
l.i AS place, round(coalesce((SELECT max(span) / 100 FROM s WHERE s.traj = l.traj AND s.lo <= l.i AND l.i < s.hi), 0) * m, 6) AS advantage FROM l""",
    "w11_judgement_reward": f"WITH {_EV} SELECT event_id, CASE WHEN page % 2 = 0 THEN [1.0::DOUBLE, 0.5, -1.0][event_id % 3 + 1] ELSE [-1.0::DOUBLE, -0.5, 1.0][event_id % 3 + 1] END AS reward FROM e",
    "w12_lookahead_reward": f"""
WITH {_EV}, k AS (SELECT event_id, page, lead(event_id % 3 = 0) OVER (PARTITION BY traj ORDER BY ts, event_id) AS nxt FROM e) SELECT event_id, CASE WHEN page %
2 <> 0 THEN 0.0 WHEN nxt THEN 1.0 ELSE 0.5 END::DOUBLE AS raised FROM k""",
    "w13_post_gold": f"""
WITH {_EV}, g AS (SELECT traj, page, min(event_id) AS t FROM e WHERE page % 5 = traj % 5 GROUP BY 1, 2), d AS (SELECT traj, max(t) AS gold_turn FROM g GROUP BY
1) SELECT traj, gold_turn, (SELECT count(*) FROM e WHERE e.traj = d.traj AND action = 'click' AND event_id > gold_turn) AS late_searches FROM d""",
    "w14_warned_searches": f"""
WITH {_EV}, k AS (SELECT *, coalesce(sum((page % 7 = 0)::INT) OVER (PARTITION BY traj ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
0) > 0 AS w FROM e) SELECT traj, count(*) FILTER (action = 'click') AS searches, count(*) FILTER (action = 'click' AND w) AS warned FROM k GROUP BY traj""",
    "w15_terminal_reward": f"""
WITH {_OR} SELECT traj, round((status = 'F')::INT + 0.5::DOUBLE * (traj % 3) / 2 + 0.2 * (traj % 3 = 2)::INT + CASE WHEN traj % 3 = 2 THEN 0.1::DOUBLE * 2 /
(traj % 4 + 2) ELSE 0 END + 0.3 * (traj % 5) / 5 - 0.1 * (traj % 8) / 8 + CASE WHEN status = 'F' AND traj % 3 = 2 AND traj % 7 > 0 THEN 0.05 * pow(0.5, traj %
6) ELSE 0 END, 6)::DOUBLE AS reward FROM o""",
    "w16_step_rewards": f"""
WITH {_EV} SELECT event_id, CASE WHEN action = 'error' OR page >= 90 THEN -1.0 WHEN page % 11 = 0 THEN -0.1 ELSE 0.0 END::DOUBLE AS reward, action = 'error' OR
page >= 90 AS ends FROM e""",
    "w17_action_penalty": f"WITH {_RW} SELECT traj, round(sum(x) - CASE WHEN traj % 4 = 0 AND max(m) = 1 THEN 0.5 ELSE 0 END, 6) + 0 AS total FROM l GROUP BY traj",
    "w18_kl_rewards": f"WITH {_RW} SELECT traj, " + ", ".join(f"round(sum(x - 0.1 * {v} * m), 9) + 0 AS {k}_reward, round(sum({v} * m) / nullif(sum(m), 0), 9) + 0 AS {k}_kl" for k, v in _KL.items()) + " FROM l GROUP BY traj",
    "w19_traj_log_ratio": f"WITH {_RW} SELECT traj % 100 AS uid, round(sum((x - y) * m) / sum(m), 6) AS log_ratio FROM l GROUP BY 1",
    "w20_expected_update": f"""
WITH {_EV}, f AS (SELECT *, (page % 10 = 0 AND row_number() OVER (PARTITION BY traj, page ORDER BY ts, event_id) = 1)::INT AS fresh FROM e) SELECT event_id,
CASE WHEN page % 10 <> 0 THEN 'reject' WHEN sum(fresh) OVER (PARTITION BY traj ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) < 3 THEN 'expand' ELSE 'accept'
END AS expected FROM f""",
    "a20_batch_metrics": "SELECT " + ", ".join(f"round({f}({m}), 9) AS {m}_{n}" for m in ("l_discount", "l_tax") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + ", round(avg(l_quantity), 9) AS length_mean, round(avg((l_quantity >= 50)::INT), 9) AS clip_ratio, count(DISTINCT l_orderkey) AS episodes, round(count(*) / count(DISTINCT l_orderkey), 9) AS episode_length FROM lineitem",
    "a21_reward_metrics": """
SELECT round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std, round(avg(l_tax), 6) AS l_tax_mean,
round(stddev_pop(l_tax), 6) AS l_tax_std, (SELECT round(avg(h), 6) FROM (SELECT min((l_quantity > 5)::INT) AS h FROM lineitem GROUP BY l_orderkey)) AS hit_all,
(SELECT round(avg(a), 6) FROM (SELECT max((l_returnflag = 'R')::INT) AS a FROM lineitem GROUP BY l_orderkey)) AS answered FROM lineitem""",
    "a22_validation_metrics": f"""
WITH {_OR} SELECT priority, round(avg(m), 6) AS mean_at_n, round(avg(s), 6) AS std_at_n, count(*) AS prompts, sum(n)::BIGINT AS samples FROM (SELECT priority,
uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1""",
    "a23_expected_extremes": f"""
WITH {_OR}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS n FROM o) SELECT uid, round(sum(score
* (pow(i / n, 4) - pow((i - 1) / n, 4))), 6) AS best_mean, round(sum(score * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))), 6) AS worst_mean FROM k GROUP BY
uid""",
    "a24_majority_value": f"""
WITH {_OR}, k AS (SELECT uid, priority, count(*) AS n, min(traj) AS f, arg_min(score, traj) AS v FROM o GROUP BY 1, 2) SELECT uid, round(v, 6) AS score FROM k
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) = 1""",
    "a26_throughput": "SELECT sum(n_chars)::BIGINT AS tokens, round(sum(n_chars) / 50, 6) AS per_second_device, round(12500 / sum(n_chars), 6) AS ms_per_token FROM documents",
    "a27_reduce_metrics": "SELECT 'discount' AS metric, round(avg(l_discount), 6) AS mean FROM lineitem UNION ALL SELECT 'flag_' || l_returnflag, round(avg(l_tax), 6) FROM lineitem GROUP BY 1",
    "a28_masked_agg": f"""
WITH {_RW}, s AS (SELECT traj, sum(x * m) AS s, sum(m) AS n, count(*) AS w FROM l GROUP BY traj) SELECT 'token-mean' AS mode, round(sum(s) / sum(n), 6) AS value
FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM s UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / greatest(n, 1)), 6) FROM s UNION ALL
SELECT 'seq-sum-norm', round(sum(s) / max(w), 6) FROM s""",
    "a29_masked_whiten": """
WITH k AS (SELECT *, (l_returnflag <> 'R')::INT AS m FROM lineitem), s AS (SELECT sum(l_discount * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM k), v AS
(SELECT any_value(mean) AS mean, sum((l_discount - mean) * (l_discount - mean) * m) / (sum(m) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM k, s)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, round((l_discount - mean) / sqrt(var + 1e-8), 6) AS white FROM k, v""",
    "a32_group_sizes": f"""
WITH {_EV}, s AS (SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM e GROUP BY traj, page) GROUP BY size) SELECT size, groups, round(groups /
sum(groups) OVER (), 6) AS share FROM s""",
    "a33_balance_report": "SELECT min(c)::BIGINT AS low, max(c)::BIGINT AS high, round(avg(c), 6) AS mean FROM (SELECT sum(n_chars) AS c FROM documents GROUP BY doc_id % 16)",
}
