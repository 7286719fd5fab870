"""Rollout analytics: returns, group-relative advantages, rewards, batch metrics.

Everything is partitioned by trajectory or question group; global statistics are one-row aggregates joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.reductions import LARGEST, SMALLEST, bootstrap
from foliant.functions.scans import scan_back

EPS = 1e-6


#: Steps that are folded in one array.
SEGMENT = 4096


def discounted_returns(steps: DataFrame, traj: str, order: Sequence[str], reward: str, gamma: float) -> DataFrame:
    """Reward + gamma * the next step's return, backwards within a trajectory; order must be total.

    A gamma of 0 or 1 needs no fold. Otherwise segments of a trajectory are folded, and what a segment's returns lack is
    the return at the start of the next one, which the later segments' first returns and lengths tell.
    """
    window = Window.partitionBy(traj).orderBy(*order)
    value = F.col(reward).cast("double")
    if gamma == 0:
        return steps.withColumn("return", value)
    if gamma == 1:
        return steps.withColumn("return", F.sum(value).over(window.rowsBetween(0, Window.unboundedFollowing)))
    placed = steps.select(F.col(traj).alias("_traj"), (F.row_number().over(window) - 1).alias("_i"), value.alias("_r"), F.struct(*map(F.col, steps.columns)).alias("_row"))
    held = placed.groupBy("_traj", F.floor(F.col("_i") / SEGMENT).alias("_seg")).agg(F.collect_list(F.struct("_i", "_r", "_row")).alias("_held"))
    held = held.withColumn("_held", F.array_sort("_held", lambda x, y: x["_i"] - y["_i"]))
    fades = F.array_repeat(F.lit(float(gamma)), F.size("_held"))
    held = held.withColumn("_own", scan_back(fades, F.transform("_held", lambda x: x["_r"])))
    # a segment is one affine map of the return behind it, so the segments' returns are a scan of their own
    maps = held.groupBy("_traj").agg(F.array_sort(F.collect_list(F.struct("_seg", F.get("_own", F.lit(0)).alias("first"), F.pow(F.lit(float(gamma)), F.size("_own")).alias("fade")))).alias("_m"))
    starts = scan_back(F.transform("_m", lambda x: x["fade"]), F.transform("_m", lambda x: x["first"]))
    starts = maps.select("_traj", F.posexplode(starts).alias("_seg", "_next")).select("_traj", (F.col("_seg") - 1).cast("long").alias("_seg"), "_next")
    held = held.join(starts, ["_traj", "_seg"], "left").withColumn("_next", F.coalesce("_next", F.lit(0.0)))
    both = F.arrays_zip("_held", "_own")
    each = held.select("_next", F.size("_own").alias("_n"), F.posexplode(both).alias("_p", "_x"))
    returned = F.col("_x._own") + F.pow(F.lit(float(gamma)), F.col("_n") - F.col("_p")) * F.col("_next")
    return each.select("_x._held._row.*", returned.alias("return"))


def grpo(rollouts: DataFrame, uid: str, score: str, by_std: bool = True, traj: str | None = None, order: str | None = None) -> DataFrame:
    """(score - mean) / (sample deviation + eps) in the question group; a lone score has mean 0 and deviation 1.

    Every row (step) has a vote in mean and deviation, or, where traj is named, the first row of each trajectory by order.
    """
    if traj is not None:
        return _grpo_by_trajectory(rollouts, uid, score, by_std, traj, order)
    w = Window.partitionBy(uid)
    lone = F.count(score).over(w) == 1
    mean = F.when(lone, 0.0).otherwise(F.avg(score).over(w))
    std = F.when(lone, 1.0).otherwise(F.stddev_samp(score).over(w))
    centred = F.col(score) - mean
    return rollouts.withColumn("advantage", centred / (std + EPS) if by_std else centred)


def _grpo_by_trajectory(steps: DataFrame, uid: str, score: str, by_std: bool, traj: str, order: str) -> DataFrame:
    """Votes are counted apart from the steps, and each step meets its question's one row of statistics: no step is sorted."""
    votes = steps.groupBy(uid, traj).agg(F.min(F.struct(F.col(order).alias("o"), F.col(score).alias("x"))).alias("_first")).select(F.col(uid).alias("_uid"), F.col("_first.x").alias("_vote"))
    lone = F.count("_vote") == 1
    stats = votes.groupBy("_uid").agg(F.when(lone, 0.0).otherwise(F.avg("_vote")).alias("_mean"), F.when(lone, 1.0).otherwise(F.stddev_samp("_vote")).alias("_std"))
    held = steps.join(stats.hint("shuffle_hash"), F.col(uid).eqNullSafe(F.col("_uid")))
    centred = F.col(score) - F.col("_mean")
    return held.withColumn("advantage", centred / (F.col("_std") + EPS) if by_std else centred).drop("_uid", "_mean", "_std")


def grpo_passk(rollouts: DataFrame, uid: str, score: str, tie: str, by_std: bool = True) -> DataFrame:
    """The best rollout of a group gets max - second, others 0. Groups of one are an error."""
    w = Window.partitionBy(uid)
    order = w.orderBy(F.desc(score), tie)
    gap = F.col(score) - F.lead(score).over(order)
    scaled = gap / (F.stddev_samp(score).over(w) + EPS) if by_std else gap
    checked = F.when(F.count("*").over(w) == 1, F.raise_error(F.lit("a group has one rollout")).cast("double"))
    return rollouts.withColumn("advantage", F.coalesce(checked, F.when(F.row_number().over(order) == 1, scaled).otherwise(0.0)))


def rloo(rollouts: DataFrame, uid: str, score: str) -> DataFrame:
    """The score against the mean of the others; a lone score is unchanged."""
    w = Window.partitionBy(uid)
    n = F.count("*").over(w)
    return rollouts.withColumn("advantage", F.when(n == 1, F.col(score)).otherwise((F.col(score) - F.avg(score).over(w)) * n / (n - 1)))


def masked_whiten(rows: DataFrame, value: Column, mask: Column, name: str) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) over the whole table; mean over sum(mask) + 1e-8, variance by Bessel's rule."""
    held = rows.withColumn("_x", value.cast("double")).withColumn("_m", mask.cast("double"))
    mean = held.agg((F.sum(F.col("_x") * F.col("_m")) / (F.sum("_m") + 1e-8)).alias("_mean"))
    squares = (F.col("_x") - F.col("_mean")) ** 2 * F.col("_m")
    spread = held.crossJoin(F.broadcast(mean)).agg(F.first("_mean").alias("_mean"), (F.sum(squares) / (F.sum("_m") + 1e-8)).alias("_v"), F.sum("_m").alias("_n"))
    one = spread.select("_mean", (F.col("_v") * F.col("_n") / (F.col("_n") - 1)).alias("_var"))  # one row
    return held.crossJoin(F.broadcast(one)).withColumn(name, (F.col("_x") - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_x", "_m", "_mean", "_var")


def rfpp_baseline(rollouts: DataFrame, uid: str, score: str, mask: str) -> DataFrame:
    """Score - group mean (0 for a lone one), then whitened over the table."""
    w = Window.partitionBy(uid)
    mean = F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg(score).over(w))
    return masked_whiten(rollouts.withColumn("_c", F.col(score) - mean), F.col("_c"), F.col(mask), "advantage").drop("_c")


def reinforce_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Discounted running value per token, zeroed where the mask is 0."""
    masks = F.transform(mask, lambda m: m.cast("double"))
    return scan_back(F.transform(masks, lambda m: m * F.lit(float(gamma))), F.zip_with(rewards, masks, lambda r, m: r.cast("double") * m))


def _constant(like: Column, x: float) -> Column:
    return F.array_repeat(F.lit(float(x)), F.size(like))


def remax_returns(rewards: Column, mask: Column, baseline: Column) -> tuple[Column, Column]:
    """Reverse cumulative sum of masked rewards, and that less baseline * mask."""
    returns = scan_back(_constant(rewards, 1), F.zip_with(rewards, mask, lambda r, m: r.cast("double") * m))
    return returns, F.zip_with(returns, mask, lambda r, m: r - baseline * m)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates per token."""
    after = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    deltas = F.zip_with(F.zip_with(rewards, values, lambda r, v: r - v), after, lambda d, n: (d + F.lit(gamma) * n).cast("double"))
    return scan_back(_constant(deltas, gamma * lam), deltas)


def whitened_tokens(rows: DataFrame, key: str, values: Column, mask: str, masked: bool) -> DataFrame:
    """Key, i, advantage: token values whitened over the masked tokens of the whole table, and zeroed elsewhere if asked."""
    tokens = rows.select(key, F.posexplode(F.arrays_zip(values.alias("v"), F.col(mask).alias("m"))).alias("i", "_x"))
    white = masked_whiten(tokens.select(key, "i", "_x.v", "_x.m"), F.col("v"), F.col("m"), "advantage")
    return white.select(key, "i", (F.col("advantage") * F.col("m") if masked else F.col("advantage")).alias("advantage"))


def reinforce_advantages(rows: DataFrame, key: str, rewards: str, mask: str, gamma: float) -> DataFrame:
    """REINFORCE++: discounted returns, whitened over the masked tokens, 0 elsewhere."""
    return whitened_tokens(rows, key, reinforce_returns(F.col(rewards), F.col(mask), gamma), mask, True)


def gae_advantages(rows: DataFrame, key: str, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage estimates, whitened over the masked tokens."""
    return whitened_tokens(rows, key, gae(F.col(rewards), F.col(values), gamma, lam), mask, False)


def gigpo_steps(steps: DataFrame, uid: str, anchor: str, score: str, by_std: bool = True) -> DataFrame:
    """Steps of a question with the same anchor form a group; a lone step has the advantage 0."""
    w = Window.partitionBy(uid, anchor)
    centred = F.col(score) - F.avg(score).over(w)
    value = centred / (F.stddev_samp(score).over(w) + EPS) if by_std else centred
    return steps.withColumn("step_advantage", F.when(F.count("*").over(w) == 1, 0.0).otherwise(value))


def gigpo(steps: DataFrame, uid: str, anchor: str, episode: str, score: str, weight: float = 1.0, by_std: bool = False) -> DataFrame:
    """W7 whole: the episode's advantage in its question group plus weight times the step's among equal anchors."""
    both = gigpo_steps(grpo(steps, uid, episode, by_std), uid, anchor, score, by_std)
    return both.withColumn("advantage", F.col("advantage") + F.lit(float(weight)) * F.col("step_advantage"))


def ra_search_steps(steps: DataFrame, uid: str, traj: str, order: Sequence[str], anchor: str, after: str, is_search: Column, min_group: int = 2, by_std: bool = True) -> DataFrame:
    """W9, the older form: only searches count, 1 if the next anchor strictly contains the anchor, else 0. The first visit of
    each (trajectory, anchor) is compared with those of its question at the same anchor, by population deviation.

    Anchors are sets given as arrays; all other steps and groups below min_group get 0.
    """
    grows = (F.size(F.array_except(anchor, after)) == 0) & (F.size(F.array_distinct(after)) > F.size(F.array_distinct(anchor)))
    held = steps.withColumn("_at", F.array_sort(F.array_distinct(anchor))).withColumn("_up", F.coalesce(grows, F.lit(False)).cast("double")).withColumn("_search", F.coalesce(is_search, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(traj, "_at", "_search").orderBy(*order))
    held = held.withColumn("_votes", F.col("_search") & (nth == 1))
    group = Window.partitionBy(uid, "_at", "_votes")
    centred = F.col("_up") - F.avg("_up").over(group)
    value = centred / (F.stddev_pop("_up").over(group) + EPS) if by_std else centred
    counted = F.col("_votes") & (F.count("*").over(group) >= min_group)
    return held.withColumn("step_advantage", F.when(counted, value).otherwise(0.0)).drop("_at", "_up", "_search", "_votes")


def ra_steps(
    steps: DataFrame, uid: str, traj: str, order: str, anchor: str, action: str, kind: str, page: str, env_reward: str, judged_reward: str,
    gamma: float = 0.0, weight: float = 1.0, min_group: int = 2, by_std: bool = True,
) -> DataFrame:
    """A search scores +1 if the next anchor strictly contains the anchor, else -1; an analysed update its reward times a
    weight; the environment's reward is added. What counts is the discounted return of that.

    Searches and analysed updates vote, once per (trajectory, anchor, action, page for updates). They are compared with the
    votes of their question that have the same anchor, action and page for updates, by population deviation; groups below
    min_group and all other steps get 0.
    """
    after = F.lead(anchor).over(Window.partitionBy(traj).orderBy(order))
    grows = (F.size(F.array_except(F.col(anchor), after)) == 0) & (F.size(after) > F.size(anchor))
    search, update = F.col(action) == "search", (F.col(action) == "update_graph") & (F.col(kind) == "analyse")
    searched = F.when(search, F.when(F.coalesce(grows, F.lit(False)), 1.0).otherwise(-1.0)).otherwise(0.0)
    analysed = F.when(F.col(kind) == "analyse", F.col(judged_reward) * weight).otherwise(0.0)
    local = searched + analysed + F.col(env_reward)
    scored = discounted_returns(steps.withColumn("local_score", local), traj, [order], "local_score", gamma)
    scored = scored.withColumn("_seen", F.when(F.col(action) == "update_graph", F.col(page).cast("string")).otherwise("")).withColumn("_active", F.coalesce(search | update, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(traj, anchor, action, "_seen", "_active").orderBy(order))
    scored = scored.withColumn("_votes", F.col("_active") & (nth == 1))
    group = Window.partitionBy(uid, anchor, action, "_seen", "_votes")
    centred = F.col("return") - F.avg("return").over(group)
    value = centred / (F.stddev_pop("return").over(group) + EPS) if by_std else centred
    return scored.withColumn("step_advantage", F.when(F.col("_votes") & (F.count("*").over(group) >= min_group), value).otherwise(0.0)).drop("_seen", "_active", "_votes", "return")


def scatter_spans(spans: DataFrame, rows: DataFrame, traj: str) -> DataFrame:
    """Spans (traj, span, lo, hi, advantage) written to token places lo..hi-1 of rows (traj, mask); later spans win."""
    places = rows.select(traj, F.posexplode("mask").alias("place", "_m"))
    marks = spans.select(traj, "span", "advantage", F.explode(F.expr("CASE WHEN hi > lo THEN sequence(lo, hi - 1) ELSE array() END")).alias("place"))
    last = marks.groupBy(traj, "place").agg(F.max_by("advantage", "span").alias("_a"))
    return places.join(last.hint("shuffle_hash"), [traj, "place"], "left").select(traj, "place", (F.coalesce("_a", F.lit(0.0)) * F.col("_m")).alias("advantage"))


def judgement_reward(is_gold: Column, verdict: Column) -> Column:
    """W11."""
    gold = F.when(verdict == "yes", 1.0).when(verdict == "partial", 0.5).otherwise(-1.0)
    return F.when(is_gold, gold).otherwise(F.when(verdict == "no", 1.0).when(verdict == "partial", -0.5).otherwise(-1.0))


def lookahead_reward(steps: DataFrame, traj: str, order: Sequence[str], reward: str, correct: str) -> DataFrame:
    """A reward of 0.5 becomes 1 when the next step is itself correct."""
    after = F.lead(correct).over(Window.partitionBy(traj).orderBy(*order))
    return steps.withColumn("raised", F.when((F.col(reward) == 0.5) & F.coalesce(after, F.lit(False)), 1.0).otherwise(F.col(reward)))


def post_gold(steps: DataFrame, gold: DataFrame, traj: str, turn: str, page: str, is_search: Column) -> DataFrame:
    """First turn by which all of a trajectory's gold pages have been shown (null if never), and searches after it."""
    first_seen = steps.groupBy(traj, page).agg(F.min(turn).alias("_t"))
    need = gold.select(traj, page).distinct().join(first_seen, [traj, page], "left")
    done = need.groupBy(traj).agg(F.when(F.count("_t") == F.count("*"), F.max("_t")).alias("gold_turn"))
    late = steps.where(is_search).join(done, traj).where(F.col(turn) > F.col("gold_turn")).groupBy(traj).agg(F.count("*").alias("late_searches"))
    return done.join(late, traj, "left").withColumn("late_searches", F.coalesce("late_searches", F.lit(0)))


def warned_searches(steps: DataFrame, traj: str, order: Sequence[str], is_search: Column, is_no: Column) -> DataFrame:
    """Per trajectory, searches, and those made after at least one earlier "no"."""
    before = F.sum(is_no.cast("int")).over(Window.partitionBy(traj).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    flagged = steps.withColumn("_w", is_search & (F.coalesce(before, F.lit(0)) > 0))
    return flagged.groupBy(traj).agg(F.count(F.when(is_search, 1)).alias("searches"), F.count(F.when(F.col("_w"), 1)).alias("warned"))


def terminal_reward(
    correct: Column, hit: Column, n_gold: Column, n_final: Column, grounding: Column, accesses: Column, late: Column, seen_all: Column,
    w: dict[str, float], all_or_none: bool = False,
) -> Column:
    """Correct + coverage + full coverage + precision at full coverage + grounding - cost of accesses + decay ** late searches.

    The last term needs a right answer, full coverage and that all gold pages were shown; weights that w lacks are 0.
    """
    weight = lambda name: w.get(name, 0.0)
    right = correct.cast("double")
    full = F.coalesce((n_gold > 0) & (hit == n_gold), F.lit(False))
    coverage = full.cast("double") if all_or_none else F.when(n_gold > 0, hit / n_gold).otherwise(0.0)
    precision = F.when(full & (n_final > 0), hit / n_final).otherwise(0.0)
    timely = F.when(correct & full & seen_all, F.pow(F.lit(w.get("decay", 1.0)), late)).otherwise(0.0)
    return (
        right + weight("coverage") * coverage + weight("full") * full.cast("double") + weight("precision") * precision + weight("grounding") * grounding
        - weight("cost") * accesses / max(1.0, w.get("max_turns", 1.0)) + weight("late") * timely
    )


def step_rewards(error_kind: Column, turn: Column, budget: int, soft: float = 0.0) -> tuple[Column, Column]:
    """Reward and whether the episode ends: -1 for a format error or a spent budget, `soft` for other errors."""
    hard = F.coalesce(error_kind == "format", F.lit(False))
    spent = turn >= budget
    return F.when(hard | spent, -1.0).when(error_kind.isNotNull(), soft).otherwise(0.0), hard | spent


def action_penalty(rows: DataFrame, rewards: str, mask: str, valid: str, coef: float) -> DataFrame:
    """Invalid actions cost coef at the last valid token."""
    last = F.array_max(F.transform(F.col(mask), lambda m, i: F.when(m == 1, i).otherwise(-1)))
    cut = F.transform(F.col(rewards), lambda x, i: F.when((i == last) & ~F.col(valid), x - coef).otherwise(x))
    return rows.withColumn(rewards, cut)


def kl_rewards(rewards: Column, logp: Column, ref: Column, mask: Column, beta: float, kind: str = "k1") -> tuple[Column, Column]:
    """Per token reward - beta * KL estimate * mask, and the masked mean of the estimate (null where nothing is masked in)."""
    def estimate(d: Column) -> Column:
        if kind == "k1":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "k2":
            return 0.5 * d * d
        back = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(back) - back - 1, F.lit(-10.0)), F.lit(10.0))

    kl = F.zip_with(F.zip_with(logp, ref, lambda a, b: estimate(a - b)), mask, lambda k, m: k * m)
    mean = F.try_divide(F.aggregate(kl, F.lit(0.0), lambda s, x: s + x), F.aggregate(mask, F.lit(0.0), lambda s, x: s + x))
    return F.zip_with(rewards, kl, lambda r, k: r - beta * k), mean


def traj_log_ratio(rows: DataFrame, traj: str, logp: str, old: str, mask: str) -> DataFrame:
    """Per trajectory, sum of masked (log p - old log p) over sum of masks, across its turns."""
    diff = F.zip_with(F.zip_with(F.col(logp), F.col(old), lambda a, b: a - b), F.col(mask), lambda d, m: d * m)
    total = lambda a: F.sum(F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
    return rows.groupBy(traj).agg((total(diff) / total(F.col(mask))).alias("log_ratio"))


def expected_update(steps: DataFrame, traj: str, order: Sequence[str], is_gold: Column, page: str, n_gold: str) -> DataFrame:
    """Reject off gold; on gold expand while gold pages are still missing after this step, else accept."""
    along = Window.partitionBy(traj).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    gold = F.coalesce(is_gold, F.lit(False))
    # a gold page counts at its first sight, so no step carries the set of them
    first = (F.row_number().over(Window.partitionBy(traj, page, "_gold").orderBy(*order)) == 1) & F.col("_gold") & F.col(page).isNotNull()
    held = steps.withColumn("_gold", gold).withColumn("_first", first.cast("int")).withColumn("_hits", F.sum("_first").over(along))
    said = F.when(~is_gold, "reject").when(F.col("_hits") < F.col(n_gold), "expand").otherwise("accept")
    return held.withColumn("expected", said).drop("_gold", "_first", "_hits")


def batch_metrics(rows: DataFrame, traj: str, measures: Sequence[str], response_len: str, cap: int) -> DataFrame:
    """Mean, max and min of each measure, lengths with the share at the cap, episodes over distinct trajectories."""
    parts = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    token = rows.agg(*parts, F.avg(response_len).alias("length_mean"), F.avg((F.col(response_len) >= cap).cast("double")).alias("clip_ratio"))
    episodes = rows.groupBy(traj).agg(F.count("*").alias("_n")).agg(F.count("*").alias("episodes"), F.avg("_n").alias("episode_length"))
    return token.crossJoin(F.broadcast(episodes))  # one row each


def reward_metrics(spans: DataFrame, traj: str, components: Sequence[str], hit: Column, answered: Column) -> DataFrame:
    """Mean and population deviation of reward parts over spans; shares of trajectories that hit all or answered."""
    over = spans.agg(*(f(c).alias(f"{c}_{n}") for c in components for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    per = spans.groupBy(traj).agg(F.bool_and(hit).alias("_h"), F.bool_or(answered).alias("_a"))
    return over.crossJoin(F.broadcast(per.agg(F.avg(F.col("_h").cast("double")).alias("hit_all"), F.avg(F.col("_a").cast("double")).alias("answered"))))


def validation_metrics(samples: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Per (source, prompt) mean and population deviation, then their means over a source's prompts."""
    per = samples.groupBy(source, prompt).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    return per.groupBy(source).agg(F.avg("_m").alias("mean_at_n"), F.avg("_s").alias("std_at_n"), F.count("*").alias("prompts"), F.sum("_n").alias("samples"))


def bootstrap_extremes(samples: DataFrame, group: str, value: str, n: int | None, draws: int, seed: str) -> DataFrame:
    """Mean and population deviation of the largest and smallest of n values drawn with replacement, over `draws` draws.

    Without n, a row for each size of a group: powers of two below its number of values, then that number; none for one value.
    """
    drawn = bootstrap(samples, group, value, {"best": LARGEST, "worst": SMALLEST}, draws, seed, n)
    return drawn if n is None else drawn.drop("n")


def expected_extremes(samples: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """A23 in closed form: the expected largest and smallest of n draws with replacement."""
    order = Window.partitionBy(group).orderBy(value)
    size = F.count("*").over(Window.partitionBy(group))
    i = F.row_number().over(order)
    up = F.pow(i / size, F.lit(n)) - F.pow((i - 1) / size, F.lit(n))
    down = F.pow((size - i + 1) / size, F.lit(n)) - F.pow((size - i) / size, F.lit(n))
    weighed = samples.withColumn("_u", F.col(value) * up).withColumn("_d", F.col(value) * down)
    return weighed.groupBy(group).agg(F.sum("_u").alias("best_mean"), F.sum("_d").alias("worst_mean"))


def majority_value(samples: DataFrame, group: str, pred: str, value: str, order: str) -> DataFrame:
    """The value of the first row that holds the commonest prediction; ties go to the prediction seen first."""
    per = samples.groupBy(group, pred).agg(F.count("*").alias("_n"), F.min(F.struct(F.col(order), F.col(value).alias("_v"))).alias("_first"))
    return per.groupBy(group).agg(F.min_by(F.col("_first._v"), F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def throughput(rows: DataFrame, tokens: str, seconds: float, devices: int) -> DataFrame:
    """A26."""
    return rows.agg(F.sum(tokens).alias("tokens")).withColumn("per_second_device", F.col("tokens") / (seconds * devices)).withColumn("ms_per_token", F.lit(1000.0 * seconds) / F.col("tokens"))


def reduce_metrics(maps: DataFrame, column: str) -> DataFrame:
    """Mean of each key over a list of metric maps."""
    return maps.select(F.explode(column).alias("metric", "_v")).groupBy("metric").agg(F.avg("_v").alias("mean"))


def masked_agg(rows: DataFrame, values: str, mask: str, mode: str) -> DataFrame:
    """Token-mean, seq-mean-token-sum, seq-mean-token-mean, or seq-sum-norm (over the width)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    held = rows.select(total(F.zip_with(F.col(values), F.col(mask), lambda x, m: x * m)).alias("_s"), total(F.col(mask)).alias("_n"), F.size(mask).alias("_w"))
    forms = {
        "token-mean": F.sum("_s") / F.sum("_n"), "seq-mean-token-sum": F.avg("_s"),
        "seq-mean-token-mean": F.avg(F.col("_s") / F.greatest("_n", F.lit(1.0))), "seq-sum-norm": F.sum("_s") / F.max("_w"),
    }
    return held.agg(forms[mode].alias("value"))


def group_sizes(steps: DataFrame, *keys: str) -> DataFrame:
    """How many groups have each size, and their share."""
    sizes = steps.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    total = sizes.agg(F.sum("groups").alias("_all"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("share", F.col("groups") / F.col("_all")).drop("_all")


def balance_report(rows: DataFrame, part: str, cost: str) -> DataFrame:
    """Smallest, largest and mean cost of a part."""
    return rows.groupBy(part).agg(F.sum(cost).alias("_c")).agg(F.min("_c").alias("low"), F.max("_c").alias("high"), F.avg("_c").alias("mean"))


def similar_groups(steps: DataFrame, uid: str, order: str, text: str, least: float = 0.95) -> DataFrame:
    """Within a question, in order, a step joins the first group whose first text is at least so similar, else opens one.

    The rule depends on the order, so a question's different texts are one group; they are a few dozen, however many steps
    have them.
    """
    kind = dict(steps.dtypes)

    def group(batches):
        from difflib import SequenceMatcher
        from functools import lru_cache

        import pandas as pd

        alike = lru_cache(1 << 16)(lambda head, value: SequenceMatcher(None, head, value).ratio() >= least)  # questions share texts
        for batch in batches:
            out = []
            for question, values in zip(batch[uid], batch["_texts"], strict=True):
                heads = []
                for value in values:
                    at = next((i for i, head in enumerate(heads) if alike(head, value)), len(heads))
                    if at == len(heads):
                        heads.append(value)
                    out.append((question, value, at))
            yield pd.DataFrame(out, columns=[uid, text, "group"])

    texts = steps.groupBy(uid, text).agg(F.min(order).alias("_first"))
    held = texts.groupBy(uid).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", text))), lambda x: x[text]).alias("_texts"))
    grouped = held.mapInPandas(group, f"{uid} {kind[uid]}, {text} {kind[text]}, group int")
    return steps.join(grouped, [uid, text]).select(uid, order, "group")
