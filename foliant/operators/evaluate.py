"""Evaluation reports (A1-A19, A25, A30, A31, A34-A36) and corpus statistics.

Each report is one grouped aggregation with conditional measures; only reports of a few rows ever leave the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def eval_summary(preds: DataFrame, ended: str, counts: Mapping[str, str], has_gold: Column, covered: Column, non_gold: Column) -> DataFrame:
    """A1: rows, rows per end reason as a map, mean of each count and share of rows with any; coverage over rows with gold."""
    per = preds.groupBy(ended).agg(F.count("*").alias("_n"))
    reasons = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(ended), F.lit("None")), "_n")))).alias("ends"))
    body = preds.agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{n}") for n, c in counts.items()), *(_share(F.col(c) > 0).alias(f"any_{n}") for n, c in counts.items()),
        F.avg(F.when(has_gold, covered.cast("double"))).alias("coverage"), F.avg(F.when(has_gold, non_gold)).alias("mean_non_gold"),
    )
    return body.crossJoin(F.broadcast(reasons))  # one row each


def accuracy_by(preds: DataFrame, key: str, correct: str) -> DataFrame:
    """Judged rows only; a null key is the group "None"."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("None"))
    measures = (F.count("*").alias("judged"), F.sum(F.col(correct).cast("int")).alias("correct"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return preds.where(F.col(correct).isNotNull()).groupBy(name.alias(key)).agg(*measures)


def judge_summary(preds: DataFrame, correct: str, error: Column) -> DataFrame:
    """A3: accuracy over judged rows; no row where none was judged."""
    out = preds.agg(F.count(correct).alias("judged"), F.sum(F.col(correct).cast("int")).alias("correct"), F.count(F.when(error, 1)).alias("errors"))
    return out.where("judged > 0").withColumn("accuracy", F.col("correct") / F.col("judged"))


def accuracy_by_multilabel(preds: DataFrame, labels: str, correct: str) -> DataFrame:
    """A4: each distinct category of a row counts once; unjudged is wrong."""
    rows = preds.select(F.explode(F.array_distinct(labels)).alias("category"), F.coalesce(F.col(correct).cast("int"), F.lit(0)).alias("_c"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.sum("_c").alias("correct"), F.avg("_c").alias("accuracy"))


def accuracy_splits(preds: DataFrame, key: str, values: Sequence[str], correct: str) -> DataFrame:
    """A5: the listed splits, absent ones with 0 rows, and "overall" weighted by counts."""
    per = preds.where(F.col(key).isin(*values)).groupBy(F.col(key).alias("split")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(correct).cast("int"), F.lit(0))).alias("correct"))
    listed = preds.sparkSession.createDataFrame([(v,) for v in values], "split string").join(per, "split", "left").fillna(0, ["n", "correct"])
    both = listed.unionByName(listed.agg(F.lit("overall").alias("split"), F.sum("n").alias("n"), F.sum("correct").alias("correct")))
    return both.withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")))


def crosstab(preds: DataFrame, a: str, b: str, correct: str) -> DataFrame:
    """By a, and by a and b ("all" for a's margin); missing values are "unknown"."""
    named = preds.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in (a, b)), F.coalesce(F.col(correct).cast("int"), F.lit(0)).alias("_c"))
    out = named.rollup(a, b).agg(F.count("*").alias("n"), F.sum("_c").alias("correct"), F.grouping(a).alias("_ga")).where("_ga = 0").drop("_ga")
    return out.withColumn(b, F.coalesce(b, F.lit("all"))).withColumn("accuracy", F.col("correct") / F.col("n"))


def judge_totals(rows: DataFrame, source: str, correct: str, torn: Column) -> DataFrame:
    """By source and overall ("all"): rows seen, judged, correct, torn ones."""
    whole = F.when(~torn, F.col(correct))
    out = rows.rollup(source).agg(
        F.count("*").alias("seen"), F.count(whole).alias("judged"), F.sum(whole.cast("int")).alias("correct"), F.count(F.when(torn, 1)).alias("torn")
    )
    return out.withColumn(source, F.coalesce(source, F.lit("all")))


def trace_stats(steps: DataFrame, traj: str, action: str, limit: int) -> DataFrame:
    """Per action its steps and share, beside trajectories, mean length and the share that reach the limit."""
    each = steps.groupBy(traj).agg(F.count("*").alias("_n"))
    lengths = each.agg(F.count("*").alias("trajectories"), F.avg("_n").alias("mean_length"), _share(F.col("_n") >= limit).alias("at_limit"), F.sum("_n").alias("_all"))
    return steps.groupBy(action).agg(F.count("*").alias("steps")).crossJoin(F.broadcast(lengths)).withColumn("share", F.col("steps") / F.col("_all")).drop("_all")


def top_errors(steps: DataFrame, kind: str, message: str, k: int = 10) -> DataFrame:
    """A10: the k most frequent messages of each kind; ties by message."""
    counts = steps.groupBy(kind, message).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), message))).where(F.col("rank") <= k)


def examples(preds: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """The first n rows of each bucket."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("rank") <= n)


def summary_v1(trajs: DataFrame, iterations: str, decision: str, classes: Sequence[str]) -> DataFrame:
    """Per decision class, absent ones with 0, its rows; mean and median iterations of all."""
    per = trajs.groupBy(F.col(decision).alias("decision")).agg(F.count("*").alias("n"))
    whole = trajs.agg(F.avg(iterations).alias("mean_iterations"), F.median(iterations).alias("median_iterations"))
    listed = trajs.sparkSession.createDataFrame([(c,) for c in classes], "decision string")
    return listed.join(per, "decision", "left").fillna(0, ["n"]).crossJoin(F.broadcast(whole))


def summary_baseline(steps: DataFrame, traj: str, kinds: Mapping[str, Column]) -> DataFrame:
    """Trajectories, mean steps, and per kind of step how many there are and how many a trajectory has."""
    per = steps.groupBy(traj).agg(F.count("*").alias("_n"), *(F.count(F.when(c, 1)).alias(n) for n, c in kinds.items()))
    return per.agg(F.count("*").alias("trajectories"), F.avg("_n").alias("mean_steps"), *(F.sum(n).alias(f"{n}_total") for n in kinds), *(F.avg(n).alias(f"{n}_mean") for n in kinds))


def corpus_stats(qa: DataFrame, split: str, deck: str, n_evidence: str, arithmetic: str) -> DataFrame:
    """Per split: questions, decks, multi-hop questions, those with arithmetic (not null, empty or "None"), evidence histogram."""
    hist = qa.groupBy(split, n_evidence).agg(F.count("*").alias("_n")).groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(n_evidence, "_n")))).alias("evidence_sizes"))
    real = ~F.coalesce(F.col(arithmetic), F.lit("")).isin("", "None")
    counts = {"questions": F.count("*"), "decks": F.count_distinct(deck), "multi": F.count(F.when(F.col(n_evidence) >= 2, 1)), "arithmetic": F.count(F.when(real, 1))}
    body = qa.groupBy(split).agg(*(c.alias(name) for name, c in counts.items()))
    return body.join(hist, split)


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The element at n // 2 of the sorted values, from the counts of distinct values and their running sums."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_middle", F.floor(F.sum("_n").over(group) / 2))
    return placed.where((F.col("_upto") > F.col("_middle")) & (F.col("_upto") - F.col("_n") <= F.col("_middle"))).select(*keys, F.col(value).alias("upper_median"))


def run_totals(trajs: DataFrame, kept: str, hop: str, reasons: str, tags: str) -> DataFrame:
    """Long form (kind, name, n): processed, kept, kept by hop, reject reasons by the text before ":", kept rows per tag."""
    count = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    good = trajs.where(F.col(kept))
    parts = [
        count(trajs, "processed", F.lit("all")), count(good, "kept", F.lit("all")), count(good, "kept_hop", F.col(hop)),
        count(trajs.where(~F.col(kept)).select(F.explode(reasons).alias("_r")), "reason", F.substring_index("_r", ":", 1)),
        count(good.select(F.explode(tags).alias("_t", "_v")).where("_v > 0"), "tag", F.col("_t")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subset_summary(rows: DataFrame, hop: str, calls: str, wanted: Mapping[str, int]) -> DataFrame:
    """Per hop: wanted, available, shortfall, calls."""
    goal = rows.sparkSession.createDataFrame(list(wanted.items()), f"{hop} string, wanted long")
    per = rows.groupBy(hop).agg(F.count("*").alias("available"), F.sum(calls).alias("calls"))
    return goal.join(per, hop, "left").fillna(0, ["available", "calls"]).withColumn("shortfall", F.greatest(F.col("wanted") - F.col("available"), F.lit(0)))


def merge_summary(kept: DataFrame, key: str, source: str) -> DataFrame:
    """Per source its rows, and how many rows repeat a key (rows less keys) in all."""
    repeats = kept.groupBy(key).agg(F.count("*").alias("_n")).agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    return kept.groupBy(source).agg(F.count("*").alias("n")).crossJoin(F.broadcast(repeats))


def validate_summary(rows: DataFrame, source: str, traj: str, score: str, tools: str) -> DataFrame:
    """Mean score by source over rows; tool calls over distinct trajectories."""
    scores = rows.groupBy(source).agg(F.avg(score).alias("mean_score"))
    calls = rows.groupBy(source, traj).agg(F.max(tools).alias("_t")).groupBy(source).agg(F.avg("_t").alias("tool_calls"), F.count("*").alias("trajectories"))
    return scores.join(calls, source)


def passk(rollouts: DataFrame, question: str, correct: str) -> DataFrame:
    """Questions, pass@k (any correct), pass@1 (mean share), and per number correct how many questions."""
    per = rollouts.groupBy(question).agg(F.sum(F.col(correct).cast("int")).alias("k"), F.count("*").alias("_n"))
    whole = per.agg(F.count("*").alias("questions"), _share(F.col("k") > 0).alias("pass_k"), F.avg(F.col("k") / F.col("_n")).alias("pass_1"))
    return per.groupBy("k").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))


def paired_flips(a: DataFrame, b: DataFrame, key: str, hop: str, correct: str) -> DataFrame:
    """By hop: pairs, wrong to right, right to wrong."""
    both = a.select(key, hop, F.col(correct).alias("_x")).join(b.select(key, F.col(correct).alias("_y")), key)
    return both.groupBy(hop).agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("_x") & F.col("_y"), 1)).alias("fixed"), F.count(F.when(F.col("_x") & ~F.col("_y"), 1)).alias("broken"))


def progress(rows: DataFrame, expected: int, order: str, key: str) -> DataFrame:
    """A34."""
    return rows.agg(F.count("*").alias("done"), F.max_by(key, order).alias("last")).withColumn("percent", F.lit(100.0) * F.col("done") / expected)


def pack_stats(rows: DataFrame, items: str) -> DataFrame:
    """A35."""
    return rows.groupBy(F.size(items).alias("images")).agg(F.count("*").alias("rows"))


def episode_outcomes(steps: DataFrame, traj: str, order: str, active: Column, source: str, success: str, reward: str) -> DataFrame:
    """Of the last active step of each trajectory: success and mean reward (null counts 0), by source and "all"."""
    last = steps.where(active).groupBy(traj).agg(F.max_by(F.struct(source, success, reward), order).alias("_s")).select(traj, "_s.*")
    out = last.rollup(source).agg(F.count("*").alias("episodes"), _share(F.col(success)).alias("success"), F.avg(F.coalesce(F.col(reward), F.lit(0.0))).alias("reward"))
    return out.withColumn(source, F.coalesce(F.col(source).cast("string"), F.lit("all")))
