"""Curation: checks, filters, selection, deduplication, sampling, balancing.

Seeded choices order rows by the MD5 of seed and id, so they don't depend on partitions. Ranks are taken inside a class
or stratum; a rank over a whole table goes through counts by hash bucket first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import written


def seeded(seed: str, *cols: str) -> Column:
    """The order of a seeded shuffle."""
    return F.md5(F.concat_ws("-", F.lit(seed), *(F.col(c).cast("string") for c in cols)).cast("binary"))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Places from 1 over the whole table in an order: sorted ranges (spark.sql.shuffle.partitions of them, or fewer by size)
    are written with a number inside each, and the counts of the ranges are summed. Rows never meet in one task.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = written(ranges.withColumn("_rk_part", F.spark_partition_id()).withColumn("_rk_id", F.monotonically_increasing_id()))
    base = sorted_.groupBy("_rk_part").agg(F.count("*").alias("_rk_n"), F.min("_rk_id").alias("_rk_low"))
    before = F.coalesce(F.sum("_rk_n").over(Window.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(base.withColumn("_rk_before", before).drop("_rk_n"))  # one row per range
    placed = sorted_.join(starts, "_rk_part").withColumn("_rk_place", F.col("_rk_id") - F.col("_rk_low") + F.col("_rk_before") + 1)
    return placed.select(*df.columns, F.col("_rk_place").alias(name))


#: Rows that Spark's own top-n may gather in one task.
FEW = 100_000


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows in an order."""
    if n <= FEW:
        return df.orderBy(*order).limit(n)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return ranked(df, cols, "_first").where(F.col("_first") <= n).drop("_first")


# checks


def check_contiguous(pages: DataFrame, doc: str, page: str, base: int = 1) -> DataFrame:
    """per document its pages, and whether they are exactly base, base + 1, ..."""
    per = pages.groupBy(doc).agg(F.min(page).alias("_lo"), F.max(page).alias("_hi"), F.count_distinct(page).alias("pages"))
    return per.select(doc, "pages", ((F.col("_lo") == base) & (F.col("_hi") == F.col("pages") + base - 1)).alias("contiguous"))


def check_evidence(qa: DataFrame, pages: DataFrame, deck: str, evidence: str) -> DataFrame:
    """questions whose evidence is empty or outside 1..num_pages of their deck (pages: deck, num_pages); unknown decks too."""
    both = qa.join(pages, deck, "left")
    out = F.exists(evidence, lambda x: (x < 1) | (x > F.col("num_pages")))
    return both.where((F.size(evidence) == 0) | F.col("num_pages").isNull() | F.coalesce(out, F.lit(False)))


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def expect(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """one row per rule with the number of rows that break it (null breaks it), in one pass."""
    counts = df.agg(*(F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in rules)), F.array(*(F.col(n) for n in rules)))).alias("rule", "violations"))


def check_boxes(facts: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """facts (keys, box) with a reason: "page" for one that the index lacks, "box" for one not inside it (pages: keys, w, h)."""
    b = lambda i: F.get("box", F.lit(i))
    inside = (b(0) >= 0) & (b(0) < b(2)) & (b(2) <= F.col("w")) & (b(1) >= 0) & (b(1) < b(3)) & (b(3) <= F.col("h"))
    joined = facts.join(pages, list(keys), "left")
    return joined.withColumn("reason", F.when(F.col("w").isNull(), "page").when(~F.coalesce(inside, F.lit(False)), "box")).where("reason IS NOT NULL")


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """rows and distinct keys of a that b has as well."""
    return a.join(b.select(key), key, "left_semi").agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))


def keep_filter(traj: DataFrame, ended: Column, errors: Column, answer: Column, verdict: Column, gold: Column, covered: Column) -> DataFrame:
    """reasons against a trajectory, in a fixed order; kept where there is none."""
    steps = F.array_sort(F.array_distinct(errors))
    reasons = F.array_compact(
        F.array(
            F.when(~ended, "not ended by answer"),
            F.when(F.size(steps) > 0, F.concat(F.lit("error steps: "), F.array_join(steps, ","))),
            F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "empty answer"),
            F.when(verdict.isNull(), "judge: missing").when(~verdict, "judge: incorrect"),
            F.when(F.size(gold) == 0, "reference pages: missing").when(~covered, "reference pages: not covered"),
        )
    )
    return traj.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


def until_api_error(df: DataFrame, order: str, failed: Column) -> DataFrame:
    """rows committed before the first service error."""
    first = df.where(failed).agg(F.min(order).alias("_first"))
    return df.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


#: What each flag of a multi-hop trajectory costs.
AUDIT_COSTS = {
    "not_answered": 80, "empty_answer": 80, "placeholder": 50, "judge_wrong": 80, "judge_missing": 15, "root_unresolved": 25, "trace_error": 60, "no_expand": 18,
    "few_accepts": 20, "many_searches": 10, "many_steps": 10, "crop_error": 60, "repeated_query": 15, "not_multi": 100,
}


def audit_score(traj: DataFrame, flags: Mapping[str, Column], rejects: Column, crops: Column) -> DataFrame:
    """100 less the flags' costs, 12 for each of two or more rejects and 8 for each crop beyond three; 0 at least."""
    cost = sum((F.when(F.coalesce(c, F.lit(False)), AUDIT_COSTS[n]).otherwise(0) for n, c in flags.items()), F.lit(0))
    cost = cost + F.when(rejects >= 2, 12 * rejects).otherwise(0) + 8 * F.greatest(crops - 3, F.lit(0))
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items())))
    return traj.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost))).withColumn("flags", names)


def trajectory_tags(steps: DataFrame, traj: str, tags: Mapping[str, Column]) -> DataFrame:
    """F12."""
    return steps.groupBy(traj).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in tags.items()))


def check_trajectories(steps: DataFrame, traj: str, index: str, terminal: str, response: str | None = None) -> DataFrame:
    """per trajectory whether its steps are 0..n-1, each once, the last is terminal, and no response (named by a column) is empty."""
    silent = F.lit(0) if response is None else F.when(F.length(F.trim(F.coalesce(response, F.lit("")))) > 0, 0).otherwise(1)
    per = steps.groupBy(traj).agg(F.sum(silent).alias("_e"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.count_distinct(index).alias("_d"), F.count("*").alias("steps"), F.max_by(terminal, index).alias("_t"))
    return per.select(traj, "steps", ((F.col("_lo") == 0) & (F.col("_hi") == F.col("steps") - 1) & (F.col("_d") == F.col("steps"))).alias("complete"), F.col("_t").alias("ends"), *([] if response is None else [(F.col("_e") == 0).alias("answered")]))


def check_traj_advantage(rows: DataFrame, traj: str, value: str, absolute: float = 1e-6, relative: float = 1e-5, mask: str | None = None) -> DataFrame:
    """per trajectory whether all values are finite and equal within the tolerance; with a mask, its values where that is above 0.
    A trajectory without such values passes.
    """
    if mask is not None:
        held = F.col(mask).cast("double") > 0
        inside = rows.select(traj, value, held.alias("_held")).where("_held")
        checked = check_traj_advantage(inside, traj, value, absolute, relative)
        return rows.select(traj).distinct().join(checked, traj, "left").select(traj, F.coalesce("same", F.lit(True)).alias("same"))
    finite = F.bool_and(~F.isnan(value) & (F.abs(value) != float("inf")))
    per = rows.groupBy(traj).agg(finite.alias("_f"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return per.select(traj, (F.col("_f") & (F.col("_hi") - F.col("_lo") <= absolute + relative * F.abs("_lo"))).alias("same"))


def drop_constant_groups(rollouts: DataFrame, uid: str, reward: str, target: int | None = None) -> DataFrame:
    """rollouts of question groups whose rewards differ; with a target, of the first so many groups by id."""
    groups = rollouts.groupBy(uid).agg(F.min(reward).alias("_lo"), F.max(reward).alias("_hi")).where("_lo <> _hi").select(uid)
    if target is not None:
        groups = first_rows(groups, [uid], target)
    return rollouts.join(groups, uid, "left_semi")


def accumulate_groups(spark: SparkSession, generate: Callable[[int], DataFrame], path: str, uid: str, reward: str, target: int, most: int) -> DataFrame:
    """rounds of generated rollouts, numbered from 1, whose groups with differing rewards are carried over until there
    are `target` rollouts; the most-th round is the last one, and all its groups are taken. Gives the rollouts with their `round`.

    Rounds are written under path as they come, so a restart goes on after the last whole one.
    """
    held = lambda n: f"{path}/round={n}"
    total, n = 0, 0
    while total < target and n < most:
        n += 1
        try:
            spark.read.text(f"{held(n)}/_SUCCESS")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            batch = generate(n)
            (batch if n == most else drop_constant_groups(batch, uid, reward)).write.mode("overwrite").parquet(held(n))
        total += spark.read.parquet(held(n)).count()
    parts = [spark.read.parquet(held(i)).withColumn("round", F.lit(i)) for i in range(1, n + 1)]
    return reduce(DataFrame.unionByName, parts)


#: Words that mark hedging.
HEDGES = ("maybe", "perhaps", "might be", "probably", "i guess", "not sure", "actually", "wait", "hmm", "alternatively")


def think_quality(turns: DataFrame, traj: str, think: str, action: str, long: int = 1500, most_turns: int = 7) -> DataFrame:
    """F16: per trajectory: any turn that repeats a sentence of 25 or more characters, any with 5 or more hedges, overlong, and any
    whose last sentence announces another action (let me, I'll, I should; crop or zoom, search, revisit) than the one taken.
    """
    sentences = F.filter(F.transform(F.split(think, r"[.!?\n]"), lambda x: F.trim(x)), lambda s: F.length(s) >= 25)
    hedges = F.size(F.regexp_extract_all(F.lower(think), F.lit(r"\b(" + "|".join(HEDGES) + r")\b"), 1))
    last = F.try_element_at(F.filter(F.transform(F.split(F.lower(think), r"[.!?\n]"), lambda x: F.trim(x)), lambda s: s != ""), F.lit(-1))
    verb = F.regexp_extract(F.coalesce(last, F.lit("")), r"\b(?:let me|i['’]ll|i should)\b.*?\b(crop|zoom|search|revisit)\b", 1)
    plain = lambda c: F.when(c == "zoom", "crop").otherwise(c)
    other = (verb != "") & (plain(verb) != F.coalesce(plain(F.lower(action)), F.lit("")))
    per = turns.groupBy(traj).agg(
        F.bool_or(other).alias("mismatch"), F.bool_or(F.size(F.array_distinct(sentences)) < F.size(sentences)).alias("repeats"), F.bool_or(hedges >= 5).alias("hedges"),
        F.max(F.length(think)).alias("_l"), F.count(F.when(F.col(action) != "crop", 1)).alias("_t"),
    )
    return per.select(traj, "repeats", "hedges", ((F.col("_l") > long) | (F.col("_t") >= most_turns)).alias("overlong"), "mismatch")


def grounded_filter(traj: DataFrame, answer: Column, gold_facts: Column, final: Column, gold: Column, most_words: int = 12) -> DataFrame:
    """the answer stands in a fact of a gold page, is short enough, and no other page is attached."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}.]+", " ")
    held = F.exists(gold_facts, lambda f: F.instr(F.concat(F.lit(" "), plain(f), F.lit(" ")), F.concat(F.lit(" "), F.trim(plain(answer)), F.lit(" "))) > 0)
    return traj.withColumn("grounded", held & (F.size(F.split(F.trim(answer), r"\s+")) <= most_words) & (F.size(F.array_except(final, gold)) == 0))


def rl_gate(rollouts: DataFrame, question: str, answer: str, correct: str, attached: str, gold_words: str, guessable: str, low: int = 1, high: int = 4) -> DataFrame:
    """questions with low..high correct rollouts, grounded, not guessable, a short gold answer, and no answer judged both ways."""
    per = rollouts.groupBy(question, answer).agg(
        F.count("*").alias("_n"), F.sum(F.col(correct).cast("int")).alias("_c"), F.sum((F.col(correct) & F.col(attached)).cast("int")).alias("_a"),
        F.max(gold_words).alias("_w"), F.bool_or(guessable).alias("_g"),
    )
    both = F.bool_or((F.col("_c") > 0) & (F.col("_c") < F.col("_n")))
    q = per.groupBy(question).agg(F.sum("_c").alias("k"), F.sum("_a").alias("_at"), F.max("_w").alias("_w"), F.bool_or("_g").alias("_g"), both.alias("_both"))
    return q.where(F.col("k").between(low, high) & (F.col("_at") >= 1) & (2 * F.col("_at") >= F.col("k")) & ~F.col("_g") & ~F.col("_both") & (F.col("_w") <= 8)).select(question, "k")


def crop_label(rollouts: DataFrame, question: str, cropped: str, correct: str) -> DataFrame:
    """from the 2 x 2 table of crop and correct: what helps, and how sure that is."""
    n = lambda c, k: F.count(F.when((F.col(cropped) == c) & (F.col(correct) == k), 1))
    t = rollouts.groupBy(question).agg(n(True, True).alias("cc"), n(True, False).alias("cw"), n(False, True).alias("nc"), n(False, False).alias("nw"))
    label = F.when((F.col("cc") > 0) & (F.col("nc") == 0), "crop").when((F.col("nc") > 0) & (F.col("cc") == 0), "no_crop")
    sure = F.when(label == "crop", F.when(F.col("nw") >= 2, "strong").otherwise("weak")).when(label == "no_crop", F.when(F.col("cw") >= 2, "strong").otherwise("weak"))
    return t.withColumn("label", label).withColumn("confidence", sure)


def clean_verdicts(raw: DataFrame, reply: str) -> DataFrame:
    """a JSON reply with `correct` (boolean) and `score` (0 or 1) that agree is a verdict; anything else an error."""
    v = F.try_parse_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    read = raw.withColumn("_c", F.try_variant_get(v, "$.correct", "boolean")).withColumn("_s", F.try_variant_get(v, "$.score", "double")).withColumn("_j", v.isNotNull())
    error = F.when(~F.col("_j"), "unreadable").when(F.col("_c").isNull(), "no verdict").when(F.col("_s").isNotNull() & (F.col("_s") != F.col("_c").cast("double")), "contradiction")
    return read.withColumn("judge_error", error).withColumn("correct", F.when(error.isNull(), F.col("_c"))).drop("_c", "_s", "_j")


# selection and deduplication


def balanced_split(cands: DataFrame, cls: str, sizes: Mapping[str, tuple[int, int]], seed: str, key: str) -> DataFrame:
    """Per class the first n rows of a seeded shuffle to train, the next m to val; too few rows of a class are an error."""
    held = dict(map(tuple, cands.where(F.col(cls).isin(list(sizes))).groupBy(cls).count().collect()))  # a row a class
    if short := [f"{c}: {held.get(c, 0)} of {n + m}" for c, (n, m) in sizes.items() if held.get(c, 0) < n + m]:
        raise ValueError(f"too few candidates ({', '.join(short)})")
    goal = cands.sparkSession.createDataFrame([(c, n, m) for c, (n, m) in sizes.items()], f"{cls} string, _n long, _m long")
    most = max((n + m for n, m in sizes.values()), default=0)
    placed = cands.join(F.broadcast(goal), cls).withColumn("_p", F.row_number().over(Window.partitionBy(cls).orderBy(seeded(seed, key), key)))
    placed = placed.where(F.col("_p") <= most)  # a number, so that Spark trims before it shuffles
    split = F.when(F.col("_p") <= F.col("_n"), "train").when(F.col("_p") <= F.col("_n") + F.col("_m"), "val")
    return placed.withColumn("split", split).where("split IS NOT NULL").drop("_n", "_m", "_p")


def packed_select(cands: DataFrame, deck: str, hop: str, key: str, n_multi: int, n_single: int) -> DataFrame:
    """Multi-hop questions from decks in order (most multi, most single, name) until n_multi; singles from those decks first."""
    counts = cands.groupBy(deck).agg(F.count(F.when(F.col(hop) == "multi", 1)).alias("_m"), F.count(F.when(F.col(hop) != "multi", 1)).alias("_s"))
    keyed = cands.join(counts, deck)
    multi = first_rows(keyed.where(F.col(hop) == "multi"), [F.desc("_m"), F.desc("_s"), deck, key], n_multi)
    chosen = multi.select(deck).distinct().withColumn("_in", F.lit(0))
    single = first_rows(keyed.where(F.col(hop) != "multi").join(chosen, deck, "left"), [F.coalesce("_in", F.lit(1)), F.desc("_s"), deck, key], n_single)
    return multi.select(*cands.columns).unionByName(single.select(*cands.columns))


def slice_ordered(df: DataFrame, order: Sequence[str], offset: int, n: int) -> DataFrame:
    """D3: n rows from place offset on. Beyond FEW rows places come from sorted ranges, so that no task holds all before them."""
    if offset + n <= FEW:
        return df.orderBy(*order).offset(offset).limit(n)
    return ranked(df, [F.col(c) for c in order], "_at").where((F.col("_at") > offset) & (F.col("_at") <= offset + n)).drop("_at")


def interleave(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """place = 1, 2, ... taking a and b in turn, leftovers last; a and b have the same columns."""
    cols = [F.col(c) for c in order]
    both = ranked(a, cols, "_i").withColumn("side", F.lit("a")).unionByName(ranked(b, cols, "_i").withColumn("side", F.lit("b")))
    return ranked(both, [F.col("_i"), F.col("side")], "place").drop("_i")


def shortest_select(rows: DataFrame, hop: str, keys: Sequence[str], n_multi: int, n: int) -> DataFrame:
    """The n_multi shortest multi-hop rows, and the shortest others up to n in all."""
    multi = first_rows(rows.where(F.col(hop) == "multi"), keys, n_multi)
    rest = first_rows(rows.where(F.col(hop) != "multi"), keys, max(0, n - multi.count()))
    return multi.unionByName(rest)


def dedup_best(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Per key the first row in an order, which ends with an ordinal so that the first of equals stays."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_latest(df: DataFrame, key: str, time: str, ordinal: str) -> DataFrame:
    """Per key the row of the newest file, the last read of equals; rows without key stay, under a made-up one."""
    named = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("__missing_"), ordinal)))
    return dedup_best(named, key, [F.desc(time), F.desc(ordinal)])


def merge_shards(shards: DataFrame, dataset: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Shard rows with their dataset ordinal; a key that occurs twice is an error."""
    if not check_unique(shards, key).isEmpty():
        raise ValueError(f"a {key} occurs in more than one shard row")
    return shards.join(dataset.select(key, ordinal), key)


def stratified_sample(df: DataFrame, cls: str, first: str, n_first: int, n: int, seed: str, key: str) -> DataFrame:
    """Up to n_first rows of one class, the rest from the others to make n."""
    a = first_rows(df.where(F.col(cls) == first), [seeded(seed, key), key], n_first)
    return a.unionByName(first_rows(df.where(F.col(cls) != first), [seeded(seed, key), key], max(0, n - a.count())))


#: Numbers that one window of a tree of sums adds up.
FAN = 1000


def prefix_sums(numbers: DataFrame, count: int) -> DataFrame:
    """_i, _w, _lo, _hi of numbers _w at places _i = 0 .. count - 1: the sum before each and up to each, where _hi equals the next _lo.

    A tree of blocks of FAN: sums of blocks get their own prefix sums first, so no window holds more than FAN rows.
    """
    if count <= FAN:
        whole = Window.orderBy("_i")  # FAN rows at most
        sums = numbers.withColumn("_hi", F.sum("_w").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
        return sums.withColumn("_lo", F.coalesce(F.lag("_hi").over(whole), F.lit(0.0)))
    blocks = numbers.groupBy(F.floor(F.col("_i") / FAN).alias("_i")).agg(F.sum("_w").alias("_w"))
    above = prefix_sums(blocks, -(-count // FAN)).select(F.col("_i").alias("_b"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
    inside = Window.partitionBy("_b").orderBy("_i")
    held = numbers.withColumn("_b", F.floor(F.col("_i") / FAN)).join(above, "_b")
    upto = F.least(F.col("_from") + F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_to"))
    held = held.withColumn("_hi", F.when(F.lead("_i").over(inside).isNull(), F.col("_to")).otherwise(upto))
    return held.withColumn("_lo", F.coalesce(F.lag("_hi").over(inside), F.col("_from"))).select("_i", "_w", "_lo", "_hi")


def weighted_resample(rows: DataFrame, score: str, key: str, n: int, seed: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """N draws with replacement; draws meet cumulative weights in cells of the unit interval, as many as the table needs.

    Weights, all + 1e-8: |score| ** power; 1 for the extremes and 0 for others ("max_min"); 0.4 for the largest and 0.1 for
    others ("max_random").
    """
    ends = F.broadcast(rows.agg(F.max(score).alias("_top"), F.min(score).alias("_bottom")))  # one row
    top = F.col(score) == F.col("_top")
    forms = {"pow": F.pow(F.abs(score), F.lit(power)), "max_min": (top | (F.col(score) == F.col("_bottom"))).cast("double"), "max_random": F.when(top, 0.4).otherwise(0.1)}
    weighed = ranked(rows.crossJoin(ends).withColumn("_w", forms[method] + 1e-8).drop("_top", "_bottom"), [F.col(key)], "_i")
    count = weighed.count()
    starts = prefix_sums(weighed.select((F.col("_i") - 1).alias("_i"), "_w"), count)
    whole = F.broadcast(starts.agg(F.max("_hi").alias("_all")))  # one row
    placed = weighed.withColumn("_i", F.col("_i") - 1).join(starts.drop("_w"), "_i").crossJoin(whole)
    # a row's share ends where the next one's begins, so every number below 1 is in one share
    placed = placed.withColumn("_lo", F.col("_lo") / F.col("_all")).withColumn("_hi", F.col("_hi") / F.col("_all"))
    cells = 1 << max(12, (max(count, n) // 256).bit_length())  # some hundred draws or rows each, whatever the table's size
    spans = placed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1).cast("long")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), draw.alias("_u")).withColumn("_cell", F.floor(F.col("_u") * cells))
    return draws.join(spans, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", *rows.columns)


def repeat_rows(df: DataFrame, n: int | str, copy: str = "copy") -> DataFrame:
    """Each row n times (a number or a column of counts), numbered from 1; order by (row, copy) or (copy, row)."""
    times = F.lit(n) if isinstance(n, int) else F.col(n).cast("int")
    return df.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))


def pad_to_multiple(df: DataFrame, m: int, order: Sequence[str], flag: str = "padding") -> DataFrame:
    """As many rows from the head, marked, as make the count a multiple of m; fewer rows than that repeat again."""
    n = df.count()
    short = -n % m if n else 0
    out = df.withColumn(flag, F.lit(False))
    if not short:
        return out
    head = first_rows(df, order, short)
    turns = F.explode(F.sequence(F.lit(0), F.lit(-(-short // n) - 1))).alias("_turn")
    more = first_rows(head.select("*", turns), ["_turn", *order], short).drop("_turn")
    return out.unionByName(more.withColumn(flag, F.lit(True)))


def drop_padding(df: DataFrame, flag: str = "padding") -> DataFrame:
    """What pad_to_multiple was given."""
    return df.where(~F.col(flag)).drop(flag)


def fit_to_multiple(df: DataFrame, m: int, mode: str, seed: str, key: str) -> DataFrame:
    """A seeded remainder copied (mode "copy") or deleted ("delete") so that the count is a multiple of m."""
    n = df.count()
    shuffled = lambda k: first_rows(df, [seeded(seed, key), key], k)
    if mode == "delete":
        return df.join(shuffled(n % m).select(key), key, "left_anti").select(*df.columns)
    out = df
    for _ in range(-n % m // n if n else 0):
        out = out.unionByName(df)
    return out.unionByName(shuffled(-n % m % n)) if n else out


def question_minibatches(rollouts: DataFrame, uid: str, key: str) -> DataFrame:
    """The i-th rollout of each question is in batch i."""
    return rollouts.withColumn("batch", F.row_number().over(Window.partitionBy(uid).orderBy(key)) - 1)


def sqrt_quota_sample(df: DataFrame, stratum: str, deck: str, n: int, cap: int, seed: str, key: str, rare: Column | None = None) -> DataFrame:
    """Quotas by the square root of stratum sizes (largest remainders), at first cap rows of a deck in a stratum.

    Where a stratum's quota isn't met, its cap rises by one until it is or no rows are left. Rows with the `rare` behaviour
    come first in their deck and among the rows of a step.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()
    share = F.lit(float(n)) * F.sqrt("_n") / F.sum(F.sqrt("_n")).over(whole)
    quota = sizes.withColumn("_share", share).withColumn("_q", F.floor("_share"))
    quota = quota.withColumn("_rest", F.lit(n) - F.sum("_q").over(whole)).withColumn("_o", F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_q")), stratum)))
    quota = quota.select(stratum, (F.col("_q") + (F.col("_o") <= F.col("_rest")).cast("int")).alias("_q"))
    by = [*([] if rare is None else [F.coalesce(~rare, F.lit(True))]), seeded(seed, key), F.col(key)]
    steps = df.withColumn("_d", F.greatest(F.row_number().over(Window.partitionBy(stratum, deck).orderBy(*by)), F.lit(cap)))
    placed = steps.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy("_d", *by))).where(F.col("_i") <= n)  # no quota is above n
    return placed.join(quota, stratum).where(F.col("_i") <= F.col("_q")).drop("_d", "_i", "_q")


def waterfill_quota(sizes: DataFrame, size: str, n: float) -> DataFrame:
    """quota = min(size, level * sqrt(size)), summing to n or to everything."""
    up = Window.orderBy(size)
    below = F.coalesce(F.sum(size).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.sqrt(size)).over(up.rowsBetween(0, Window.unboundedFollowing))
    level = sizes.withColumn("_level", (F.lit(float(n)) - below) / left)
    found = F.min(F.when(F.col("_level") <= F.sqrt(size), F.struct(F.col(size).alias("_at"), "_level"))).over(Window.partitionBy())["_level"]
    return level.withColumn("quota", F.least(F.col(size).cast("double"), F.coalesce(found, F.lit(float("inf"))) * F.sqrt(size))).drop("_level")


def round_robin(df: DataFrame, deck: str, n: int, seed: str, key: str) -> DataFrame:
    """Rounds that take one row per deck, in a seeded order, until n."""
    turn = df.withColumn("round", F.row_number().over(Window.partitionBy(deck).orderBy(seeded(seed, key), key)))
    turn = turn.where(F.col("round") <= n)  # no deck gives more, and Spark trims before it shuffles
    return first_rows(turn, ["round", seeded(seed, deck), key], n)


def _mixed(key: str) -> list[Column]:
    number = F.col(key).try_cast("long")
    return [number.isNull(), number, F.col(key)]


def sort_samples(df: DataFrame, key: str, place: str = "place") -> DataFrame:
    """Every row with its place from 1: numeric ids by value, others last."""
    return ranked(df, _mixed(key), place)


def top_up(removed: DataFrame, pool: DataFrame, stratum: str, order: Sequence[Column], key: str) -> DataFrame:
    """For each removed row the next best unused row of its stratum."""
    r = removed.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).select(stratum, "_i", F.col(key).alias("replaced"))
    p = pool.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return r.join(p, [stratum, "_i"]).drop("_i")


def preview(df: DataFrame, n: int, seed: str, text: str) -> DataFrame:
    """The first n rows of a seeded shuffle by text."""
    return first_rows(df, [seeded(seed, text), text], n)


def smoke_set(df: DataFrame, cls: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of one class, in order."""
    return first_rows(df.where(cls), order, n)


def skip_reasons(df: DataFrame, kept: DataFrame, first: Sequence[str], second: Sequence[str], order: str) -> DataFrame:
    """Rows that were not kept, with `reasons`: which of their keys an earlier kept row has, else "beyond the target"."""
    out = df.join(kept.select(order), order, "left_anti")
    for name, cols in (("_r1", first), ("_r2", second)):
        had = kept.dropna(subset=list(cols)).groupBy(*cols).agg(F.min(order).alias(name))
        out = out.join(had, list(cols), "left")
    reasons = F.array_compact(F.array(F.when(F.col("_r1") < F.col(order), "first key"), F.when(F.col("_r2") < F.col(order), "second key")))
    out = out.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("beyond the target"))))
    return out.select(*df.columns, "reasons")
