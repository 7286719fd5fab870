"""Fuller reports (A14, A18-A20, A36, W17) and rows for training and reading.

Counts of several kinds come in long form: kind, name, n.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counted(df: DataFrame, kind: str, name: Column, *keys: str, n: Column | None = None) -> DataFrame:
    total = F.count("*") if n is None else F.sum(n)
    return df.groupBy(*keys, name.cast("string").alias("name")).agg(total.alias("n")).select(*keys, F.lit(kind).alias("kind"), "name", "n")


def _long(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def corpus_histograms(qa: DataFrame, pages: DataFrame, split: str, deck: str, hop: str, n_evidence: str, num_pages: str) -> DataFrame:
    """Per split (kind, name, n): questions by hop, by number of evidence pages, by pages of their deck; decks; page files."""
    decks = qa.select(split, deck).distinct()
    return _long([
        _counted(qa, "hop", F.col(hop), split), _counted(qa, "num_evidence", F.col(n_evidence), split), _counted(qa, "pages_per_deck", F.col(num_pages), split),
        _counted(decks, "decks", F.lit("all"), split), _counted(pages, "page_files", F.lit("all"), split),
    ])


def subset_counts(selected: DataFrame, calls: DataFrame, key: str, hop: str, step: str) -> DataFrame:
    """(kind, name, n) of a selection of trajectories and all calls: selected by hop, trajectories by number of calls, calls by hop and by step."""
    own = calls.join(selected.select(key, hop), key)
    per = selected.select(key).join(own.groupBy(key).agg(F.count("*").alias("_c")), key, "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    return _long([
        _counted(selected, "selected", F.col(hop)), _counted(per, "calls_per_trajectory", F.col("_c")), _counted(own, "calls_by_hop", F.col(hop)), _counted(own, "calls_by_step", F.col(step)),
    ])


def merge_counts(kept: DataFrame, skipped: DataFrame, source: str, hop: str, calls: str, reasons: str, keys: Mapping[str, list[str]]) -> DataFrame:
    """(kind, name, n) of a merge: kept rows and their calls (a column of counts) by source and by hop, skip reasons, and for each
    named key how many rows repeat one; rows with a null in a key don't count for it.
    """
    parts = [
        _counted(kept, "rows_by_source", F.col(source)), _counted(kept, "rows_by_hop", F.col(hop)), _counted(kept, "calls_by_source", F.col(source), n=F.col(calls)),
        _counted(kept, "calls_by_hop", F.col(hop), n=F.col(calls)), _counted(skipped.select(F.explode(reasons).alias("_r")), "skipped", F.col("_r")),
    ]
    for name, cols in keys.items():
        per = kept.dropna(subset=cols).groupBy(*cols).agg(F.count("*").alias("_n"))
        parts.append(per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicates").alias("kind"), F.lit(name).alias("name"), "n"))
    return _long(parts)


def _masked(values: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["v"])


def training_metrics(
    rows: DataFrame, traj: str, order: str, scores: str, rewards: str, advantages: str, returns: str, values: str, mask: str, lengths: Mapping[str, tuple[Column, int]], episode: Mapping[str, Column],
) -> DataFrame:
    """One row: mean, max and min of summed scores and rewards per row, of advantages, returns and values over the masked tokens, of each length
    with its share at the cap, and of episode figures over distinct trajectories (their first row by order); and the explained variance
    1 - var(return - value) / (var(return) + 1e-5) over the masked tokens.
    """
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x)
    three = lambda c, name: [f(c).alias(f"{name}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    of_rows = three(total(scores), "score") + three(total(rewards), "reward")
    for name, (length, cap) in lengths.items():
        of_rows += [*three(length, name), F.avg((length == cap).cast("double")).alias(f"{name}_clip_ratio")]
    body = rows.agg(*of_rows)
    tokens = rows.select(F.explode(F.arrays_zip(*(_masked(F.col(c), F.col(mask)).alias(n) for n, c in (("a", advantages), ("r", returns), ("v", values))))).alias("t")).select("t.*")
    explained = (1 - F.var_samp(F.col("r") - F.col("v")) / (F.var_samp("r") + 1e-5)).alias("explained_variance")
    inside = tokens.agg(*three(F.col("a"), "advantage"), *three(F.col("r"), "return"), *three(F.col("v"), "value"), explained)
    first = rows.groupBy(traj).agg(*(F.min_by(c, order).alias(n) for n, c in episode.items()))
    over = first.agg(F.count("*").alias("episodes"), *(x for n in episode for x in three(F.col(n), n)))
    return body.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(over))  # one row each


def episode_report(steps: DataFrame, traj: str, order: str, active: Column, source: str, success: str, terms: Mapping[str, Column], ends: Mapping[str, Column], counts: Mapping[str, Column]) -> DataFrame:
    """From the last active step of each trajectory, by source and for "all": episodes, success; means of reward terms (null counts 0); shares of
    end reasons; means of behaviour counts, and for each the share of episodes where it is above 0 (`<name>_rate`).
    """
    figures = {success: F.col(success).cast("double"), **{n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in terms.items()}}
    figures |= {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in ends.items()}
    for n, c in counts.items():
        figures |= {n: F.coalesce(c.cast("double"), F.lit(0.0)), f"{n}_rate": (F.coalesce(c, F.lit(0)) > 0).cast("double")}
    last = steps.where(active).select(traj, F.col(order).alias("_o"), source, *(c.alias(f"_{n}") for n, c in figures.items()))
    last = last.groupBy(traj).agg(F.max_by(F.struct(source, *(f"_{n}" for n in figures)), "_o").alias("_s")).select("_s.*")
    out = last.rollup(source).agg(F.count("*").alias("episodes"), *(F.avg(f"_{n}").alias(n) for n in figures), F.grouping(source).alias("_all"))
    return out.withColumn(source, F.when(F.col("_all") == 1, "all").otherwise(F.col(source).cast("string"))).drop("_all")


def step_penalty(rows: DataFrame, rewards: str, mask: str, step_reward: str, valid: str, coef: float) -> DataFrame:
    """An action that isn't valid (null counts so) costs coef at its last valid token and in its step reward."""
    last = F.array_max(F.transform(F.col(mask), lambda m, i: F.when(m > 0, i).otherwise(-1)))
    wrong = ~F.coalesce(F.col(valid), F.lit(False))
    cut = F.transform(F.col(rewards), lambda x, i: F.when((i == last) & wrong, x - coef).otherwise(x))
    return rows.withColumns({rewards: cut, step_reward: F.when(wrong, F.col(step_reward) - coef).otherwise(F.col(step_reward))})


def valid_action_ratio(rows: DataFrame, valid: str) -> DataFrame:
    """One row: the share of valid actions."""
    return rows.agg(F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("double")).alias("valid_action_ratio"))


def skipped_text_only(calls: DataFrame, sample: str, images: str) -> DataFrame:
    """One row: samples, those packed, and those skipped as none of their calls has an image."""
    per = calls.groupBy(sample).agg(F.max(F.size(F.coalesce(F.col(images), F.array().cast("array<string>")))).alias("_i"))
    return per.agg(F.count("*").alias("samples"), F.count(F.when(F.col("_i") > 0, 1)).alias("packed"), F.count(F.when(F.col("_i") <= 0, 1)).alias("skipped_text_only"))


def page_visits(turns: DataFrame, sample: str, turn: str, view: str) -> DataFrame:
    """The visits of a memory's pages: sample, page, visit (from 1 for each page), turn, and whether it is a revisit."""
    seen = turns.where(F.col(view).isNotNull())
    visit = F.row_number().over(Window.partitionBy(sample, view).orderBy(turn))
    return seen.select(sample, F.col(view).alias("page"), visit.alias("visit"), turn).withColumn("revisit", F.col("visit") > 1)


# The lines of rendered memories.
NO_PAGES, PAGES_HEAD, TREE_HEAD, NOTES_HEAD = "Page memory: none", "Page memory:", "Question tree:", "Page notes:"
INNER, LAST = "├─ ", "└─ "


def render_pages(pages: Column) -> Column:
    """Page blocks as lines. pages: array of id, descriptor, query, facts (texts), linked (ids of nodes)."""

    def block(p: Column) -> Column:
        named = F.when(F.coalesce(p["descriptor"], F.lit("")) != "", F.concat(p["id"], F.lit(": "), p["descriptor"])).otherwise(p["id"])
        answers = F.when(F.size(p["linked"]) > 0, F.concat(F.lit("   -> answers "), F.array_join(p["linked"], ", "))).otherwise("")
        quoted = F.regexp_extract(F.to_json(F.struct(p["query"].alias("q"))), r'^\{"q":(.*)\}$', 1)
        head = F.concat(named, F.lit("   (found by: "), quoted, F.lit(")"), answers)
        facts = F.transform(p["facts"], lambda f, i: F.concat(F.when(i == F.size(p["facts"]) - 1, LAST).otherwise(INNER), F.lit("F"), (i + 1).cast("string"), F.lit(": "), f))
        return F.array_join(F.concat(F.array(head), facts), "\n")

    return F.when(F.size(pages) > 0, F.concat(F.lit(f"{PAGES_HEAD}\n"), F.array_join(F.transform(pages, block), "\n\n"))).otherwise(NO_PAGES)


def forced_notes(nodes: Column, active: Column, pages: Column) -> Column:
    """The notes that a forced answer is made from: the tree with each node's state, answer and pages, then each page with its facts."""

    def node(n: Column) -> Column:
        state = F.concat(F.lit(" ["), n["status"], F.when(n["id"] == active, ", ACTIVE").otherwise(""), F.lit("]: "))
        answer = F.when(F.coalesce(n["answer"], F.lit("")) != "", F.concat(F.lit("  = "), n["answer"])).otherwise("")
        seen = F.when(F.size(n["pages"]) > 0, F.concat(F.lit("   (pages: "), F.array_join(n["pages"], ", "), F.lit(")"))).otherwise("")
        return F.concat(n["id"], state, n["question"], answer, seen)

    def page(p: Column) -> Column:
        named = F.when(F.coalesce(p["descriptor"], F.lit("")) != "", p["descriptor"]).otherwise("(no description)")
        head = F.concat(p["id"], F.lit(": "), named, F.lit('   (found by: "'), F.coalesce(p["query"], F.lit("None")), F.lit('")'))
        return F.array_join(F.concat(F.array(head), F.transform(p["facts"], lambda f: F.concat(F.lit("  - "), f))), "\n")

    lines = F.concat(F.array(F.lit(TREE_HEAD)), F.transform(nodes, node), F.array(F.lit(""), F.lit(NOTES_HEAD)), F.transform(pages, page))
    return F.array_join(lines, "\n")


def phase_rows(steps: DataFrame, traj: str, order: str, kind: str, verdict: str, hop: str, first: int, then: int) -> DataFrame:
    """Rows of two phases, of trajectories in order of their id: of the `first` ones a "judge" row for each analysed page ("warmup"); of
    the `then` next ones, step by step, a "decide" row for each decision, and a "judge" and an "update" row for each analysed page
    ("joint"). An update's target is the page's verdict, but that the last one but "no" of a multi-hop trajectory is "yes".
    Fewer trajectories than asked for are an error.
    """
    from .curate import ranked

    placed = ranked(steps.select(traj).distinct(), [F.col(traj)], "_t").where(F.col("_t") <= first + then)
    if (n := placed.count()) < first + then:
        raise ValueError(f"{first + then} trajectories are needed, there are {n}")
    analysed, said = F.col(kind) == "analyse", F.coalesce(F.col(verdict), F.lit("no"))
    last = F.max(F.when(analysed & (said != "no"), F.col(order))).over(Window.partitionBy(traj))
    held = steps.join(placed, traj).withColumn("_last", last)
    row = lambda task, target, nth: F.struct(F.lit(task).alias("task"), target.alias("target"), F.lit(nth).alias("nth"))
    raised = F.when((F.lower(hop) == "multi") & (F.col(order) == F.col("_last")), "yes").otherwise(said)
    none = F.lit(None).cast("string")
    warm = F.when(analysed, F.array(row("judge", said, 0)))
    joint = F.when(F.col(kind) == "decide", F.array(row("decide", none, 0))).when(analysed, F.array(row("judge", said, 0), row("update", raised, 1)))
    out = held.withColumn("phase", F.when(F.col("_t") <= first, "warmup").otherwise("joint")).withColumn("_r", F.explode(F.when(F.col("_t") <= first, warm).otherwise(joint)))
    return out.select("phase", traj, order, "_r.*")


def clean_traces(steps: DataFrame, sample: str, order: str, kind: str, verdict: str, page: str, query: str, summary: str) -> tuple[DataFrame, DataFrame]:
    """M5: decisions, searches and analyses of traces, as they are kept: verdicts but yes and partial are "no", an analysis without a query
    of its own has the last search's, and a summary names its query. And (kind, name, n): steps that came, steps that stay, verdicts.
    """
    known = F.col(kind).isin("decide", "search", "analyse")
    along = Window.partitionBy(sample).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    analysed = F.col(kind) == "analyse"
    said = F.when(analysed, F.when(F.lower(verdict).isin("yes", "partial"), F.lower(verdict)).otherwise("no"))
    searched = F.last(F.when(F.col(kind) == "search", F.coalesce(F.col(query), F.lit(""))), ignorenulls=True).over(along)
    own = F.when(F.trim(F.coalesce(F.col(query), F.lit(""))) != "", F.trim(query))
    held = steps.withColumn("_query", F.coalesce(own, F.trim(searched), F.lit("")))
    text = F.trim(F.coalesce(F.col(summary), F.lit("")))
    line = F.when(analysed & (text != ""), F.when(F.col("_query") != "", F.concat(F.lit("[query: "), F.col("_query"), F.lit("] "), text)).otherwise(text))
    cleaned = held.where(known).select(sample, order, kind, said.alias("verdict"), F.when(analysed, F.col(page)).alias("page"), F.when(analysed, F.col("_query")).alias("query"), line.alias("summary"))
    counts = _long([_counted(steps, "input", F.col(kind)), _counted(cleaned, "output", F.col(kind)), _counted(cleaned.where(analysed), "verdict", F.col("verdict"))])
    return cleaned, counts
