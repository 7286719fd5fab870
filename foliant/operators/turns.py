"""Turn logs: parsing, structural rules, flattening, training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.labels import page_key, to_conversations

TAGS = ("page", "tree", "act")
#: What an action needs beside its type.
ACTION_FIELDS = {"search": ("query",), "revisit": ("page_id",), "crop": (), "answer": ("text",)}


def parse_turns(raw: DataFrame, text: str) -> DataFrame:
    """adds think, page, tree, act (JSON texts), error_kind and error.

    Thinks are joined; of each other block the last outside the thinks counts. A block's first JSON value is read, what
    follows its last closing brace is ignored. Errors in this order: a block that isn't closed, no act, a block that isn't
    JSON, an act whose type or fields are wrong.
    """
    thinks = F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)</think>"), 1)
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", "")
    found = raw.withColumn("_think", F.array_join(F.filter(F.transform(thinks, lambda t: F.trim(t)), lambda t: t != ""), "\n"))
    found = found.withColumn("_rest", rest)
    last = lambda t: F.try_element_at(F.regexp_extract_all("_rest", F.lit(rf"(?s)<{t}>(.*?)</{t}>"), 1), F.lit(-1))
    found = found.withColumns({f"_{t}": F.trim(last(t)) for t in TAGS})
    found = found.withColumns({f"_cut_{t}": F.when(F.col(f"_{t}") != "null", F.regexp_extract(f"_{t}", r"(?s)^\s*(\{.*\})", 1)) for t in TAGS})
    found = found.withColumns({f"_value_{t}": F.nullif(F.col(f"_cut_{t}"), F.lit("")) for t in TAGS})
    bad = lambda t: F.col(f"_{t}").isNotNull() & (F.col(f"_{t}") != ("" if t == "act" else "null")) & F.try_parse_json(f"_value_{t}").isNull()
    unclosed = F.array_compact(F.array(*(F.when(F.col(f"_{t}").isNull() & F.contains("_rest", F.lit(f"<{t}>")), t) for t in TAGS)))
    broken = F.array_compact(F.array(*(F.when(bad(t), t) for t in TAGS)))
    found = found.withColumn("_u", unclosed).withColumn("_b", broken).withColumn("_kind", F.get_json_object("_value_act", "$.type"))
    lacks = F.lit(False)
    for name, fields in ACTION_FIELDS.items():
        missing = F.lit(False)
        for f in fields:
            missing = missing | (F.coalesce(F.trim(F.get_json_object("_value_act", f"$.{f}")), F.lit("")) == "")
        lacks = lacks | ((F.col("_kind") == name) & missing)
    wrong = ~F.coalesce(F.col("_kind").isin(*ACTION_FIELDS), F.lit(False)) | F.coalesce(lacks, F.lit(False))
    found = found.withColumn("_error_kind", F.when(F.size("_u") > 0, "unclosed").when(F.col("_act").isNull(), "no_act").when(F.size("_b") > 0, "json").when(wrong, "schema"))
    kind = F.col("_error_kind")
    error = (
        F.when(kind == "unclosed", F.concat(F.lit("<"), F.get("_u", F.lit(0)), F.lit("> is not closed"))).when(kind == "no_act", "missing <act>")
        .when(kind == "json", F.concat(F.lit("<"), F.get("_b", F.lit(0)), F.lit("> is not JSON"))).when(kind == "schema", "<act> schema")
    )
    out = {"think": F.col("_think"), **{t: F.col(f"_value_{t}") for t in TAGS}, "error_kind": kind, "error": error}
    # handed on as generated columns: a filter on them would else be pushed below, with the whole parse written out in it for each use
    parsed = found.select(*(c for c in raw.columns if c not in out), F.inline(F.array(F.struct(*(v.alias(k) for k, v in out.items())))))
    return parsed.select(*raw.columns, *(c for c in out if c not in raw.columns))


def check_rules(turns: DataFrame, view: str, current: str, forced: str) -> DataFrame:
    """F8: the first structural rule that a parsed turn breaks, given what is in view (none, page or zoom)."""
    kind = F.get_json_object("act", "$.type")
    rule = (
        F.when(F.col(forced) & (kind != "answer"), "budget").when((F.col(view) == "none") & F.col("page").isNotNull(), "page edit without page")
        .when((F.col(view) == "none") & (kind == "crop"), "crop without page").when((F.col(view) == "zoom") & (kind == "crop"), "second crop")
        .when((kind == "revisit") & (F.get_json_object("act", "$.page_id") == F.upper(current)), "page in view")
    )
    return turns.withColumn("rule", rule)


def explode_trace(preds: DataFrame, trace: str) -> DataFrame:
    """One row per step, one with nulls for an empty trace."""
    return preds.select(*(c for c in preds.columns if c != trace), F.posexplode_outer(trace).alias("step", "s")).select("*", "s.*").drop("s")


def build_sft_rows(turns: DataFrame, sample: str, turn: str, messages: str, target: str, applied: Column) -> DataFrame:
    """Applied turns with messages and a target: id, conversations."""
    good = turns.where(applied & (F.coalesce(F.trim(target), F.lit("")) != "") & (F.size(messages) > 0))
    return good.withColumn("id", F.concat(F.col(sample).cast("string"), F.lit(":turn:"), F.col(turn).cast("string"))).withColumn("conversations", to_conversations(F.col(messages), F.col(target)))


def pack_trajectories(calls: DataFrame, sample: str, order: str, text: str, images: str) -> DataFrame:
    """Per sample its calls' texts and images in order; samples without any image go."""
    per = calls.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(order, text, images))).alias("_c"))
    packed = per.select(sample, F.transform("_c", lambda c: c[text]).alias("texts"), F.flatten(F.transform("_c", lambda c: c[images])).alias("images"))
    return packed.where(F.size("images") > 0)


def flatten_memory(memory: DataFrame, sample: str) -> dict[str, DataFrame]:
    """Nodes, their pages, and facts of a folded memory as tables."""
    nodes = memory.select(sample, F.posexplode("nodes").alias("place", "n")).select(sample, "place", "n.*")
    links = nodes.select(sample, F.col("id").alias("node"), F.posexplode("pages").alias("nth", "page"))
    facts = memory.select(sample, F.explode("facts").alias("f")).select(sample, "f.*")
    return {"nodes": nodes.drop("pages"), "links": links, "facts": facts}


def evidence_pages(nodes: Column, labels: Column) -> Column:
    """Pages of all nodes, each once in node order, as real labels by a map from alias."""
    return F.transform(F.array_distinct(F.flatten(F.transform(nodes, lambda n: n["pages"]))), lambda p: F.try_element_at(labels, p))


def linked(nodes: Column, page: Column) -> Column:
    """Ids of the nodes that list a page."""
    return F.transform(F.filter(nodes, lambda n: F.array_contains(n["pages"], page)), lambda n: n["id"])


def render_notes(nodes: Column) -> Column:
    """The question tree as lines."""
    found = lambda n: F.concat(F.lit(" = "), n["answer"], F.lit(" ["), F.array_join(n["pages"], ", "), F.lit("]"))
    line = lambda n: F.concat(n["id"], F.lit(" "), n["question"], F.when(n["status"] == "resolved", found(n)).otherwise(" (open)"))
    return F.array_join(F.transform(nodes, line), "\n")


def relevance_rows(steps: DataFrame, traj: str, order: str, verdict: str, hop: str) -> DataFrame:
    """One row per judged step with the verdicts before it; a multi-hop trace's last verdict but "no" becomes "yes"."""
    along = Window.partitionBy(traj).orderBy(order)
    last = F.max(F.when(F.col(verdict) != "no", F.col(order))).over(Window.partitionBy(traj))
    before = F.array_join(F.collect_list(verdict).over(along.rowsBetween(Window.unboundedPreceding, -1)), ",")
    return steps.withColumn("earlier", before).withColumn("target", F.when((F.col(hop) == "multi") & (F.col(order) == last), "yes").otherwise(F.col(verdict)))


def page_tasks(qa: DataFrame, sample: str, pages: str, low: int, high: int) -> DataFrame:
    """One row per distinct evidence page in range; ids once."""
    tasks = qa.select(sample, F.explode(F.array_distinct(pages)).alias("page")).where(F.col("page").between(low, high))
    return tasks.withColumn("id", F.format_string("%s_page_%02d", F.col(sample).cast("string"), F.col("page").cast("int"))).dropDuplicates(["id"])


def pick_labels(arrays: Sequence[str], most: int) -> Column:
    """Distinct labels of the arrays by priority, the first `most`."""
    return F.slice(F.array_distinct(F.flatten(F.array(*arrays))), 1, most)


def rows_to_columns(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long (key, name, value) as one column per name."""
    return df.groupBy(key).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def collate_rollouts(steps: DataFrame, traj: str, active: Column, measures: Sequence[Column]) -> DataFrame:
    """Active steps with their episode's measures."""
    return steps.where(active).join(steps.groupBy(traj).agg(*measures), traj)


def retrieved_pages(labels: Sequence[str]) -> Column:
    """(deck, page) of the labels in several arrays, each once, without unreadable ones."""
    every = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in labels)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, page_key), lambda k: k.isNotNull())))
