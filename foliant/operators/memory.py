"""State over ordered turns (M1-M7): aliases, fact versions, the memory fold, and checks against stored results."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "struct<id:string,question:string,status:string,answer:string,pages:array<string>>"
FACT = "struct<page:string,n:int,text:string,revision:int>"
MEMORY = f"nodes array<{NODE}>, facts array<{FACT}>, active string, errors array<int>"

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_MEMORY = [
    pa.field("nodes", pa.list_(pa.struct({"id": _TEXT, "question": _TEXT, "status": _TEXT, "answer": _TEXT, "pages": _TEXTS}.items()))),
    pa.field("facts", pa.list_(pa.struct({"page": _TEXT, "n": pa.int32(), "text": _TEXT, "revision": pa.int32()}.items()))),
    pa.field("active", _TEXT), pa.field("errors", pa.list_(pa.int32())),
]
_CLUES = [
    pa.field("nodes", pa.list_(pa.struct({
        "id": pa.int32(), "parent": pa.int32(), "question": _TEXT, "answer": _TEXT, "open": pa.bool_(),
        "facts": pa.list_(pa.struct({"text": _TEXT, "box": pa.list_(pa.float64()), "superseded": pa.bool_()}.items())), "refs": _TEXTS,
    }.items()))), pa.field("next_id", pa.int32()), pa.field("refused", pa.int32()),
]


def page_aliases(visits: DataFrame, sample: str, turn: str, label: str) -> DataFrame:
    """M1: P1, P2, ... by first sight in each sample."""
    first = visits.groupBy(sample, label).agg(F.min(turn).alias("first_turn"))
    place = F.row_number().over(Window.partitionBy(sample).orderBy("first_turn", label))
    return first.withColumn("alias", F.concat(F.lit("P"), place.cast("string")))


def fact_versions(events: DataFrame, fact: str, turn: str, *values: str) -> DataFrame:
    """M2: per fact its current values (text, box, source, ...), the number of revisions, and the earlier ones in order."""
    held = events.groupBy(fact).agg(F.array_sort(F.collect_list(F.struct(turn, *values))).alias("_h"))
    now = F.element_at("_h", -1)
    earlier = F.transform(F.slice("_h", 1, F.size("_h") - 1), lambda h: F.struct(*(h[v].alias(v) for v in values)) if len(values) > 1 else h[values[0]])
    return held.select(fact, *(now[v].alias(v) for v in values), (F.size("_h") - 1).alias("revision"), earlier.alias("history"))


@dataclass
class Memory:
    """One sample's question tree and facts. Nodes are [id, question, status, answer, pages]; facts are kept by page."""

    nodes: list[list] = field(default_factory=lambda: [["N0", "", "open", None, []]])
    facts: dict[str, list[list]] = field(default_factory=dict)

    def active(self) -> int:
        return next((i for i, n in enumerate(self.nodes) if i and n[2] == "open"), 0)

    def step(self, turn: dict) -> bool:
        """Applies one turn: facts of the page in view, then the tree's operation. Nothing changes if any part is refused."""
        page, texts, updates = turn["view"], turn["added"], turn["updated"]
        known = [list(f) for f in self.facts.get(page, [])]
        if (len(texts) or len(updates)) and not page:
            return False
        known += [[t, 0] for t in texts]
        for n, text in updates:
            if not 1 <= n <= len(known):
                return False
            known[n - 1] = [text, known[n - 1][1] + 1]
        facts = {**self.facts, **({page: known} if page else {})}
        pages = list(dict.fromkeys(turn["pages"]))
        if turn["op"] and any(not facts.get(p) for p in pages):
            return False
        if turn["op"] == "resolve":
            at = next((i for i, n in enumerate(self.nodes) if n[0] == turn["node"]), None) if turn["node"] else self.active()
            if at is None:
                return False
            node = self.nodes[at]
            node[2:] = ["resolved", turn["answer"], [*node[4], *(p for p in pages if p not in node[4])]]
        elif turn["op"] == "expand":
            at, fresh = self.active(), len(self.nodes)
            if at:
                node = self.nodes[at]
                node[1:] = [turn["answered"], "resolved", turn["answer"], [*node[4], *(p for p in pages if p not in node[4])]]
                self.nodes.insert(at + 1, [f"N{fresh}", turn["next"], "open", None, []])
            else:
                self.nodes += [[f"N{fresh}", turn["answered"], "resolved", turn["answer"], pages], [f"N{fresh + 1}", turn["next"], "open", None, []]]
        self.facts = facts
        return True


def _plain(row) -> dict:
    as_list = lambda x: [] if x is None else list(x)
    return {
        "view": row.view or None, "added": as_list(row.added), "updated": [(u["n"], u["text"]) for u in as_list(row.updated)],
        "op": row.op or None, "node": row.node or None, "answered": row.answered, "answer": row.answer, "next": row.next, "pages": as_list(row.pages),
    }


def folded(memory: Memory, errors: list[int]) -> dict:
    names = ("id", "question", "status", "answer", "pages")
    return {
        "nodes": [dict(zip(names, n, strict=True)) for n in memory.nodes], "active": memory.nodes[memory.active()][0], "errors": errors,
        "facts": [{"page": p, "n": i + 1, "text": t, "revision": r} for p, fs in memory.facts.items() for i, (t, r) in enumerate(fs)],
    }


#: Samples that are handed on in one batch.
HANDED = 256


def fold_samples(rows: DataFrame, sample: str, order: str, columns: tuple[str, ...], start: Callable, step: Callable, finish: Callable, schema: str, types: list[pa.Field]) -> DataFrame:
    """One row per sample: finish(state) after step(state, row, order) of its rows in order; rows have the columns named.

    A task streams through its samples, sorted: it holds one sample's state and a batch of rows, whatever a sample's size.
    The fold costs far more than the bytes of its rows tell, so tasks are not put together by their bytes.
    """
    Row = namedtuple("Row", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: list[pa.Field] = []

        def stream():
            for batch in batches:
                every[:] = [pa.field(sample, batch.schema.field(0).type), *types]
                keys, orders, *values = (c.to_pylist() for c in batch.columns)
                yield from zip(keys, orders, map(Row._make, zip(*values, strict=True)), strict=True)

        out = []
        for key, group in groupby(stream(), key=lambda x: x[0]):
            state = start()
            for _, at, row in group:
                step(state, row, at)
            out.append({sample: key, **finish(state)})
            if len(out) == HANDED:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(every))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(every))

    held = rows.select(F.col(sample).alias("_sample"), F.col(order).alias("_order"), *columns)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartition(tasks, "_sample").sortWithinPartitions("_sample", F.asc_nulls_last("_order"))
    return dealt.mapInArrow(run, f"`{sample}` {dict(rows.dtypes)[sample]}, {schema}")


def fold_memory(turns: DataFrame, sample: str, turn: str) -> DataFrame:
    """M3: per sample the memory after its turns in order, and the turns that were refused.

    turns: view (page alias or null), added (texts), updated (n, text), op (resolve, expand or null), node, answered,
    answer, next, pages. Samples are dealt over the cluster.
    """
    columns = ("view", "added", "updated", "op", "node", "answered", "answer", "next", "pages")

    def step(state: tuple[Memory, list[int]], row, at) -> None:
        memory, errors = state
        if not memory.step(_plain(row)):
            errors.append(int(at))

    return fold_samples(turns, sample, turn, columns, lambda: (Memory(), []), step, lambda state: folded(*state), MEMORY, _MEMORY)


class ClueGraph:
    """The older memory: a tree of questions. Facts are [text, box or None, superseded]; ids are never used again."""

    def __init__(self):
        self.nodes: dict[int, dict] = {}
        self.fresh, self.active, self.target = 0, 0, None
        self._add(None, "")

    def _add(self, parent: int | None, question: str) -> dict:
        self.nodes[self.fresh] = {"id": self.fresh, "parent": parent, "question": question, "answer": None, "open": True, "facts": [], "refs": []}
        self.fresh += 1
        return self.nodes[self.fresh - 1]

    def _children(self, node: dict) -> list[dict]:
        return [n for n in self.nodes.values() if n["parent"] == node["id"]]

    @staticmethod
    def _more(node: dict, facts: list, refs: list) -> None:
        for fact in facts:
            if fact[0] not in [known[0] for known in node["facts"]]:
                node["facts"].append(list(fact))
        node["refs"] += [r for r in dict.fromkeys(refs) if r not in node["refs"]]

    def _absorb(self, node: dict, child: dict) -> None:
        for below in self._children(child):
            self._absorb(node, below)
        self._more(node, child["facts"], child["refs"])
        del self.nodes[child["id"]]

    def step(self, kind: str, answer: str | None, facts: list, refs: list, answered: str | None, remaining: str | None, region: list | None) -> bool:
        """Applies one decision; False if it lacks what its kind needs."""
        node = self.nodes[self.active]
        if kind == "REJECT":
            self.target = None
        elif kind == "ACCEPT" and answer:
            node["answer"], node["open"] = answer, False
            self.target = node["id"]
            if node["id"] == 0 or len(self._children(node)) >= 2:  # a synthesis takes the place of what was known
                node["facts"] = []
                facts = facts or [[answer, None, False]]
            self._more(node, facts, refs)
            self.active = node["id"] if node["parent"] is None else node["parent"]
        elif kind == "EXPAND" and answer and answered and remaining:
            for child in self._children(node):
                self._absorb(node, child)
            self._more(node, [], refs)
            done = self._add(node["id"], answered)
            done["answer"], done["open"] = answer, False
            self._more(done, facts or [[answer, None, False]], refs)
            self.target, self.active = done["id"], self._add(node["id"], remaining)["id"]
        elif kind.startswith("CROP_") and self.target in self.nodes:
            return kind == "CROP_REJECT" or self._crop(self.nodes[self.target], answer, facts, refs, region)
        else:
            return False
        return True

    def _crop(self, node: dict, answer: str | None, facts: list, refs: list, region: list | None, slack: float = 10.0) -> bool:
        """What a closer look says goes to the node that the page's facts went to, and earlier facts inside the region are superseded."""
        for fact in node["facts"] if region else ():
            if fact[1] and all(fact[1][i] >= region[i] - slack and fact[1][i + 2] <= region[i + 2] + slack for i in (0, 1)):
                fact[2] = True
        self._more(node, facts or ([[answer, None, False]] if answer else []), refs)
        node["answer"] = (answer or "").strip() or node["answer"]
        return True


def fold_graph(decisions: DataFrame, sample: str, order: str) -> DataFrame:
    """M4: the older clue graph per sample after its decisions in order, the next free id and how many decisions were refused.

    decisions: decision (ACCEPT, REJECT, EXPAND, or CROP_ before one of them), answer, facts (text, box), refs, answered,
    remaining, region. ACCEPT closes the active node and goes up; the root and nodes that were expanded have their facts
    overwritten, others more of them. EXPAND first takes in what older children knew, drops them, and opens an answered and
    a remaining question. A crop's facts go to the node that the last page's facts went to and supersede those inside it.
    """
    node = "struct<id:int,parent:int,question:string,answer:string,open:boolean,facts:array<struct<text:string,box:array<double>,superseded:boolean>>,refs:array<string>>"
    columns = ("decision", "answer", "facts", "refs", "answered", "remaining", "region")
    names = ("text", "box", "superseded")

    def step(state: dict, row, at) -> None:
        facts = [[f["text"], f["box"], False] for f in row.facts or ()]
        state["refused"] += not state["graph"].step(row.decision, row.answer, facts, row.refs or [], row.answered, row.remaining, row.region)

    def finish(state: dict) -> dict:
        nodes = [{**n, "facts": [dict(zip(names, f, strict=True)) for f in n["facts"]]} for n in state["graph"].nodes.values()]
        return {"nodes": nodes, "next_id": state["graph"].fresh, "refused": state["refused"]}

    return fold_samples(decisions, sample, order, columns, lambda: {"graph": ClueGraph(), "refused": 0}, step, finish, f"nodes array<{node}>, next_id int, refused int", _CLUES)


def fold_findings(steps: DataFrame, sample: str, order: str, kind: str, text: str) -> DataFrame:
    """M5: per sample: confirmed findings, the last two partial ones, how many warnings, summaries as lines; all in order."""
    newest = F.row_number().over(Window.partitionBy(sample, kind).orderBy(F.desc(order)))
    ranked = steps.withColumn("_r", newest)
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(order, text)))), lambda s: s[text])
    return ranked.groupBy(sample).agg(
        pick(F.col(kind) == "confirmed").alias("confirmed"), pick((F.col(kind) == "partial") & (F.col("_r") <= 2)).alias("partials"),
        F.count(F.when(F.col(kind) == "warning", 1)).alias("warnings"), F.array_join(pick(F.col(kind) == "summary"), "\n").alias("summaries"),
    )


def evidence_prefixes(steps: DataFrame, sample: str, order: str, item: Column) -> tuple[DataFrame, DataFrame]:
    """M6: per sample its distinct items in order of sight, once; and the steps with n_before and n_after, how many of them were
    known before and after each. What is kept grows with steps and items, not with their product.
    """
    first = F.row_number().over(Window.partitionBy(sample, "_item").orderBy(order)) == 1
    seen = steps.withColumn("_item", item).withColumn("_new", (first & F.col("_item").isNotNull()).cast("int"))
    after = F.sum("_new").over(Window.partitionBy(sample).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("_new") == 1, F.struct(F.col(order).alias("o"), F.col("_item").alias("i"))))), lambda x: x["i"])
    return seen.groupBy(sample).agg(held.alias("items")), seen.withColumn("n_after", after).withColumn("n_before", after - F.col("_new")).drop("_item", "_new")


def evidence_states(steps: DataFrame, sample: str, order: str, item: Column) -> DataFrame:
    """M6: the distinct items known before and after each step, in order of sight, written out for each step."""
    items, placed = evidence_prefixes(steps, sample, order, item)
    both = placed.join(items, sample)
    part = lambda n: F.slice("items", F.lit(1), F.col(n))
    return both.withColumn("state_before", part("n_before")).withColumn("state_after", part("n_after")).select(*steps.columns, "state_before", "state_after")


def replay_check(folded: DataFrame, stored: DataFrame, sample: str, columns: list[str]) -> DataFrame:
    """M7: samples whose fold equals what was stored, by null-safe comparison of the columns."""
    other = stored.select(F.col(sample).alias("_s"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = folded.join(other, F.col(sample) == F.col("_s"))
    for c in columns:
        both = both.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    return both.select(*folded.columns)


def memory_rows(batches: Iterator[pd.DataFrame], memory: Memory, turn: str) -> tuple[Memory, list[int], str | None]:
    """Applies batches of one sample's turns to a memory, up to an answer or an error: the memory, refused turns, and what ended it."""
    errors: list[int] = []
    for row in (row for batch in batches for row in batch.sort_values(turn).itertuples(index=False)):
        if row.op == "error":
            return memory, errors, "error"
        if not memory.step(_plain(row)):
            errors.append(int(getattr(row, turn)))
        if row.op == "answer":
            return memory, errors, "answer"
    return memory, errors, None
