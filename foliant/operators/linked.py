"""First-wins deduplication over two keys (D8), by components of the graph that keys and rows make.

Rows link their two keys. A decision about a row only depends on rows of its component, so components come first, in
a number of rounds that grows with the logarithm of the longest chain. Components of up to FOLDED rows are then decided each in
one pass over its rows in order; only larger ones go through rounds of keeping and dropping.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.scratch import written

from .curate import first_rows

#: Rows of a component that one pass decides; of each, two hashes and the order are held.
FOLDED = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, component of edges (a, b): the smallest node that is reachable, in rounds written to the shared folder.

    Each node points to a smaller one or to itself. A round points nodes, and what they point to, to the smallest node that
    their neighbours point to in two steps, and then follows each pointer once more.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both)
    at = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("f")))
    while True:
        up = at.select(F.col("a").alias("f"), F.col("f").alias("g"))
        far = written(at.join(up, "f").select("a", "f", "g"))  # g: where two steps lead
        near = both.join(far.select(F.col("a").alias("b"), F.col("g").alias("to")), "b").groupBy("a").agg(F.min("to").alias("to"))
        found = far.join(near, "a")
        hooks = found.select("a", F.least("g", "to").alias("to")).union(found.select(F.col("f").alias("a"), "to"))
        now = written(far.select("a", "f").join(hooks.groupBy("a").agg(F.min("to").alias("to")), "a").select("a", F.least("f", "to").alias("f"), F.col("f").alias("was")))
        moved = not now.where("f <> was").isEmpty()
        at = now.select("a", "f")
        if not moved:
            return at.select(F.col("a").alias("node"), F.col("f").alias("component"))


def _kept_in_pass(rows: pd.DataFrame) -> pd.DataFrame:
    first, second, kept = set(), set(), []
    for order, a, b in rows.sort_values("_order")[["_order", "_k1", "_k2"]].itertuples(index=False):
        if a not in first and b not in second:
            first.add(a)
            second.add(b)
            kept.append(order)
    return pd.DataFrame({"_order": kept})


def _kept_in_rounds(left: DataFrame) -> DataFrame:
    """Each round keeps the rows that come first among the undecided of both their keys, and drops those that share a key with them."""
    kept: list[DataFrame] = []
    while not left.isEmpty():
        firsts = left
        for name in ("_k1", "_k2"):
            firsts = firsts.join(left.groupBy(name).agg(F.min("_order").alias(f"_m{name}")), name)
        now = written(firsts.where("_order = _m_k1 AND _order = _m_k2").select("_order", "_k1", "_k2"))
        kept.append(now.select("_order"))
        rest = left
        for name in ("_k1", "_k2"):
            rest = rest.join(now.select(name), name, "left_anti")
        left = written(rest.select("_order", "_k1", "_k2"))
        if len(kept) % 32 == 0:  # one table for many, so that the plan doesn't grow
            whole = kept[0]
            for more in kept[1:]:
                whole = whole.unionByName(more)
            kept = [written(whole)]
    out = left.select("_order")
    for more in kept:
        out = out.unionByName(more)
    return out


def dedup_two_keys(df: DataFrame, first: Sequence[str], second: Sequence[str], order: str, target: int | None = None, folded: int = FOLDED) -> DataFrame:
    """In order, which tells all rows apart, a row is kept if no kept row has its first or its second key; then the first `target` rows.

    Keys with a null don't count.
    """

    def key(name: str, cols: Sequence[str]) -> Column:
        whole = F.lit(bool(cols))
        for c in cols:
            whole = whole & F.col(c).isNotNull()
        own = F.concat(F.lit(f"{name}-"), F.col(order).cast("string"))
        text = F.when(whole, F.concat(F.lit(f"{name}:"), F.to_json(F.struct(*cols)))).otherwise(own) if cols else own
        return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)  # 128 bits

    keyed = written(df.select(F.col(order).alias("_order"), key("k1", first).alias("_k1"), key("k2", second).alias("_k2")))
    # rows whose keys occur once need no component
    often = [keyed.groupBy(name).count().where("count > 1").select(name) for name in ("_k1", "_k2")]
    first_often, second_often = (keyed.join(keys, name, "left_semi").select("_order") for keys, name in zip(often, ("_k1", "_k2"), strict=True))
    tangled = written(keyed.join(first_often.union(second_often).distinct(), "_order", "left_semi"))
    alone = keyed.join(tangled.select("_order"), "_order", "left_anti").select("_order")
    of_node = components(tangled.select(F.col("_k1").alias("a"), F.col("_k2").alias("b")))
    placed = written(tangled.join(of_node.select(F.col("node").alias("_k1"), "component"), "_k1"))
    # few, as each has over `folded` rows; sent to all tasks, so that a component's rows needn't meet in one
    large = F.broadcast(placed.groupBy("component").count().where(F.col("count") > folded).select("component"))
    small = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(_kept_in_pass, f"_order {dict(keyed.dtypes)['_order']}")
    kept = alone.unionByName(small).unionByName(_kept_in_rounds(written(placed.join(large, "component", "left_semi").select("_order", "_k1", "_k2"))))
    out = df.join(kept.select(F.col("_order").alias(order)), order, "left_semi").select(*df.columns)
    return out if target is None else first_rows(out, [order], target)
