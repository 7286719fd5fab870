"""Cost-balanced assignment (D15, D16): longest first to the least loaded rank with room.

The greedy rule is sequential, so it runs on the histogram of costs: equal rows are placed together. That is one stream over
distinct costs, which holds each rank's load and room; it says how many rows of a cost each rank takes and from which load
on. Numbered in the same order, these slots and the rows meet in a join, so rows are sorted in ranges and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.scratch import written

from .curate import ranked


def placed(loads: np.ndarray, room: np.ndarray, cost: int, many: int) -> np.ndarray:
    """How many of `many` rows of one cost each rank takes, where each goes to the least loaded rank with room, ties to the first rank."""
    if cost == 0:  # loads don't change, so ranks fill up in order
        order = np.lexsort((np.arange(len(loads)), loads))
        before = np.concatenate([[0], np.cumsum(room[order])[:-1]])
        taken = np.zeros(len(loads), np.int64)
        taken[order] = np.clip(many - before, 0, room[order])
        return taken
    upto = lambda level: np.clip((level - loads) // cost + 1, 0, room)  # noqa: E731  # rows placed at loads up to a level
    low, high = int(loads.min()) - 1, int(loads.max()) + cost * (many + 1)
    while high - low > 1:  # the lowest level that holds them all
        middle = (low + high) // 2
        low, high = (low, middle) if upto(middle).sum() >= many else (middle, high)
    taken = upto(low)
    last = np.flatnonzero(upto(high) > taken)[: many - int(taken.sum())]
    taken[last] += 1
    return taken


def _slots(histogram: DataFrame, n: int, room: list[int]) -> DataFrame:
    """_cost, rank, _load (before the first), _many: one stream over the costs, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, left = np.zeros(n, np.int64), np.array(room, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for cost, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                taken = placed(loads, left, cost, many)
                out += [(cost, r, int(loads[r]), int(taken[r])) for r in np.flatnonzero(taken).tolist()]
                loads += taken * cost
                left -= taken
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["_cost", "rank", "_load", "_many"])

    in_order = histogram.repartition(1).sortWithinPartitions(F.desc("_cost"))  # a row a distinct cost
    return in_order.mapInArrow(run, "_cost long, rank int, _load long, _many long")


def _histogram(rows: DataFrame, cost: str) -> DataFrame:
    whole = F.col(cost).cast("long")
    checked = F.when(whole.isNull() | (whole < 0) | (whole != F.col(cost)), F.raise_error(F.lit(f"{cost} must be a whole number from 0 on"))).otherwise(whole)
    return written(rows.select(checked.alias("_cost")).groupBy("_cost").agg(F.count("*").alias("_n")))


def _assigned(rows: DataFrame, cost: str, key: str, slots: DataFrame) -> DataFrame:
    """Rows in the order of cost and key take the slots in the order they were filled."""
    each = slots.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
    filled = each.select("_cost", (F.col("_load") + F.col("_i") * F.col("_cost")).alias("_at"), "_i", "rank")
    # at cost 0 a rank fills up before the next one of its load
    filled = ranked(filled, [F.desc("_cost"), F.col("_at"), F.col("rank"), F.col("_i")], "_place").select("_place", "rank")
    return ranked(rows, [F.desc(cost), F.col(key)], "_place").join(filled, "_place").drop("_place")


def balance_ranks(traj: DataFrame, cost: str, key: str, n: int) -> DataFrame:
    """Rows with a `rank`: largest cost first, ties by key, each to the least loaded rank with room, ties to the lower
    rank. Each rank has room for an equal share, the first ones for one more where shares don't come out even. Costs are
    whole numbers from 0 on, else an error.
    """
    histogram = _histogram(traj, cost)
    total = histogram.agg(F.sum("_n")).first()[0] or 0
    return _assigned(traj, cost, key, written(_slots(histogram, n, [total // n + (r < total % n) for r in range(n)])))


def micro_batches(rows: DataFrame, cost: str, key: str, budget: int) -> DataFrame:
    """Rows with a `batch`: ceil(total / budget) batches without limits of their counts, balanced as in D15; if the
    largest is above the budget there are more. Rows above the budget are batches of their own, numbered after the others
    in the order of key. Tries run on the histogram of costs alone.
    """
    histogram = _histogram(rows, cost)
    fits = histogram.where(F.col("_cost") <= budget)
    total, n = fits.agg(F.sum(F.col("_cost") * F.col("_n")), F.sum("_n")).first()
    many, n = max(1, -(-(total or 0) // budget)), n or 0
    while True:
        many = min(many, max(1, n))
        slots = written(_slots(fits, many, [n] * many))
        top = slots.groupBy("rank").agg(F.sum(F.col("_cost") * F.col("_many")).alias("_s")).agg(F.max("_s")).first()[0] or 0
        if top <= budget or many >= n:
            break
        many += max(1, many // 8)
    within = _assigned(rows.where(F.col(cost) <= budget), cost, key, slots).withColumnRenamed("rank", "batch")
    beyond = ranked(rows.where(F.col(cost) > budget), [F.col(key)], "_i").withColumn("batch", (F.col("_i") - 1 + (many if n else 0)).cast("int")).drop("_i")
    return within.unionByName(beyond)
