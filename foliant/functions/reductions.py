"""Reductions that a caller passes in, and bootstraps over them.

A reduction starts from `zero`, takes a value so many times by `update`, joins two states by `merge` and gives its result by
`finish`; states are plain Python values. It runs over counts of distinct values, in blocks of bounded size, whose states
are merged: no group has to fit into one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from hashlib import md5
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a block, and draws that are worked out at a time.
BLOCK, DRAWS = 4096, 256


@dataclass(frozen=True)
class Reduction:
    """`batch`, where it is given, makes the states of many draws at once, from sorted values and a matrix of how often each draw has each;
    `whole` their results, where these are all of a draw's values.
    """

    zero: Callable[[], Any]
    update: Callable[[Any, float, int], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]
    batch: Callable[[np.ndarray, np.ndarray], list] | None = None
    whole: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def results(self, values: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Of draws that hold at least one value each."""
        if self.whole is not None:
            return self.whole(values, times)
        return np.array([self.finish(s) for s in self.states(values, times)], float)

    def states(self, values: np.ndarray, times: np.ndarray) -> list:
        if self.batch is not None:
            return self.batch(values, times)
        out = []
        for row in times:
            state = self.zero()
            for i in np.flatnonzero(row):
                state = self.update(state, float(values[i]), int(row[i]))
            out.append(state)
        return out


def _either(pick: Callable[[float, float], float], last: bool) -> Reduction:
    both = lambda a, b: b if a is None else a if b is None else pick(a, b)

    def batch(values: np.ndarray, times: np.ndarray) -> list:
        held = times[:, ::-1] > 0 if last else times > 0
        at = held.argmax(axis=1)
        return [x if any_ else None for x, any_ in zip(values[len(values) - 1 - at if last else at].tolist(), held.any(axis=1).tolist(), strict=True)]

    def whole(values: np.ndarray, times: np.ndarray) -> np.ndarray:
        return values[len(values) - 1 - (times[:, ::-1] > 0).argmax(axis=1)] if last else values[(times > 0).argmax(axis=1)]

    return Reduction(lambda: None, lambda s, x, _: both(s, x), both, lambda s: s, batch, whole)


LARGEST, SMALLEST = _either(max, True), _either(min, False)
MEAN = Reduction(
    lambda: (0.0, 0), lambda s, x, n: (s[0] + x * n, s[1] + n), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None,
    lambda values, times: list(zip((times @ values).tolist(), times.sum(axis=1).tolist(), strict=True)),
)


def _dealt(samples: DataFrame, group: str, value: str) -> DataFrame:
    """_g, _b, _v, _n: distinct values with their counts, in blocks of about BLOCK, of which the group has _blocks; null values are left out."""
    counts = samples.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy("_g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    return counts.join(sizes, "_g").withColumn("_b", F.pmod(F.xxhash64("_v"), F.col("_blocks")).cast("int"))


def _held_whole(dealt: DataFrame) -> DataFrame:
    """_g, _vs, _ns: values in order and their counts of each group, about BLOCK at most; the rows are few bytes and much work, so they
    are dealt to a number of tasks that doesn't follow their size.
    """
    held = dealt.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_h"))
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.select("_g", F.transform("_h", lambda x: x["_v"]).alias("_vs"), F.transform("_h", lambda x: x["_n"]).alias("_ns")).repartition(tasks, "_g")


def reduce_by(samples: DataFrame, group: str, value: str, reductions: Mapping[str, Reduction]) -> DataFrame:
    """U4: per group the reductions of its values by name; a group without values has no row."""
    kind = dict(samples.dtypes)[group]

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v")
        values, times = rows["_v"].to_numpy(float), rows["_n"].to_numpy()[None, :]
        states = {name: pickle.dumps(r.states(values, times)[0]) for name, r in reductions.items()}
        return pd.DataFrame([{"_g": rows["_g"].iloc[0], "_b": rows["_b"].iloc[0], **states}])

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for name, r in reductions.items():
            state = r.zero()
            for other in rows.sort_values("_b")[name]:
                state = r.merge(state, pickle.loads(other))
            out[name] = r.finish(state)
        return pd.DataFrame([{group: rows["_g"].iloc[0], **out}])

    def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in batches:
            out = {name: [] for name in reductions}
            for values, counts in zip(groups["_vs"], groups["_ns"], strict=True):
                for name, r in reductions.items():
                    out[name].append(r.finish(r.merge(r.zero(), r.states(np.asarray(values, float), np.asarray(counts)[None, :])[0])))
            yield pd.DataFrame({group: groups["_g"], **{name: pd.Series(x, groups.index, float) for name, x in out.items()}})

    schema = f"`{group}` {kind}, " + ", ".join(f"`{n}` double" for n in reductions)
    dealt = _dealt(samples, group, value)
    blocks = dealt.where("_blocks > 1").groupBy("_g", "_b").applyInPandas(of_block, f"_g {kind}, _b int, " + ", ".join(f"`{n}` binary" for n in reductions))
    return blocks.groupBy("_g").applyInPandas(of_group, schema).unionByName(_held_whole(dealt.where("_blocks = 1")).mapInPandas(of_groups, schema))


def sizes_of(many: int) -> list[int]:
    """The sizes that a group of so many values is drawn at: powers of two below its number, then that number; none for one value."""
    return [*(1 << k for k in range(1, many.bit_length()) if 1 << k < many), many] if many > 1 else []


def _random(*names: Any) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(md5("-".join(map(str, names)).encode()).digest(), "big"))


def bootstrap(samples: DataFrame, group: str, value: str, reductions: Mapping[str, Reduction], draws: int, seed: str, n: int | None = None) -> DataFrame:
    """Group, n, and for each reduction `<name>_mean` and `<name>_std` (population) over `draws` draws of n values with replacement.

    Without n each group is drawn at all of its sizes (`sizes_of`). A draw is a multinomial split of n over the group's blocks, which every
    block works out alike from the blocks' totals and a seed, and then over the block's values.
    """
    kind, chunks = dict(samples.dtypes)[group], -(-draws // DRAWS)
    dealt = _dealt(samples, group, value).drop("_blocks")
    totals = dealt.groupBy("_g", "_b").agg(F.sum("_n").alias("_t")).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_b", "_t"))).alias("_totals"))  # a number a block
    asked = dealt.join(totals, "_g")
    names = [f"`{r}` binary" for r in reductions]
    figures = [f"`{r}_{x}` double" for r in reductions for x in ("mean", "var")]

    def rows_of(values: np.ndarray, share: np.ndarray, split: Callable[[int, int, int], np.ndarray], sizes: list[int], *name: Any) -> Iterator[tuple]:
        """size, chunk, how many draws, states by reduction."""
        for size in sizes:
            for chunk in range(chunks):
                many = min(DRAWS, draws - chunk * DRAWS)
                own = _random(seed, *name[:1], size, chunk, *name[1:])
                times = own.multinomial(split(size, chunk, many), share)
                yield size, chunk, many, {r: f.states(values, times) for r, f in reductions.items()}

    def figures_of(results: Mapping[str, np.ndarray]) -> dict[str, float]:
        return {f"{r}_{x}": figure for r, held in results.items() for x, figure in (("mean", held.mean()), ("var", held.var()))}

    def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups of one block, whose states need no merging; where all values are alike, so are all draws."""
        columns = ["_g", "n", "_many", *(f"{r}_{x}" for r in reductions for x in ("mean", "var"))]
        for groups in batches:
            out = []
            for name, values, counts in zip(groups["_g"], groups["_vs"], groups["_ns"], strict=True):
                values, counts = np.asarray(values, float), np.asarray(counts, float)
                for size in [n] if n is not None else sizes_of(int(counts.sum())):
                    if len(values) == 1:
                        only = [r.results(values, np.array([[size]]))[0] for r in reductions.values()]
                        out.append((name, size, draws, *(figure for x in only for figure in (x, x - x))))
                        continue
                    for chunk in range(chunks):
                        many = min(DRAWS, draws - chunk * DRAWS)
                        times = _random(seed, name, size, chunk, 0).multinomial(np.full(many, size), counts / counts.sum())
                        figures = figures_of({r: f.results(values, times) for r, f in reductions.items()})
                        out.append((name, size, many, *figures.values()))
            yield pd.DataFrame(out, columns=columns)

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v")
        name, block = rows["_g"].iloc[0], rows["_b"].iloc[0]
        totals = np.array([t["_t"] for t in rows["_totals"].iloc[0]], float)
        place = [t["_b"] for t in rows["_totals"].iloc[0]].index(block)
        share = rows["_n"].to_numpy(float)
        split = lambda size, chunk, many: _random(seed, name, size, chunk).multinomial(size, totals / totals.sum(), many)[:, place]
        found = rows_of(rows["_v"].to_numpy(float), share / share.sum(), split, [n] if n is not None else sizes_of(int(totals.sum())), name, block)
        out = [{"_g": name, "_b": block, "n": size, "_chunk": chunk, **{r: pickle.dumps(s) for r, s in states.items()}} for size, chunk, _, states in found]
        return pd.DataFrame(out, columns=["_g", "_b", "n", "_chunk", *reductions])

    def of_chunk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, merged = rows.sort_values("_b"), {}
        for name, r in reductions.items():
            for other in map(pickle.loads, rows[name]):
                merged[name] = other if name not in merged else [r.merge(a, b) for a, b in zip(merged[name], other, strict=True)]
        return pd.DataFrame([{"_g": rows["_g"].iloc[0], "n": rows["n"].iloc[0], "_many": min(DRAWS, draws - DRAWS * int(rows["_chunk"].iloc[0])), **figures_of({r: np.array([reductions[r].finish(s) for s in held], float) for r, held in merged.items()})}])

    alone = _held_whole(asked.where(F.size("_totals") == 1))
    schema = f"_g {kind}, n int, _many int, " + ", ".join(figures)
    of_blocks = asked.where(F.size("_totals") > 1).groupBy("_g", "_b").applyInPandas(of_block, f"_g {kind}, _b int, n int, _chunk int, " + ", ".join(names))
    parts = of_blocks.groupBy("_g", "n", "_chunk").applyInPandas(of_chunk, schema).unionByName(alone.mapInPandas(of_groups, schema))
    whole = Window.partitionBy("_g", "n")
    mean = lambda r: F.sum(F.col(f"{r}_mean") * F.col("_many")) / F.sum("_many")
    for r in reductions:  # the variance of all draws, from that inside chunks and that between them
        held = F.sum(F.col(f"{r}_mean") * F.col("_many")).over(whole) / F.sum("_many").over(whole)
        parts = parts.withColumn(f"{r}_all", F.col(f"{r}_var") + F.pow(F.col(f"{r}_mean") - held, F.lit(2)))
    spread = lambda r: F.sqrt(F.sum(F.col(f"{r}_all") * F.col("_many")) / F.sum("_many"))
    told = [x for r in reductions for x in (mean(r).alias(f"{r}_mean"), spread(r).alias(f"{r}_std"))]
    return parts.groupBy("_g", "n").agg(*told).withColumnRenamed("_g", group)
