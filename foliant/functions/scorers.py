"""Scorers that callers plug in."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[str, str, str, str], float]


def exact_match(prediction: Column, gold: Column) -> Column:
    """The default: 1 where both are equal after trim and lower case, else -1."""
    return F.when(F.trim(F.lower(prediction)) == F.trim(F.lower(gold)), 1.0).otherwise(-1.0)


def load_scorer(path: str, name: str = "compute_score") -> Scorer:
    """A function of (data_source, solution_str, ground_truth, extra_info) from a file."""
    spec = importlib.util.spec_from_file_location("foliant_scorer", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)


def scorer_column(scorer: Scorer, on_error: float | None = 0.0):
    """A pandas UDF of four columns giving (score, error). A failure scores on_error; None raises it."""

    @F.pandas_udf("score double, error string")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            rows = []
            for args in zip(*columns, strict=True):
                try:
                    rows.append((float(scorer(*args)), None))
                except Exception as e:
                    if on_error is None:
                        raise
                    rows.append((on_error, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["score", "error"])

    return scored


def supported_match(prediction: Column, gold: Column, facts: Column, gold_facts: Column) -> Column:
    """(correct, support, support_gold): the answer is right; stands in a cited fact; stands in a cited fact of a gold page."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    holds = lambda fs: F.exists(fs, lambda f: F.contains(plain(f), plain(prediction))) & (plain(prediction) != "")
    return F.struct((plain(prediction) == plain(gold)).alias("correct"), holds(facts).alias("support"), holds(gold_facts).alias("support_gold"))


#: U4: reductions by name, column to column.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "median": F.median}


def reduce_groups(df: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """U4: the named reductions of value per group."""
    return df.groupBy(*keys).agg(*(REDUCTIONS[n](F.col(value)).alias(n) for n in names))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """Df with a vector per text by the caller's batch function."""
    fields = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                piece = part.iloc[i : i + batch]
                yield piece.assign(vector=model(piece[text].tolist()))

    return df.mapInPandas(run, fields)
