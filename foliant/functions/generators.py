"""Row generators that a caller passes in: table functions over a partitioned and ordered table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def generated(df: DataFrame, generator: type, returns: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a generator over df: one instance for each value of `by` sees its rows in order (`eval`) and its end (`terminate`)."""
    return F.udtf(generator, returnType=returns)(df.asTable().partitionBy(*by).orderBy(*order))


def register_generator(df: DataFrame, name: str, generator: type, returns: str) -> None:
    """For SQL: SELECT * FROM name(TABLE(t) PARTITION BY a ORDER BY b)."""
    df.sparkSession.udtf.register(name, F.udtf(generator, returnType=returns))


RUNS = "traj long, action string, first long, steps long"


class ActionRuns:
    """Runs of one action in a row: traj, action, its first step, how many steps. Rows: traj, step, action."""

    def __init__(self):
        self.run: list | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.run and self.run[1] == row["action"]:
            self.run[3] += 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["traj"], row["action"], row["step"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)
