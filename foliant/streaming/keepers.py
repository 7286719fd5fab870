"""State kept by key across micro-batches (X5, X8): typed lists, maps and values in the state store, with timers and expiry.

Both need Spark's RocksDB state store; `keep_in_rocksdb` sets it for streams that are started after it. Streams with timers run
with a processing-time trigger: under availableNow, Spark goes on for the timers and doesn't end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.memory import MEMORY, Memory, folded, memory_rows


def keep_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Keeper(StatefulProcessor):
    """A timer that each arrival sets anew."""

    wait_ms: int | None

    def wait(self, timer_values) -> None:
        if self.wait_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.wait_ms)

    def no_timer(self) -> None:
        for timer in list(self.handle.listTimers()) if self.wait_ms else ():
            self.handle.deleteTimer(timer)


class MemoryKeeper(_Keeper):
    """One sample's memory: its tree as a list of nodes, its facts as a map by page, refused turns as a list."""

    def __init__(self, sample: str, turn: str, wait_ms: int | None, ttl_ms: int | None):
        self.sample, self.turn, self.wait_ms, self.ttl_ms = sample, turn, wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getListState("nodes", "id string, question string, status string, answer string, pages array<string>", self.ttl_ms)
        self.facts = handle.getMapState("facts", "page string", "facts array<struct<text: string, revision: int>>", self.ttl_ms)
        self.errors = handle.getListState("errors", "turn long", self.ttl_ms)

    def _held(self) -> tuple[Memory, list[int]]:
        if not self.nodes.exists():
            return Memory(), []
        facts = {k[0]: [[f[0], f[1]] for f in v[0]] for k, v in self.facts.iterator()} if self.facts.exists() else {}
        nodes = [[*n[:4], list(n[4])] for n in self.nodes.get()]
        return Memory(nodes, facts), [e[0] for e in self.errors.get()] if self.errors.exists() else []

    def _clear(self) -> None:
        for state in (self.nodes, self.facts, self.errors):
            state.clear()

    def _row(self, key: tuple, memory: Memory, errors: list[int], ended: str) -> pd.DataFrame:
        return pd.DataFrame([{self.sample: key[0], **folded(memory, errors), "ended": ended}])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, errors = self._held()
        before = dict(memory.facts)
        memory, more, ended = memory_rows(rows, memory, self.turn)
        if ended:
            self._clear()
            self.no_timer()
            yield self._row(key, memory, errors + more, ended)
            return
        self.nodes.put([tuple(n) for n in memory.nodes])
        for page, facts in memory.facts.items():
            if before.get(page) is not facts:
                self.facts.updateValue((page,), ([tuple(f) for f in facts],))
        if more:
            self.errors.appendList([(e,) for e in more])
        self.wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        memory, errors = self._held()
        self._clear()
        yield self._row(key, memory, errors, "abandoned")


def keep_memory(turns: DataFrame, sample: str, turn: str, wait_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Memories of samples whose turns arrive interleaved; one row when a sample ends, by an answer or an error (op "answer"
    or "error"), with what ended it. After wait_ms without turns a sample ends as "abandoned", with what it holds; after ttl_ms
    its state expires without a row. Turns of a sample arrive in order over micro-batches.
    """
    kind = dict(turns.dtypes)[sample]
    keeper = MemoryKeeper(sample, turn, wait_ms, ttl_ms)
    timed = "ProcessingTime" if wait_ms or ttl_ms else "None"
    return turns.groupBy(sample).transformWithStateInPandas(keeper, f"{sample} {kind}, {MEMORY}, ended string", "append", timed)


class DueKeeper(_Keeper):
    """Rows of one source that wait to be scored, how many were seen, how many batches were released."""

    def __init__(self, source: str, names: list[str], waiting: T.StructType, order: str, expected: str | None, batch_size: int, every_poll: bool, wait_ms: int | None):
        self.source, self.names, self.schema, self.order, self.expected = source, names, waiting, order, expected
        self.batch_size, self.every_poll, self.wait_ms = batch_size, every_poll, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.counts = handle.getValueState("counts", "seen long, batches long")

    def _released(self, key: tuple, held: pd.DataFrame, n: int, seen: int, batches: int) -> pd.DataFrame:
        out, rest = held.iloc[:n], held.iloc[n:]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([tuple(None if pd.isna(x) else x for x in r) for r in rest.astype(object).itertuples(index=False, name=None)])
        self.counts.update((seen, batches + bool(n)))
        return out.assign(**{self.source: key[0], "batch": batches + 1})[[self.source, *self.names, "batch"]]

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        seen, batches = self.counts.get() if self.counts.exists() else (0, 0)
        seen += len(fresh)
        held = pd.concat([pd.DataFrame(self._held(), columns=self.names, dtype=object), fresh[self.names].sort_values(self.order).astype(object)], ignore_index=True)
        whole = self.expected is not None and pd.notna(fresh[self.expected]).any() and seen >= int(fresh[self.expected].max())
        due = len(held) if whole or self.every_poll else self.batch_size if len(held) >= self.batch_size else 0
        out = self._released(key, held, due, int(seen), int(batches))
        if due < len(held):
            self.wait(timerValues)
        else:
            self.no_timer()
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(self._held(), columns=self.names, dtype=object)
        seen, batches = self.counts.get()
        if len(held):
            yield self._released(key, held, len(held), int(seen), int(batches))


def release_when_due(stream: DataFrame, source: str, order: str, batch_size: int, expected: str | None = None, every_poll: bool = False, wait_ms: int | None = None) -> DataFrame:
    """Rows wait in the stream's state, source by source. At a poll that brings rows of a source, its first batch_size waiting
    rows are released if there are so many; all of them on every poll if asked, once as many rows were seen as the column
    `expected` says, or after wait_ms without new ones. A row comes with the number of its `batch`. Nothing is read twice;
    a source holds less than batch_size rows and what one poll brings.
    """
    fields = [f for f in stream.schema.fields if f.name not in (source, expected)]
    keeper = DueKeeper(source, [f.name for f in fields], T.StructType(fields), order, expected, batch_size, every_poll, wait_ms)
    out = T.StructType([stream.schema[source], *fields, T.StructField("batch", T.LongType())])
    return stream.groupBy(source).transformWithStateInPandas(keeper, out, "append", "ProcessingTime" if wait_ms else "None")
