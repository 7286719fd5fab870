"""Incremental judging with Structured Streaming.

The contract of the file source holds here: producers close a file before it shows up. Files that grow in place are
`tail`, latest rows by key are `latest`, and state with timers is `keepers`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.memory import MEMORY, Memory, folded, memory_rows

from .keepers import keep_in_rocksdb, release_when_due


def stream_predictions(spark: SparkSession, root: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Rows of new JSON files under root, with their file; a broken line becomes a row with `bad`."""
    reader = spark.readStream.schema(f"{schema}, bad string").option("columnNameOfCorruptRecord", "bad").option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(root).withColumn("file", F.col("_metadata.file_path"))


def score_rows(rows: DataFrame, score: Column, verdict: str = "verdict", error: str = "judge_error") -> DataFrame:
    """Rows with a verdict or an error pass through, bad ones become errors, the rest are scored."""
    bad = F.col("bad").isNotNull()
    ready = F.col(verdict).isNotNull() | F.col(error).isNotNull()
    said = F.when(bad, F.concat(F.lit("bad row: "), F.substring("bad", 1, 200))).otherwise(F.col(error))
    return rows.withColumns({error: said, verdict: F.when(bad | ready, F.col(verdict)).otherwise(score)})


def stream_totals(rows: DataFrame, source: str, verdict: str) -> DataFrame:
    """Running totals by source, for the complete output mode."""
    return rows.groupBy(source).agg(F.count("*").alias("seen"), F.count(verdict).alias("judged"), F.sum(F.col(verdict).cast("int")).alias("correct"))


def commit_scored(stream: DataFrame, path: str, checkpoint: str, key: str, score: Column, within: tuple[str, str] | None = None) -> StreamingQuery:
    """Every key is scored and committed once, under path/batch=<number>; which keys are done is the stream's own state.

    Nothing that is committed is read again, and a micro-batch that is repeated after a failure writes the same folder.
    The state keeps each key for good, or, with a time column and a delay ("10 minutes"), for that long after it was seen.
    """

    def commit(batch: DataFrame, number: int) -> None:
        score_rows(batch, score).write.mode("overwrite").parquet(f"{path}/batch={number}")

    first = stream.dropDuplicates([key]) if within is None else stream.withWatermark(*within).dropDuplicatesWithinWatermark([key])
    return first.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(rows: DataFrame, sidecar: DataFrame, key: str, verdict: str, most: int) -> DataFrame:
    """Samples without a verdict whose attempts are below the limit."""
    tried = sidecar.groupBy(key).agg(F.count("*").alias("_n"), F.count(verdict).alias("_v"))
    left = rows.where(F.col(verdict).isNull()).join(tried, key, "left")
    return left.where((F.coalesce("_n", F.lit(0)) < most) & (F.coalesce("_v", F.lit(0)) == 0)).drop("_n", "_v")


def attempts_stream(attempts: DataFrame, key: str, verdict: str, most: int) -> DataFrame:
    """X4 as a stream: per key its attempts so far and whether it is open, done or given up."""
    kind = dict(attempts.dtypes)[key]

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, done = state.get if state.exists else (0, False)
        for batch in batches:
            n, done = n + len(batch), bool(done or batch[verdict].notna().any())
        state.update((int(n), done))
        yield pd.DataFrame({key: [group[0]], "attempts": [n], "status": ["done" if done else "given up" if n >= most else "open"]})

    return attempts.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, attempts int, status string", "n int, done boolean", "update", GroupStateTimeout.NoTimeout)


def should_score(n_pending: int, batch_size: int, every_poll: bool, seen: int, expected: int | None) -> bool:
    """Enough pending, or on every poll, or everything is in."""
    return n_pending > 0 and (n_pending >= batch_size or every_poll or (expected is not None and seen >= expected))


def _committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is at path, or an empty table where nothing is yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def score_when_due(
    stream: DataFrame, path: str, checkpoint: str, key: str, score: Column, batch_size: int, every_poll: bool = False, expected: int | None = None, source: str | None = None,
) -> StreamingQuery:
    """Rows wait until they are due, and are then scored into path/scored.

    Without a source column all rows are one source, whose waiting rows are tables under path/waiting (`_release_one_source`). With
    one they wait in the stream's state (`keepers.release_when_due`), and expected is for each source.
    """
    keep_in_rocksdb(stream.sparkSession)
    first = stream.dropDuplicates([key])

    def commit(batch: DataFrame, number: int) -> None:
        score_rows(batch, score).select(*stream.columns).write.mode("overwrite").parquet(f"{path}/scored/poll={number}")

    if source is None:
        due = first
        step = lambda batch, number: _release_one_source(batch, number, path, key, batch_size, every_poll, expected, commit)
    else:
        marked = first.withColumns({"due_source": F.col(source).cast("string"), "due_expected": F.lit(expected).cast("long")})
        due = release_when_due(marked, "due_source", key, batch_size, "due_expected", every_poll).drop("due_source", "batch")
        step = commit
    return due.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _release_one_source(batch: DataFrame, number: int, path: str, key: str, batch_size: int, every_poll: bool, expected: int | None, commit: Callable[[DataFrame, int], None]) -> None:
    """A poll's rows become a table under path/waiting; the first waiting rows, by poll and key, or all of them are committed if they are due.

    One small row a poll says how many rows were seen and wait, in which poll's table the waiting ones begin, how many of that are gone and
    the last one's key. A poll that brings nothing releases nothing. Polls that are repeated start from the row of the poll before.
    """
    spark = batch.sparkSession
    shape = T.StructType([*T.StructType.fromDDL("poll long, seen long, waiting long, head long, gone long").fields, T.StructField("last", batch.schema[key].dataType)])
    table = lambda poll: f"{path}/waiting/poll={poll}"
    was = _committed(spark, f"{path}/progress", shape).select(*shape.names).where(F.col("poll") < number).orderBy(F.desc("poll")).first()
    seen, waiting, head, gone, last = tuple(was)[1:] if was else (0, 0, number, 0, None)
    batch.write.mode("overwrite").parquet(table(number))
    held = lambda poll: spark.read.schema(batch.schema).parquet(table(poll))
    fresh = held(number).count()
    seen, waiting = seen + fresh, waiting + fresh

    def left(poll: int) -> DataFrame:
        if poll > head or not gone:
            return held(poll)
        return held(poll).where(F.col(key) > last if last is not None else F.col(key).isNotNull())  # keys are distinct, a null one comes first

    polls = range(head, number + 1)
    if fresh and (every_poll or (expected is not None and seen >= expected)):
        rows = left(head)
        later = spark.read.schema(batch.schema).parquet(*map(table, polls[1:])) if len(polls) > 1 else None
        commit(rows if later is None else rows.unionByName(later), number)
        waiting, head, gone, last = 0, number + 1, 0, None
    elif fresh and waiting >= batch_size:
        wanted, taken = batch_size, []
        for poll in polls:
            rows = left(poll).orderBy(key).limit(wanted)
            n, top = rows.agg(F.count("*"), F.max(key)).first()
            gone, last, head = (gone if poll == head else 0) + n, top if n else last if poll == head else None, poll
            taken.append(rows)
            wanted -= n
            if not wanted:
                break
        commit(reduce(DataFrame.unionByName, taken), number)
        waiting -= batch_size
    spark.createDataFrame([(number, seen, waiting, head, gone, last)], shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/at={number}")


def missing_count(snapshot: DataFrame, key: str, expected: int) -> DataFrame:
    """One row: unique_ids, expected, missing."""
    unique = F.count_distinct(key)
    return snapshot.agg(unique.alias("unique_ids"), F.lit(expected).cast("long").alias("expected"), F.greatest(F.lit(0).cast("long"), F.lit(expected) - unique).alias("missing"))


def commit_until(stream: DataFrame, path: str, checkpoint: str, order: str, kept: Column, fatal: Column, target: int) -> StreamingQuery:
    """Rows are committed in order up to the target-th kept one or the first fatal one, that one included; what comes
    later is left alone. Files must come in order; a restart skips what is committed.
    """
    spark = stream.sparkSession
    shape = T.StructType.fromDDL(f"seq long, kept long, fatal long, last {dict(stream.dtypes)[order]}")

    def commit(batch: DataFrame, _: int) -> None:
        # one small row a commit says how far it came, so nothing that is committed is read again
        progress = _committed(spark, f"{path}/_progress", shape)
        seq, n_kept, n_fatal, last = progress.agg(F.max("seq"), F.max("kept"), F.max("fatal"), F.max("last")).first()
        n_kept, seq = n_kept or 0, 0 if seq is None else seq + 1
        if n_kept >= target or n_fatal:
            return
        fresh = batch if last is None else batch.where(F.col(order) > last)
        stops = [fresh.where(fatal).agg(F.min(order)).first()[0]]
        nth = fresh.where(kept).select(order).orderBy(order).limit(target - n_kept).agg(F.count("*"), F.max(order)).first()
        stops += [nth[1]] if nth[0] == target - n_kept else []
        stop = min((x for x in stops if x is not None), default=None)
        (fresh if stop is None else fresh.where(F.col(order) <= stop)).write.mode("overwrite").parquet(f"{path}/seq={seq}")
        counts = spark.read.schema(batch.schema).parquet(f"{path}/seq={seq}").agg(F.count(F.when(kept, 1)), F.count(F.when(fatal, 1)), F.max(order)).first()
        row = (seq, n_kept + counts[0], counts[1], last if counts[2] is None else counts[2])
        spark.createDataFrame([row], shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/_progress/commit={seq}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_until(step: Callable[[], Any], enough: Callable[[], bool], rounds: int = 1000) -> int:
    """Rounds of a committed step until a check over what is committed says stop; gives the rounds taken."""
    for n in range(rounds):
        if enough():
            return n
        step()
    return rounds


def stream_memory(turns: DataFrame, sample: str, turn: str, timeout_ms: int | None = None) -> DataFrame:
    """Memories of samples whose turns arrive interleaved; one row when a sample ends, by an answer or an error (op
    "answer" or "error"), with what ended it.

    Turns of a sample arrive in order over micro-batches. With a timeout, a sample without turns for so long is given up.
    The state is JSON, so that it outlives changes of this code.
    """
    kind = dict(turns.dtypes)[sample]

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        nodes, facts, errors = json.loads(state.get[0]) if state.exists else (None, {}, [])
        memory, more, ended = memory_rows(batches, Memory(nodes, facts) if nodes else Memory(), turn)
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame([{sample: group[0], **folded(memory, errors + more), "ended": ended}])
        else:
            state.update((json.dumps((memory.nodes, memory.facts, errors + more)),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return turns.groupBy(sample).applyInPandasWithState(fold, f"{sample} {kind}, {MEMORY}, ended string", "held string", "append", wait)
