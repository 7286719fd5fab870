"""Growing files, log-structured snapshots, waiting rows and memories with timers."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.streaming import keepers, tail
from foliant.streaming.latest import LatestTable


def test_growing_files(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "s").mkdir(parents=True)

    def rows():
        stream = tail.tail_predictions(spark, str(root), "id int")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((os.path.basename(r.file), r.line, r.id, r.bad) for r in spark.read.parquet(out).collect())

    (root / "a.jsonl").write_text('{"id":1}\n{"id":2}\n{"id"')
    (root / "s/b.jsonl").write_text('{"id":10}\nxx\n\n{"id":11}\n')
    (root / "none.jsonl").write_text('{"id":5')
    (root / "other.txt").write_text('{"id":6}\n')
    first = [("a.jsonl", 0, 1, None), ("a.jsonl", 1, 2, None), ("b.jsonl", 0, 10, None), ("b.jsonl", 1, None, "xx"), ("b.jsonl", 3, 11, None)]
    assert rows() == first
    with (root / "a.jsonl").open("a") as f:
        f.write(':3}\n{"id":4}\n')
    (root / "s/b.jsonl").write_text('{"id":20}\n')
    second = sorted([*first, ("a.jsonl", 2, 3, None), ("a.jsonl", 3, 4, None), ("b.jsonl", 0, 20, None)])
    assert rows() == second
    assert rows() == second  # a restart reads nothing twice


def test_ranges_end_with_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "PART", 100)
    monkeypatch.setattr(tail, "READ", 64)
    lines = [f"line {i} " + "x" * (i % 37) for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\ntorn")
    reader = tail.TailReader(str(tmp_path), ".jsonl")
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    read = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(parts) > 20 and [r["value"] for r in read] == lines and [r["line"] for r in read] == list(range(200))
    assert reader.partitions(end, reader.latestOffset()) == []


def test_small_files_share_tasks(tmp_path):
    for i in range(3000):
        (tmp_path / f"{i}.jsonl").write_text(f"{i}\n" if i % 3 else f"{i}\nx\ntorn")
    reader = tail.TailReader(str(tmp_path), ".jsonl")
    start = reader.latestOffset()
    parts = reader.partitions({}, start)
    assert len(parts) <= 4
    read = sorted((os.path.basename(r["file"]), r["line"], r["value"]) for p in parts for batch in reader.read(p) for r in batch.to_pylist())
    assert read == sorted((f"{i}.jsonl", n, x) for i in range(3000) for n, x in enumerate([str(i)] if i % 3 else [str(i), "x"]))
    with (tmp_path / "0.jsonl").open("a") as f:
        f.write(" no more\n")
    whole = {str(tmp_path / k): v for k, v in start.items()}  # offsets that name whole paths
    for known in (start, whole):
        parts = reader.partitions(known, reader.latestOffset())
        assert [(r["line"], r["value"]) for p in parts for batch in reader.read(p) for r in batch.to_pylist()] == [(2, "torn no more")]


def size(path):
    return sum(os.path.getsize(os.path.join(top, name)) for top, _, names in os.walk(path) for name in names)


def test_log_structured_snapshot(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path), "k string, t long, v long", "k", "t", "v", bucket_rows=300, share=0.5, waiting=60)
    want, rnd, now = {}, random.Random(1), 0
    for n, many in enumerate((900, 900, 10, 10, 600)):
        rows = []
        for _ in range(many):
            now += 1
            k, t = f"k{rnd.randrange(800)}", rnd.choice([now, now - 500])
            rows.append((k, t, now))
            want[k] = max(want.get(k, (t, now)), (t, now))
        for _ in range(1 + (n == 2)):  # a repeated micro-batch
            table.merge(spark.createDataFrame(rows, table.schema).coalesce(1), n)
        assert {r.k: (r.t, r.v) for r in table.read().collect()} == want and table.read().count() == len(want)
        if many == 10:  # what is written follows the batch, and nothing is compacted
            assert size(tmp_path / f"data/delta={n}") < size(tmp_path / "data/base=1") and not (tmp_path / f"data/base={n}").exists()
    state = table.manifest()
    assert state["depth"] >= 2 and len(state["buckets"]) == 1 << state["depth"]
    assert sorted(os.listdir(tmp_path / "manifest")) == ["version=3", "version=4"]
    named = {f for v in (4, 5) for b in table.manifest(before=v)["buckets"].values() for f, _ in b["files"]}
    assert set(os.listdir(tmp_path / "data")) == named
    table.merge(spark.createDataFrame([], table.schema), 5)
    assert table.read().count() == len(want)


def run(spark, tmp_path, frame, schema, make):
    spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_waiting_rows_survive_restarts(spark, tmp_path):
    keepers.keep_in_rocksdb(spark)
    schema = "id long, src string, total long"
    make = lambda s: keepers.release_when_due(s, "src", "id", 3, "total").select("id", "src", "batch")
    assert run(spark, tmp_path, [(1, "a", 6), (2, "a", 6), (3, "b", 2)], schema, make) == []
    second = [(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "a", 1), (6, "b", 1)]
    assert run(spark, tmp_path, [(4, "a", 6), (5, "a", 6), (6, "b", 2)], schema, make) == second
    assert run(spark, tmp_path, [(8, "a", 6), (7, "a", 6)], schema, make) == sorted([*second, (5, "a", 2), (7, "a", 2), (8, "a", 2)])


@pytest.mark.parametrize("kind", ["waiting", "memory"])
def test_timers(spark, tmp_path, kind):
    """What nothing more comes for is given up: rows are released, a memory ends with what it holds."""
    from tests.test_memory import TURN, turn

    keepers.keep_in_rocksdb(spark)
    if kind == "waiting":
        schema, rows = "id long, src string", [(1, "a"), (2, "a")]
        make = lambda s: keepers.release_when_due(s, "src", "id", 5, wait_ms=500).select("id", "src", "batch")
        want = {(1, "a", 1), (2, "a", 1)}
    else:
        schema, rows = TURN, [turn(1, 1, "P1", ["x", "y"])]
        make = lambda s: keepers.keep_memory(s, "sample", "turn", wait_ms=500).select("sample", F.size("facts"), "ended")
        want = {(1, 2, "abandoned")}
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    # a stream that waits for time to pass: an availableNow run with timers doesn't end
    stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(f"timers_{kind}").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table(f"timers_{kind}").count():
            time.sleep(0.5)
        assert {tuple(r) for r in spark.table(f"timers_{kind}").collect()} == want
    finally:
        query.stop()


def test_memory_in_state(spark, tmp_path):
    from tests.test_memory import TURN, turn

    keepers.keep_in_rocksdb(spark)
    make = lambda s: keepers.keep_memory(s, "sample", "turn").select("sample", F.size("nodes"), F.col("facts.text"), "errors", "ended")
    assert run(spark, tmp_path, [turn(1, 1, "P1", ["x"]), turn(2, 1, "P1", ["y"])], TURN, make) == []
    assert run(spark, tmp_path, [turn(1, 2, op="resolve", answer="42", pages=["P7"]), turn(1, 3, "P2", ["z"])], TURN, make) == []
    assert run(spark, tmp_path, [turn(1, 4, op="answer", answer="42"), turn(2, 2, op="error")], TURN, make) == [(1, 1, ["x", "z"], [2], "answer"), (2, 1, ["y"], [], "error")]
