"""Files, streams and literal label cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import labels, scorers
from foliant.operators import evaluate, joins, retrieve
from foliant.sources import io
from foliant.streaming import jobs
from foliant.streaming.latest import LatestTable, latest_rows


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_labels(spark):
    for label, want in (("d1/page_03", ("d1", 3)), ("d1/page_3", ("d1", 3)), ("page_03", ("", 3)), ("d1/cover", None)):
        got = one(spark, labels.page_key(F.col("v")), v=label)
        assert (tuple(got) if got else None) == want
    for w, h, grid, want in ((1024, 768, 28, (728, 532)), (800, 600, 28, (728, 532)), (300, 120, 28, (728, 308)), (728, 532, 28, (728, 532)), (800, 600, 32, (704, 544))):
        assert tuple(one(spark, labels.shown_size(F.col("w"), F.col("h"), grid), w=w, h=h)) == want
    box = lambda *v, m=False: one(spark, labels.unit_box(F.array(*map(F.lit, v)), F.lit(728), F.lit(532), m))
    assert box(0, 0, 500, 1000, m=True) == [0, 0, 0.5, 1] and box(10, 10, 16, 50, m=True)[2] == 0.016
    assert not any((box(100, 100, 50, 200), box(800, 0, 900, 10), box(10, 10, 13, 50), box(10, 10, 15, 50, m=True)))
    assert one(spark, labels.extract_final_answer(F.col("v")), v="a Answer: x Final answer: b Answer: `42`") == "42"
    assert one(spark, labels.crop_region(F.array(*map(F.lit, (100.0, 100.0, 200.0, 200.0))), F.lit(1000), F.lit(500))) == [72, 72, 228, 228]
    assert one(spark, labels.crop_region(F.array(*map(F.lit, (0.5, 480.2, 50.0, 500.0))), F.lit(1000), F.lit(500))) == [0, 452, 78, 500]
    assert one(spark, labels.unit_box(F.array(*map(F.lit, (-10, 0, 364, 532))), F.lit(728), F.lit(532))) == [0, 0, 0.5, 1]
    with pytest.raises(Exception, match="unknown image kind"):
        one(spark, labels.image_ext(F.col("v")), v=bytearray(b"GIF89a"))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "a"}\n\n{"id": "b"}\n{"id": "c", ')
    good, bad = io.read_jsonl_lenient(spark, str(path), "id string")
    assert sorted(r.id for r in good.collect()) == ["a", "b"] and [r.line for r in bad.collect()] == ['{"id": "c", ']
    path.write_text("\n".join([*(json.dumps({"id": str(i)}) for i in range(5)), "", json.dumps({"id": "6"})]) + "\n")
    assert [r.id for r in io.read_jsonl(spark, str(path), "id string", start=3, limit=3).orderBy("id").collect()] == ["3", "4", "6"]


def test_page_files(spark, tmp_path):
    for name, data in (("x/abc_1.jpg", b"\xff\xd8\xff1"), ("x/abc_2.JPG", b"\xff\xd8\xff2"), ("y/n.txt", b"n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = io.scan_page_files(spark, str(tmp_path))
    assert sorted(r.label for r in files.collect()) == ["x/abc_1", "x/abc_2"]
    parsed = io.parse_page_files(files, "path", r"^([a-z]+)_(\d+)\.(?:jpg|JPG)$", 0)
    assert sorted(r.label for r in parsed.collect()) == ["abc/page_02", "abc/page_03"]
    with pytest.raises(Exception, match="not a page file"):
        io.parse_page_files(files, "path", r"^(\d+)_(\d+)\.jpg$", 1).collect()
    listed = io.manifest(spark, str(tmp_path)).cache()
    assert {r.path: r.sha256 for r in listed.collect()}["y/n.txt"] == hashlib.sha256(b"n").hexdigest()
    off = listed.withColumn("bytes", F.when(F.col("path").like("%_1%"), 99).otherwise(F.col("bytes"))).where("path NOT LIKE 'y%'")
    off = off.withColumn("sha256", F.when(F.col("path").like("%_2%"), "no").otherwise(F.col("sha256")))
    assert {r.path: r.error for r in io.verify_manifest(listed, off).collect()} == {"x/abc_1.jpg": "size", "x/abc_2.JPG": "sha256", "y/n.txt": "missing"}


def test_tasks_list_the_lower_folders(spark, tmp_path, monkeypatch):
    names = {f"a{i}/b{i % 3}/c/{i}.txt" for i in range(90)} | {"top.txt", "a1/up.txt", "a1/x.log", "_tmp/no.txt", "a2/.no.txt", "_k=1/yes.txt", "a3/b0/c/d/e/f.txt"}
    io.put_files(spark.createDataFrame([(n, "x" * (1 + i % 5)) for i, n in enumerate(sorted(names))], "path string, value string"), str(tmp_path))
    sizes = {n: 1 + i % 5 for i, n in enumerate(sorted(names))}
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path)).select("path", "length", "modificationTime")
    driver_lists = []
    real = io.pafs.FileSelector
    monkeypatch.setattr(io.pafs, "FileSelector", lambda *a, **k: driver_lists.append(a) or real(*a, **k))
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        got = io.list_files(spark, root, "*.txt").collect()
        assert sorted((r.path, r.length) for r in got) == sorted((r.path, r.length) for r in whole.collect())
        assert all(abs((r.modificationTime - w.modificationTime).total_seconds()) < 0.001 for r, w in zip(sorted(got), sorted(whole.collect()), strict=True))
    assert len(driver_lists) == 3 and len(got) == len([n for n in names if n.endswith("txt") and "/." not in n and "_tmp" not in n])
    assert all(sizes[r.path.removeprefix(f"file:{tmp_path}/")] == r.length for r in got)
    (tmp_path / "a1/empty.txt").write_text("")
    assert [r.path[-9:] for r in io.list_files(spark, str(tmp_path), "*.txt").where("length = 0").collect()] == ["empty.txt"]
    with pytest.raises(FileNotFoundError):
        io.list_files(spark, str(tmp_path / "none"))


def test_unpivot_and_entries(spark, tmp_path):
    raw = spark.sql("SELECT 'd' AS deck, named_struct('bytes', X'01') AS page_1, CAST(NULL AS STRUCT<bytes: BINARY>) AS page_2, named_struct('bytes', X'03') AS page_3 UNION ALL SELECT 'd', named_struct('bytes', X'01'), NULL, NULL")
    assert sorted((r.deck, r.page) for r in io.unpivot_pages(raw, "deck").collect()) == [("d", 1), ("d", 3)]
    (tmp_path / "e.jsonl").write_text('"a/b/page_1.png"\n{"image_path": "c/d.jpg", "page_label": "L"}\n')
    assert sorted((r.image_path, r.page_label) for r in io.read_index_entries(spark, str(tmp_path / "e.jsonl")).collect()) == [("a/b/page_1.png", "page_1"), ("c/d.jpg", "L")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, v int")
    assert io.append_new(df, str(tmp_path / "t")).count() == 2
    assert io.append_new(df.union(spark.createDataFrame([("c", 3)], df.schema)), str(tmp_path / "t")).count() == 3
    assert io.write_verified(df, str(tmp_path / "w"), df.schema, "sample_id").count() == 2
    with pytest.raises(ValueError, match="twice"):
        io.write_verified(df.union(df), str(tmp_path / "w2"), df.schema, "sample_id")
    assert io.write_verified(df, str(tmp_path / "w3"), df.schema, "sample_id", ["v"]).count() == 2
    df.orderBy("v").coalesce(1).write.parquet(str(tmp_path / "w4"))
    with pytest.raises(ValueError, match="order"):
        io.verify_order(spark.read.parquet(str(tmp_path / "w4")).select("sample_id", "v", "_metadata").withColumn("v", -F.col("v")), ["v"])
    io.fanout(df, {"all": F.lit(True), "big": F.col("v") > 1}, str(tmp_path / "f"))
    assert {(r.outcome, r["count"]) for r in spark.read.parquet(str(tmp_path / "f")).groupBy("outcome").count().collect()} == {("all", 2), ("big", 1)}
    io.dump_generations(df.withColumn("step", F.col("v")), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).where("step = 2").count() == 1
    io.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 2
    for run in ("r1", "r2", "merged_x"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "predictions.jsonl").write_text("{}\n")
    runs = io.discover_runs(spark, str(tmp_path / "runs")).collect()
    assert len(runs) == 2 and sum(r.newest for r in runs) == 1


def test_streams(spark, tmp_path):
    schema = "sample_id string, t int, verdict boolean, judge_error string, answer string"
    src = tmp_path / "in"
    src.mkdir()
    put = lambda name, *rows: (src / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    put("1.json", {"sample_id": "a", "t": 1, "answer": "x"}, {"sample_id": "b", "t": 1, "verdict": False}, "{broken")
    score = scorers.exact_match(F.col("answer"), F.lit("x")) == 1

    def run():
        jobs.commit_scored(jobs.stream_predictions(spark, str(src), schema), str(tmp_path / "out"), str(tmp_path / "cp"), "sample_id", score).awaitTermination()
        return {r.sample_id: (r.verdict, (r.judge_error or "")[:7]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = run()
    assert first["a"] == (True, "") and first["b"] == (False, "") and first[None] == (None, "bad row")
    put("2.json", {"sample_id": "a", "t": 2, "answer": "y"}, {"sample_id": "c", "t": 1, "answer": "y"})
    second = run()
    assert second["a"] == (True, "") and second["c"] == (False, "") and len(second) == 4

    stream = jobs.stream_predictions(spark, str(src), schema).where("bad IS NULL").select("sample_id", "t", "verdict", F.col("t").alias("ord"))
    table = LatestTable(spark, str(tmp_path / "snap"), "sample_id string, t int, verdict boolean, ord int", "sample_id", "t", "ord")
    latest_rows(stream, table, str(tmp_path / "cp2")).awaitTermination()
    assert {r.sample_id: r.t for r in table.read().collect()} == {"a": 2, "b": 1, "c": 1}

    totals = jobs.stream_totals(jobs.stream_predictions(spark, str(src), schema), "t", "verdict")
    totals.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.t: (r.seen, r.judged) for r in spark.table("totals").collect()} == {1: (3, 1), 2: (1, 0), None: (1, 0)}

    tries = jobs.attempts_stream(jobs.stream_predictions(spark, str(src), schema, 1).where("sample_id IS NOT NULL"), "sample_id", "verdict", 2)
    tries.writeStream.format("memory").queryName("tries").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = {r.sample_id: r.status for r in spark.table("tries").orderBy("attempts").collect()}
    assert last == {"a": "given up", "b": "done", "c": "open"}


def test_stream_memory(spark, tmp_path):
    from tests.test_memory import TURN, turn

    for i, rows in enumerate(([turn(1, 1, "P1", ["x"]), turn(2, 1, "P1", ["y"])], [turn(1, 2, op="resolve", answer="42", pages=["P1"])], [turn(1, 3, op="answer", answer="42")])):
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        spark.range(1).count()
        assert i >= 0
    stream = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    jobs.stream_memory(stream, "sample", "turn").writeStream.format("memory").queryName("mem").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("mem").collect()
    assert [(r.sample, r.nodes[0].answer, r.nodes[0].pages) for r in rows] == [(1, "42", ["P1"])]


def test_pending_and_triggers(spark):
    rows = spark.createDataFrame([("a", None), ("b", True), ("c", None)], "k string, v boolean")
    side = spark.createDataFrame([("a", None), ("a", None), ("c", None)], "k string, v boolean")
    assert [r.k for r in jobs.pending(rows, side, "k", "v", 2).collect()] == ["c"]
    assert jobs.should_score(3, 3, False, 3, None) and not jobs.should_score(2, 3, False, 2, 9) and jobs.should_score(2, 3, False, 9, 9) and not jobs.should_score(0, 1, True, 1, 1)
    n = []
    assert jobs.run_until(lambda: n.append(1), lambda: len(n) >= 4) == 4


def test_scoring_waits_until_it_is_due(spark, tmp_path):
    schema = "sample_id int, verdict boolean, judge_error string, bad string, answer string"
    done = lambda: sorted(r.sample_id for r in spark.read.schema(schema).parquet(str(tmp_path / "out/scored")).collect()) if (tmp_path / "out/scored").exists() else []
    for step, (ids, want) in enumerate([([1, 2], []), ([3, 4], [1, 2, 3]), ([5], [1, 2, 3]), ([6], [1, 2, 3, 4, 5, 6])]):
        spark.createDataFrame([(i, None, None, None, "x") for i in ids], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{step}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        jobs.score_when_due(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "sample_id", F.col("answer") == "x", 3, expected=6).awaitTermination()
        assert done() == want


def test_waiting_rows_of_one_source_are_tables(spark, tmp_path):
    schema = "sample_id int, verdict boolean, judge_error string, bad string, answer string"
    released, polls = {}, [([9, 8, None], []), ([1], [[None, 8]]), ([3, 2, 9], [[9, 1]]), ([4], [[2, 3]]), ([6, 5], [[4, 5]]), ([7], [[6, 7]])]
    for step, (ids, want) in enumerate(polls):
        spark.createDataFrame([(i, None, None, None, "x") for i in ids], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{step}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        size, expected = (4, None) if step == 0 else (2, None)  # the first poll has too few
        jobs.score_when_due(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "sample_id", F.col("answer") == "x", size, expected=expected).awaitTermination()
        found = {d.name: sorted((r.sample_id for r in spark.read.schema(schema).parquet(str(d)).collect()), key=lambda x: (x is not None, x)) for d in (tmp_path / "out/scored").glob("poll=*")}
        assert [sorted(v, key=lambda x: (x is not None, x)) for k, v in found.items() if k not in released] == [sorted(w, key=lambda x: (x is not None, x)) for w in want]
        released |= found
    assert len(list((tmp_path / "out/waiting").iterdir())) == len(polls)  # state holds keys only


def test_committing_stops(spark, tmp_path):
    for name, fatal_at, target, want in (("kept", None, 4, 8), ("fatal", 5, 4, 5), ("never", None, 99, 19)):
        for step in range(2):
            rows = [(i, i % 2 == 0, i == fatal_at) for i in range(10 * step + (not step), 10 * step + 10)]
            spark.createDataFrame(rows, "i int, kept boolean, fatal boolean").write.parquet(str(tmp_path / f"{name}/in{step}"))
            stream = spark.readStream.schema("i int, kept boolean, fatal boolean").parquet(str(tmp_path / f"{name}/in{step}"))
            jobs.commit_until(stream, str(tmp_path / f"{name}/out"), str(tmp_path / f"{name}/cp{step}"), "i", F.col("kept"), F.col("fatal"), target).awaitTermination()
        assert [r.i for r in spark.read.parquet(str(tmp_path / f"{name}/out")).orderBy("i").collect()] == list(range(1, want + 1))


def test_snapshots_keep_rows_without_a_key(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "snap"), "k string, t int, o string", "k", "t", "o")
    for step, rows in enumerate([[("a", 1), ("b", 1), (None, 1)], [("a", 3)], [("a", 2), ("c", 1), (None, 2)]]):
        spark.createDataFrame(rows, "k string, t int").coalesce(1).write.parquet(str(tmp_path / f"in/{step}"))
        stream = spark.readStream.schema("k string, t int").parquet(str(tmp_path / "in/*")).withColumn("o", F.concat("t", F.lit("-"), F.coalesce("k", F.lit("none"))))
        latest_rows(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.t) for r in table.read().collect()) == [("__missing_1-none", 1), ("__missing_2-none", 2), ("a", 3), ("b", 1), ("c", 1)]

def test_retrieval_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(retrieve, "BLOCK_NUMBERS", 40)
    monkeypatch.setattr(retrieve, "MAX_BROADCAST_BYTES", 200)
    rnd = random.Random(7)
    rows = [(f"p{i % 37}", [rnd.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(60)]
    pages = spark.createDataFrame([*rows, ("null", None), ("other", [1.0])], "label string, v array<double>")
    queries = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows[:9])], "query int, qv array<double>")
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    want = set()
    for i, (_, q) in enumerate(rows[:9]):
        best = sorted((-round(sum(a * b for a, b in zip(unit(q), unit(v), strict=True)), 6) + 0.0, label) for label, v in rows)[:5]
        want |= {(i, label, -s + 0.0, r + 1) for r, (s, label) in enumerate(best)}
    got = {(r.query, r.label, r.score + 0.0, r["rank"]) for r in retrieve.dense_topk(queries, pages, 5).collect()}
    assert got == want
    assert retrieve.score_pairs(queries.drop("qv"), pages.select("label")).count() == 9 * 62


def test_maxsim_both_forms(spark):
    import random

    rnd = random.Random(3)
    vec = lambda n: [[rnd.uniform(-1, 1) for _ in range(8)] for _ in range(n)]
    pages = [(i, vec(n)) for i, n in enumerate((3, 9, 5, 1, 7))]
    q = vec(4)
    want = {i: round(sum(max(sum(a * b for a, b in zip(x, y, strict=True)) for y in v) for x in q), 6) for i, v in pages}
    array = retrieve.maxsim_topk(spark.createDataFrame([(0, q)], "query int, qv array<array<double>>"), spark.createDataFrame(pages, "label int, v array<array<double>>"), 5)
    assert {r.label: r.score for r in array.collect()} == want
    tokens = [(i, t, x) for i, v in pages for t, x in enumerate(v)]
    long = retrieve.maxsim_long(spark.createDataFrame([(0, t, x) for t, x in enumerate(q)], "query int, qtok int, qv array<double>"), spark.createDataFrame(tokens, "label int, tok int, v array<double>"))
    assert {r.label: r.score for r in long.collect()} == pytest.approx(want, abs=2e-6)
    with pytest.raises(ValueError, match="deck"):
        retrieve.maxsim_topk(spark.createDataFrame([(0, q, "z")], "query int, qv array<array<double>>, deck string"), spark.createDataFrame([(0, q, "y")], "label int, v array<array<double>>, deck string"), 5, ["deck"])


def test_accuracy_and_coverage(spark):
    preds = spark.createDataFrame([("single", True), ("single", False), ("multi", True), ("multi", None), (None, True)], "hop string, ok boolean")
    assert {r.hop: (r.judged, r.correct, r.accuracy) for r in evaluate.accuracy_by(preds, "hop", "ok").collect()} == {"single": (2, 1, 0.5), "multi": (1, 1, 1.0), "None": (1, 1, 1.0)}
    pairs = spark.createDataFrame([(["d1/page_01"], ["d1/page_1", "d2/page_04"]), (["d1/page_02"], ["d9/page_02"])], "g array<string>, f array<string>")
    assert [(r.covered, r.non_gold) for r in joins.evidence_overlap(pairs, "g", "f").collect()] == [(True, 1), (False, 1)]


def test_terminal_rewards(spark):
    from foliant.operators.rollouts import terminal_reward

    w = {"coverage": 0.5, "full": 0.0, "precision": 0.2, "cost": 0.1, "max_turns": 8.0}
    reward = lambda hit, gold, final, steps: one(spark, terminal_reward(F.lit(True), F.lit(hit), F.lit(gold), F.lit(final), F.lit(0.0), F.lit(steps), F.lit(0), F.lit(True), w), v=1)
    assert reward(1, 1, 1, 1) == pytest.approx(1.7 - 0.1 / 8) and reward(2, 2, 2, 2) == pytest.approx(1.7 - 0.2 / 8) and reward(1, 2, 2, 2) == pytest.approx(1.25 - 0.2 / 8)
