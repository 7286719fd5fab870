"""Whole jobs: results that must grow with the tables, on tables written here."""

import math

from pyspark.sql import functions as F

from foliant import plans
from foliant.operators import curate, rollouts


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_missing_ids_and_progress_follow_the_documents(spark, tmp_path):
    put(spark, tmp_path, "documents", [(i,) for i in range(3000)], "doc_id long")
    put(spark, tmp_path, "labels", [(i,) for i in range(0, 3000, 3)], "doc_id long")
    q = plans.queries()
    assert sorted(r.doc_id for r in q["j8_missing_ids"](spark, str(tmp_path)).collect()) == [i for i in range(3000) if i % 3]
    assert tuple(q["a34_progress"](spark, str(tmp_path)).first()) == (1000, 2997, 33.333333333)


def test_all_mixed_ids_have_their_place(spark, tmp_path):
    put(spark, tmp_path, "documents", [(i, "en", "s", 1) for i in range(300)], "doc_id long, lang string, source string, n_chars long")
    got = [r.id for r in plans.queries()["d20_sort_samples"](spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [str(i) for i in range(300) if i % 10] + sorted(f"x{i}" for i in range(0, 300, 10))


def test_bootstrap_takes_every_size(spark, tmp_path):
    sizes = {1: [], 2: [2], 3: [2, 3], 4: [2, 4], 9: [2, 4, 8, 9], 25: [2, 4, 8, 16, 25]}
    rows = [(g, g * 100 + i, 1000.0 * i, "F", "1") for g in sizes for i in range(g)]
    put(spark, tmp_path, "orders", rows, "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string")
    got = plans.queries()["a23_bootstrap"](spark, str(tmp_path)).collect()
    assert sorted((r.uid, r.n) for r in got) == [(g, n) for g in sizes for n in sizes[g]]
    held = spark.createDataFrame([(g, float(i)) for g in sizes for i in range(g)], "g long, v double")
    true = {(r.g, n): r for n in (2, 3, 4, 8, 9, 16, 25) for r in rollouts.expected_extremes(held, "g", "v", n).collect()}
    for r in got:
        t = true[r.uid, r.n]
        assert abs(r.best_mean - t.best_mean) <= 5 * r.best_std / 1000**0.5 and abs(r.worst_mean - t.worst_mean) <= 5 * r.worst_std / 1000**0.5
        assert round(r.best_mean * 1000, 6) % 1 == 0  # a mean over 1,000 draws of whole values


def test_first_unseen_skips_seen_pages(spark, tmp_path):
    rows = [(i, 0, [math.cos(i * 0.003), math.sin(i * 0.003)]) for i in range(500)]
    put(spark, tmp_path, "embeddings", rows, "vec_id long, label long, embedding array<float>")
    got = {r.episode: r.label for r in plans.queries()["r7_first_unseen"](spark, str(tmp_path)).collect()}
    assert got[100] in (99, 101) and got[200] in (199, 201) and (got[0], got[300], got[400]) == (0, None, 400)


def test_deck_cap_rises_until_the_quota_is_met(spark):
    rows = [(i, "one", "a", i % 10 == 0) for i in range(100)] + [(100 + i, "many", f"d{i % 50}", False) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, s string, deck string, rare boolean")
    for cap in (1, 4):
        got = curate.sqrt_quota_sample(df, "s", "deck", 40, cap, "x", "id", F.col("rare")).collect()
        assert sorted(r.s for r in got) == ["many"] * 20 + ["one"] * 20
        assert sum(r.rare for r in got) == 10
        decks = [r.deck for r in got if r.s == "many"]
        assert cap > 1 or len(decks) == len(set(decks))


def test_announced_actions_are_held_against_the_taken_ones(spark):
    said = {1: ("Fine. Let me zoom in on it.", "crop"), 2: ("Fine. Let me zoom in on it.", "search"), 3: ("I'll search. The page shows it.", "crop"), 4: ("I should revisit page 2", "answer"), 5: ("", "crop"), 6: (None, None)}
    df = spark.createDataFrame([(i, *v) for i, v in said.items()], "i long, think string, act string")
    assert {r.i for r in curate.think_quality(df, "i", "think", "act").collect() if r.mismatch} == {2, 4}


def test_a_remainder_is_copied_or_deleted(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(curate.drop_padding(curate.pad_to_multiple(df, 8, ["i"]))) == list(range(10))
    less, more = ids(curate.fit_to_multiple(df, 4, "delete", "s", "i")), ids(curate.fit_to_multiple(df, 32, "copy", "s", "i"))
    assert len(less) == len(set(less)) == 8 and len(more) == 32 and min(map(more.count, range(10))) == 3


def test_files_grow_with_the_pages(spark, tmp_path):
    put(spark, tmp_path, "pages", [(i, f"u{i}") for i in range(120)], "page_id long, url string")
    put(spark, tmp_path, "labels", [(i, 1, 0) for i in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    q = plans.queries()
    assert q["s5_scan_page_files"](spark, str(tmp_path)).distinct().count() == q["s6_parse_page_files"](spark, str(tmp_path)).distinct().count() == 120
    errors = [("missing", "size", "sha256", None)[k % 4] for k in range(10)]
    assert sorted((r.part, r.error) for r in q["s11_verify_manifest"](spark, str(tmp_path)).collect()) == sorted((f"part={k}", x) for k, x in enumerate(errors) if x)


def test_a_trace_without_pages_in_range_keeps_its_row(spark, tmp_path):
    rows = [(1, 7, "click", 1.0, '{"k": 3}'), (2, 7, "view", 1.0, '{"k": 3}'), (3, 8, "click", 1.0, '{"k": 40}'), (4, 9, "click", 1.0, None)]
    put(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string, value double, props string")
    got = plans.queries()["u6_row_generators"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.tasks, r.steps) for r in got) == [(7, 1, 2), (8, 0, 1), (9, 0, 1)]
