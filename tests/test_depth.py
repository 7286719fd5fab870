"""Scans, balanced assignment, linked keys, trees of sums, reductions, bounded searches: hand cases and plain versions."""

import heapq
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import reductions
from foliant.functions.scans import scan_back, scanned_back
from foliant.operators import balance, curate, linked, memory, retrieve, rollouts


def test_pages_with_holes_take_no_place(spark):
    nan = float("nan")
    pages = [("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [0.9, 0.1]), ("d", [None, 1.0]), ("e", [0.5, 0.5]), ("f", [float("inf"), 0.0]), ("g", None), ("h", [])]
    df = spark.createDataFrame(pages, "label string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0])], "query int, qv array<double>")
    assert [(r.query, r.label) for r in retrieve.dense_topk(asked, df, 3).orderBy("rank").collect()] == [(1, "a"), (1, "c"), (1, "e")]
    scoped = retrieve.dense_topk(asked.withColumn("s", F.lit(1)), df.withColumn("s", F.lit(1)), 3, ["s"])
    assert [(r.query, r.label) for r in scoped.orderBy("rank").collect()] == [(1, "a"), (1, "c"), (1, "e")]
    tokens = df.withColumn("v", F.array("v", F.array(F.lit(0.1), F.lit(0.1))))
    many = asked.withColumn("qv", F.array("qv"))
    for scope in ((), ("s",)):
        found = retrieve.maxsim_topk(*(x.withColumn("s", F.lit(1)) for x in (many, tokens)), 3, scope) if scope else retrieve.maxsim_topk(many, tokens.where("label <> 'h'"), 3)
        assert [(r.query, r.label) for r in found.where("label <> 'h'").orderBy("rank").collect()] == [(1, "a"), (1, "c"), (1, "e")]


def test_blocks_of_pairs(spark, monkeypatch):
    queries, pages = spark.range(40).select(F.col("id").alias("query")), spark.range(70).select(F.col("id").alias("label"))
    monkeypatch.setattr(retrieve, "MAX_BROADCAST_BYTES", 200)
    pairs = retrieve.score_pairs(queries, pages)
    assert pairs.distinct().count() == pairs.count() == 2800 and "CartesianProduct" not in pairs._jdf.queryExecution().toString()


def test_late_interaction_bounds():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(60, 16)) * 4
    page = lambda: (centres[rnd.integers(0, 60, rnd.integers(1, 4))].repeat(rnd.integers(3, 30), axis=0) + 0)
    pages = [p + rnd.normal(size=p.shape) * 0.05 for p in (page() for _ in range(800))]
    asked = [centres[rnd.integers(0, 60, 5)] + rnd.normal(size=(5, 16)) * 0.05 for _ in range(12)]
    want = np.array([[(q @ p.T).max(axis=1).sum() for p in pages] for q in asked])
    got, scored = retrieve.late_interactions(*(pa.array([x.tolist() for x in xs]) for xs in (asked, pages)), 10)
    for a, b in zip(got, want, strict=True):
        best = np.argsort(-b)[:10]
        assert np.allclose(a[best], b[best]) and np.allclose(a[np.isfinite(a)], b[np.isfinite(a)])
    assert scored < 0.25 * want.size
    one = retrieve.late_interactions(pa.array([[[1.0]]]), pa.array([[[2.0]], [[3.0], [1.0]]]), 10)
    assert one[0].tolist() == [[2.0, 3.0]] and one[1] == 2


def test_scans(spark):
    rnd = np.random.default_rng(1)
    for lengths in ([], [0, 3, 0, 1], [5000, 2, 9000, 0, 40]):
        n = np.array(lengths, np.int64)
        a, b = rnd.uniform(0, 1, n.sum()), rnd.normal(size=n.sum())
        want, at = [], 0
        for k in lengths:
            state, part = 0.0, []
            for j in range(at + k - 1, at - 1, -1):
                state = b[j] + a[j] * state
                part.append(state)
            want, at = want + part[::-1], at + k
        assert scanned_back(n, a, b).tolist() == want
    df = spark.createDataFrame([([0.5, 0.5], [1.0, 2.0]), ([], []), (None, None)], "a array<double>, b array<double>")
    assert [r.x for r in df.select(scan_back(F.col("a"), F.col("b")).alias("x")).collect()] == [[2.0, 2.0], [], []]


def test_a_million_steps(spark):
    n = 1_000_000
    steps = spark.range(n).select(F.lit(1).alias("t"), F.col("id").alias("i"), F.lit(1.0).alias("r"))
    out = rollouts.discounted_returns(steps, "t", ["i"], "r", 0.999)
    got = {r.i: r["return"] for r in out.where("i IN (0, 4095, 4096, 500000, 999998, 999999)").collect()}
    assert all(math.isclose(x, (1 - 0.999 ** (n - i)) / (1 - 0.999), rel_tol=1e-9) for i, x in got.items()) and len(got) == 6
    tokens = spark.range(1).select(F.array_repeat(F.lit(1.0), n).alias("x"))
    back = tokens.select(rollouts.reinforce_returns(F.col("x"), F.col("x"), 0.5).alias("y")).select(F.size("y"), F.get("y", F.lit(0)), F.element_at("y", -1)).first()
    assert (back[0], round(back[1], 9), back[2]) == (n, 2.0, 1.0)


def greedy(rows, room):
    heap, out = [(0, r) for r in range(len(room))], {}
    left = list(room)
    for key, cost in sorted(rows, key=lambda x: (-x[1], x[0])):
        while not left[heap[0][1]]:
            heapq.heappop(heap)
        load, r = heapq.heappop(heap)
        out[key], left[r] = r, left[r] - 1
        heapq.heappush(heap, (load + cost, r))
    return out


@pytest.mark.parametrize("n", [1, 3, 7])
def test_longest_first(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([0, 0, 5, 5, 5, 9, 100, rnd.randrange(60)])) for i in range(101)]
    room = [101 // n + (r < 101 % n) for r in range(n)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k int, c int, rank_name string")
    assert {r.k: r["rank"] for r in balance.balance_ranks(df, "c", "k", n).collect()} == greedy(rows, room)
    assert balance.balance_ranks(df.where("false"), "c", "k", n).count() == 0
    with pytest.raises(Exception, match="whole number"):
        balance.balance_ranks(df.withColumn("c", F.col("c") + 0.5), "c", "k", n).collect()


def test_oversize_rows_are_batches(spark):
    df = spark.createDataFrame([(i, 10) for i in range(40)] + [(99, 1000)], "k int, c int")
    out = balance.micro_batches(df, "c", "k", 100).groupBy("batch").agg(F.count("*").alias("n"), F.sum("c").alias("s")).orderBy("batch").collect()
    assert [tuple(r) for r in out] == [(0, 10, 100), (1, 10, 100), (2, 10, 100), (3, 10, 100), (4, 1, 1000)]
    assert [r.batch for r in balance.micro_batches(df.where("k = 99"), "c", "k", 100).collect()] == [0]
    assert balance.micro_batches(df.where("false"), "c", "k", 100).count() == 0


def plain_first_wins(rows):
    one, two, kept = set(), set(), []
    for i, a, b in sorted(rows):
        if (a is None or a not in one) and (b is None or b not in two):
            kept.append(i)
            one.add(a)
            two.add(b)
    return kept


def test_long_chains(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.floor(F.col("id") / 2).alias("a"), F.floor((F.col("id") + 1) / 2).alias("b"))
    tracker, before = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = {r.id for r in linked.dedup_two_keys(chain, ["a"], ["b"], "id").select("id").collect()}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
    assert got == set(plain_first_wins([(i, i // 2, (i + 1) // 2) for i in range(n)])) and tracker is not None
    assert jobs < 400


def test_large_components_in_rounds(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, *range(40)]), rnd.choice([None, *range(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a int, b int")
    for folded in (0, 20, 1000):
        assert sorted(r.i for r in linked.dedup_two_keys(df, ["a"], ["b"], "i", folded=folded).collect()) == plain_first_wins(rows)
    assert linked.dedup_two_keys(df.where("false"), ["a"], ["b"], "i").count() == 0


def test_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(curate, "FAN", 4)
    rnd = random.Random(2)
    w = [rnd.random() for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(w)), "_i long, _w double")
    rows = curate.prefix_sums(df, 150).orderBy("_i").collect()
    assert all(a._hi == b._lo for a, b in zip(rows, rows[1:])) and rows[0]._lo == 0
    assert np.allclose([r._hi for r in rows], np.cumsum(w))


def test_too_few_candidates(spark):
    df = spark.createDataFrame([(i, "multi") for i in range(5)], "k int, hop string")
    with pytest.raises(ValueError, match="multi: 5 of 10, single: 0 of 1"):
        curate.balanced_split(df, "hop", {"multi": (8, 2), "single": (1, 0)}, "s", "k")


def test_slices_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(curate, "FEW", 10)
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "k int").repartition(5)
    assert sorted(r.k for r in curate.slice_ordered(df, ["k"], 40, 7).collect()) == list(range(40, 47))


def test_rounds_go_on_after_a_restart(spark, tmp_path):
    made = []

    def generate(n):
        made.append(n)
        return spark.createDataFrame([(f"{n}-{u}", int(u == 0 and i)) for u in range(2) for i in range(2)], "uid string, r int")

    first = curate.accumulate_groups(spark, generate, str(tmp_path), "uid", "r", 4, 5)
    assert made == [1, 2] and sorted(set(r.uid for r in first.collect())) == ["1-0", "2-0"]
    more = curate.accumulate_groups(spark, generate, str(tmp_path), "uid", "r", 100, 3)
    assert made == [1, 2, 3] and more.where("round = 3").count() == 4 and more.count() == 8


def test_states_as_prefixes(spark):
    steps = spark.createDataFrame([(1, i, x) for i, x in enumerate(["b", None, "a", "b", "c"])], "s int, o int, x string")
    items, placed = memory.evidence_prefixes(steps, "s", "o", F.col("x"))
    assert items.first()["items"] == ["b", "a", "c"]
    assert [(r.n_before, r.n_after) for r in placed.orderBy("o").collect()] == [(0, 1), (1, 1), (1, 2), (2, 2), (2, 3)]
    assert [r.state_after for r in memory.evidence_states(steps, "s", "o", F.col("x")).orderBy("o").collect()] == [["b"], ["b"], ["b", "a"], ["b", "a"], ["b", "a", "c"]]


def test_bootstrap_of_own_reductions(spark, monkeypatch):
    monkeypatch.setattr(reductions, "BLOCK", 3)
    values = [float(x) for x in (1, 2, 2, 3, 5, 8, 13, 21, 21, 34)]
    df = spark.createDataFrame([("g", x) for x in values] + [("one", 4.0), ("none", None)], "g string, v double")
    count = reductions.Reduction(lambda: 0, lambda s, x, n: s + n, lambda a, b: a + b, float)
    out = {r.n: r for r in reductions.bootstrap(df, "g", "v", {"mean": reductions.MEAN, "best": reductions.LARGEST, "count": count}, 2000, "s").collect()}
    assert sorted(out) == [2, 4, 8, 10]
    for n, r in out.items():
        best = sum(x * ((i + 1) ** n - i**n) for i, x in enumerate(values)) / 10**n
        spread = np.std(values) / math.sqrt(n)
        assert (r.count_mean, r.count_std) == (n, 0) and abs(r.mean_mean - np.mean(values)) < 5 * spread / math.sqrt(2000)
        assert abs(r.mean_std - spread) < 0.1 * spread and abs(r.best_mean - best) < 5 * r.best_std / math.sqrt(2000) + 1e-9
    sums = reductions.reduce_by(df, "g", "v", {"mean": reductions.MEAN, "n": count}).collect()
    assert sorted((r.g, r["mean"], r.n) for r in sums) == [("g", 11.0, 10.0), ("one", 4.0, 1.0)]


def test_slices_and_large_scopes_find_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    pages = spark.createDataFrame([(i, i % 3 if i % 50 else None, [float(rnd.randrange(-3, 4)) for _ in range(4)]) for i in range(700)], "label long, deck long, v array<double>")
    queries = pages.where("label % 10 = 0").select(F.col("label").alias("query"), "deck", F.col("v").alias("qv"))
    rows = lambda df: sorted((r.query, r.rank, r.label, r.score) for r in df.collect())
    flat, deck = rows(retrieve.dense_topk(queries.drop("deck"), pages.drop("deck"), 6)), retrieve.dense_topk(queries, pages, 6, scope=["deck"])
    real = retrieve._cosines
    monkeypatch.setattr(retrieve, "SCORES", 1500)

    def small(asked, held):
        assert len(asked) * len(held) <= 1500
        return real(asked, held)

    monkeypatch.setattr(retrieve, "_cosines", small)
    assert rows(retrieve.dense_topk(queries.drop("deck"), pages.drop("deck"), 6)) == flat
    monkeypatch.setattr(retrieve, "LARGE_SCOPE", 1)
    large = retrieve.dense_topk(queries, pages, 6, scope=["deck"])
    assert rows(large) == rows(deck) and large.columns == ["deck", "query", "label", "score", "rank"]
    assert {(r.query, r.deck) for r in large.collect()} == {(r.query, r.deck) for r in queries.where("deck IS NOT NULL").collect()}


def test_small_groups_meet_in_few_calls(spark):
    """Groups of one block are reduced by batches; draws of a single value are worked out once; results of whole draws equal those of their states."""
    calls = spark.sparkContext.accumulator(0)

    def update(s, x, n):
        calls.add(1)
        return s + x * n

    total = reductions.Reduction(lambda: 0.0, update, lambda a, b: a + b, lambda s: s)
    df = spark.createDataFrame([(g, float(g)) for g in range(20) for _ in range(9)], "g long, v double")
    got = reductions.bootstrap(df, "g", "v", {"total": total}, 500, "s").collect()
    assert sorted((r.g, r.n, r.total_mean, r.total_std) for r in got) == [(g, n, g * float(n), 0.0) for g in range(20) for n in (2, 4, 8, 9)]
    assert calls.value == 20 * 4
    plan = reductions.reduce_by(df, "g", "v", {"total": total})
    assert sorted((r.g, r.total) for r in plan.collect()) == [(g, 9.0 * g) for g in range(20)]
    values, times = np.sort(np.random.default_rng(1).random(12)), np.random.default_rng(2).multinomial(np.full(300, 5), np.full(12, 1 / 12))
    for r in (reductions.LARGEST, reductions.SMALLEST):
        assert r.results(values, times).tolist() == [r.finish(s) for s in r.states(values, times)]


def test_similar_groups_take_questions_by_batches(spark):
    """Many questions with the same texts go through one call for a batch."""
    import difflib

    rows = [(q, 10 * q + i, x) for q in range(30) for i, x in enumerate(("the first text here", "quite another one", "the first text hera", "the first text here"))]
    df = spark.createDataFrame(rows, "q long, i long, x string").coalesce(1)
    plan = rollouts.similar_groups(df, "q", "i", "x", 0.9)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString() and "MapInPandas" in plan._jdf.queryExecution().toString()
    alike = difflib.SequenceMatcher(None, rows[0][2], rows[2][2]).ratio() >= 0.9
    assert sorted((r.q, r.i % 10, r.group) for r in plan.collect()) == [(q, i, (0, 1, 0 if alike else 2, 0)[i]) for q in range(30) for i in range(4)]


def test_a_large_component_meets_in_no_task(spark, monkeypatch):
    """Its rows are told from the others by a broadcast, even where joins are not broadcast by their size."""
    seen, real = [], linked.written
    monkeypatch.setattr(linked, "written", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, i % 5, i % 7 if i < 300 else i) for i in range(320)], "i long, a long, b long")
        got = sorted(r.i for r in linked.dedup_two_keys(df, ["a"], ["b"], "i", folded=50).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(r.i for r in linked.dedup_two_keys(df, ["a"], ["b"], "i").collect()) == [0, 1, 2, 3, 4]
    assert any("BroadcastHashJoin [component" in plan for plan in seen)
