"""Ordered state, against plain versions and written-out cases."""

import random

from foliant.operators import curate, linked, memory, rollouts
from foliant.plans import nested

TURN = "sample int, turn int, view string, added array<string>, updated array<struct<n:int,text:string>>, op string, node string, answered string, answer string, next string, pages array<string>"


def turn(sample, n, view=None, added=(), updated=(), op=None, node=None, answered=None, answer=None, next=None, pages=()):
    return (sample, n, view, list(added), [{"n": a, "text": b} for a, b in updated], op, node, answered, answer, next, list(pages))


def fold(spark, *turns):
    return {r.sample: r for r in memory.fold_memory(spark.createDataFrame(list(turns), TURN), "sample", "turn").collect()}


def test_fold(spark):
    read = lambda s, *pages: [turn(s, i, f"P{p}", ["x"]) for i, p in enumerate(pages)]
    got = fold(
        spark,
        *read(1, 1, 2), turn(1, 5, op="resolve", answer="42", pages=["P1"]), turn(1, 6, op="resolve", answer="43", pages=["P2", "P1"]),
        *read(2, 1, 2, 3), turn(2, 5, op="expand", answered="s1", answer="a1", next="s2", pages=["P1"]), turn(2, 6, op="expand", answered="s2 part", answer="a2", next="s3", pages=["P2"]),
        *read(3, 1), turn(3, 5, "P2", op="resolve", answer="42", pages=["P2"]), turn(3, 6, None, ["no page"]), turn(3, 7, "P1", ["kept out"], [(9, "z")]),
        turn(4, 1, "P1", ["a"], op="resolve", answer="1", pages=["P1"]), turn(4, 2, "P1", [], [(1, "b")]),
        *read(5, 1), turn(5, 5, op="expand", answered="s", answer="a", next="t", pages=["P1"]), turn(5, 6, op="resolve", node="N1", answer="b", pages=["P1"]), turn(5, 7, op="resolve", node="N9", answer="b", pages=["P1"]),
    )
    root = got[1].nodes[0]
    assert (root.answer, root.pages, got[1].errors) == ("43", ["P1", "P2"], [])
    assert [n.id for n in got[2].nodes] == ["N0", "N1", "N2", "N3"] and got[2].active == "N3"
    assert (got[2].nodes[2].question, got[2].nodes[2].status, got[2].nodes[2].pages) == ("s2 part", "resolved", ["P2"])
    assert got[3].errors == [5, 6, 7] and got[3].nodes[0].status == "open" and len(got[3].facts) == 1
    assert got[4].errors == [] and [(f.text, f.revision) for f in got[4].facts] == [("b", 1)] and got[4].nodes[0].pages == ["P1"]
    assert got[5].errors == [7] and got[5].nodes[1].answer == "b"


def test_fold_of_all_users(spark, sf):
    rows = nested._tree_turns(spark, sf).collect()
    got = {r.user_id: r for r in nested.m3_fold_memory(spark, sf).collect()}
    for user in {r.user_id for r in rows}:
        nodes, facts, errors, fresh = [["N0", "open", []]], {}, 0, 1
        for r in sorted((r for r in rows if r.user_id == user), key=lambda r: r.event_id):
            new = {p: list(v) for p, v in facts.items()}
            ok = not (r.added or r.updated) or r.view is not None
            if ok and r.view:
                new.setdefault(r.view, []).extend(r.added)
                ok = not r.updated or len(new[r.view]) >= 1
            ok = ok and (not r.op or all(new.get(p) for p in r.pages))
            act = next((n for n in nodes[1:] if n[1] == "open"), nodes[0])
            if ok and r.op == "resolve":
                at = act if not r.node else next((n for n in nodes if n[0] == r.node), None)
                ok = at is not None
                if ok:
                    at[1], at[2] = "done", at[2] + [p for p in r.pages if p not in at[2]]
            elif ok and r.op == "expand":
                if act is nodes[0]:
                    nodes += [[f"N{fresh}", "done", list(r.pages)], [f"N{fresh + 1}", "open", []]]
                    fresh += 2
                else:
                    act[1], act[2] = "done", act[2] + [p for p in r.pages if p not in act[2]]
                    nodes.insert(nodes.index(act) + 1, [f"N{fresh}", "open", []])
                    fresh += 1
            facts, errors = (new, errors) if ok else (facts, errors + 1)
        x = got[user]
        active = next((n for n in nodes[1:] if n[1] == "open"), nodes[0])[0]
        assert (x.n_nodes, x.n_facts, x.active, x.n_errors) == (len(nodes), sum(map(len, facts.values())), active, errors)
        assert x.evidence == ",".join(dict.fromkeys(p for n in nodes for p in n[2]))


def test_streamed_memories_are_the_folded_ones(spark, sf):
    from pyspark.sql import functions as F

    from foliant.plans import files

    turns = nested._tree_turns(spark, sf)
    last = {r.user_id: r.m for r in turns.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    ends = spark.createDataFrame(list(last.items()), "user_id long, m long")
    turns = turns.join(ends, "user_id")
    applied = turns.where((F.col("event_id") < F.col("m")) | (F.col("user_id") % 3 != 0))  # an error's turn changes nothing
    applied = applied.withColumn("op", F.when(F.col("event_id") == F.col("m"), "answer").otherwise(F.col("op"))).drop("m")
    want = {r.user_id: (len(r.nodes), r.active, "answer") for r in memory.fold_memory(applied, "user_id", "event_id").collect() if r.user_id % 3}
    want |= {r.user_id: (len(r.nodes), r.active, "error") for r in memory.fold_memory(applied, "user_id", "event_id").collect() if r.user_id % 3 == 0}
    alone = {u for u in last if u % 3 == 0} - set(want)  # whose only turn is the error
    want |= {u: (1, "N0", "error") for u in alone}
    assert {r.user_id: (r.n_nodes, r.active, r.ended) for r in files.x8_stream_memory(spark, sf).collect()} == want


DECISION = "s int, i int, decision string, answer string, facts array<struct<text:string,box:array<double>>>, refs array<string>, answered string, remaining string, region array<double>"


def decision(s, i, kind, answer=None, facts=(), refs=(), answered=None, remaining=None, region=None):
    return (s, i, kind, answer, [{"text": t, "box": b} for t, b in facts], list(refs), answered, remaining, region)


def test_clue_graph(spark):
    rows = [
        decision(1, 1, "EXPAND", "a1", [("f1", [0.0, 0.0, 50.0, 50.0]), ("wide", [0.0, 0.0, 900.0, 900.0])], ["P1"], "q1", "q2"),
        decision(1, 2, "CROP_ACCEPT", "a1 closer", [("f1b", None)], ["P1"], region=[5.0, 5.0, 60.0, 60.0]), decision(1, 3, "REJECT"), decision(1, 4, "CROP_ACCEPT", "lost"),
        decision(1, 5, "ACCEPT", "a2", [("f2", None)], ["P2"]), decision(1, 6, "EXPAND", "a3", (), ["P3"], "q3", "q4"), decision(1, 7, "ACCEPT", "a4", [("f4", None)]), decision(1, 8, "ACCEPT", "all", ()),
        decision(2, 1, "ACCEPT"), decision(2, 2, "EXPAND", "x"), decision(2, 3, "ACCEPT", "plain", [("g", None)]),
    ]
    got = {r.s: r for r in memory.fold_graph(spark.createDataFrame(rows, DECISION), "s", "i").collect()}
    nodes = {n.id: n for n in got[1].nodes}
    assert set(nodes) == {0, 3, 4} and got[1].next_id == 5 and got[1].refused == 1  # ids 1 and 2 are never used again
    assert (nodes[0].answer, nodes[0].open, [f.text for f in nodes[0].facts], nodes[0].refs) == ("all", False, ["all"], ["P1", "P2", "P3"])
    assert [(n.question, n.answer, [f.text for f in n.facts], n.refs) for n in (nodes[3], nodes[4])] == [("q3", "a3", ["a3"], ["P3"]), ("q4", "a4", ["f4"], [])]
    assert got[2].refused == 2 and [f.text for f in got[2].nodes[0].facts] == ["g"]
    before = memory.fold_graph(spark.createDataFrame(rows[:3], DECISION), "s", "i").first()
    assert [(f.text, f.superseded) for f in before.nodes[1].facts] == [("f1", True), ("wide", False), ("f1b", False)] and before.nodes[1].answer == "a1 closer"
    kept = memory.fold_graph(spark.createDataFrame(rows[:6], DECISION), "s", "i").first().nodes[0]
    assert [f.text for f in kept.facts] == ["f1", "wide", "f1b", "f2"]  # what older children knew


def test_graph_of_all_users(spark, sf):
    """Counts of m4_fold_graph by a plain fold over (id, parent, facts) rows."""
    from pyspark.sql import functions as F

    k = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).orderBy("event_id").collect():
        k.setdefault(r.user_id, []).append(r.k)
    for r in nested.m4_fold_graph(spark, sf).collect():
        tree, active, fresh, target, refused = {0: [None, {}]}, 0, 1, None, 0
        drop = lambda i, into: [*(drop(c, into) for c in [c for c in tree if tree[c][0] == i]), *(tree[into][1].setdefault(t, v) for t, v in tree.pop(i)[1].items())]  # noqa: E731, B023
        for x in k[r.user_id]:
            kind, answer = ("ACCEPT", "EXPAND", "CROP_ACCEPT", "REJECT", "EXPAND", "CROP_EXPAND", "CROP_REJECT")[x % 7], str(x % 10) if x % 13 else None
            facts = {f"f{x % 23}": [(x, x, x + 9, x + 9) if x % 4 else None, False]} if x % 5 else {}
            below = [c for c in tree if tree[c][0] == active]
            if kind == "REJECT":
                target = None
            elif kind == "ACCEPT" and answer:
                if active == 0 or len(below) >= 2:
                    tree[active][1] = facts or {answer: [None, False]}
                else:
                    tree[active][1] = facts | tree[active][1]
                target, active = active, active if tree[active][0] is None else tree[active][0]
            elif kind == "EXPAND" and answer and x % 17:
                for c in below:
                    drop(c, active)
                tree[fresh], tree[fresh + 1] = [active, facts or {answer: [None, False]}], [active, {}]
                target, active, fresh = fresh, fresh + 1, fresh + 2
            elif kind.startswith("CROP") and target in tree:
                if kind != "CROP_REJECT":
                    for box in tree[target][1].values() if x % 2 == 0 else ():
                        box[1] = box[1] or bool(box[0]) and box[0][0] >= -10 and box[0][2] <= 70
                    tree[target][1] = (facts or ({answer: [None, False]} if answer else {})) | {} if not tree[target][1] else {**tree[target][1], **{t: v for t, v in (facts or ({answer: [None, False]} if answer else {})).items() if t not in tree[target][1]}}
            else:
                refused += 1
        counts = (len(tree), fresh, refused, sum(len(n[1]) for n in tree.values()), sum(f[1] for n in tree.values() for f in n[1].values()))
        assert (r.n_nodes, r.next_id, r.refused, r.n_facts, r.n_superseded) == counts


def test_two_keys(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, *range(12)]), rnd.randrange(15)) for i in range(120)]
    seen1, seen2, want = set(), set(), []
    for i, a, b in rows:
        if (a is not None and a in seen1) or b in seen2:
            continue
        want.append(i)
        seen2.add(b)
        if a is not None:
            seen1.add(a)
    df = spark.createDataFrame(rows, "i int, a int, b int")
    assert sorted(r.i for r in linked.dedup_two_keys(df, ["a"], ["b"], "i").collect()) == want
    assert sorted(r.i for r in linked.dedup_two_keys(df, ["a"], ["b"], "i", 5).collect()) == want[:5]
    kept = df.where(df.i.isin(want[:5]))
    reasons = {r.i: r.reasons for r in curate.skip_reasons(df, kept, ["a"], ["b"], "i").collect()}
    held = [x for x in rows if x[0] in want[:5]]
    for i, a, b in rows:
        had = ["first key"] * any(x[0] < i and a is not None and x[1] == a for x in held) + ["second key"] * any(x[0] < i and x[2] == b for x in held)
        assert i in want[:5] or reasons[i] == (had or ["beyond the target"])


def test_similar_groups(spark):
    rows = [(1, 1, "a" * 40), (1, 2, "a" * 39 + "b"), (1, 3, "c" * 40), (1, 4, "a" * 40), (2, 1, "c" * 40)]
    got = {(r.u, r.o): r.group for r in rollouts.similar_groups(spark.createDataFrame(rows, "u int, o int, t string"), "u", "o", "t").collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 0, (2, 1): 0}


def test_bootstrap_is_near_its_expectation(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 5, 9)], "g int, v double")
    drawn, true = (f(df, "g", "v", 4, *more).first() for f, more in ((rollouts.bootstrap_extremes, (4000, "s")), (rollouts.expected_extremes, ())))
    assert abs(drawn.best_mean - true.best_mean) < 0.15 and abs(drawn.worst_mean - true.worst_mean) < 0.15


def test_group_of_one(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 2, 1.0), (2, 3, 3.0)], "u int, t int, s double")
    assert {r.t: round(r.advantage, 3) for r in rollouts.grpo(df, "u", "s").collect()} == {1: 5.0, 2: -0.707, 3: 0.707}
    assert {r.t: r.advantage for r in rollouts.rloo(df, "u", "s").collect()} == {1: 5.0, 2: -2.0, 3: 2.0}
    assert rollouts.gigpo_steps(df, "u", "u", "s").where("t = 1").first().step_advantage == 0


def test_votes_and_combined_advantages(spark):
    df = spark.createDataFrame([(1, "a", 0, 4.0, 1.0), (1, "a", 1, 6.0, 2.0), (1, "b", 0, 8.0, 5.0), (2, "c", 0, 3.0, 7.0)], "u int, t string, i int, s double, r double")
    lone = {(r.t, r.i): r.advantage for r in rollouts.grpo(df, "u", "s", False, traj="t", order="i").collect()}
    assert lone == {("a", 0): -2.0, ("a", 1): 0.0, ("b", 0): 2.0, ("c", 0): 3.0}
    both = {(r.t, r.i): r.advantage for r in rollouts.gigpo(df, "u", "i", "s", "r", 0.5).collect()}
    assert both == {("a", 0): -2.0 + 0.5 * -2, ("a", 1): 0.0, ("b", 0): 2.0 + 0.5 * 2, ("c", 0): 3.0}


def test_older_anchored_steps(spark):
    steps = [(1, 1, 1, [], ["x"], True), (1, 1, 2, [], ["x"], True), (1, 2, 1, [], [], True), (1, 3, 1, ["x"], ["x", "y"], True), (1, 3, 2, [], ["z"], False)]
    df = spark.createDataFrame(steps, "u int, t int, i int, a array<string>, n array<string>, s boolean")
    got = {(r.t, r.i): round(r.step_advantage, 3) for r in rollouts.ra_search_steps(df, "u", "t", ["i"], "a", "n", df.s).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): -1.0, (3, 1): 0.0, (3, 2): 0.0}


def test_returns_over_several_segments(spark):
    rnd = random.Random(4)
    rows = [(t, i, rnd.random()) for t, n in ((1, 1), (2, 64), (3, 65), (4, 300)) for i in range(n)]
    got = {(r.t, r.i): r["return"] for r in rollouts.discounted_returns(spark.createDataFrame(rows, "t int, i int, x double"), "t", ["i"], "x", 0.9).collect()}
    for t in (1, 2, 3, 4):
        run = 0.0
        for _, i, x in sorted((r for r in rows if r[0] == t), reverse=True):
            run = x + 0.9 * run
            assert abs(got[t, i] - run) < 1e-9


def test_resampling_draws_every_time(spark):
    df = spark.range(1, 5001).selectExpr("id AS k", "(id % 7 - 3) * 1e-3 AS w")
    got = curate.weighted_resample(df, "w", "k", 20000, "s").collect()
    assert sorted(r.draw for r in got) == list(range(20000)) and {r.k for r in got} <= set(range(1, 5001))


def test_resampling_follows_weights(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "id2 int, w double")
    n = {r.id2: r["count"] for r in curate.weighted_resample(df, "w", "id2", 4000, "s", power=1.0).groupBy("id2").count().collect()}
    assert sum(n.values()) == 4000 and all(abs(n[i] - 400 * i) < 150 for i in range(1, 5))
    assert {r.id2 for r in curate.weighted_resample(df, "w", "id2", 200, "s", "max_min").collect()} == {1, 4}
