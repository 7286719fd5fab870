"""What one task holds: plans of queries whose tasks grew with the tables, and the rows of what replaced the growing step."""

from pyspark.sql import functions as F

from foliant.operators import joins, memory, rollouts, turns
from foliant.plans import joins as join_plans
from foliant.plans import nested
from foliant.plans import rollouts as rollout_plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trajectory_votes_sort_no_step(spark, sf):
    assert "Window" not in plan(rollout_plans.w2_grpo_trajectory_votes(spark, sf))
    rows = [("q", "a", 2, 9.0), ("q", "a", 1, 1.0), ("q", "b", 1, 3.0), (None, "c", 1, 4.0), (None, "c", 2, 6.0), ("n", "d", 1, None), ("n", "d", 2, 5.0)]
    got = rollouts.grpo(spark.createDataFrame(rows, "uid string, traj string, at int, score double"), "uid", "score", traj="traj", order="at")
    assert got.columns == ["uid", "traj", "at", "score", "advantage"]
    got = {(r.uid, r.traj, r.at): r.advantage for r in got.withColumn("advantage", F.round("advantage", 4)).collect()}
    # votes of q are 1 and 3; a question without a name is one as well; a vote that is null gives no mean
    assert got == {("q", "a", 1): -0.7071, ("q", "a", 2): 4.9497, ("q", "b", 1): 0.7071, (None, "c", 1): 4.0, (None, "c", 2): 6.0, ("n", "d", 1): None, ("n", "d", 2): None}


def test_filter_on_parsed_turns_parses_once(spark, sf):
    said = plan(nested.f8_check_rules(spark, sf))
    assert said.count("regexp_") < 20 and said.count("get_json_object") < 20
    rows = [("<think>a</think><act>{\"type\": \"answer\", \"text\": \"x\"}</act>", 1), (None, 2), ("<act>{}</act>", 3), ("<page>null</page><act>{\"type\": \"crop\"}", 4)]
    parsed = turns.parse_turns(spark.createDataFrame(rows, "page string, n int"), "page")  # the text may be in a column that is replaced
    assert parsed.columns == ["page", "n", "think", "tree", "act", "error_kind", "error"]
    assert [r.n for r in parsed.where("error_kind IS NULL").collect()] == [1]
    assert {r.n: (r.think, r.page, r.error) for r in parsed.collect()} == {1: ("a", None, None), 2: (None, None, "missing <act>"), 3: ("", None, "<act> schema"), 4: ("", None, "<act> is not closed")}


def test_folds_stream_through_samples(spark, sf):
    for df in (nested.m4_fold_graph(spark, sf), nested.m3_fold_memory(spark, sf)):
        assert "FlatMapGroupsInPandas" not in plan(df)
    # more samples than are handed on at once, one of them longer than an Arrow batch, and one without a name
    many = spark.range(1500).selectExpr("nullif(id, 7) AS s", "id AS i").unionByName(spark.range(25000).selectExpr("3L AS s", "100000 - id AS i"))
    kind = F.when(F.col("i") % 2 == 0, "REJECT").otherwise("CROP_ACCEPT")
    turns_ = many.select("s", "i", kind.alias("decision"), F.lit("a").alias("answer"), F.lit(None).cast("array<struct<text:string,box:array<double>>>").alias("facts"), F.lit(None).cast("array<string>").alias("refs"), *(F.lit(None).cast(t).alias(c) for c, t in (("answered", "string"), ("remaining", "string"), ("region", "array<double>"))))
    got = {r.s: (len(r.nodes), r.next_id, r.refused) for r in memory.fold_graph(turns_, "s", "i").collect()}
    assert len(got) == 1500 and got[None] == (1, 1, 1) and got[3] == (1, 1, 12501)
    assert all(got[s] == (1, 1, s % 2) for s in range(1500) if s not in (3, 7))


def test_same_rows_counts_after_dealing(spark, sf):
    said = plan(join_plans.t5_same_rows(spark, sf))
    assert "REPARTITION_BY_NUM" in said and ", 3), REPARTITION" not in said and "RoundRobin" not in said
    deals = spark.range(0, 40000, 1, 1).selectExpr("id AS a", "nullif(id % 3, 2) AS b")
    same = joins.same_rows(deals, deals.repartition(3))
    said = plan(same)
    assert said.rindex("partial_sum") < said.index("hashpartitioning(a")  # rows are dealt below the counts, not above them
    assert same.first().same and not joins.same_rows(deals, deals.limit(39999)).first().same and not joins.same_rows(deals, deals.unionAll(deals.limit(1))).first().same
    none = deals.where("a < 0")
    assert joins.same_rows(none, none).first().same and not joins.same_rows(none, deals).first().same


def test_lines_are_dealt_before_they_are_listed(spark, sf):
    said = plan(rollout_plans.w10_scatter_spans(spark, sf))
    assert "SortMergeJoin" not in said and said.count("REPARTITION_BY_NUM") == 2  # below both the lists and the spans' distinct rows
    rows = spark.createDataFrame([("t", [1.0, 0.0, 1.0]), ("none", [1.0]), ("void", [])], "traj string, mask array<double>")
    spans = spark.createDataFrame([("t", 1, 0, 3, 5.0), ("t", 2, 2, 9, 7.0), ("t", 3, 1, 1, 9.0)], "traj string, span int, lo int, hi int, advantage double")
    got = sorted(tuple(r) for r in rollouts.scatter_spans(spans, rows, "traj").collect())
    assert got == [("none", 0, 0.0), ("t", 0, 5.0), ("t", 1, 0.0), ("t", 2, 7.0)]
