"""Joins and set operations: documents with their labels are judged predictions, pages a corpus, orders rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import joins as J

from .tables import table

_docs = lambda s, d: table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def j1_join_predictions(spark, sf):
    preds = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("qa_id"), F.col("doc_id").alias("sample_id"), "quality")
    data = table(spark, sf, "documents").select((F.col("doc_id") - F.col("doc_id") % 2).alias("id"), "lang", "n_chars", "doc_id")
    return J.join_predictions(preds, data, ["qa_id", "sample_id"], "id", "doc_id").select("sample_id", "quality", "lang", "n_chars")


def j2_todo(spark, sf):
    return J.todo(_docs(spark, sf).select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


def j3_exclude(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("deck"), F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("question"))
    bad = e.where("event_id % 97 = 0").select(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("event_id"), "deck", F.when(F.col("event_id") % 3 == 0, F.col("question")).alias("question"))
    return J.exclude(e, bad, "event_id", "deck", "question")


def j4_index_coverage(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("label"))
    return J.index_coverage(e, table(spark, sf, "pages").select(F.col("page_id").alias("label")).where("label % 3 <> 0"), "user_id", "label")


def j5_missing_refs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("label"))
    return J.missing_refs(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("label")), table(spark, sf, "pages").select(F.col("page_id").alias("label")), "label")


def _needed(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 3 + F.col("turn")).alias("page_id"))


def j6_materialize_pages(spark, sf):
    return J.materialize_pages(_needed(spark, sf), table(spark, sf, "pages").select("page_id", "url"), ["page_id"])[0]


def j6_undelivered_pages(spark, sf):
    return J.materialize_pages(_needed(spark, sf), table(spark, sf, "pages").select("page_id", "url"), ["page_id"])[1]


def j7_merge_sidecar(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).alias("verdict"), F.when(F.col("doc_id") % 3 == 0, "old").alias("error"))
    side = table(spark, sf, "events").select(F.pmod("event_id", F.lit(500)).alias("doc_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 1).alias("verdict"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("error"))
    return J.merge_sidecar(labels, side, "doc_id", "verdict", "error", "seq")


def j8_missing_ids(spark, sf):
    """All ids up to the documents' last one are expected."""
    last = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    return J.missing_ids(table(spark, sf, "labels"), "doc_id", 0 if last is None else last + 1)


def _preds(spark, sf):
    label = lambda k: F.format_string("d%d/page_%02d", F.col("user_id") % 5, k)
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", F.array(label(k % 3), label(k % 4)).alias("gold"), F.array(label(k % 5), F.format_string("d%d/PAGE-%d", F.col("user_id") % 5, k % 3), F.lit("cover")).alias("final"))


def j9_evidence_overlap(spark, sf):
    return J.evidence_overlap(_preds(spark, sf), "gold", "final").select("event_id", "covered", "non_gold")


def j10_grounding(spark, sf):
    line = table(spark, sf, "lineitem")
    box = lambda a, b: F.array((a % 50).cast("double"), (b % 50).cast("double"), (a % 50 + 20).cast("double"), (b % 50 + 30).cast("double"))
    rows = line.select(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 3).alias("page"), box(F.col("l_partkey"), F.col("l_suppkey")).alias("box"), F.col("l_linenumber").alias("n"), "l_returnflag")
    gold = rows.where("n = 1").select("sample", "page", "box")
    facts = rows.where("n <> 1").select("sample", "page", F.when(F.col("l_returnflag") == "R", "zoom").otherwise("page").alias("frame"), F.col("box").alias("bbox"))
    samples = rows.select("sample").distinct()
    final = rows.where("n <> 1 AND page <> 2").select("sample", "page").distinct()
    return J.grounding(gold, facts, final, samples).withColumn("grounding", F.round("grounding", 6))


def j12_route(spark, sf):
    q = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("corpus"))
    return J.route(q, table(spark, sf, "nation").select(F.col("n_nationkey").alias("corpus"), "n_name"))


def j13_union_columns(spark, sf):
    d = _docs(spark, sf)
    return J.union_columns(d.select("doc_id", "lang", "source"), d.select("doc_id", "lang", "n_chars"), "doc_id")


def j14_score_distinct(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "source")
    return J.score_distinct(d, ["lang", "source"], lambda t: t.withColumn("score", F.length("lang") + F.length("source")))


def t1_concat(spark, sf):
    return J.concat(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


def t2_needed_labels(spark, sf):
    return J.needed_labels(_preds(spark, sf), ["gold", "final"])


def t3_common(spark, sf):
    return J.common(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def t4_minus(spark, sf):
    return J.minus(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def t5_same_rows(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    dealt = line.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # the same rows in other places
    return J.same_rows(line, dealt).withColumn("what", F.lit("itself")).unionByName(J.same_rows(line, dealt.distinct()).withColumn("what", F.lit("distinct")))


def t6_found_missing(spark, sf):
    out = J.found_missing(_preds(spark, sf), "final", "gold")
    return out.select("event_id", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))


def a16_split_overlap(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("split"), F.concat_ws("/", F.col("user_id") % 40, F.get_json_object("props", "$.k")).alias("deck"))
    return J.split_overlap(e, "split", "deck")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "jta" and k[1].isdigit()}

_P = """p AS (SELECT event_id, user_id % 5 AS d, (props->>'$.k')::INT AS k FROM events),
k AS (SELECT event_id, list_distinct([k % 3, k % 4]) AS g, list_distinct([k % 5, k % 3]) AS f FROM p)"""
ORACLE_SQL = {
    "j1_join_predictions": """
WITH r AS (SELECT doc_id - doc_id % 2 AS id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1) SELECT doc_id AS
sample_id, quality, lang, n_chars FROM labels JOIN r ON r.id = doc_id""",
    "j2_todo": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j3_exclude": """
WITH e AS (SELECT event_id, user_id AS deck, event_type || '-' || (props->>'$.k') AS question FROM events), b AS (SELECT CASE WHEN event_id % 2 = 0 THEN
event_id END AS i, deck AS d, CASE WHEN event_id % 3 = 0 THEN question END AS q FROM e WHERE event_id % 97 = 0) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM
b WHERE i = event_id) AND NOT EXISTS (SELECT 1 FROM b WHERE q = question)""",
    "j4_index_coverage": """
WITH e AS (SELECT user_id, (props->>'$.k')::BIGINT AS l FROM events), i AS (SELECT page_id FROM pages WHERE page_id % 3 <> 0) SELECT count(DISTINCT l) AS
labels, count(DISTINCT l) FILTER (l IN (SELECT page_id FROM i)) AS covered, count(DISTINCT user_id) AS samples, count(DISTINCT user_id) FILTER (l IN (SELECT
page_id FROM i)) AS samples_hit FROM e""",
    "j5_missing_refs": "SELECT doc_id AS label FROM documents EXCEPT SELECT doc_id FROM labels EXCEPT SELECT page_id FROM pages",
    "j6_materialize_pages": "SELECT page_id, url FROM pages WHERE page_id IN (SELECT conv_id * 3 + turn FROM conversations)",
    "j6_undelivered_pages": "SELECT DISTINCT conv_id * 3 + turn AS page_id FROM conversations WHERE conv_id * 3 + turn NOT IN (SELECT page_id FROM pages)",
    "j7_merge_sidecar": """
WITH s AS (SELECT event_id % 500 AS doc_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT l.doc_id, CASE WHEN t = 'click' THEN 1 WHEN
l.doc_id % 2 = 0 THEN quality END AS verdict, CASE WHEN t = 'click' THEN NULL WHEN l.doc_id % 2 <> 0 THEN coalesce(t, CASE WHEN l.doc_id % 3 = 0 THEN 'old' END)
WHEN l.doc_id % 3 = 0 THEN 'old' END AS error FROM labels l LEFT JOIN s ON l.doc_id = s.doc_id""",
    "j8_missing_ids": "SELECT unnest(range(max(doc_id) + 1)) AS doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "j9_evidence_overlap": f"WITH {_P} SELECT event_id, list_has_all(f, g) AS covered, len(list_filter(f, lambda x: NOT list_contains(g, x)))::INT AS non_gold FROM k",
    "j10_grounding": """WITH r AS (SELECT row_number() OVER () AS g, l_orderkey AS s, l_suppkey % 3 AS p, l_partkey % 50 AS x, l_suppkey % 50 AS y, l_linenumber AS n, l_returnflag AS f FROM lineitem),
 i AS (SELECT a.g, a.s, CASE WHEN b.s IS NOT NULL THEN greatest(least(a.x, b.x) + 20 - greatest(a.x, b.x), 0) * greatest(least(a.y, b.y) + 30 - greatest(a.y, b.y), 0) END AS bb FROM r a LEFT JOIN r b ON a.s = b.s AND a.p = b.p AND b.n <> 1 AND b.f <> 'R' AND b.p <> 2 WHERE a.n = 1),
 m AS (SELECT s, g, coalesce(max(bb / (1200 - bb)), 0) AS best FROM i GROUP BY 1, 2), v AS (SELECT s, avg(best) AS v FROM m GROUP BY 1)
 SELECT DISTINCT r.s AS sample, round(coalesce(v, 0), 6) AS grounding FROM r LEFT JOIN v ON r.s = v.s""",
    "j12_route": "SELECT s_nationkey AS corpus, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "j13_union_columns": "SELECT doc_id, lang, source, n_chars FROM documents",
    "j14_score_distinct": "SELECT doc_id, lang, source, (length(lang) + length(source))::INT AS score FROM documents",
    "t1_concat": "SELECT c_custkey AS id, c_name AS name, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier",
    "t2_needed_labels": f"""
WITH {_P} SELECT DISTINCT unnest(['d' || d || '/page_0' || k % 3, 'd' || d || '/page_0' || k % 4, 'd' || d || '/page_0' || k % 5, 'd' || d || '/PAGE-' || k % 3,
'cover']) AS label FROM p""",
    "t3_common": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "t4_minus": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "t5_same_rows": "SELECT true AS same, 'itself' AS what UNION ALL SELECT count(*) = (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), 'distinct' FROM lineitem",
    "t6_found_missing": f"""
WITH {_P} SELECT k.event_id, coalesce(array_to_string(list_transform(list_sort(list_filter(g, lambda x: x = p.k % 5)), lambda x: 'd' || p.d || '/page_0' || x),
','), '') AS found, coalesce(array_to_string(list_transform(list_sort(list_filter(g, lambda x: x <> p.k % 5)), lambda x: 'd' || p.d || '/page_0' || x), ','),
'') AS missing FROM k JOIN p ON k.event_id = p.event_id""",
    "a16_split_overlap": """
WITH e AS (SELECT DISTINCT event_type AS s, (user_id % 40)::VARCHAR || '/' || (props->>'$.k') AS d FROM events) SELECT a.s AS a, b.s AS b, count(*) AS shared
FROM e a JOIN e b ON a.d = b.d AND a.s < b.s GROUP BY 1, 2""",
}
