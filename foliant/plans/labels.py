"""Harmonising and label functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import labels as P

from .tables import table

_join = lambda c: F.array_join(c, ",")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def p1_first_present(spark, sf):
    return _events(spark, sf).select("event_id", P.first_present(F.when(F.col("k") % 3 == 0, "").otherwise(F.when(F.col("k") % 3 == 1, F.col("event_type"))), F.col("user_id")).alias("x"))


def p2_canonical_qa(spark, sf):
    e = _events(spark, sf).select("event_id", F.when(F.col("k") > 50, F.col("event_type")).alias("query"), F.lit("").alias("question"), F.array("event_type", F.col("user_id").cast("string")).alias("answers"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("qa_id"))
    out = P.canonical_qa(e, {"question": ["question", "query"], "answer": ["answer", "answers"], "sample_id": ["id", "qa_id"]}, "event_id")
    return out.select("event_id", "question", "answer", "sample_id")


def p3_reference_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", _join(P.reference_pages(F.col("url"))).alias("pages"))


def p4_page_label(spark, sf):
    return _events(spark, sf).select("event_id", P.page_label(F.col("event_type"), F.col("k")).alias("label"))


def p5_page_key(spark, sf):
    label = F.when(F.col("k") % 4 == 0, F.concat("event_type", F.lit("/x/page_"), "k")).when(F.col("k") % 4 == 1, F.format_string("%s/Page-%05d.png", "event_type", "k")).when(F.col("k") % 4 == 2, F.concat(F.lit("page"), "k")).otherwise("cover/none")
    key = P.page_key(label)
    return _events(spark, sf).select("event_id", key["deck"].alias("deck"), key["n"].alias("n"))


def p6_normalize_pages(spark, sf):
    return _events(spark, sf).select("event_id", _join(P.normalize_pages(F.array(F.col("k"), F.col("k") % 7, F.col("k") % 5, F.col("k") % 7 + 1, F.lit(3), F.lit(19)))).alias("pages"))


def p7_normalize_reference_pages(spark, sf):
    value = F.concat(F.lit("["), "k", F.lit(', "'), "event_type", F.lit('/page_01", "'), "k", F.lit('", null]'))
    return _events(spark, sf).select("event_id", _join(P.normalize_reference_pages(value, F.col("event_type"))).alias("pages"))


def p8_normalize_keyfacts(spark, sf):
    fact = lambda page, box: F.concat(F.lit('{"page": "'), page, F.lit('", "bbox_2d": ['), box, F.lit("]}"))
    value = F.concat(F.lit("["), fact(F.col("k").cast("string"), F.concat_ws(", ", F.col("k"), F.lit(2), F.lit(30), F.lit(40))), F.lit(", "), fact(F.lit("x"), F.lit("1, 2, 3")), F.lit(', {"bbox_2d": [1, 2, 3, 4]}]'))
    facts = P.normalize_keyfacts(value, F.col("event_type"))
    return _events(spark, sf).select("event_id", F.size(facts).alias("n"), facts[0]["page"].alias("page"), facts[0]["bbox_2d"][0].alias("x1"))


def p9_normalize_anchor(spark, sf):
    value = F.when(F.col("k") % 3 == 0, F.concat_ws("|", F.col("k"), F.lit(" b"), F.lit("a"), F.lit("b"))).when(F.col("k") % 3 == 1, F.concat(F.lit('["z", "a", "'), "event_type", F.lit('"]')))
    return _events(spark, sf).select("event_id", _join(P.normalize_anchor(value)).alias("anchor"))


def p10_normalize_question(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(P.normalize_question(F.col("text"))).alias("q"))


def p11_question_from_turns(spark, sf):
    return P.question_from_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", r"(\w+)[.?!]")


def p12_extract_final_answer(spark, sf):
    text = F.concat(F.lit("x Answer: old "), F.when(F.col("k") % 2 == 0, "Final answer: `a` Final answer: ``").otherwise(""), F.lit(" Answer: "), F.col("event_type"), F.lit("` "))
    return _events(spark, sf).select("event_id", P.extract_final_answer(F.when(F.col("k") % 5 == 0, F.col("event_type")).otherwise(text)).alias("answer"))


def p13_extract_json(spark, sf):
    text = F.concat(F.lit("```json\n"), F.when(F.col("k") % 3 == 0, "{broken").otherwise(F.col("props")), F.lit("\n``` } "[:5]))
    return _events(spark, sf).select("event_id", P.extract_json(text).alias("json"))


def p14_hop(spark, sf):
    return _events(spark, sf).select("event_id", P.hop(F.array_distinct(F.array(F.col("k") % 2, F.col("event_id") % 2)), F.when(F.col("k") % 10 == 0, "given").otherwise("")).alias("hop"))


def p15_safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.safe_name(F.col("url"), 30).alias("name"))


def p16_image_ext(spark, sf):
    data = F.unhex(F.when(F.col("k") % 3 == 0, "FFD8FFE000104A4649460001").when(F.col("k") % 3 == 1, "89504E470D0A1A0A0000000D").otherwise("524946460A0B0C0D57454250"))
    return _events(spark, sf).select("event_id", P.image_ext(data).alias("ext"))


def p17_compact_unique(spark, sf):
    items = F.array(F.col("event_type"), F.upper("event_type"), F.lit("  a  b "), F.lit("A B"), F.lit(" "), (F.col("k") % 3).cast("string"), F.lit("1"))
    return _events(spark, sf).select("event_id", _join(P.compact_unique(items)).alias("same"), _join(P.compact_unique(items, True)).alias("alike"))


def p18_cells_to_labels(spark, sf):
    cell = F.concat(F.char(F.col("k") % 8 + 65), F.col("k") % 9 + 1)
    cells, bad = P.cells_to_labels(F.array(cell, F.lit(" h8 "), F.lit("Z1")))
    return _events(spark, sf).select("event_id", F.aggregate(F.transform(cells, lambda x, i: x.cast("double") * i), F.lit(0.0), lambda s, x: s + x).alias("weighted"), bad.alias("bad"))


def p19_compact_error(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.compact_error(F.col("text"), 40).alias("error"))


def p20_api_error(spark, sf):
    errors = F.array(F.lit(None).cast("string"), F.when(F.col("k") % 2 == 0, F.concat(F.col("event_type"), F.when(F.col("k") % 4 == 0, " Rate Limit hit").otherwise(""))))
    return _events(spark, sf).select("event_id", P.api_error(errors, F.when(F.col("k") % 3 == 0, "HTTP 503 x")).alias("error"))


def p21_scrub(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(P.scrub(F.col("text"), ["[a-m]+", "[.,|]"])).alias("scrubbed"))


def p22_to_conversations(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    out = turns.select("conv_id", F.explode(P.to_conversations(F.col("m"), F.lit("done"))).alias("x"))
    return out.groupBy("conv_id", F.col("x.from").alias("speaker")).agg(F.count("*").alias("n"), F.sum(F.length("x.value")).alias("chars"))


def p23_to_rl_rows(spark, sf):
    qa = _events(spark, sf).select(F.col("event_type").alias("question"), F.col("k").cast("string").alias("answer"), F.col("user_id").alias("deck"), F.array(F.col("k"), F.col("k") + 1).alias("evidence"), F.col("event_id").alias("sample_id"))
    r = P.to_rl_rows(qa, "own")
    return r.select("data_source", "ability", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.sample_id", "extra_info.hop", "env_kwargs.reference_pages")


def p24_rewrite_prefix(spark, sf):
    path = F.concat(F.when(F.col("k") % 2 == 0, "/old/a/").otherwise("/old/"), "event_type")
    return _events(spark, sf).select("event_id", P.rewrite_prefix(path, ["/old/a/", "/old/"], "/corpus/").alias("path"))


def p25_reframe_boxes(spark, sf):
    e = _events(spark, sf).select("event_id", "k", (F.col("k") * 20 + 200).alias("fw"), (F.col("event_id") % 50 * 20 + 200).alias("fh"))
    # the sizes are columns before boxes use them, so that their formulas stand in the plan once
    e = e.withColumn("box", F.array(F.col("k") - 10, F.lit(5), F.col("k") * 3, F.col("event_id") % 300)).withColumn("s", P.shown_size(F.col("fw"), F.col("fh")))
    e = e.select("event_id", "fw", "fh", "box", F.col("s.w").alias("w"), F.col("s.h").alias("h"))
    e = e.withColumn("u", P.unit_box(F.col("box"), F.col("w"), F.col("h")))
    e = e.withColumn("p", P.page_box(F.col("u"), F.col("fw"), F.col("fh"))).withColumn("z", P.box_in_zoom(F.col("u"), F.array(*map(F.lit, (0.25, 0.25, 0.75, 0.75)))))
    return e.select("event_id", "w", "h", F.round(F.col("u")[2], 6).alias("ux2"), F.col("p")[2].alias("px2"), F.round(F.col("z")[3], 6).alias("zy2"))


def p26_crop_region(spark, sf):
    box = F.array(F.col("k") * 10 + 0.5, F.col("event_id") % 700 + 0.25, F.col("k") * 10 + 80.75, F.col("event_id") % 700 + 3.5)
    c = P.crop_region(box, F.lit(1000), F.lit(600))
    return _events(spark, sf).select("event_id", _join(c.cast("array<string>")).alias("crop"))


def p27_index_path(spark, sf):
    return _events(spark, sf).select("event_id", P.index_path(P.parse_index_paths(F.concat(F.lit("click=/c,view=/v/"), "user_id", F.lit(",purchase=/p,signup=/s,error=/e"))), F.col("event_type")).alias("path"))


def p28_unfold_chunks(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    out = P.unfold_chunks(e, 4, ["v"])
    return out.select("vec_id", "chunk", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1].isdigit()}

_E = "WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events)"
_SIDE = "(CASE WHEN nw * nh > 401408 THEN greatest(floor({0} / down / 28) * 28, 28) WHEN nw * nh < 200704 THEN ceil({0} * up / 28) * 28 ELSE {1} END)::BIGINT"
_T = r"'[ \t\n\x0B\f\r]+'"
ORACLE_SQL = {
    "p1_first_present": f"{_E} SELECT event_id, CASE WHEN k % 3 = 1 THEN event_type ELSE user_id::VARCHAR END AS x FROM e",
    "p2_canonical_qa": f"""
{_E} SELECT event_id, CASE WHEN k > 50 THEN event_type END AS question, event_type || ' | ' || user_id AS answer, CASE WHEN k % 2 = 0 THEN k ELSE event_id
END::VARCHAR AS sample_id FROM e""",
    "p3_reference_pages": r"SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url, '\d+'), lambda x: x::INT))), ','), '') AS pages FROM pages",
    "p4_page_label": f"{_E} SELECT event_id, printf('%s/page_%02d', event_type, k) AS label FROM e",
    "p5_page_key": f"{_E} SELECT event_id, CASE k % 4 WHEN 0 THEN event_type || '/x' WHEN 1 THEN event_type WHEN 2 THEN '' END AS deck, CASE WHEN k % 4 < 3 THEN k END AS n FROM e",
    "p6_normalize_pages": f"""
{_E}, x AS (SELECT event_id, unnest([k, k % 7, k % 5, k % 7 + 1, 3, 19]) AS p, generate_subscripts([1, 1, 1, 1, 1, 1], 1) AS i FROM e), f AS (SELECT event_id,
p, min(i) AS i FROM x WHERE p BETWEEN 1 AND 20 GROUP BY 1, 2) SELECT event_id, array_to_string(list(p ORDER BY i)[:4], ',') AS pages FROM f GROUP BY 1""",
    "p7_normalize_reference_pages": f"""
{_E} SELECT event_id, CASE WHEN k = 1 THEN printf('%s/page_01', event_type) ELSE printf('%s/page_%02d,%s/page_01', event_type, k, event_type) END AS pages FROM
e""",
    "p8_normalize_keyfacts": f"{_E} SELECT event_id, 1 AS n, printf('%s/page_%02d', event_type, k) AS page, k::DOUBLE AS x1 FROM e",
    "p9_normalize_anchor": f"""
{_E} SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(CASE k % 3 WHEN 0 THEN [k::VARCHAR, 'a', 'b'] WHEN 1 THEN ['z', 'a', event_type] END)),
','), '') AS anchor FROM e""",
    "p10_normalize_question": f"SELECT doc_id, md5(trim(regexp_replace(lower(text), {_T}, ' ', 'g'))) AS q FROM documents",
    "p11_question_from_turns": r"WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, nullif(regexp_extract(t, '([0-9A-Za-z_]+)[.?!]', 1), '') AS question FROM t",
    "p12_extract_final_answer": "SELECT event_id, event_type AS answer FROM events",
    "p13_extract_json": f"{_E} SELECT event_id, CASE WHEN k % 3 <> 0 THEN props END AS json FROM e",
    "p14_hop": f"{_E} SELECT event_id, CASE WHEN k % 10 = 0 THEN 'given' WHEN k % 2 <> event_id % 2 THEN 'multi' ELSE 'single' END AS hop FROM e",
    "p15_safe_name": "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 30) AS name FROM pages",
    "p16_image_ext": f"{_E} SELECT event_id, ['jpg', 'png', 'webp'][k % 3 + 1] AS ext FROM e",
    "p17_compact_unique": f"""
{_E} SELECT event_id, event_type || ',' || upper(event_type) || ',  a  b ,A B, ,' || k % 3 || CASE WHEN k % 3 <> 1 THEN ',1' ELSE '' END AS same, event_type ||
',a b,' || k % 3 || CASE WHEN k % 3 <> 1 THEN ',1' ELSE '' END AS alike FROM e""",
    "p18_cells_to_labels": f"""
{_E} SELECT event_id, (63 + CASE WHEN k % 9 < 8 AND (k % 8) * 8 + k % 9 <> 63 THEN (k % 8) * 8 + k % 9 ELSE 0 END)::DOUBLE AS weighted, CASE WHEN k % 9 < 8 THEN
1 ELSE 2 END AS bad FROM e""",
    "p19_compact_error": f"SELECT doc_id, substr(trim(regexp_replace(text, {_T}, ' ', 'g')), 1, 40) AS error FROM documents",
    "p20_api_error": f"{_E} SELECT event_id, CASE WHEN k % 4 = 0 THEN event_type || ' Rate Limit hit' WHEN k % 2 = 0 THEN NULL WHEN k % 3 = 0 THEN 'HTTP 503 x' END AS error FROM e",
    "p21_scrub": f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[a-m]+', ' ', 'g'), '[.,|]', ' ', 'g'), {_T}, ' ', 'g'))) AS scrubbed FROM documents",
    "p22_to_conversations": """
WITH m AS (SELECT conv_id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS speaker, length(text) AS c FROM conversations UNION
ALL SELECT DISTINCT conv_id, 'gpt', 4 FROM conversations) SELECT conv_id, speaker, count(*) AS n, sum(c)::BIGINT AS chars FROM m GROUP BY 1, 2""",
    "p23_to_rl_rows": f"""
{_E} SELECT 'own' AS data_source, 'doc_qa' AS ability, event_type AS content, k::VARCHAR AS ground_truth, event_id AS sample_id, 'multi' AS hop, '[' || k || ','
|| k + 1 || ']' AS reference_pages FROM e""",
    "p24_rewrite_prefix": "SELECT event_id, '/corpus/' || event_type AS path FROM events",
    "p25_reframe_boxes": f"""{_E}, s AS (SELECT event_id, k, k * 20 + 200 AS w, event_id % 50 * 20 + 200 AS h FROM e),
 n AS (SELECT *, greatest(round_even(w / 28, 0) * 28, 28) AS nw, greatest(round_even(h / 28, 0) * 28, 28) AS nh, sqrt((w * h)::DOUBLE / 401408) AS down, sqrt(200704::DOUBLE / (w * h)) AS up FROM s),
 g AS (SELECT *, {_SIDE.format("w", "nw")} AS sw, {_SIDE.format("h", "nh")} AS sh FROM n),
 u AS (SELECT *, least(sw, greatest(0, k - 10)) / sw::DOUBLE AS x1, least(sh, 5) / sh::DOUBLE AS y1, least(sw, k * 3) / sw::DOUBLE AS x2, least(sh, event_id % 300) / sh::DOUBLE AS y2 FROM g),
 b AS (SELECT *, (x2 - x1) * sw >= 4 AND (y2 - y1) * sh >= 4 AS good FROM u)
 SELECT event_id, sw AS w, sh AS h, CASE WHEN good THEN round(x2, 6) END AS ux2, CASE WHEN good THEN round_even(x2 * w, 0) END AS px2, CASE WHEN good THEN round(0.25 + y2 * 0.5, 6) END AS zy2 FROM b""",
    "p26_crop_region": f"""{_E}, b AS (SELECT event_id, greatest(floor(k * 10 + 0.5 - 28), 0)::BIGINT AS x1, greatest(floor(event_id % 700 + 0.25 - 28), 0)::BIGINT AS y1, least(ceil(k * 10 + 80.75 + 28), 1000)::BIGINT AS x2, least(ceil(event_id % 700 + 3.5 + 28), 600)::BIGINT AS y2 FROM e)
 SELECT event_id, CASE WHEN x2 > x1 AND y2 > y1 AND greatest(x2 - x1, y2 - y1) <= 180 * least(x2 - x1, y2 - y1) THEN x1 || ',' || y1 || ',' || x2 || ',' || y2 END AS crop FROM b""",
    "p27_index_path": "SELECT event_id, CASE event_type WHEN 'click' THEN '/c' WHEN 'view' THEN '/v/' || user_id WHEN 'purchase' THEN '/p' WHEN 'signup' THEN '/s' ELSE '/e' END AS path FROM events",
    "p28_unfold_chunks": """
SELECT vec_id, c::INT AS chunk, round(list_sum(list_transform(embedding[c * 16 + 1:c * 16 + 16], lambda x: x::DOUBLE)), 6) AS total FROM embeddings,
unnest(range(4)) AS t(c)""",
}
