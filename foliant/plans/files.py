"""Sources, sinks and streams over files that Spark derives from the driver's tables, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.scorers import exact_match
from foliant.sources import io
from foliant.sources.scratch import shared_folder
from foliant.streaming import jobs

from .tables import table


def _new(spark):
    return f"{shared_folder(spark)}/foliant/{uuid.uuid4().hex}"


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic")


def s1_read_jsonl(spark, sf):
    """Files that begin with an empty line, which the start skips, and hold others."""
    path = _new(spark)
    line = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.to_json(F.struct("doc_id", "quality")))
    rows = _labels(spark, sf).select((F.col("doc_id") % 8).alias("part"), F.lit(1).alias("first"), line.alias("value"))
    heads = rows.select("part", F.lit(0).alias("first"), F.lit("").alias("value")).distinct()
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "first").select("part", "value").write.partitionBy("part").text(path)
    return io.read_jsonl(spark, f"{path}/part=*", "doc_id long, quality int", start=1).groupBy("quality").agg(F.count("*").alias("n"))


def s1_read_jsonl_limit(spark, sf):
    """The first hundred rows of each file, in the order in which it holds them."""
    path = _new(spark)
    rows = _labels(spark, sf).select((F.col("doc_id") % 8).alias("part"), "doc_id", F.to_json(F.struct("doc_id", "quality")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return io.read_jsonl(spark, f"{path}/part=*", "doc_id long, quality int", limit=100)


def s2_read_jsonl_lenient(spark, sf):
    path = _new(spark)
    line = F.to_json(F.struct("doc_id", "quality"))
    _labels(spark, sf).select(F.when(F.col("doc_id") % 9 == 0, F.substring(line, 1, 14)).otherwise(line).alias("value")).write.text(path)
    good, bad = io.read_jsonl_lenient(spark, path, "doc_id long, quality int")
    return good.select(F.col("doc_id").cast("string").alias("x"), F.lit("good").alias("side")).unionByName(bad.select(F.col("line").alias("x"), F.lit("bad").alias("side")))


def s3_read_qa_parquet(spark, sf):
    return io.read_qa_parquet(spark, f"{sf}/documents.parquet", ["doc_id", "lang"])


def s4_unpivot_pages(spark, sf):
    """As many page columns as the longest conversation has turns."""
    c = table(spark, sf, "conversations")
    turns = (c.agg(F.max("turn")).first()[0] or 0) + 1
    wide = c.groupBy("conv_id").agg(*(F.max(F.when(F.col("turn") == k, F.struct(F.col("text").cast("binary").alias("bytes")))).alias(f"page_{k + 1}") for k in range(turns)))
    return io.unpivot_pages(wide.unionByName(wide), "conv_id").select("conv_id", "page", F.length("bytes").alias("size"))


def _page_tree(spark, sf):
    """One file per page, fifty in a folder of its deck."""
    path = _new(spark)
    place = F.format_string("deck=%d/n=%d/page.txt", F.expr("page_id div 50"), F.col("page_id") % 50)
    io.put_files(table(spark, sf, "pages").select("page_id", place.alias("path"), F.concat("url", F.lit("\n")).alias("value")).repartition(F.expr("page_id div 50")), path)
    return path


def s5_scan_page_files(spark, sf):
    files = io.scan_page_files(spark, _page_tree(spark, sf), ["txt"])
    return files.select(F.regexp_extract("path", r"(deck=\d+/n=\d+)/", 1).alias("place"))


def s6_parse_page_files(spark, sf):
    files = io.scan_page_files(spark, _page_tree(spark, sf), ["txt"]).select(F.regexp_replace("path", r"^.*deck=(\d+)/n=(\d+)/.*$", "/x/$1_$2.jpg").alias("path"))
    return io.parse_page_files(files, "path", r"^(\d+)_(\d+)\.jpg$", 0).select("deck", "page", "label")


def s7_read_index_entries(spark, sf):
    path = _new(spark)
    p = table(spark, sf, "pages").select(F.col("page_id"), F.concat(F.lit("img/page_"), F.col("page_id"), F.lit(".png")).alias("f"))
    p.select(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"'), "f", F.lit('"'))).otherwise(F.to_json(F.struct(F.col("f").alias("image_path"), F.when(F.col("page_id") % 3 == 0, F.lit("named")).alias("page_label")))).alias("value")).write.text(path)
    return io.read_index_entries(spark, path)


def s8_append_new(spark, sf):
    path, d = _new(spark), _labels(spark, sf).withColumnRenamed("doc_id", "sample_id")
    io.append_new(d.where("sample_id % 3 = 0"), path)
    return io.append_new(d.withColumn("quality", F.lit(9)), path)


def s9_write_verified(spark, sf):
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("quality", T.LongType())])
    return io.write_verified(_labels(spark, sf), _new(spark), schema, "doc_id", ["quality", "doc_id"])


def s10_write_summary(spark, sf):
    path = _new(spark)
    io.write_summary(_labels(spark, sf).agg(F.count("*").alias("n"), F.sum("quality").alias("good")), path)
    return spark.read.schema("n long, good long").json(path)


def s11_verify_manifest(spark, sf):
    """One file for fifty ids; of each four files one is missing, one of a wrong size, one with a wrong checksum."""
    path = _new(spark)
    _labels(spark, sf).withColumn("part", F.expr("doc_id div 50")).repartition("part").write.partitionBy("part").json(path)
    found = io.manifest(spark, path).where("path LIKE 'part=%'")
    kind = F.regexp_extract("path", r"^part=(\d+)/", 1).cast("long") % 4
    off = found.where(kind != 0).withColumn("bytes", F.when(kind == 1, 0).otherwise(F.col("bytes"))).withColumn("sha256", F.when(kind == 2, "x").otherwise(F.col("sha256")))
    return io.verify_manifest(found, off).select(F.regexp_extract("path", r"^(part=\d+)/", 1).alias("part"), "error")


def s12_discover_runs(spark, sf):
    """A run per user and kind of event, in folders of their users; those of every fourth user are merged ones and left out."""
    path = _new(spark)
    e = table(spark, sf, "events").select(F.concat(F.when(F.col("user_id") % 4 == 0, "merged_").otherwise("eval_"), F.col("user_id")).alias("owner"), F.col("event_type").alias("run"), F.to_json(F.struct("event_id", "value")).alias("value"))
    place = F.concat(F.lit("owner="), "owner", F.lit("/run="), F.coalesce(F.url_encode("run"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/run.txt"))
    io.put_files(e.where("owner IS NOT NULL").groupBy("owner", "run").agg(F.max("value").alias("value")).select(place.alias("path"), F.concat("value", F.lit("\n")).alias("value")), path)
    tidied = io.discover_runs(spark, path, "*.txt").where(~F.col("path").rlike("/owner=merged_[^/]*/"))
    return tidied.groupBy(F.regexp_extract("parent", r"owner=(\w+)$", 1).alias("owner")).agg(F.count_distinct("run").alias("runs"), F.count(F.when(F.col("newest"), 1)).alias("newest"))


def s13_dump_generations(spark, sf):
    path = _new(spark)
    io.dump_generations(_labels(spark, sf).withColumn("step", F.col("doc_id") % 5), path)
    return spark.read.schema("doc_id long, quality int, toxic int, step int").json(path).groupBy("step").agg(F.count("*").alias("n"))


def s14_fanout(spark, sf):
    path = _new(spark)
    io.fanout(_labels(spark, sf), {"all": F.lit(True), "kept": F.col("quality") == 1, "rejected": F.col("quality") == 0}, path)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("n"))


_SCHEMA = "sample_id long, t long, verdict boolean, judge_error string, answer string"


def _prediction_files(spark, sf):
    e = table(spark, sf, "events").select(F.pmod("event_id", F.lit(700)).alias("sample_id"), F.col("event_id").alias("t"), F.when(F.col("user_id") % 5 == 0, True).alias("verdict"), F.lit(None).cast("string").alias("judge_error"), F.col("event_type").alias("answer"))
    path = _new(spark)
    e.repartition(4, "t").write.json(path, ignoreNullFields=True)
    return path


def x2_commit_scored(spark, sf):
    """Every row is a sample here; each is scored and committed once."""
    path, out = _prediction_files(spark, sf), _new(spark)
    stream = jobs.stream_predictions(spark, path, _SCHEMA)
    jobs.commit_scored(stream.withColumn("sample_id", F.col("t")), out, _new(spark), "sample_id", exact_match(F.col("answer"), F.lit("click")) == 1).awaitTermination()
    return spark.read.parquet(out).select("sample_id", "verdict", "judge_error")


def x3_stream_totals(spark, sf):
    totals = jobs.stream_totals(jobs.stream_predictions(spark, _prediction_files(spark, sf), _SCHEMA, 1), "answer", "verdict")
    out = _new(spark)
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    totals.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", _new(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(out)


def _in_order(spark, df, order, parts=4):
    """Closed files of an ordered table, written one after the other; each is several parts."""
    path, top = _new(spark), (df.agg(F.max(order)).first()[0] or 0) + 1
    for i in range(parts):
        df.where(F.floor(F.col(order) * parts / top) == i).write.mode("append").parquet(f"{path}/step={i}")
    return path


def x5_score_when_due(spark, sf):
    """Scored when five hundred wait, and all of them once every row is in."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), F.lit(None).cast("boolean").alias("verdict"), F.lit(None).cast("string").alias("judge_error"), F.lit(None).cast("string").alias("bad"), F.col("event_type").alias("answer"))
    path, out = _in_order(spark, e, "sample_id"), _new(spark)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/step=*")
    jobs.score_when_due(stream, out, _new(spark), "sample_id", exact_match(F.col("answer"), F.lit("click")) == 1, 500, expected=e.count()).awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{out}/scored").select("sample_id", "verdict")


def x7_commit_until(spark, sf):
    """Committed in order until a third of the clicks are kept or an error of user 7 comes in."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    kept, fatal = F.col("event_type") == "click", (F.col("event_type") == "error") & (F.col("user_id") % 50 == 7)
    path, out = _in_order(spark, e, "event_id"), _new(spark)
    for i in range(4):  # a restart for each step of files
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/step={i}")
        jobs.commit_until(stream, out, _new(spark), "event_id", kept, fatal, e.where(kept).count() // 3).awaitTermination()
    return spark.read.schema(e.schema).parquet(out).select("event_id")

def x1_stream_predictions(spark, sf):
    out = _new(spark)
    stream = jobs.stream_predictions(spark, _prediction_files(spark, sf), _SCHEMA, 2)
    stream.where("bad IS NULL").select("sample_id", "t", "answer").writeStream.format("parquet").option("checkpointLocation", _new(spark)).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("sample_id long, t long, answer string").parquet(out)


def x8_stream_memory(spark, sf):
    """Turns arrive in three steps of files; the last one of each user answers, or is an error for every third user."""
    from .nested import _tree_turns

    turns, out = _tree_turns(spark, sf), _new(spark)
    last = turns.groupBy(F.col("user_id").alias("_u")).agg(F.max("event_id").alias("_m"))
    turns = turns.join(last, F.col("user_id") == F.col("_u")).withColumn("op", F.when(F.col("event_id") == F.col("_m"), F.when(F.col("user_id") % 3 == 0, "error").otherwise("answer")).otherwise(F.col("op"))).drop("_u", "_m")
    path, checkpoint, landing = _in_order(spark, turns, "event_id", parts=3), _new(spark), _new(spark)
    for step in (f"{path}/step={i}" for i in range(3)):  # one run of the stream for each step, whose files all come before those of the next
        spark.read.schema(turns.schema).parquet(step).write.mode("append").parquet(landing)
        stream = jobs.stream_memory(spark.readStream.schema(turns.schema).parquet(landing), "user_id", "event_id")
        stream.select("user_id", F.size("nodes").alias("n_nodes"), "active", "ended").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("user_id long, n_nodes int, active string, ended string").parquet(out)


def x4_pending(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, True).alias("verdict"))
    side = table(spark, sf, "events").select(F.pmod("event_id", F.lit(1500)).alias("doc_id"), F.when(F.col("event_type") == "click", True).alias("verdict")).where("verdict IS NULL OR doc_id % 2 = 0")
    return jobs.pending(rows, side, "doc_id", "verdict", 6).select("doc_id")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "sx" and k[1].isdigit()}

_E = "WITH e AS (SELECT event_id % 700 AS sample_id, event_id AS t, user_id % 5 = 0 AS v, event_type AS answer FROM events)"
ORACLE_SQL = {
    "s1_read_jsonl": "SELECT quality, count(*) AS n FROM labels WHERE doc_id % 10 <> 0 GROUP BY 1",
    "s1_read_jsonl_limit": "SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) <= 100",
    "s2_read_jsonl_lenient": """SELECT CASE WHEN doc_id % 9 = 0 THEN substr('{"doc_id":' || doc_id || ',"quality":', 1, 14) ELSE doc_id::VARCHAR END AS x, CASE WHEN doc_id % 9 = 0 THEN 'bad' ELSE 'good' END AS side FROM labels""",
    "s3_read_qa_parquet": "SELECT doc_id, lang FROM documents",
    "s4_unpivot_pages": "SELECT conv_id, (turn + 1)::INT AS page, strlen(text)::INT AS size FROM conversations",
    "s5_scan_page_files": "SELECT 'deck=' || page_id // 50 || '/n=' || page_id % 50 AS place FROM pages",
    "s6_parse_page_files": "SELECT (page_id // 50)::VARCHAR AS deck, (page_id % 50 + 1)::INT AS page, page_id // 50 || '/page_' || lpad((page_id % 50 + 1)::VARCHAR, 2, '0') AS label FROM pages",
    "s11_verify_manifest": "SELECT DISTINCT 'part=' || doc_id // 50 AS part, ['missing', 'size', 'sha256'][doc_id // 50 % 4 + 1] AS error FROM labels WHERE doc_id // 50 % 4 < 3",
    "s7_read_index_entries": "SELECT 'img/page_' || page_id || '.png' AS image_path, CASE WHEN page_id % 2 = 1 AND page_id % 3 = 0 THEN 'named' ELSE 'page_' || page_id END AS page_label FROM pages",
    "s8_append_new": "SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN quality ELSE 9 END AS quality, toxic FROM labels",
    "s9_write_verified": "SELECT doc_id::VARCHAR AS doc_id, quality::BIGINT AS quality FROM labels",
    "s10_write_summary": "SELECT count(*) AS n, sum(quality)::BIGINT AS good FROM labels",
    "s12_discover_runs": "SELECT 'eval_' || user_id AS owner, count(DISTINCT event_type) AS runs, 1::BIGINT AS newest FROM events WHERE user_id % 4 <> 0 GROUP BY user_id",
    "s13_dump_generations": "SELECT (doc_id % 5)::INT AS step, count(*) AS n FROM labels GROUP BY 1",
    "s14_fanout": "SELECT 'all' AS outcome, count(*) AS n FROM labels UNION ALL SELECT CASE quality WHEN 1 THEN 'kept' ELSE 'rejected' END, count(*) FROM labels GROUP BY 1",
    "x1_stream_predictions": f"{_E} SELECT sample_id, t, answer FROM e",
    "x2_commit_scored": f"{_E} SELECT t AS sample_id, v OR answer = 'click' AS verdict, NULL::VARCHAR AS judge_error FROM e",
    "x3_stream_totals": f"{_E} SELECT answer, count(*) AS seen, count(*) FILTER (v) AS judged, nullif(count(*) FILTER (v), 0) AS correct FROM e GROUP BY 1",
    "x5_score_when_due": "SELECT event_id AS sample_id, event_type = 'click' AS verdict FROM events",
    "x7_commit_until": """
WITH c AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE event_type = 'click'), s AS (SELECT least(coalesce((SELECT
min(event_id) FROM events WHERE event_type = 'error' AND user_id % 50 = 7), 1e18), coalesce((SELECT event_id FROM c WHERE i = (SELECT count(*) // 3 FROM c)),
1e18)) AS stop) SELECT event_id FROM events, s WHERE event_id <= stop""",
    "x4_pending": """
WITH s AS (SELECT event_id % 1500 AS d, event_type = 'click' AS v FROM events WHERE event_type <> 'click' OR event_id % 1500 % 2 = 0), n AS (SELECT d, count(*)
AS n, count(*) FILTER (v) AS v FROM s GROUP BY 1) SELECT doc_id FROM documents LEFT JOIN n ON d = doc_id WHERE doc_id % 4 <> 0 AND coalesce(n, 0) < 6 AND
coalesce(v, 0) = 0""",
}
