"""Streams with state of their own: files that grow, snapshots of latest rows, rows that wait, memories with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.streaming import jobs
from foliant.streaming.keepers import keep_in_rocksdb, keep_memory, release_when_due
from foliant.streaming.latest import LatestTable, latest_rows
from foliant.streaming.tail import tail_predictions

from .files import _SCHEMA, _in_order, _new, _prediction_files
from .tables import table

#: Bytes of a file's last line that come with the next step.
TORN = 6


def _grown(rows: DataFrame, root: str, step: int) -> None:
    """rows: file, event_id, t, top (the table's last id). At step 0 each file gets its first half but for the end of the last line; at
    step 1 the rest of the line and of the rows, or, where t is a multiple of five, a shorter file of the last quarter in its place.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = pafs.FileSystem.from_uri(root)
        system.create_dir(folder)
        text = lambda part: "".join(f'{{"t": {i}}}\n' for i in part).encode()
        for batch in batches:
            for file, user, top, ids in zip(batch["file"], batch["user"], batch["top"], batch["ids"].map(lambda x: x.tolist()), strict=True):
                path, first = f"{folder}/{file}.jsonl", text(i for i in ids if i * 2 < top)[:-TORN]
                if step == 0:
                    if first:
                        with system.open_output_stream(path) as out:
                            out.write(first)
                elif user % 5 == 0:
                    with system.open_output_stream(path) as out:
                        out.write(text(i for i in ids if i * 4 >= top * 3))
                else:
                    with system.open_append_stream(path) as out:
                        out.write(text(ids)[len(first) :])
            yield pd.DataFrame({"n": [len(batch)]})

    files = rows.groupBy("file").agg(F.first("t").alias("user"), F.first("top").alias("top"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    files.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def x1_tail_growing(spark, sf):
    """A file a user, read while it is half there with a torn line, and again when it has grown, or shrunk for every fifth user."""
    e = table(spark, sf, "events")
    top = F.broadcast(e.agg(F.max("event_id").alias("top")))  # one row
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "event_id", F.col("user_id").alias("t")).crossJoin(top)
    root, out, checkpoint = _new(spark), _new(spark), _new(spark)
    for step in range(2):
        _grown(rows, root, step)
        stream = tail_predictions(spark, root, "t long").where("bad IS NULL")
        stream.select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("file"), "line", "t").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("file string, line long, t long").parquet(out)


def _latest(spark, path, schema):
    """Small buckets and early compaction, so that every part of the table is in use."""
    return LatestTable(spark, path, schema, "sample_id", "t", "seq", bucket_rows=150, share=0.5, waiting=40)


def x6_latest_snapshot(spark, sf):
    e = table(spark, sf, "events").select(F.pmod("event_id", F.lit(700)).alias("sample_id"), F.col("event_id").alias("t"), F.col("event_type").alias("answer"), F.col("event_id").alias("seq"))
    path, landing, checkpoint = _in_order(spark, e, "t"), _new(spark), _new(spark)
    latest = _latest(spark, _new(spark), "sample_id string, t long, answer string, seq long")
    for step in range(4):
        spark.read.schema(e.schema).parquet(f"{path}/step={step}").write.mode("append").parquet(landing)
        latest_rows(spark.readStream.schema(e.schema).parquet(landing), latest, checkpoint).awaitTermination()
    return latest.read().select("sample_id", "t", "answer")


def x6_missing_count(spark, sf):
    """What a snapshot of events lacks, where every document is expected."""
    stream = jobs.stream_predictions(spark, _prediction_files(spark, sf), _SCHEMA, 1).select("sample_id", "t", F.col("t").alias("seq"))
    latest = _latest(spark, _new(spark), "sample_id string, t long, seq long")
    latest_rows(stream, latest, _new(spark)).awaitTermination()
    return jobs.missing_count(latest.read(), "sample_id", table(spark, sf, "documents").count())


def x5_release_when_due(spark, sf):
    """Events wait by user until 20 are there, or all of the user's; a poll is one of four steps of files."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    e = e.join(e.groupBy("user_id").agg(F.count("*").alias("expected")), "user_id")
    path, landing, checkpoint, out = _in_order(spark, e, "event_id"), _new(spark), _new(spark), _new(spark)
    keep_in_rocksdb(spark)
    for step in range(4):
        spark.read.schema(e.schema).parquet(f"{path}/step={step}").write.mode("append").parquet(landing)
        due = release_when_due(spark.readStream.schema(e.schema).parquet(landing), "user_id", "event_id", 20, "expected")
        due.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("user_id long, event_id long, batch long").parquet(out).select("user_id", "event_id", "batch")


def x8_keep_memory(spark, sf):
    """Facts and refused turns of each user, whose turns arrive in three steps of files; the last one answers, or is an error for every third user."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    empty = F.array().cast("array<string>")
    op = F.when(F.col("event_id") == F.col("last"), F.when(F.col("user_id") % 3 == 0, "error").otherwise("answer"))
    no_text = [F.lit(None).cast("string").alias(c) for c in ("node", "answered", "answer", "next")]
    # a purchase updates the first fact of its page; it is refused where the page has none
    turns = e.join(last, "user_id").select(
        "user_id", "event_id", F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string")).alias("view"), F.when(F.col("event_type") == "click", F.array(F.col("event_type"))).otherwise(empty).alias("added"),
        F.when(F.col("event_type") == "purchase", F.array(F.struct(F.lit(1).alias("n"), F.lit("u").alias("text")))).alias("updated"), op.alias("op"), *no_text, empty.alias("pages"),
    )
    path, landing, checkpoint, out = _in_order(spark, turns, "event_id", parts=3), _new(spark), _new(spark), _new(spark)
    keep_in_rocksdb(spark)
    for step in range(3):
        spark.read.schema(turns.schema).parquet(f"{path}/step={step}").write.mode("append").parquet(landing)
        kept = keep_memory(spark.readStream.schema(turns.schema).parquet(landing), "user_id", "event_id")
        digest = kept.select("user_id", F.size("facts").cast("long").alias("n_facts"), F.aggregate("facts", F.lit(0).cast("long"), lambda a, f: a + f["revision"]).alias("n_updates"), F.size("errors").cast("long").alias("n_refused"), "ended")
        digest.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("user_id long, n_facts long, n_updates long, n_refused long, ended string").parquet(out)


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "x" and k[1].isdigit()}

ORACLE_SQL = {
    "x1_tail_growing": """
WITH e AS (SELECT 'u' || user_id AS file, event_id AS t, user_id % 5 = 0 AS shrinks, (SELECT max(event_id) FROM events) AS top FROM events),
early AS (SELECT file, t, row_number() OVER (PARTITION BY file ORDER BY t) - 1 AS line, count(*) OVER (PARTITION BY file) AS n FROM e WHERE shrinks AND 2 * t < top)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY t) - 1 AS line, t FROM e WHERE NOT shrinks
UNION ALL SELECT file, line, t FROM early WHERE line < n - 1
UNION ALL SELECT file, row_number() OVER (PARTITION BY file ORDER BY t) - 1, t FROM e WHERE shrinks AND 4 * t >= 3 * top""",
    "x6_latest_snapshot": """
SELECT (event_id % 700)::VARCHAR AS sample_id, max(event_id) AS t, arg_max(event_type, event_id) AS answer FROM events GROUP BY 1""",
    "x6_missing_count": """
WITH u AS (SELECT count(DISTINCT event_id % 700) AS n FROM events), d AS (SELECT count(*) AS m FROM documents)
SELECT n AS unique_ids, m AS expected, greatest(0, m - n) AS missing FROM u, d""",
    "x5_release_when_due": """
WITH RECURSIVE e AS (SELECT user_id, event_id, floor(event_id * 4.0 / ((SELECT max(event_id) FROM events) + 1))::INT AS poll FROM events),
a AS (SELECT u.user_id, p.poll, count(e.event_id) AS came FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN (SELECT unnest(range(4)) AS poll) p LEFT JOIN e USING (user_id, poll) GROUP BY 1, 2),
s AS (SELECT user_id, poll, came, sum(came) OVER (PARTITION BY user_id ORDER BY poll) AS seen, sum(came) OVER (PARTITION BY user_id) AS expected FROM a),
r AS (SELECT user_id, -1 AS poll, 0::HUGEINT AS out, 0::HUGEINT AS done, 0 AS batch FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, s.poll, n, done + n, batch + (n > 0)::INT FROM (SELECT r.user_id, r.poll, r.done, r.batch,
  CASE WHEN s.came = 0 THEN 0 WHEN s.seen >= s.expected THEN s.seen - r.done WHEN s.seen - r.done >= 20 THEN 20 ELSE 0 END AS n FROM r JOIN s ON r.user_id = s.user_id AND s.poll = r.poll + 1) t
  JOIN s USING (user_id) WHERE s.poll = t.poll + 1),
o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM e)
SELECT o.user_id, event_id, batch::BIGINT AS batch FROM o JOIN r ON o.user_id = r.user_id AND place > done - out AND place <= done""",
    "x8_keep_memory": """
WITH e AS (SELECT user_id, event_id, event_type, event_id % 3 AS page, max(event_id) OVER (PARTITION BY user_id) AS last FROM events),
t AS (SELECT *, event_id = last AND user_id % 3 = 0 AS error FROM e),
f AS (SELECT *, coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id, page ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS facts FROM t WHERE NOT error)
SELECT user_id, count(*) FILTER (NOT error AND event_type = 'click') AS n_facts, coalesce(any_value(u), 0)::BIGINT AS n_updates, coalesce(any_value(x), 0)::BIGINT AS n_refused,
 CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'answer' END AS ended
FROM t LEFT JOIN (SELECT user_id, sum((event_type = 'purchase' AND facts > 0)::INT) AS u, sum((event_type = 'purchase' AND facts = 0)::INT) AS x FROM f GROUP BY 1) USING (user_id) GROUP BY user_id""",
}
