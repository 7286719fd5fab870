"""Mixing sources to target weights by systematic sampling.

Within a source every document expects `target / source size` copies. The expected copies are summed along a fixed
order of the source's documents, one offset in [0, 1) is added, and a document is emitted once for each integer that
the sum passes at it. The order runs by size, so what a source gives differs from its target by little more than the
spread of sizes at one place of the order.

The prefix sums are taken in steps, so that no source, however large, meets in one task: documents get their place
inside (source, size class, bucket), buckets inside (source, size class), classes inside a source. A class is one
sixteenth of an octave of sizes and a bucket is a hash of the id (of the text where there is no id), so equal documents
spread over all buckets.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; sources of size 0 have the
target 0; repeated rows are separate documents; ties in size are ordered by hashes of id and text, so reruns draw the
same; a text of any length counts by its words; an empty table gives an empty mix; `mix` reads the id, the source and
the text only, and `mixed_documents` hands all columns on whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, row_key, settle

BUCKETS = 64
SUB_CLASSES = 16
#: Copies of one document that one task writes, at most.
COPIES = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash16(value: Column) -> Column:
    """A whole number below 65536 from the MD5 of a string."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 4), 16, 10).cast("long")


def _named(source: Column) -> Column:
    """Sources as group keys: null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: source_size, n_docs, target.

    One row a source is worked on in one task: sources are taken to be names, thousands at most, not keys of documents.
    Sources by code point, null last, take the weights in turn; together they get `share` of all sizes. A target stops
    at `most` times its source's size and what is over goes to the others by weight, which comes to
    min(most * size, level * weight) with one level for all; the level is where the sums meet.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_docs"), F.max("_null").alias("_null"))
    every = Window.orderBy("_null", "_source")
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_source")
    below = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - below) / left
    levels = weighed.withColumn("_level", level).withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("_w")).withColumn("_place", F.row_number().over(up))
    found = F.min(F.when(F.col("_fits"), F.struct("_place", "_level"))).over(whole)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(found, F.lit(float("inf"))) * F.col("_w"))
    return levels.select("_source", "source_size", "n_docs", target.alias("target"))


def _drawn(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """_id, _src, _row (the same in rows with equal id, source and text), _size, source_size, target, copies."""
    size = F.col("_size")
    octave = F.length(F.bin(F.greatest(size, F.lit(1)))) - 1
    text = F.col(text_col).cast("string")
    named = F.coalesce(F.col(id_col).cast("string"), F.md5(text.cast("binary")), F.lit("")).alias("_name")
    key = row_key(F.col(id_col), F.col(source_col), text).alias("_row")
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), key, named, n_words(text).alias("_size"))
    sizes = sizes.select("*", _named(F.col("_src")).alias("_source"), F.col("_src").isNull().cast("int").alias("_null"))
    sizes = settle(
        sizes.withColumn("_octave", octave)
        .withColumn("_class", F.expr(f"CASE WHEN _size = 0 THEN 0 ELSE 1 + _octave * {SUB_CLASSES} + shiftright(_size * {SUB_CLASSES}, _octave) % {SUB_CLASSES} END").cast("int"))
        .withColumn("_bucket", (_hash16(F.col("_name")) % BUCKETS).cast("int"))
        .drop("_octave")
    )
    targets = source_targets(sizes, weights, share, most)
    cells = sizes.groupBy("_source", "_class", "_bucket").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_class = cells.withColumn("_before", before(Window.partitionBy("_source", "_class").orderBy("_bucket")))
    classes = cells.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"))
    classes = classes.select("_source", "_class", before(Window.partitionBy("_source").orderBy("_class")).alias("_first"))
    offset = _hash16(F.concat(F.lit(seed), F.lit("-"), F.col("_source"))) / F.lit(65536.0)
    start = (F.col("_first") + F.col("_before")).alias("_start")
    places = in_class.join(classes, ["_source", "_class"]).join(targets, "_source")
    places = places.select("_source", "_class", "_bucket", start, "source_size", "target", offset.alias("_offset"))
    order = Window.partitionBy("_source", "_class", "_bucket").orderBy("_size", F.md5(F.col("_name").cast("binary")), "_id", "_row")
    placed = sizes.withColumn("_rank", F.row_number().over(order)).join(places, ["_source", "_class", "_bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    passed = lambda place: F.floor(F.col("_offset") + rate * place)
    place = F.col("_start") + F.col("_rank")
    copies = F.least(passed(place) - passed(place - 1), F.ceil(rate)).cast("long")
    return placed.withColumn("copies", copies)


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), copies, taken (copies * size)."""
    drawn = _drawn(docs, weights, share, most, seed, id_col, source_col, text_col)
    taken = (F.col("copies") * F.col("_size")).alias("taken")
    return drawn.select(F.col("_id").alias(id_col), F.col("_src").alias(source_col), F.col("_size").alias("size"), "source_size", "target", "copies", taken)


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows with equal id, source and text are drawn apart, but any one of them gives its other columns to all their copies.
    """
    drawn = _drawn(docs, weights, share, most, seed, id_col, source_col, text_col)
    times = drawn.where("copies > 0").groupBy(F.col("_row").alias("__row")).agg(F.sum("copies").alias("__times"))
    key = row_key(F.col(id_col), F.col(source_col), F.col(text_col).cast("string"))
    taken = docs.withColumn("__row", key).dropDuplicates(["__row"]).join(times, "__row")
    lots = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__times") / COPIES)))
    taken = taken.withColumn("__lot", lots).withColumn("__left", F.col("__times") - (F.col("__lot") - 1) * COPIES)
    if not times.where(F.col("__times") > COPIES).isEmpty():  # equal rows, whose copies one task would write alone
        taken = taken.where(F.col("__times") <= COPIES).unionByName(taken.where(F.col("__times") > COPIES).repartition("__row", "__lot"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("__left"), F.lit(COPIES).cast("long"))))
    return taken.withColumn("__copy", copies).select(*docs.columns)
