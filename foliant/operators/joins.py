"""Joins and set operations over keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.labels import page_key


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest order per key, without a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def join_predictions(preds: DataFrame, dataset: DataFrame, keys: Sequence[str], key: str, order: str) -> DataFrame:
    """Predictions with the dataset row of their first present key, as string; unmatched ones go; duplicate dataset keys: last wins."""
    names = F.coalesce(*(F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys))
    right = last_wins(dataset.withColumn(key, F.col(key).cast("string")), key, order).withColumnRenamed(key, "_key")
    return preds.withColumn("_key", names).join(right, "_key").drop("_key")


def todo(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples without a committed row."""
    return samples.join(done.select(key), key, "left_anti")


def exclude(cands: DataFrame, exclusions: DataFrame, id_col: str, deck: str, question: str) -> DataFrame:
    """Drops a candidate whose id, or normalised question, or (deck, question) is excluded: three anti joins, not one OR."""
    ids, texts, both = ([c] for c in (id_col, question, deck))
    keyed = lambda cols: exclusions.select(*cols).where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).distinct()
    for cols in (ids, texts, both + texts):
        cands = cands.join(keyed(cols), cols, "left_anti")
    return cands


def index_coverage(gold: DataFrame, entries: DataFrame, sample: str, label: str) -> DataFrame:
    """Distinct gold labels, those in the index, samples, samples with any hit."""
    there = entries.select(label).distinct().withColumn("_in", F.lit(1))
    joined = gold.join(there, label, "left")
    return joined.agg(
        F.count_distinct(label).alias("labels"), F.count_distinct(F.when(F.col("_in").isNotNull(), F.col(label))).alias("covered"),
        F.count_distinct(sample).alias("samples"), F.count_distinct(F.when(F.col("_in").isNotNull(), F.col(sample))).alias("samples_hit"),
    )


def missing_refs(targets: DataFrame, base: DataFrame, extracted: DataFrame, label: str) -> DataFrame:
    """Target labels in neither table."""
    return targets.select(label).distinct().join(base.select(label), label, "left_anti").join(extracted.select(label), label, "left_anti")


def materialize_pages(needed: DataFrame, pages: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The pages that are needed, and the needed keys that no page has."""
    wanted = needed.select(*keys).distinct()
    return pages.join(wanted, list(keys), "left_semi"), wanted.join(pages.select(*keys), list(keys), "left_anti")


def merge_sidecar(rows: DataFrame, sidecar: DataFrame, key: str, verdict: str, error: str, order: str) -> DataFrame:
    """The last sidecar row's verdict overrides and clears the error; its error only fills where there is no verdict."""
    last = last_wins(sidecar.select(key, order, F.col(verdict).alias("_v"), F.col(error).alias("_e")), key, order).drop(order)
    both = rows.join(last, key, "left")
    merged = F.coalesce("_v", verdict)
    return both.withColumn(error, F.when(F.col("_v").isNotNull(), None).when(F.col(verdict).isNull(), F.coalesce("_e", error)).otherwise(F.col(error))).withColumn(verdict, merged).drop("_v", "_e")


def missing_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Ids 0..n-1 without a row."""
    return rows.sparkSession.range(n).withColumnRenamed("id", key).join(rows.select(key), key, "left_anti")


def evidence_overlap(preds: DataFrame, gold: str, final: str) -> DataFrame:
    """Whether the final pages hold all gold pages, and how many of them aren't gold; labels compare by (deck, page)."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.col(c), page_key), lambda k: k.isNotNull()))
    return preds.withColumn("covered", F.size(F.array_except(keys(gold), keys(final))) == 0).withColumn("non_gold", F.size(F.array_except(keys(final), keys(gold))))


def iou(a: Column, b: Column) -> Column:
    """Of boxes [x1, y1, x2, y2]; 0 where they don't meet or one is empty."""
    at = lambda v, i: F.get(v, F.lit(i)).cast("double")
    side = lambda lo, hi: F.greatest(F.least(at(a, hi), at(b, hi)) - F.greatest(at(a, lo), at(b, lo)), F.lit(0.0))
    area = lambda v: (at(v, 2) - at(v, 0)) * (at(v, 3) - at(v, 1))
    both = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def grounding(gold: DataFrame, facts: DataFrame, final: DataFrame, samples: DataFrame) -> DataFrame:
    """Per sample the mean over gold boxes of the best IoU among its page-frame facts on that page, if the page is final.

    gold: sample, page, box; facts: sample, page, frame, bbox; final: sample, page; samples: sample. No gold box gives 0.
    """
    held = facts.where("frame = 'page'").join(final, ["sample", "page"], "left_semi").select("sample", "page", "bbox")
    boxes = gold.withColumn("_g", F.monotonically_increasing_id()).join(held, ["sample", "page"], "left")
    best = boxes.groupBy("sample", "_g").agg(F.coalesce(F.max(iou(F.col("box"), F.col("bbox"))), F.lit(0.0)).alias("_best"))
    means = best.groupBy("sample").agg(F.avg("_best").alias("grounding"))
    return samples.join(means, "sample", "left").withColumn("grounding", F.coalesce("grounding", F.lit(0.0)))


def route(queries: DataFrame, pages: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Each query with the pages of the corpus it names; an unknown corpus is an error."""
    if not queries.join(pages.select(corpus).distinct(), corpus, "left_anti").isEmpty():
        raise ValueError("a query names an unknown corpus")
    return queries.join(pages, corpus)


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A with b's new columns, by key; columns that both have must be equal, row by row."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    right = b.select(key, F.lit(1).alias("_b"), *(F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns if c != key))
    both = a.withColumn("_a", F.lit(1)).join(right, key, "full")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in shared), F.col("_a").isNotNull() & F.col("_b").isNotNull())
    checked = both.withColumn(key, F.when(same, F.col(key)).otherwise(F.raise_error(F.lit("the tables differ in shared columns")).cast(dict(a.dtypes)[key])))
    return checked.select(*a.columns, *(c for c in b.columns if c not in a.columns))


def score_distinct(rows: DataFrame, keys: Sequence[str], scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each distinct combination of keys is scored once; scorer adds columns to the distinct table."""
    scored = scorer(rows.select(*keys).distinct())
    named = scored.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in scored.columns if c not in keys))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"_k_{k}" for k in keys))


def concat(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def needed_labels(rows: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Distinct labels over several array columns, in one pass."""
    every = F.flatten(F.array(*(F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays)))
    return rows.select(F.explode(every).alias("label")).where("label IS NOT NULL").distinct()


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """T3."""
    return a.select(key).intersect(b.select(key))


def minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """T4."""
    return a.select(key).subtract(b.select(key))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """T5: one row: whether both hold the same rows as often, by one grouped count.

    Rows are dealt by their values before they are counted, so that a task holds its share of the different rows only, not all
    that its part of the input has.
    """
    marked = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = marked.repartition(tasks, *a.columns).groupBy(*a.columns).agg(F.sum("_d").alias("_d"))
    return counts.agg(F.coalesce(F.max(F.abs("_d")), F.lit(0)).alias("_m")).select((F.col("_m") == 0).alias("same"))


def found_missing(rows: DataFrame, retrieved: str, reference: str) -> DataFrame:
    """Sorted found and missing reference labels."""
    found = F.array_sort(F.array_intersect(reference, retrieved))
    return rows.withColumn("found", found).withColumn("missing", F.array_sort(F.array_except(F.col(reference), F.col("found"))))


def split_overlap(rows: DataFrame, split: str, key: str) -> DataFrame:
    """Shared keys of each pair of splits; pairs come from each key's small set of splits."""
    per = rows.select(split, key).distinct().groupBy(key).agg(F.array_sort(F.collect_list(split)).alias("_s"))
    pairs = F.flatten(F.transform(F.col("_s"), lambda x, i: F.transform(F.slice(F.col("_s"), i + 2, F.size("_s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
