"""Documents to packed training windows: quality rules, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but
the last return documents' columns, and hand on further columns whatever they are called. Every stage gives an empty
table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import langid, mixing, packing, rules, setsketch
from foliant.llm.queries import vocabulary
from foliant.llm.shared import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v3. Null, empty and wordless texts go, short ones stay; texts are measured whole;
    repeated rows and rows without an id are judged each; a value on a rule's border does not fail it.
    """
    return rules.passing(docs, rules.POLICIES["v3"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language for at least half of their letters, learned from the rows that name one. Null and
    letterless texts go; a tie of two languages stays, as each has half; texts of any length are one path; repeated rows and
    rows without an id are judged each.
    """
    return langid.in_known_language(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; ties are repeated rows, of which one stays.
    A row without an id only stays where no row of its group has one; null and wordless texts are in no group; texts are compared whole.
    """
    return setsketch.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, none more than twice its rows. A null source is one of its own;
    null texts have size 0; ties in size go by hashes of id and text, so reruns agree; repeated rows are drawn each, long texts
    like others.
    """
    return mixing.mixed_documents(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens. Copies of the mix are packed each; null texts are one separator; long
    texts are cut; pieces of one length (ties) are placed by hash.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("source_mix", source_mix), ("window_packing", window_packing)]
#: Language identification and the tokenizer can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/foliant/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
