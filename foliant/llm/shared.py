"""What the training-data operators share: scratch tables, text columns in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the six ASCII white-space characters. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master, a folder of our own where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/foliant/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that a task works on at a time; batches have up to 10,000.
ROWS = 4096


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds Python objects of few rows at once."""
    return (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, named apart from anything else in docs."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def row_key(*columns: Column) -> Column:
    """A hash of some columns that tells null from every value."""
    return F.xxhash64(*(c for column in columns for c in (column.isNull(), column)))


#: A key with over 1 / SHARES of the rows (of SHARES rows at least) is busy, so there are at most SHARES busy keys.
SHARES = 1024


def busy_keys(rows: DataFrame, key: str, count: str | None = None) -> DataFrame | None:
    """key, _shares (how many ordinary keys' worth of rows it has) of the busy keys, at most SHARES; None if there is none.

    rows is a settled table; count names a column for rows that stand for so many.
    """
    many = F.sum(count) if count else F.count("*")
    most = max(SHARES, (rows.agg(many).first()[0] or 0) // SHARES)
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(many.alias("_rows")).where(F.col("_rows") > most)
    found = [(r[key], -(-r["_rows"] // most)) for r in counted.collect()]
    return rows.sparkSession.createDataFrame(found, f"{key} {dict(rows.dtypes)[key]}, _shares int") if found else None


def matched(rows: DataFrame, table: DataFrame, key: str, busy: DataFrame | None, how: str = "inner") -> DataFrame:
    """A settled table joined with one that has one row a key. Rows of busy keys stay where they are: their few rows of the table come to them."""
    if busy is None:
        return rows.join(table, key, how)
    marked = rows.join(F.broadcast(busy), key, "left")
    to_all = F.broadcast(table.join(F.broadcast(busy.select(key)), key, "left_semi"))
    common = marked.where("_shares IS NOT NULL").drop("_shares").join(to_all, key, how)
    return marked.where("_shares IS NULL").drop("_shares").join(table, key, how).unionByName(common)


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def annotated(docs: DataFrame, text_col: str, added: list[T.StructField], work: Callable[[list[bytes | None]], list[pa.Array]]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns worked out from its texts, one pass and no join; and what gives a result docs' own columns back.

    While both stand side by side, docs' columns go by their places (`_c0`, ...), so names can't clash.
    """
    placed = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = work(texts_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(f.name for f in added)])

    out = placed.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in placed.schema), *added]))
    return out, lambda df: df.select(*placed.columns).toDF(*docs.columns)
