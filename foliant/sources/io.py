"""Sources and sinks (S1-S14): JSON lines, Parquet, page images, manifests, resumable and verified writes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.labels import image_ext, page_label


def _numbered(lines: DataFrame, counted: Column, name: str) -> DataFrame:
    """Numbers from 0 of a file's lines (file, _block, _i), or of those of them where `counted` holds; a block of a file is
    one window, and the counts of the blocks are summed.
    """
    counts = lines.groupBy("file", "_block").agg(F.count(F.when(counted, 1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    in_block = F.sum(F.when(counted, 1).otherwise(0)).over(Window.partitionBy("file", "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_r", in_block).join(starts, ["file", "_block"]).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_before", "_r")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, start: int = 0, limit: int | None = None) -> DataFrame:
    """JSON lines; start counts all lines of a file, limit the non-blank ones after it. A broken line is an error."""
    if not start and limit is None:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    # a line's place is fixed by its file, block and place in the block
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"))
    kept = spark.read.text(path).select("value", *place)
    if start:
        kept = _numbered(kept, F.lit(True), "line").where(F.col("line") >= start)
    kept = kept.where(F.trim("value") != "")
    if limit is not None:
        kept = _numbered(kept, F.lit(True), "_nth").where(F.col("_nth") < limit)
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and broken lines by their first 200 characters."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = read.where("r._corrupt IS NULL").select("r.*").drop("_corrupt")
    return good, read.where("r._corrupt IS NOT NULL").select(F.substring("value", 1, 200).alias("line"))


def read_qa_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """S3: only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def unpivot_pages(raw: DataFrame, deck: str) -> DataFrame:
    """Columns page_1, page_2, ... (structs with bytes) as rows (deck, page, bytes), absent ones dropped, each page once."""
    there = sorted(int(c[5:]) for c in raw.columns if c.startswith("page_") and c[5:].isdigit())
    flat = raw.select(deck, *(F.col(f"page_{k}.bytes").alias(str(k)) for k in there))
    long = flat.unpivot([deck], [str(k) for k in there], "page", "bytes").where("bytes IS NOT NULL")
    return long.withColumn("page", F.col("page").cast("int")).dropDuplicates([deck, "page"])


#: Folders that the driver lists at least before tasks go on, and folders that one task gets.
FOLDERS, FOLDERS_A_TASK = 64, 1000


def list_files(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """path (with its scheme), length, modificationTime of the files under root at any depth whose name fits the pattern; names that
    begin with a dot or an underscore are left out, as Spark leaves them out. root is a URI or an absolute path, which Arrow opens.

    The driver lists the upper folders only, tasks list those below.
    """
    scheme, _, rest = root.rpartition("://")
    prefix = f"{scheme}://{rest.split('/')[0]}" if scheme not in ("", "file") else "file:"

    def opened(base: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base)

    def shown(x: pafs.FileInfo) -> bool:
        return x.base_name[0] != "." and (x.base_name[0] != "_" or "=" in x.base_name)

    def below(system: pafs.FileSystem, folders: list[str]) -> Iterator[pafs.FileInfo]:
        for folder in folders:
            yield from filter(shown, system.get_file_info(pafs.FileSelector(folder)))

    def rows(found: list[pafs.FileInfo]) -> pa.RecordBatch:
        times = pa.array([x.mtime_ns // 1000 if x.mtime_ns else None for x in found], pa.int64()).cast(pa.timestamp("us", "UTC"))
        paths = [prefix + ("" if x.path.startswith("/") else "/") + (x.path if prefix == "file:" else x.path.removeprefix(rest.split("/")[0]).lstrip("/")) for x in found]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x.size for x in found], pa.int64()), times], ["path", "length", "modificationTime"])

    def wanted(found: list[pafs.FileInfo]) -> list[pafs.FileInfo]:
        return [x for x in found if x.is_file and fnmatchcase(x.base_name, name)]

    system, top = opened(root)
    if system.get_file_info(top).type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    upper, folders = [], [top]
    while folders and len(folders) < FOLDERS:
        found = list(below(system, folders))
        upper += wanted(found)
        folders = [x.path for x in found if x.type == pafs.FileType.Directory]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                held = [folder]
                while held:
                    found = list(below(system, held))
                    held = [x.path for x in found if x.type == pafs.FileType.Directory]
                    yield rows(wanted(found))

    schema = "path string, length long, modificationTime timestamp"
    lower = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())}))
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(folders) // FOLDERS_A_TASK))
    here = spark.createDataFrame(pa.Table.from_batches([rows(upper)]), schema)
    return here.unionByName(lower.repartition(tasks).mapInArrow(listed, schema))


def put_files(files: DataFrame, root: str) -> None:
    """Writes each row's text, `value`, as a file of its own at `path` under root, which is a URI or an absolute path."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                system.create_dir(f"{folder}/{path}".rpartition("/")[0])
                with system.open_output_stream(f"{folder}/{path}") as out:
                    out.write((value or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def scan_page_files(spark: SparkSession, root: str, extensions: Sequence[str] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """Images under root at any depth: label (folder and stem), path, size; contents aren't read."""
    files = list_files(spark, root).select("path", "length")
    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*extensions))
    return wanted.select(F.regexp_extract("path", r"([^/]+/[^/]+)\.[^.]+$", 1).alias("label"), "path", "length")


def parse_page_files(files: DataFrame, path: str, pattern: str, base: int) -> DataFrame:
    """Deck and page from file names by a pattern with two groups; page numbers from `base` become 1-based."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    deck = F.regexp_extract(name, pattern, 1)
    checked = F.when(deck != "", deck).otherwise(F.raise_error(F.concat(F.lit("not a page file: "), name)).cast("string"))
    page = F.regexp_extract(name, pattern, 2).cast("int") + (1 - base)
    return files.withColumn("deck", checked).withColumn("page", page).withColumn("label", page_label(F.col("deck"), F.col("page")))


def read_index_entries(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line, a path string or an object with image_path and page_label; the label falls back to the stem."""
    v = F.try_parse_json("value")
    image = F.coalesce(F.try_variant_get(v, "$.image_path", "string"), F.try_variant_get(v, "$", "string"))
    label = F.coalesce(F.try_variant_get(v, "$.page_label", "string"), F.regexp_extract(image, r"([^/]+?)(\.[^./]+)?$", 1))
    return spark.read.text(path).where(F.trim("value") != "").select(image.alias("image_path"), label.alias("page_label"))


def append_new(df: DataFrame, path: str, key: str = "sample_id") -> DataFrame:
    """Appends the rows whose key isn't committed yet, one per key, and gives what is committed now."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).parquet(path)
        fresh = df.join(done.select(key), key, "left_anti")
    except Exception as e:  # nothing is committed
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    fresh.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_verified(df: DataFrame, path: str, schema: T.StructType, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Written under the schema, read again and compared: same rows as often, no key twice, and, with an order, files and
    rows of a file in that order; an error otherwise.
    """
    cast = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    (cast.repartitionByRange(*order).sortWithinPartitions(*order) if order else cast).write.parquet(path)
    back = df.sparkSession.read.schema(schema).parquet(path)
    marked = cast.withColumn("_d", F.lit(1)).unionByName(back.withColumn("_d", F.lit(-1)))
    names = [F.to_json(F.struct(*back.columns)).alias("_row")]
    if not marked.groupBy(*names).agg(F.sum("_d").alias("_d")).where("_d <> 0").isEmpty():
        raise ValueError("what was read differs from what was written")
    if not back.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"a {key} occurs twice")
    if order:
        verify_order(back, order)
    return back


def verify_order(back: DataFrame, order: Sequence[str]) -> None:
    """An error unless the rows of Parquet files, read by file name and row, follow the order."""
    place = back.select(F.struct(*order).alias("o"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("o").over(Window.partitionBy("file").orderBy("row"))
    ends = place.groupBy("file").agg(F.min("o").alias("o"), F.max("o").alias("last"))  # one row per file
    before_file = F.max("last").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    if not place.withColumn("_b", before).where("_b > o").isEmpty() or not ends.withColumn("_b", before_file).where("_b > o").isEmpty():
        raise ValueError("rows are not in order")


def write_summary(df: DataFrame, path: str) -> None:
    """An aggregate of one row as one JSON document."""
    if df.count() != 1:
        raise ValueError("a summary is one row")
    df.coalesce(1).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Path under root, bytes, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, else of another size, else of another checksum."""
    there = actual.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    error = F.when(F.col("_b").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "size").when(F.col("_s") != F.col("sha256"), "sha256")
    return expected.join(there, "path", "left").select("path", error.alias("error")).where("error IS NOT NULL")


def discover_runs(spark: SparkSession, root: str, name: str = "predictions.jsonl") -> DataFrame:
    """Per folder that holds a file of that name, but no merged or sidecar tree: its file and time; `newest` marks the last per parent."""
    files = list_files(spark, root, name).select("path", "modificationTime")
    runs = files.where(~F.col("path").rlike(r"/(merged[^/]*|sidecar|judge_sidecar)/")).withColumn("run", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    runs = runs.withColumn("parent", F.regexp_extract("run", r"^(.*)/[^/]+$", 1))
    order = Window.partitionBy("parent").orderBy(F.desc("modificationTime"), F.desc("run"))
    return runs.withColumn("newest", F.row_number().over(order) == 1)


def dump_generations(df: DataFrame, path: str, step: str = "step") -> None:
    """One folder per training step."""
    df.repartition(step).write.mode("overwrite").partitionBy(step).json(path)


def fanout(df: DataFrame, outputs: Mapping[str, Column], path: str) -> None:
    """Rows to every output whose predicate they meet, in one write partitioned by output."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in outputs.items())))
    df.withColumn("outcome", F.explode(names)).write.mode("overwrite").partitionBy("outcome").parquet(path)


def image_kinds(files: DataFrame, content: str) -> DataFrame:
    """P16 over a table of files."""
    return files.withColumn("kind", image_ext(F.col(content)))
