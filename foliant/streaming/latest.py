"""A snapshot of the latest row per key as a log-structured table.

Each micro-batch writes its own newest rows as a delta, dealt into buckets by a hash of the key, so what is written follows
the batch and not the table. Reading merges each bucket's base with its deltas. A bucket whose deltas outgrow a share of its
base is compacted into a new base; when buckets hold more rows than they should, their number doubles, and a bucket's
files serve both halves until each is compacted. A small manifest a version says which files make up each bucket; files that
neither it nor the one before names are removed. A repeated micro-batch writes the same version again.

    path/manifest/version=<n>       one line of JSON
    path/data/delta=<n>/bucket=<b>  path/data/base=<n>/bucket=<b>
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.curate import dedup_latest

#: Rows a bucket should hold at most; deltas of a bucket that may wait, as a share of its base and as rows.
BUCKET_ROWS, SHARE, WAITING = 1_000_000, 0.5, 10_000


class LatestTable:
    """The latest row per key of that schema, by time and then ordinal."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, time: str, ordinal: str, bucket_rows: int = BUCKET_ROWS, share: float = SHARE, waiting: int = WAITING):
        self.spark, self.path, self.key, self.time, self.ordinal = spark, path.rstrip("/"), key, time, ordinal
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.bucket_rows, self.share, self.waiting = bucket_rows, share, waiting

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        system, path = self._folder(*parts)
        return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []

    def versions(self) -> list[int]:
        """Versions whose manifest is complete."""
        found = [int(x.split("=")[1]) for x in self._names("manifest") if x.startswith("version=")]
        return sorted(v for v in found if "_SUCCESS" in self._names("manifest", f"version={v}"))

    def manifest(self, before: int | None = None) -> dict:
        """buckets: bucket -> {rows, waiting, files: [[folder, bucket in it], ...], base: whether the first of files is one}; depth: 2 ** depth buckets."""
        versions = [v for v in self.versions() if before is None or v < before]
        if not versions:
            return {"depth": 0, "buckets": {"0": {"rows": 0, "waiting": 0, "files": [], "base": False}}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/version={versions[-1]}").first()[0])

    def _bucket(self, depth: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(1 << depth)).cast("int")

    def _files(self, files: Iterable[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for folder, b in sorted(set(map(tuple, files)))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return dedup_latest(rows, self.key, self.time, self.ordinal)

    def read(self) -> DataFrame:
        """The current rows. Buckets that are one base are taken as they are."""
        buckets = self.manifest()["buckets"].values()
        settled = [f for b in buckets if b["base"] and len(b["files"]) == 1 for f in b["files"]]
        mixed = [f for b in buckets if not (b["base"] and len(b["files"]) == 1) for f in b["files"]]
        parts = ([self._files(settled)] if settled else []) + ([self._newest(self._files(mixed))] if mixed or not settled else [])
        return reduce(DataFrame.unionByName, parts)

    def merge(self, batch: DataFrame, version: int) -> None:
        """The batch's rows become version `version`."""
        state = self.manifest(before=version)
        depth, buckets = state["depth"], state["buckets"]
        self._newest(batch.select(*self.schema.names)).withColumn("bucket", self._bucket(depth)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/delta={version}")
        written = self.spark.read.parquet(f"{self.path}/data/delta={version}") if self._names("data", f"delta={version}") != ["_SUCCESS"] else None
        if written is not None:
            for b, n in written.groupBy("bucket").count().collect():  # one row a bucket
                buckets[str(b)]["files"].append([f"delta={version}", b])
                buckets[str(b)]["waiting"] += n
        while sum(b["rows"] + b["waiting"] for b in buckets.values()) > self.bucket_rows << depth:
            for b in range(1 << depth):
                old = buckets[str(b)]
                # both halves read the same files until they are compacted, so neither is a base of its own
                half = {"rows": old["rows"] // 2, "waiting": old["rows"] // 2 + old["waiting"] // 2, "files": old["files"], "base": False}
                buckets[str(b)], buckets[str(b + (1 << depth))] = half, {**half, "files": list(old["files"])}
            depth += 1
        due = [b for b, x in buckets.items() if x["files"] and x["waiting"] > max(self.waiting, self.share * x["rows"])]
        if due:
            self._compact(due, buckets, depth, version)
        self.spark.createDataFrame([(json.dumps({"depth": depth, "buckets": buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={version}")
        self._clean(version)

    def _compact(self, due: list[str], buckets: dict, depth: int, version: int) -> None:
        rows = self._files(f for b in due for f in buckets[b]["files"]).withColumn("bucket", self._bucket(depth))
        whole = self._newest(rows.where(F.col("bucket").isin([int(b) for b in due])))
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/base={version}")
        counts = dict(map(tuple, self.spark.read.parquet(f"{self.path}/data/base={version}").groupBy("bucket").count().collect()))
        for b in due:
            n = counts.get(int(b), 0)
            buckets[b] = {"rows": n, "waiting": 0, "files": [[f"base={version}", int(b)]] if n else [], "base": bool(n)}

    def _clean(self, version: int) -> None:
        """Manifests before the last two go, and the data folders that neither names."""
        kept = self.versions()[-2:]
        named = {folder for v in kept for b in self.manifest(before=v + 1)["buckets"].values() for folder, _ in b["files"]}
        for kind, folders in (("manifest", {f"version={v}" for v in kept}), ("data", named)):
            for name in self._names(kind):
                number = int(name.split("=")[1]) if "=" in name else version
                if name not in folders and number <= version and "=" in name:
                    system, path = self._folder(kind, name)
                    system.delete(path, True)


def latest_rows(stream: DataFrame, table: LatestTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of the stream is merged into the table; rows without a key are samples of their own."""
    named = stream.withColumn(table.key, F.coalesce(F.col(table.key).cast("string"), F.concat(F.lit("__missing_"), F.col(table.ordinal).cast("string"))))
    return named.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
