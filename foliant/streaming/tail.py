"""Streams over files that grow in place (X1): complete lines are read once, a half line waits, a shrunken file starts over.

The offset of the stream maps each file to its complete lines and bytes and a checksum of its first line; it lives in the
stream's checkpoint, so a restart goes on where the last committed batch ended. A file with fewer bytes than before, or
with another first line, is read from its start again.

The driver reads what is new to count its lines, many files at a time; tasks read ranges of about PART bytes, or many small
ones together. Paths are any that Arrow's file systems open on driver and executors: folders that they share, HDFS, object
stores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task's ranges, about, and of a read; opening a file counts as so many bytes; files that the driver counts at once.
PART, READ, OPEN, AT_ONCE = 64 << 20, 1 << 20, 64 << 10, 16
#: Rows of a batch that a task hands on, about.
ROWS = 10_000

LINES = "file string, line long, value string"


@dataclass
class Range:
    """Bytes start to end of a file, which begin with line number `line`."""

    file: str
    start: int
    end: int
    line: int


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range]):
        super().__init__(None)
        self.ranges = ranges


def _packed(ranges: list[Range]) -> list[Ranges]:
    """Ranges one after the other, as many as PART bytes hold."""
    out, held = [], 0
    for r in ranges:
        cost = OPEN + r.end - r.start
        if not out or held + cost > PART:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += cost
    return out


def _chunks(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    f.seek(start)
    at = start
    while at < end:
        data = f.read(min(READ, end - at))
        if not data:
            return
        yield data
        at += len(data)


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix
        self.known: dict[str, list[int]] = {}  # what this process has counted: file under root -> lines, bytes, checksum

    def initialOffset(self) -> dict:
        return {}

    def _counted(self, system: pafs.FileSystem, path: str, size: int, was: list[int] | None) -> list[int] | None:
        """Lines, bytes and first line's checksum of a file's complete lines; None if it has none."""
        with system.open_input_file(path) as f:
            first = bytearray()
            for data in _chunks(f, 0, size):
                at = data.find(b"\n")
                first += data if at < 0 else data[: at + 1]
                if at >= 0:
                    break
            else:
                return None
            head = zlib.crc32(first)
            lines, done = was[:2] if was and was[2] == head and was[1] <= size else (0, 0)
            at = done
            for data in _chunks(f, done, size):
                lines += data.count(b"\n")
                if (last := data.rfind(b"\n")) >= 0:
                    done = at + last + 1
                at += len(data)
        return [lines, done, head]

    def latestOffset(self) -> dict:
        system, root = pafs.FileSystem.from_uri(self.root)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith(self.suffix) and x.base_name[0] not in "._")
        names = [path[len(root) :].lstrip("/") for path, _ in files]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            counts = pool.map(lambda name, x: self._counted(system, *x, self.known.get(name)), names, files)
            self.known = {name: counted for name, counted in zip(names, counts, strict=True) if counted}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        system, root = pafs.FileSystem.from_uri(self.root)
        out = []
        for name, (_, size, head) in end.items():
            path = f"{root.rstrip('/')}/{name}" if name[0] != "/" else name  # whole paths in checkpoints of an earlier version
            was = start.get(name) or start.get(path) or [0, 0, head]
            line, at = (was[0], was[1]) if was[2] == head and was[1] <= size else (0, 0)
            if size - at <= PART:
                out += [Range(path, at, size, line)] if size > at else []
                continue
            first, n, here = at, 0, at  # cut after the line that passes PART bytes
            with system.open_input_file(path) as f:
                for data in _chunks(f, at, size):
                    if here + len(data) - first > PART and (last := data.rfind(b"\n")) >= 0:
                        n += data.count(b"\n", 0, last + 1)
                        out.append(Range(path, first, here + last + 1, line))
                        line, first, n = line + n, here + last + 1, data.count(b"\n", last + 1)
                    else:
                        n += data.count(b"\n")
                    here += len(data)
            out += [Range(path, first, size, line)] if size > first else []
        return _packed(out)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.root)
        files, numbers, values, held = [], [], [], 0
        for r in partition.ranges:
            rest, line = b"", r.line
            with system.open_input_file(r.file) as f:
                for data in _chunks(f, r.start, r.end):
                    *lines, rest = (rest + data).split(b"\n")
                    files += [r.file] * len(lines)
                    numbers += range(line, line + len(lines))
                    values += [x.decode("utf-8", "replace") for x in lines]
                    line += len(lines)
                    held += len(data)
                    if len(values) >= ROWS or held >= READ:
                        yield _batch(files, numbers, values)
                        files, numbers, values, held = [], [], [], 0
        if values:
            yield _batch(files, numbers, values)


def _batch(files: list[str], numbers: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), pa.array(values, pa.string())], ["file", "line", "value"])


class TailSource(DataSource):
    """Format `lines_tail`; options path and suffix (".jsonl")."""

    @classmethod
    def name(cls) -> str:
        return "lines_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def tail_lines(spark: SparkSession, root: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of file, line (from 0, in the file's present life), value: each complete line once. root is a URI or an absolute path."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("lines_tail").option("suffix", suffix).load(root)


def tail_predictions(spark: SparkSession, root: str, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """Rows of growing JSON lines files with file and line; a broken line becomes a row with `bad`, blank lines are left out."""
    read = F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    lines = tail_lines(spark, root, suffix).where(F.trim("value") != "")
    return lines.select("file", "line", read.alias("r")).select("r.*", "file", "line")
