"""Removes every stretch of bytes that occurs earlier: a suffix array over the suffixes that may have a twin.

Documents are packed into blocks of some megabytes, in the order of their ids inside each block. Which suffixes may repeat
for `length` bytes is found first: each window of `length` bytes has one anchor, the place inside it where a hash of `gram`
bytes is least, so equal windows have equal anchors at equal places. Consecutive windows with one anchor are a record. Only
anchors whose hash occurs twice go on; hashes alone are shuffled for that, each once a block.

Sampled splitters then range-partition the anchors' suffixes by their leading `gram` bytes. A bucket sorts its suffixes, and
the contexts before the anchors read backwards, by multikey quicksort: a quicksort by eight bytes, whose runs of equal keys go
on to the next eight, all runs of a depth side by side. Common prefixes of neighbours then tell which windows are equal: those
that share `length` - o bytes after the anchor and o bytes before it, for each place o of the anchor in the window. The
window that comes first stays; the bytes of all others are removed. A gram that fills several buckets is dealt over them;
windows that are first in their bucket are then compared across boundaries, by their bytes, in a join.

Copies inside a block are told there, so a passage that many documents share sends one record a block. All groups are bounded:
a block, or a bucket whose number grows with the records.

Defined cases: a null text is empty and keeps an empty result; texts are whole, however long; "earlier" is the smaller id, a
null id coming last, then, for rows with one id, a hash of the text, then any order, the same for all of a row (of equal rows one
stays whole, as they look alike); then the earlier start; repeated rows each give a row; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, slices, texts_of

#: Bytes of a block's texts (a longer text is a block of its own), and windows that are hashed at a time.
BLOCK, STEP = 2_000_000, 1 << 17
#: Bytes of hashes and of records that a bucket has, about.
ASKED, BUCKET = 4_000_000, 6_000_000
#: Blocks from which splitters are taken, about (twice as many at most), and suffixes from each.
SAMPLE_BLOCKS, SAMPLE_SUFFIXES = 128, 256
#: Records whose bytes are laid out at a time.
LAID = 4096

_RECORD = np.dtype([("at", "<u4"), ("many", "<u2"), ("off", "<u2")])  # first window, number of windows, bytes before the anchor
_ASK = np.dtype([("hash", "<u8"), ("record", _RECORD)])
_SENT = np.dtype([("null", "u1"), ("id", "<i8"), ("hash", "<i8"), ("at", "<u4"), ("many", "<u2"), ("off", "<u2")])
_RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])

_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)  # modulo 2^64


class Shape:
    """Length of what repeats, of the grams that anchors are taken from, and how many grams a window has."""

    def __init__(self, length: int):
        self.length, self.gram = length, max(1, min(32, length // 2))
        self.window = length - self.gram + 1
        self.powers, self.inverse = _powers(_ODD, STEP + length), _powers(pow(_ODD, -1, 1 << 64), STEP + length)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _packed(data: bytes) -> bytes:
    return _codec().compress(data, asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return _codec().decompress(data, decompressed_size=size, asbytes=True) if size else b""


def anchors_of(buffer: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """A block's records and the hashes of their anchors; ends: where documents end in the buffer."""
    length, gram, window = shape.length, shape.gram, shape.window
    records, hashes = [np.zeros(0, _RECORD)], [np.zeros(0, np.uint64)]
    sizes = np.diff(np.concatenate([[0], ends]))
    low = np.uint64((1 << 18) - 1)
    for first in range(0, max(0, len(buffer) - length + 1), STEP):
        part = buffer[first : first + STEP + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * shape.powers[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * shape.inverse[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1  # equal hashes: the first place
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if window > size:
            least = np.minimum(least[: size - window], least[window - size :])
        anchor = (least & low).astype(np.int64)
        # windows that don't reach into the next document
        docs = slice(np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + n - 1, "right") + 1)
        starts = np.maximum(ends[docs] - sizes[docs] - first, 0)
        stops = np.clip(ends[docs] - length + 1 - first, 0, len(anchor))
        inside = np.zeros(len(anchor) + 1, np.int32)
        has = stops > starts
        np.add.at(inside, starts[has], 1)
        np.add.at(inside, stops[has], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(at):
            continue
        a = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
        found = np.zeros(len(new), _RECORD)
        found["at"], found["many"], found["off"] = at[new] + first, np.diff(np.append(new, len(at))), a[new] - at[new]
        records.append(found)
        hashes.append(h[a[new]])
    return np.concatenate(records), np.concatenate(hashes)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of eight-byte words, and how many bytes each row in that order shares with the one before it."""
    order = np.argsort(words[:, 0])
    shared = np.zeros(len(order), np.int64)
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])  # with the row before, so far
    _count_shared(words, order, shared, np.flatnonzero(~tied), 0)
    for depth in range(1, words.shape[1]):
        inner = tied.copy()
        inner[:-1] |= tied[1:]
        places = np.flatnonzero(inner)  # rows of runs that are still equal
        if not len(places):
            break
        run = np.cumsum(~tied)[places]
        key = words[order[places], depth]
        order[places] = order[places[np.lexsort((key, run))]]
        same = words[order[places], depth] == words[order[places - 1], depth]
        parted = places[tied[places] & ~same]
        _count_shared(words, order, shared, parted, depth)
        tied[parted] = False
    shared[tied] = 8 * words.shape[1]
    return order, shared


def _count_shared(words: np.ndarray, order: np.ndarray, shared: np.ndarray, places: np.ndarray, depth: int) -> None:
    places = places[places > 0]
    differ = words[order[places], depth] ^ words[order[places - 1], depth]
    shared[places] = 8 * depth + (differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)


def laid_out(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, width: int) -> np.ndarray:
    """Rows of words with the bytes from each start on, forwards or (step -1) backwards, zeros after sizes."""
    width = -(-max(1, width) // 8) * 8
    out = np.zeros((len(starts), width), np.uint8)
    places = np.arange(width)
    for i in range(0, len(starts), LAID):
        at = np.clip(starts[i : i + LAID, None] + step * places, 0, len(buffer) - 1)
        out[i : i + LAID] = np.where(places < sizes[i : i + LAID, None], buffer[at], 0)
    return out.view(">u8").astype(np.uint64)


def repeated_windows(buffer: np.ndarray, starts: np.ndarray, many: np.ndarray, off: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Which of each record's windows also occur in an earlier record, or earlier in the same order of records; records come in
    order, starts: where each one's bytes lie in the buffer. Also: which records have a twin among the earlier ones.
    """
    length, n = shape.length, len(starts)
    anchors = starts + off
    right, right_shared = multikey_order(laid_out(buffer, anchors, many - 1 - off + length, 1, length))
    left, left_shared = multikey_order(laid_out(buffer, anchors - 1, off, -1, shape.window - 1))
    classes = np.zeros((2, n), np.int64)

    def place(shares: np.ndarray, order: np.ndarray, needed: int, into: np.ndarray) -> None:
        into[order] = np.cumsum(shares < needed)

    place(right_shared, right, 1 << 30, classes[0])
    place(right_shared, right, length, classes[0])
    place(left_shared, left, shape.window - 1, classes[1])
    whole = np.lexsort((np.arange(n), many, off, classes[1], classes[0]))
    same = np.logical_and.reduce([x[whole[1:]] == x[whole[:-1]] for x in (classes[0], classes[1], off, many)])
    twins = np.zeros(n, bool)
    twins[whole[1:][same]] = True
    flags = np.zeros((n, int(many.max(initial=0))), bool)
    flags[twins] = np.arange(flags.shape[1]) < many[twins, None]
    # what is left is compared window by window, where a gram has several records left
    place(right_shared, right, shape.gram, classes[0])
    alone = np.bincount(classes[0][~twins], minlength=n + 1)[classes[0]] == 1
    rest = np.flatnonzero(~twins & ~alone)
    for o in range(shape.window):
        at = rest[(off[rest] >= o) & (off[rest] - many[rest] < o)]
        if len(at):
            place(right_shared, right, length - o, classes[0])
            place(left_shared, left, o, classes[1])
            _, first, which = np.unique(classes[0][at] * (n + 1) + classes[1][at], return_index=True, return_inverse=True)
            later = at[first[which] != np.arange(len(at))]
            flags[later, off[later] - o] = True
    return flags, twins


def ranges_of(flags: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of each record's flagged windows, and the record of each."""
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    record, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]
    out = np.zeros(len(record), _RANGE)
    out["start"], out["end"] = at[record] + first, at[record] + last - 1 + length
    return out, record


def _block_columns() -> str:
    return "_ids array<long>, _hashes array<long>, _sizes array<long>, _data binary"


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in blocks, written: _block, _ids, _hashes, _sizes, _data (all texts, compressed)."""
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))

    def row(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ids, hashes, texts = zip(*held, strict=True)
        arrays = [pa.array([list(x)], pa.list_(pa.int64())) for x in (ids, hashes, map(len, texts))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([_packed(b"".join(texts))], pa.binary())], ["_ids", "_hashes", "_sizes", "_data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 256):
            for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                text = r[2] or b""
                if held and size + len(text) > BLOCK:
                    yield row(held)
                    held, size = [], 0
                held.append((*r[:2], text))
                size += len(text)
        if held:
            yield row(held)

    return settle(read.mapInArrow(run, _block_columns()).withColumn("_block", F.monotonically_increasing_id()))


def _buffer(sizes: np.ndarray, data: bytes) -> np.ndarray:
    return np.frombuffer(_unpacked(data, int(sizes.sum())), np.uint8)


def _rows(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    if not len(keys):
        return []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def _asked(blocks: DataFrame, shape: Shape, n_buckets: int) -> DataFrame:
    """_bucket, _block, _known, _data: hashes of anchors, each once a block, by bucket; and records known to have a twin in their block."""
    kinds = {"_bucket": pa.int32(), "_block": pa.int64(), "_known": pa.bool_(), "_data": pa.binary()}

    def of_block(block: int, sizes: np.ndarray, data: bytes) -> pa.RecordBatch:
        records, hashes = anchors_of(_buffer(sizes, data), np.cumsum(sizes), shape)
        order = np.argsort(hashes, kind="stable")
        hashes, records = hashes[order], records[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True) if len(hashes) else new
        asked = np.zeros(int(new.sum()), _ASK)
        asked["hash"], asked["record"] = hashes[new], np.where(alone, records, np.zeros(1, _RECORD))[new]
        bucket = ((asked["hash"] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
        rows = [(b, block, False, asked[ends[b] : ends[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(ends)).tolist()]
        if len(known := records[~alone]):
            rows.append((block % n_buckets, block, True, known.tobytes()))
        return _rows(kinds, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield of_block(batch.column("_block")[i].as_py(), np.array(batch.column("_sizes")[i].as_py(), np.int64), batch.column("_data")[i].as_py())

    return blocks.select("_block", "_sizes", "_data").mapInArrow(run, "_bucket int, _block long, _known boolean, _data binary")


def _wanted(asked: DataFrame) -> DataFrame:
    """_block, _data: the records whose anchor's hash occurs twice."""
    kinds = {"_block": pa.int64(), "_data": pa.binary()}

    def of_bucket(table: pa.Table) -> pa.Table:
        blocks, known, data = (table.column(c).to_pylist() for c in ("_block", "_known", "_data"))
        rows = [(b, d) for b, k, d in zip(blocks, known, data, strict=True) if k]
        parts = [(b, np.frombuffer(d, _ASK)) for b, k, d in zip(blocks, known, data, strict=True) if not k]
        if parts:
            every = np.concatenate([p for _, p in parts])
            block = np.repeat([b for b, _ in parts], [len(p) for _, p in parts])
            order = np.argsort(every["hash"], kind="stable")
            hashes = every["hash"][order]
            same = hashes[1:] == hashes[:-1]
            twin = np.zeros(len(every), bool)
            twin[order[1:][same]] = twin[order[:-1][same]] = True
            twin &= every["record"]["many"] > 0  # else the block knows already
            block, found = block[twin], every["record"][twin]
            order = np.argsort(block, kind="stable")
            block, found = block[order], found[order]
            rows += [(int(block[a]), found[a:b].tobytes()) for a, b in _runs(block)]
        return pa.Table.from_batches([_rows(kinds, rows)])

    return asked.groupBy("_bucket").applyInArrow(of_bucket, "_block long, _data binary")


class Records:
    """One block's wanted records, in the block's order, without those that have a twin before them there."""

    def __init__(self, block: pa.Table, wanted: pa.Table, shape: Shape):
        sizes = np.array(block.column("_sizes")[0].as_py(), np.int64)
        self.buffer = _buffer(sizes, block.column("_data")[0].as_py())
        every = np.concatenate([np.frombuffer(d, _RECORD) for d in wanted.column("_data").to_pylist()])
        every = every[np.argsort(every["at"], kind="stable")]
        first: dict[tuple, int] = {}
        whole = self.buffer.tobytes()
        kept = np.ones(len(every), bool)
        for i, (at, many, off) in enumerate(every.tolist()):
            kept[i] = first.setdefault((whole[at : at + many - 1 + shape.length], off), i) == i
        self.removed, self.records = every[~kept], every[kept]
        doc = np.searchsorted(np.cumsum(sizes), self.records["at"], "right")
        ids = block.column("_ids")[0].as_py()
        self.null = np.array([x is None for x in ids], np.uint8)[doc]
        self.id = np.array([x or 0 for x in ids], np.int64)[doc]
        self.hash = np.array(block.column("_hashes")[0].as_py(), np.int64)[doc]
        grams = self.records["at"].astype(np.int64) + self.records["off"]
        flat = np.ascontiguousarray(self.buffer[grams[:, None] + np.arange(shape.gram)])
        self.grams = flat.view(f"S{shape.gram}")[:, 0]


def splitters(blocks: DataFrame, wanted: DataFrame, shape: Shape, n_buckets: int) -> np.ndarray:
    """Grams that part the sampled suffixes into n_buckets equal shares."""
    share = min(1 << 16, -(-(SAMPLE_BLOCKS << 16) // max(1, blocks.count())))
    few = blocks.where(F.pmod(F.xxhash64("_block"), F.lit(1 << 16)) < share).limit(2 * SAMPLE_BLOCKS)

    def of_block(block: pa.Table, found: pa.Table) -> pa.Table:
        grams = np.zeros(0, f"S{shape.gram}")
        if block.num_rows and found.num_rows:
            grams = Records(block, found, shape).grams
            grams = grams[:: -(-len(grams) // SAMPLE_SUFFIXES)]
        return pa.table({"_gram": pa.array([g.ljust(shape.gram, b"\0") for g in grams.tolist()], pa.binary())})

    drawn = few.groupBy("_block").cogroup(wanted.groupBy("_block")).applyInArrow(of_block, "_gram binary").collect()
    grams = np.sort(np.array([bytes(r["_gram"]) for r in drawn], f"S{shape.gram}"))
    return grams[[len(grams) * i // n_buckets for i in range(1, n_buckets)]] if len(grams) else grams


_DEALT = {"_bucket": pa.int32(), "_block": pa.int64(), "_size": pa.int32(), "_data": pa.binary()}


def _dealt(blocks: DataFrame, wanted: DataFrame, shape: Shape, cuts: np.ndarray) -> DataFrame:
    """_bucket, _block, _size, _data: records with their bytes, by bucket; _size 0: ranges that the block has found itself."""
    sent = blocks.sparkSession.sparkContext.broadcast(cuts)  # a gram a bucket

    def of_block(block: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if block.num_rows and found.num_rows:
            number, cuts, own = block.column("_block")[0].as_py(), sent.value, Records(block, found, shape)
            n_buckets = len(cuts) + 1
            if len(own.removed):
                out = np.zeros(len(own.removed), _RANGE)
                out["start"] = own.removed["at"]
                out["end"] = own.removed["at"] + own.removed["many"] - 1 + shape.length
                rows.append((number % n_buckets, number, 0, out.tobytes()))
            low, high = (np.searchsorted(cuts, own.grams, side) for side in ("left", "right"))
            bucket = np.where(high - low > 1, high - number % np.maximum(1, high - low), high)  # a gram of several cuts fills the buckets between them
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                at = order[ends[b] : ends[b + 1]]
                head = np.zeros(len(at), _SENT)
                head["null"], head["id"], head["hash"] = own.null[at], own.id[at], own.hash[at]
                for name in ("at", "many", "off"):
                    head[name] = own.records[name][at]
                texts = [own.buffer[x : x + m - 1 + shape.length] for x, m, _ in own.records[at].tolist()]
                data = len(at).to_bytes(4, "little") + head.tobytes() + np.concatenate(texts).tobytes()
                rows.append((b, number, len(data), _packed(data)))
        return pa.Table.from_batches([_rows(_DEALT, rows)])

    found = blocks.groupBy("_block").cogroup(wanted.groupBy("_block"))
    return found.applyInArrow(of_block, "_bucket int, _block long, _size int, _data binary")


_RESOLVED = {"_block": pa.int64(), "_data": pa.binary(), "_window": pa.binary(), "_null": pa.int8(), "_id": pa.int64(), "_hash": pa.int64(), "_at": pa.int64()}
_RESOLVED_SQL = "_block long, _data binary, _window binary, _null byte, _id long, _hash long, _at long"


def _resolved(dealt: DataFrame, shape: Shape, cuts: np.ndarray) -> DataFrame:
    """_block, _data: ranges to remove; or a window of a gram that fills several buckets, the first of its bucket, with its place."""
    several = cuts[1:][cuts[1:] == cuts[:-1]] if len(cuts) else cuts
    sent = dealt.sparkSession.sparkContext.broadcast(np.unique(several))

    def of_bucket(table: pa.Table) -> pa.Table:
        rows, parts = [], []
        for block, size, data in zip(*(table.column(c).to_pylist() for c in ("_block", "_size", "_data")), strict=True):
            if not size:
                rows.append((block, data, *[None] * 5))
                continue
            data = _unpacked(data, size)
            n = int.from_bytes(data[:4], "little")
            parts.append((block, np.frombuffer(data, _SENT, n, 4), np.frombuffer(data, np.uint8, offset=4 + n * _SENT.itemsize)))
        if parts:
            blocks = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            heads, buffer = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            sizes = heads["many"].astype(np.int64) - 1 + shape.length
            starts = np.cumsum(sizes) - sizes
            order = np.lexsort((heads["at"], blocks, heads["hash"], heads["id"], heads["null"]))
            blocks, heads, starts = blocks[order], heads[order], starts[order]
            many, off = heads["many"].astype(np.int64), heads["off"].astype(np.int64)
            flags, _ = repeated_windows(buffer, starts, many, off, shape)
            ranges, record = ranges_of(flags, heads["at"].astype(np.int64), shape.length)
            by = np.argsort(blocks[record], kind="stable")
            of_block, ranges = blocks[record][by], ranges[by]
            rows += [(int(of_block[a]), ranges[a:b].tobytes(), *[None] * 5) for a, b in _runs(of_block)]
            if len(sent.value):
                grams = np.ascontiguousarray(buffer[(starts + off)[:, None] + np.arange(shape.gram)]).view(f"S{shape.gram}")[:, 0]
                whole = buffer.tobytes()
                for i in np.flatnonzero(np.isin(grams, sent.value)).tolist():
                    h = heads[i]
                    for j in np.flatnonzero(~flags[i, : many[i]]).tolist():
                        rows.append((int(blocks[i]), None, whole[starts[i] + j : starts[i] + j + shape.length], int(h["null"]), int(h["id"]), int(h["hash"]), int(h["at"]) + j))
        return pa.Table.from_batches([_rows(_RESOLVED, rows)])

    return dealt.groupBy("_bucket").applyInArrow(of_bucket, _RESOLVED_SQL)


def _across(resolved: DataFrame, length: int) -> DataFrame:
    """_block, _data: ranges of windows that a bucket holds first, but another one earlier."""
    place = F.struct("_null", "_id", "_hash", "_block", "_at")
    windows = resolved.where("_window IS NOT NULL").select("_window", "_block", "_at", place.alias("_place"))
    firsts = windows.groupBy("_window").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = windows.join(firsts, "_window").where("_place <> _first")
    # a range as two words of four bytes, the lowest first
    digits = [F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0") for x in (F.col("_at"), F.col("_at") + length) for i in range(4)]
    return later.select("_block", F.unhex(F.concat(*digits)).alias("_data"))


def _cleaned(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """_id, _size, _spans, _kept of each document."""

    def of_block(block: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows:
            sizes = np.array(block.column("_sizes")[0].as_py(), np.int64)
            buffer, ends = _buffer(sizes, block.column("_data")[0].as_py()), np.cumsum(sizes)
            change = np.zeros(len(buffer) + 1, np.int32)
            for data in found.column("_data").to_pylist():
                part = np.frombuffer(data, _RANGE)
                np.add.at(change, part["start"], 1)
                np.add.at(change, part["end"], -1)
            gone = np.cumsum(change[:-1]) > 0
            for doc, start, end in zip(block.column("_ids")[0].as_py(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                here = gone[start:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]]))).reshape(-1, 2)
                out.append((doc, end - start, [{"start": a, "end": b} for a, b in edges.tolist()], buffer[start:end][~here].tobytes()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_batches([_rows({"_id": pa.int64(), "_size": pa.int64(), "_spans": span, "_kept": pa.binary()}, out)])

    found = blocks.groupBy("_block").cogroup(ranges.groupBy("_block"))
    return found.applyInArrow(of_block, "_id long, _size long, _spans array<struct<start: long, end: long>>, _kept binary")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (byte ranges that are removed), kept (what is left, bytes): every byte goes that a string of length bytes
    covers which also starts earlier, in a document before it or in its own.
    """
    spark, shape = docs.sparkSession, Shape(length)
    blocks = blocks_of(docs, id_col, text_col)
    total = blocks.agg(F.sum(F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    asked = _asked(blocks, shape, max(_partitions(spark), 2 * total * _ASK.itemsize // shape.window // ASKED))
    wanted = settle(_wanted(asked))
    sent = (wanted.agg(F.sum(F.octet_length("_data"))).first()[0] or 0) // _RECORD.itemsize * (length + shape.window // 2 + _SENT.itemsize)
    cuts = splitters(blocks, wanted, shape, max(_partitions(spark), sent // BUCKET))
    resolved = settle(_resolved(_dealt(blocks, wanted, shape, cuts), shape, cuts))
    ranges = resolved.where("_window IS NULL").select("_block", "_data")
    if (cuts[1:] == cuts[:-1]).any():
        ranges = ranges.unionByName(_across(resolved, length))
    return _cleaned(blocks, ranges).select(F.col("_id").alias(id_col), F.col("_size").alias("n_bytes"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))
