"""Packing documents into windows of tokens by non-negative least squares over shallow length combinations.

1. A document's ids (with the separator) are cut into full windows and one remainder; every piece gets the CRC of its ids
   in the same pass. Only lengths, places and CRCs go on, never ids.
2. The histogram of remainder lengths, in bins of `grain` tokens (at most window / grain numbers, whatever the input),
   is fitted by repeat counts x >= 0 of all combinations of up to three bins that fill a window exactly:
   min |A x - h|^2 by the active-set method.
3. The counts are rounded down, and what is left is packed greedily, longest first and best fit, on the histogram. A
   pattern counts only if it fills `min_fill` of the window.
4. What cannot be packed so well is laid end to end and cut at window ends; only the few documents cut there are
   tokenized again, for the CRCs of their parts.

Pieces find their slots by rank inside their bin. Ranks come from counts per (bin, hash bucket) and a row number inside
each such cell, so no bin, however common, meets in one task; the plan sent to the tasks has at most a few thousand rows.

Defined cases: a null text is an empty document, whose only id is the separator; repeated rows are packed each, with an id
or without one; pieces of one length (ties) are placed by hash, id and start, and equal rows are interchangeable; a text
of any length is encoded in parts, but its ids are held by one task while it is cut; an empty table gives no pieces;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, settle
from .tokens import encoder

WINDOW, GRAIN, MIN_FILL = 1024, 4, 0.985
#: Rows of a rank cell, about.
CELL = 500_000


def combinations(window_bins: int) -> list[tuple[int, ...]]:
    """All sums of two or three bins that fill the window, longest bin first."""
    pairs = [(a, window_bins - a) for a in range(window_bins - 1, (window_bins - 1) // 2, -1) if a >= window_bins - a]
    triples = [(a, b, window_bins - a - b) for a in range(window_bins - 2, 0, -1) for b in range(min(a, window_bins - a - 1), 0, -1) if b >= window_bins - a - b > 0]
    return pairs + triples


def nonnegative_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |A x - h|: Lawson and Hanson's active set, on normal equations; h[b] counts bin b."""
    a = np.zeros((len(histogram), len(combos)))
    for j, combo in enumerate(combos):
        for b in combo:
            a[b, j] += 1
    x = np.zeros(len(combos))
    active: list[int] = []
    scale = max(1.0, float(histogram.max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (histogram - a @ x)
        gain[active] = -1
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * scale:
            break
        active.append(best)
        while True:
            part = a[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ histogram)
            if solved.min() > 0:
                x[:] = 0
                x[active] = solved
                break
            now = x[active]
            down = solved <= 0
            step = np.min(now[down] / np.maximum(now[down] - solved[down], 1e-300))
            now = now + step * (solved - now)
            stay = (now > 1e-12 * scale)
            x[:] = 0
            active = [j for j, s in zip(active, stay, strict=True) if s]
            x[active] = now[stay]
            if not active:
                break
    return x


def plan_patterns(histogram: dict[int, int], window_bins: int, min_fill: float) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats), using no bin more often than it occurs. Bins left out are to be cut."""
    left = np.zeros(window_bins + 1)
    for b, n in histogram.items():
        left[b] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window_bins]:
        out.append(((window_bins,), int(left[window_bins])))
        left[window_bins] = 0
    if not left.any():
        return out
    combos = [c for c in combinations(window_bins) if all(left[b] > 0 for b in c)]
    if combos:
        x = nonnegative_counts(combos, left.copy())
        for j in np.argsort(-x, kind="stable"):
            uses = {b: combos[j].count(b) for b in combos[j]}
            n = min(int(x[j] + 1e-6), *(int(left[b]) // u for b, u in uses.items()))
            if n > 0:
                out.append((combos[j], n))
                for b, u in uses.items():
                    left[b] -= n * u
    longest = window_bins
    while longest:
        if left[longest] <= 0:
            longest -= 1
            continue
        pattern, room, free = [longest], window_bins - longest, left.copy()
        free[longest] -= 1
        while room and (fits := np.flatnonzero(free[1 : room + 1] > 0)).size:
            b = int(fits[-1]) + 1
            many = min(room // b, int(free[b]))
            pattern += [b] * many
            free[b] -= many
            room -= many * b
        if window_bins - room < min_fill * window_bins:
            longest -= 1  # these are cut
            continue
        n = min(int(left[b]) // pattern.count(b) for b in set(pattern))
        out.append((tuple(pattern), n))
        for b in set(pattern):
            left[b] -= n * pattern.count(b)
    return out


def _pieces(path: str, by_rank: bool, window: int, separator: int):
    names = ["_id", "_hash", "start", "length", "ids_crc32", "doc_tokens"]
    end = int(separator).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, by_rank)
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                ids = enc.ids(text.as_py()) + end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    rows.append(row)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(len(ids) // 4)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))], names)

    return pieces


def _recut(path: str, by_rank: bool, separator: int):
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "_place"]
    end = int(separator).to_bytes(4, "little")

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, by_rank)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for row, (text, start, length, first, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "start", "length", "_first", "_place")), strict=True)):
                ids = enc.ids(text) + end
                for at, n, where in ((start, first, place), (start + first, length - first, place + first)):
                    for column, value in zip(out, (row, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4, where), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], names)

    return recut


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, separator: int = 0, grain: int = GRAIN, min_fill: float = MIN_FILL, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window % grain:
        raise ValueError("grain must divide window")
    spark, bins = docs.sparkSession, window // grain
    source = id_and_text(docs, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    source = source.select("_id", F.xxhash64("_text").alias("_hash"), "_text")
    kind, by_rank = dict(source.dtypes)["_id"], encoder(path).merges_by_rank()
    pieces = settle(source.mapInArrow(_pieces(path, by_rank, window, separator), f"_id {kind}, _hash long, start long, length long, ids_crc32 long, doc_tokens long"))
    pieces = pieces.withColumn("_bin", F.ceil(F.col("length") / grain).cast("int"))

    counts = {r["_bin"]: r["n"] for r in pieces.groupBy("_bin").agg(F.count("*").alias("n")).collect()}  # at most window / grain rows
    slots, used, base = [], {}, 0
    for pattern, repeats in plan_patterns(counts, bins, min_fill):
        for place, b in enumerate(pattern):
            lo = used.get(b, 0)
            slots.append((b, lo, lo + repeats, base, place))
            used[b] = lo + repeats
        base += repeats
    plan = spark.createDataFrame(slots, "_bin int, _lo long, _hi long, _base long, _place long")

    cells = max(64, sum(counts.values()) // CELL)
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64("_id", "start", "_hash"), F.lit(cells)).cast("int"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_bin", "_cell").agg(F.count("*").alias("_n")).withColumn("_from", before(Window.partitionBy("_bin").orderBy("_cell"), "_n")).drop("_n")
    in_cell = F.row_number().over(Window.partitionBy("_bin", "_cell").orderBy("_id", "start", "_hash")) - 1
    ranked = dealt.withColumn("_rank", in_cell).join(starts, ["_bin", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_from"))
    slot = F.broadcast(plan.withColumnRenamed("_bin", "_b"))  # patterns times their depth: bounded by the bins
    placed = ranked.join(slot, (F.col("_bin") == F.col("_b")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")), "left")
    placed = settle(placed.select("_id", "_hash", "start", "length", "ids_crc32", "doc_tokens", "_cell", (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "_place"))

    columns = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "_place"]
    loose = placed.where("sequence_id IS NULL")
    sums = loose.groupBy("_cell").agg(F.sum("length").alias("_n")).withColumn("_from", before(Window.orderBy("_cell"), "_n")).drop("_n")
    along = before(Window.partitionBy("_cell").orderBy("_id", "start", "_hash"), "length")
    loose = loose.withColumn("_place", along).join(sums, "_cell").withColumn("_place", F.col("_place") + F.col("_from"))
    loose = settle(loose.withColumn("_first", F.lit(window) - F.col("_place") % window).select("_id", "_hash", "start", "length", "ids_crc32", "doc_tokens", "_place", "_first"))
    is_cut = F.col("_first") < F.col("length")
    cut = loose.where(is_cut).withColumnRenamed("_id", "_cid").withColumnRenamed("_hash", "_chash").drop("ids_crc32", "doc_tokens")
    texts = source.join(cut.select("_cid", "_chash").distinct(), F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")), "left_semi").dropDuplicates(["_id", "_hash"])
    parts = cut.join(texts, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash"))).select("_id", "_text", "start", "length", "_first", "_place")
    parts = parts.mapInArrow(_recut(path, by_rank, separator), f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _place long")
    end_to_end = loose.where(~is_cut).select(*parts.columns).unionByName(parts)
    end_to_end = end_to_end.withColumn("sequence_id", F.lit(base) + F.floor(F.col("_place") / window))

    out = placed.where("sequence_id IS NOT NULL").select(*columns).unionByName(end_to_end.select(*columns))
    offset = before(Window.partitionBy("sequence_id").orderBy("_place"), "length")
    shared = out.where(F.col("length") < window).withColumn("offset", offset)
    alone = out.where(F.col("length") == window).withColumn("offset", F.lit(0).cast("long"))
    return shared.unionByName(alone).select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
