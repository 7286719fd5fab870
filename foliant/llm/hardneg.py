"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels in a window of scores.

Rows are packed by sort-tile-recursive: the label is the first coordinate, the components follow by falling variance. Cuts
from a bounded sample deal the rows into tiles of bounded size, rows that lie on a cut to either side by turns, so equal rows
spread. In each tile an R-tree is packed the same way. A node's box bounds each component, so q_i * [low_i, high_i] is an
interval for every coordinate, and the intervals' sum bounds the inner product with a query. A queue takes boxes by falling
upper bound: boxes without rows of a wanted label, outside all score windows, or strictly below the k-th score found in each
window they reach, are not opened; boxes that may tie are. Rows of opened leaves are scored exactly.

Tiles meet blocks of anchors, each pair in one group of bounded size; k rows an anchor and window leave it. The first search
finds the positives, whose scores give the windows of the second. Where directions are all alike, boxes of many dimensions
overlap in score and most leaves are opened.

Defined cases: rows with a null id or label, a null or empty vector, or any null or non-finite component take no part; vectors
meet those of the same length; a row is neither positive nor negative of its own id; equal rows are one anchor, rows with one
id and different vectors or labels are several; as positives and negatives repeated rows all count; ties go to the smaller id;
components and scores beyond a long count as the largest or smallest long; an anchor without positives, a positive without
negatives and an empty table give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle
from .topk import quantized

#: Rows of a tile, anchors of a block, rows of a leaf, children of a node.
TILE, ANCHORS, LEAF, FAN = 32768, 16384, 128, 8
#: Rows that the tiles' cuts are taken from, about (twice as many at most).
SAMPLE = 8192
LONG = (1 << 63) - 1


def _slabs(n: int, dims: int) -> tuple[int, int]:
    """Into how many slabs n parts are cut along the first of dims dimensions, and how many dimensions are worth cutting."""
    dims = max(1, min(dims, round(math.log(max(n, 2), 4))))
    return max(1, math.ceil(n ** (1 / dims))), dims


def cuts_of(points: np.ndarray, n: int, dims: list[int]) -> tuple | None:
    """n tiles as nested cuts: (dimension, cut values, what is inside each slab); None is a tile."""
    if n <= 1 or not len(points):
        return None
    slabs, many = _slabs(n, len(dims))
    slabs = n if many == 1 else slabs
    values = np.sort(points[:, dims[0]])
    cuts = values[[len(values) * i // slabs for i in range(1, slabs)]]
    which = np.minimum(np.searchsorted(cuts, points[:, dims[0]], "left"), slabs - 1)
    inside = [n // slabs + (i < n % slabs) for i in range(slabs)]
    return dims[0], cuts, [cuts_of(points[which == i], x, dims[1:] or dims) for i, x in enumerate(inside)]


def tile_of(cuts: tuple | None, points: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Each point's tile. A value that equals cuts may lie in any slab that touches it: turns, a number for each point, decides."""
    tiles, n = np.zeros(len(points), int), 0

    def fill(node: tuple | None, rows: np.ndarray) -> None:
        nonlocal n
        if node is None:
            tiles[rows] = n
            n += 1
            return
        dim, values, inner = node
        first, last = (np.searchsorted(values, points[rows, dim], side) for side in ("left", "right"))
        slab = first + (turns[rows] >> (4 * (dim % 8))) % (last - first + 1)
        for i, child in enumerate(inner):
            fill(child, rows[slab == i])

    fill(cuts, np.arange(len(points)))
    return tiles


class Tree:
    """An R-tree of one tile's rows, packed by sort-tile-recursive, its leaves' rows side by side."""

    def __init__(self, labels: np.ndarray, vectors: np.ndarray, ids: np.ndarray):
        points = np.column_stack([labels, vectors])
        dims = [0, *(1 + np.argsort(-vectors.astype(float).var(axis=0)))]
        order = self._packed(points, np.arange(len(ids)), dims)
        self.labels, self.vectors, self.ids = labels[order], vectors[order], ids[order]
        starts = np.arange(0, len(order), LEAF)
        self.lows, self.highs = [np.minimum.reduceat(points[order], starts)], [np.maximum.reduceat(points[order], starts)]
        while len(self.lows[-1]) > 1:
            starts = np.arange(0, len(self.lows[-1]), FAN)
            self.lows.append(np.minimum.reduceat(self.lows[-1], starts))
            self.highs.append(np.maximum.reduceat(self.highs[-1], starts))

    def _packed(self, points: np.ndarray, rows: np.ndarray, dims: list[int]) -> np.ndarray:
        rows = rows[np.argsort(points[rows, dims[0]], kind="stable")]
        leaves = -(-len(rows) // LEAF)
        slabs, many = _slabs(leaves, len(dims))
        if many == 1 or leaves <= 1:
            return rows
        step = -(-leaves // slabs) * LEAF
        return np.concatenate([self._packed(points, rows[i : i + step], dims[1:]) for i in range(0, len(rows), step)])

    def bounds(self, level: int, nodes: slice, rising: np.ndarray, falling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that rows of some nodes can have; rising and falling: the query's positive and negative components."""
        low, high = self.lows[level][nodes, 1:], self.highs[level][nodes, 1:]
        return low @ rising + high @ falling, high @ rising + low @ falling


def search(tree: Tree, query: np.ndarray, own: int, wanted: Callable[[np.ndarray], np.ndarray], may_hold: Callable[[np.ndarray, np.ndarray], np.ndarray], windows: list[tuple[int, int]], k: int) -> tuple[list, int]:
    """For each window of scores the k best (score, id) among rows of a wanted label; and how many leaves were opened."""
    rising, falling = np.maximum(query, 0), np.minimum(query, 0)
    found = [(np.zeros(0, query.dtype), np.zeros(0, np.int64)) for _ in windows]
    least = [low for low, _ in windows]  # what a score must reach to count
    opened, queue = 0, []

    def push(level: int, nodes: slice) -> None:
        low, high = tree.bounds(level, nodes, rising, falling)
        holds = may_hold(tree.lows[level][nodes, 0], tree.highs[level][nodes, 0])
        reached = np.logical_or.reduce([(high >= a) & (low <= b) for a, (_, b) in zip(least, windows, strict=True)])
        for i in np.flatnonzero(holds & reached):
            heapq.heappush(queue, (-high[i], level, nodes.start + int(i), low[i]))

    top = len(tree.lows) - 1
    push(top, slice(0, len(tree.lows[top])))
    while queue:
        high, level, node, low = heapq.heappop(queue)
        if -high < min(least):
            break
        if not any(-high >= a and low <= b for a, (_, b) in zip(least, windows, strict=True)):
            continue
        if level:
            push(level - 1, slice(node * FAN, min((node + 1) * FAN, len(tree.lows[level - 1]))))
            continue
        opened += 1
        rows = slice(node * LEAF, (node + 1) * LEAF)
        scores = tree.vectors[rows] @ query
        if scores.dtype == object:
            scores = np.array([max(-LONG - 1, min(LONG, s)) for s in scores], object)
        near = np.flatnonzero((scores >= min(least)) & (scores <= max(b for _, b in windows)) & wanted(tree.labels[rows]) & (tree.ids[rows] != own))
        if not len(near):
            continue
        scores, ids = scores[near], tree.ids[rows][near]
        for j, (_, most) in enumerate(windows):
            fits = (scores >= least[j]) & (scores <= most)
            if fits.any():
                s, i = np.concatenate([found[j][0], scores[fits]]), np.concatenate([found[j][1], ids[fits]])
                order = np.lexsort((i, -s))[:k]
                found[j] = s[order], i[order]
                if len(order) == k:
                    least[j] = max(least[j], s[order[-1]])
    return [list(zip(map(int, s), map(int, i), strict=True)) for s, i in found], opened


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = table.column("_v").combine_chunks()
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return table.column("_label").to_numpy(), matrix, table.column("_id").to_numpy()


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where all sums of products are whole numbers that doubles hold, else as Python's whole numbers."""
    size = math.prod(max(1.0, float(np.abs(a.astype(float)).max(initial=0))) for a in arrays) * arrays[0].shape[-1]
    return [a.astype(float if size < 2.0**53 else object) for a in arrays]


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id",
    vector_col: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score: for each anchor and each of its
    n_positives best rows of the same label, the k best of other labels with scores of least to most percent of the positive's.
    """
    spark = rows.sparkSession
    columns = F.col(id_col).cast("long").alias("_id"), (F.col("label") if label is None else label).cast("long").alias("_label"), quantized(F.col(vector_col), scale).alias("_v")
    ready = rows.select(*columns, is_anchor.alias("_anchor")).where("_id IS NOT NULL AND _label IS NOT NULL AND _v IS NOT NULL")
    ready = settle(ready.withColumn("_d", F.size("_v")).withColumn("_row", F.monotonically_increasing_id()))

    # tiles: cuts from a sample, for each length of vector
    share = F.lit(SAMPLE << 16)
    sizes = {r["_d"]: (r["n"], r["a"]) for r in ready.groupBy("_d").agg(F.count("*").alias("n"), F.count(F.when(F.col("_anchor"), 1)).alias("a")).collect()}
    least_tiles = spark.sparkContext.defaultParallelism
    tiles = {d: max(1, -(-n // TILE), min(least_tiles, -(-n // (8 * LEAF)))) for d, (n, _) in sizes.items()}
    blocks = {d: max(1, -(-a // ANCHORS)) for d, (_, a) in sizes.items()}
    counts = F.create_map(*(F.lit(x) for d, (n, _) in sizes.items() for x in (d, n))) if sizes else F.lit(None)
    cuts: dict[int, tuple | None] = {}
    if any(n > 1 for n in tiles.values()):
        drawn = ready.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 16)) * counts[F.col("_d")] < share).limit(2 * SAMPLE).select("_d", "_label", "_v").toArrow()
        for d in tiles:
            of_d = drawn.filter(pc.equal(drawn.column("_d"), d))
            if tiles[d] > 1 and of_d.num_rows:
                labels, matrix, _ = _rows_of(of_d.append_column("_id", of_d.column("_label")))
                points = np.column_stack([labels, matrix])
                cuts[d] = cuts_of(points, tiles[d], [0, *(1 + np.argsort(-matrix.astype(float).var(axis=0)))])
    sent = spark.sparkContext.broadcast(cuts)  # about one number a tile

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, tile = pa.Table.from_batches([batch]), np.zeros(batch.num_rows, int)
            lengths = table.column("_d").to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                labels, matrix, _ = _rows_of(table.take(pa.array(at)))
                turns = (table.column("_row").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)
                tile[at] = tile_of(sent.value.get(int(d)), np.column_stack([labels, matrix]), turns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile, pa.int32())], [*batch.schema.names, "_tile"])

    number = lambda of: F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col("_d")] if of else F.lit(1)
    every = lambda of: F.explode(F.sequence(F.lit(0), number(of) - 1))
    dealt = ready.mapInArrow(deal, T.StructType([*ready.schema.fields, T.StructField("_tile", T.IntegerType())]))
    dealt = settle(dealt.select("_id", "_label", "_v", "_d", "_tile"))
    key = F.xxhash64("_id", "_label", "_v")
    anchors = ready.where("_anchor").dropDuplicates(["_id", "_label", "_v"]).select("_id", "_label", "_v", "_d", key.alias("_key"), F.pmod(key, number(blocks)).cast("int").alias("_block"))
    keys = ("_block", "_tile", "_d")
    candidates = dealt.select("*", every(blocks).alias("_block"))

    def searched(asked: DataFrame, same: bool, many: int) -> DataFrame:
        """_anchor_id, _key, _place of the window, _found id, _score; asked has _windows, whose [score, score] pairs are in _lows and _highs."""

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                q_labels, q, q_ids = _rows_of(left)
                labels, x, ids = _rows_of(right)
                q, x = _exact(q, x)
                labels, q_labels = np.split(np.unique(np.concatenate([labels, q_labels]), return_inverse=True)[1], [len(labels)])
                tree = Tree(labels, x, ids)
                lows, highs = (left.column(c).to_pylist() for c in ("_lows", "_highs"))
                for i, (own, label, name) in enumerate(zip(q_ids, q_labels, left.column("_key").to_pylist(), strict=True)):
                    if same:
                        wanted, may_hold = (lambda x, a=label: x == a), (lambda low, high, a=label: (low <= a) & (high >= a))
                    else:
                        wanted, may_hold = (lambda x, a=label: x != a), (lambda low, high, a=label: (low != a) | (high != a))
                    found, _ = search(tree, q[i], own, wanted, may_hold, list(zip(lows[i], highs[i], strict=True)), many)
                    out += [(int(own), name, j, row, score) for j, best in enumerate(found) for score, row in best]
            names = ("_anchor_id", "_key", "_place", "_found", "_score")
            return pa.table({n: pa.array([r[i] for r in out], pa.int32() if n == "_place" else pa.int64()) for i, n in enumerate(names)})

        schema = "_anchor_id long, _key long, _place int, _found long, _score long"
        found = asked.select("*", every(tiles).alias("_tile")).groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(pair, schema)
        rank = F.row_number().over(Window.partitionBy("_anchor_id", "_key", "_place").orderBy(F.desc("_score"), "_found"))
        return found.withColumn("rank", rank).where(F.col("rank") <= many)

    all_scores = F.array(F.lit(-LONG - 1).cast("long")), F.array(F.lit(LONG))
    positives = settle(searched(anchors.select("*", all_scores[0].alias("_lows"), all_scores[1].alias("_highs")), True, n_positives))
    # the whole scores s with least * p <= 100 * s <= most * p
    p = F.col("_score").cast("decimal(38,0)")
    low, high = F.ceil(p * least / 100).cast("long"), F.floor(p * most / 100).cast("long")
    held = F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high"))))
    windows = positives.groupBy("_key").agg(held.alias("_w")).select("_key", F.col("_w.low").alias("_lows"), F.col("_w.high").alias("_highs"))
    negatives = searched(anchors.join(windows, "_key"), False, k)
    of_positive = positives.select("_key", (F.col("rank") - 1).alias("_place"), F.col("_found").alias("positive_id"), F.col("_score").alias("positive_score"))
    joined = negatives.join(of_positive, ["_key", "_place"])
    return joined.select(F.col("_anchor_id").alias("anchor_id"), "positive_id", "rank", F.col("_found").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score"))
