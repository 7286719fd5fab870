"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are turned by one orthonormal transform, the principal axes of a sample of at most about SAMPLE vectors, so that most of
what tells them apart comes first; inner products stay what they are. A turned vector is cut into 1, 4 and 16 segments,
short ones first. With the mean and deviation of each segment, Cauchy-Schwarz gives for a segment of length m:
sum(q * x) <= m * (mean_q * mean_x + dev_q * dev_x), and so a lower bound of the distance |q|^2 + |x|^2 - 2 q.x. Exact
scores of a few likely candidates give each query the score to reach; bounds are taken coarse to fine, each level on the
candidates that the last one left, and only survivors are scored exactly, on the whole numbers themselves.

Queries and candidates are dealt into blocks by a hash; each pair of blocks is one group of bounded size, and only k rows
per query leave it. Nothing that grows with the data is broadcast or collected. How much the bounds save depends on the
vectors: nothing where all directions are alike, most where few directions tell them apart.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors are compared
with those of the same length, however long; a query is never its own candidate (rows with its id are left out); rows
with a null id take no part; equal rows are one query, rows with the same id and different vectors are several, each with
ranks of its own; as candidates all rows count, equal ones, too; ties go to the smaller id; components and scores beyond a long
count as the largest or smallest long; fewer than k candidates give
all of them; an empty table gives no rows; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 32768
LEVELS = (1, 4, 16)
#: Scores are computed for so many query-candidate pairs at a time.
PAIRS = 2_000_000
#: Vectors from which the transform is taken, about (twice as many at most), and the longest that are turned.
SAMPLE, TURNED = 4096, 512
#: Candidates of a block that are scored first to find the score to reach.
SEEDS = 512
LONG = (1 << 63) - 1


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(doubles, lambda x: F.floor(F.lit(scale) * x).cast("long")))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the direction with the largest mean square first."""
    _, axes = np.linalg.eigh(sample.T.astype(float) @ sample)
    return axes[:, ::-1]


def _cuts(length: int, segments: int) -> np.ndarray:
    """Where segments begin and end: lengths grow evenly by factors, as what comes first tells most."""
    if segments >= length:
        return np.arange(length + 1)
    ends = np.round(length ** (np.arange(1, segments + 1) / segments)).astype(int)
    return np.unique([0, *ends])


def _statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per vector, sqrt(m) * mean and sqrt(m) * deviation of each segment, side by side: dot products of these are bounds."""
    cuts = _cuts(vectors.shape[1], segments)
    m = np.diff(cuts)
    sums = np.add.reduceat(vectors, cuts[:-1], axis=1)
    squares = np.add.reduceat(vectors * vectors, cuts[:-1], axis=1)
    deviations = np.sqrt(np.maximum(squares - sums * sums / m, 0))
    return np.hstack([sums / np.sqrt(m), deviations[:, m > 1]])


def _side(vectors: np.ndarray) -> np.ndarray:
    """On which sides of the first axes a vector lies, as a number."""
    first = vectors[:, :8] > 0
    return first @ (1 << np.arange(first.shape[1]))


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, axes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list, list[int]]:
    """Places in q, places in x and scores of the k best candidates of each query; and how many pairs each level left."""
    qf, xf = q.astype(float), x.astype(float)
    exact = max(1, abs(qf).max()) * max(1, abs(xf).max()) * q.shape[1] < 2.0**53  # else scores are worked out as Python's whole numbers
    turned = [v if axes is None else v @ axes for v in (qf, xf)]
    slack = 1e-6 * (np.linalg.norm(qf, axis=1) * (np.linalg.norm(xf, axis=1).max() + 1)) + 1e-6
    levels = [[_statistics(v, s) for v in turned] for s in LEVELS]
    # likely candidates of a query lie on its side of the first axes
    sides = [_side(v) for v in turned]
    q_order, x_order = (np.argsort(side, kind="stable") for side in sides)
    spread = x_order[:: max(1, 2 * len(x_order) // SEEDS)]
    survivors = [0] * len(levels)
    places: tuple[list, list, list] = ([], [], [])
    step = max(1, PAIRS // len(x))
    for at in range(0, len(q), step):
        rows = q_order[at : at + step]
        middle = np.searchsorted(sides[1][x_order], sides[0][rows[len(rows) // 2]])
        seeds = np.union1d(x_order[max(0, middle - SEEDS // 4) : middle + SEEDS // 4], spread)
        least = np.full(len(rows), -np.inf)
        if len(seeds) >= k:
            first = np.where(q_ids[rows, None] != x_ids[seeds], np.clip(qf[rows] @ xf[seeds].T, -LONG - 1, LONG), -np.inf)
            least = np.partition(first, len(seeds) - k, axis=1)[:, len(seeds) - k]
        reach = (least - slack[rows])[:, None]
        columns, alive = np.arange(len(x)), q_ids[rows, None] != x_ids
        for i, (a, b) in enumerate(levels):
            alive &= a[rows] @ b[columns].T >= reach
            left = alive.any(axis=0)
            columns, alive = columns[left], alive[:, left]
            survivors[i] += int(alive.sum())
        if not len(columns):
            continue
        if exact:
            scores = np.where(alive, qf[rows] @ xf[columns].T, -np.inf)
        else:
            scores = np.where(alive, np.minimum(np.maximum(q[rows].astype(object) @ x[columns].astype(object).T, -LONG - 1), LONG), -np.inf)
        many = min(k, len(columns))
        ranked = np.partition(scores, len(columns) - many, axis=1) if exact else np.sort(scores, axis=1)
        least = ranked[:, len(columns) - many]
        j, i = np.nonzero(alive & (scores >= least[:, None]))
        order = np.lexsort((x_ids[columns[i]], np.unique(-scores[j, i], return_inverse=True)[1], j))
        j, i = j[order], i[order]
        taken = np.arange(len(j)) - np.searchsorted(j, j) < k
        places[0].append(rows[j[taken]])
        places[1].append(columns[i[taken]])
        places[2].extend(map(int, scores[j[taken], i[taken]]))
    whole = [np.concatenate(p) if p else np.zeros(0, int) for p in places[:2]]
    return whole[0], whole[1], places[2], survivors


def _matrix(table: pa.Table) -> np.ndarray:
    vectors = table.column("_v").combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def segment_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k largest inner products of whole-number vectors for each query."""
    spark = vectors.sparkSession
    ready = vectors.select(F.col(id_col).cast("long").alias("_id"), quantized(F.col(vector_col)).alias("_v"), is_query.alias("_q")).where("_id IS NOT NULL AND _v IS NOT NULL")
    ready = settle(ready.withColumn("_key", F.xxhash64("_id", "_v")).withColumn("_d", F.size("_v")).withColumn("_row", F.monotonically_increasing_id()))
    n, nq = ready.agg(F.count("*"), F.count(F.when(F.col("_q"), 1))).first()
    tasks = min(spark.sparkContext.defaultParallelism, -(-n // 4096))  # a small table still gives every core a group
    n_groups, n_blocks = max(1, tasks, -(-n // CANDIDATE_BLOCK)), max(1, -(-nq // QUERY_BLOCK))

    share = F.lit(min(1 << 31, (SAMPLE << 31) // max(1, n)))
    sampled = ready.where((F.col("_d") <= TURNED) & (F.col("_key").bitwiseAND(F.lit((1 << 31) - 1)) < share)).dropDuplicates(["_key"])
    sample = sampled.limit(2 * SAMPLE).select("_v").toArrow().column("_v").to_pylist()
    axes = {d: principal_axes(np.array([v for v in sample if len(v) == d])) for d in set(map(len, sample))}
    sent = spark.sparkContext.broadcast(axes)  # no more numbers than the sample has, times TURNED / SAMPLE

    dealt = lambda many, *by: F.pmod(F.xxhash64(*by), F.lit(many)).cast("int")  # noqa: E731  # candidates by row, so that equal ones spread
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    queries = ready.where("_q").dropDuplicates(["_id", "_v"]).select("_id", "_key", "_v", "_d", dealt(n_blocks, "_key").alias("_block"), every(n_groups).alias("_group"))
    candidates = ready.select("_id", "_v", "_d", every(n_blocks).alias("_block"), dealt(n_groups, "_row").alias("_group"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if left.num_rows and right.num_rows:
            q, x = _matrix(left), _matrix(right)
            q_ids, x_ids = left.column("_id").to_numpy(), right.column("_id").to_numpy()
            j, i, scores, _ = best_of(q, q_ids, x, x_ids, k, sent.value.get(q.shape[1]))
            found = (q_ids[j], left.column("_key").to_numpy()[j], x_ids[i], scores)
        return pa.table({name: pa.array(v, pa.int64()) for name, v in zip(("query_id", "_key", "vec_id", "score"), found, strict=True)})

    keys = ("_block", "_group", "_d")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(pair, "query_id long, _key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
