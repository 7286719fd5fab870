"""Page retrieval: vectors, dense and late-interaction ranking, recall.

A flat search pairs every query with every page by contract; queries are a stated set. Both are dealt into blocks of bounded
size, a task scores two blocks by matrix products and hands k pages per query on, which are then ranked by query. A search
inside a deck is a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are paired with all pages are broadcast up to so many bytes, about; more are dealt in blocks of that size.
MAX_BROADCAST_BYTES = 16 << 20
#: Numbers of the vectors in a block, about, and scores of a block's pairs that are held at a time.
BLOCK_NUMBERS, SCORES = 4_000_000, 1 << 21
#: Pages of a scope from which it is searched by blocks.
LARGE_SCOPE = 4096


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its norm, which counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """R2: per key, the mean vector of its rows whose mask is 1; the number of such rows counts as 1 at least."""
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    long = tokens.select(key, weight.alias("_w"), F.posexplode(vector).alias("_dim", "_x"))
    sums = long.groupBy(key, "_dim").agg(F.sum(F.col("_x").cast("double") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n"))
    pooled = sums.select(key, F.struct("_dim", (F.col("_s") / F.greatest("_n", F.lit(1.0))).alias("_v")).alias("_p"))
    return pooled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["_v"]).alias(vector))


def _bytes(df: DataFrame) -> int:
    """About how many bytes the rows hold: numbers as eight, strings as they are, arrays by their members."""
    def width(column: Column, kind: str) -> Column:
        if kind.startswith("array<array"):
            return 8 * F.size(F.flatten(column))
        if kind.startswith("array"):
            return 8 * F.size(column)
        return F.octet_length(column) if kind in ("string", "binary") else F.lit(16)

    row = sum((F.coalesce(width(F.col(f"`{c}`"), kind), F.lit(0)) for c, kind in df.dtypes), F.lit(16))
    return df.agg(F.sum(row)).first()[0] or 0


def score_pairs(queries: DataFrame, pages: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Queries with the pages they search: all of them, or those with the same scope columns (an equi join)."""
    if scope:
        return queries.join(pages, list(scope))
    size = _bytes(queries)
    blocks = -(-size // MAX_BROADCAST_BYTES)
    if blocks <= 1:
        return pages.crossJoin(F.broadcast(queries))
    # both sides in blocks of bounded size, so that no task gets all pages
    groups = max(1, -(-_bytes(pages) // MAX_BROADCAST_BYTES))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_block", dealt(queries, blocks)).withColumn("_group", every(groups))
    right = pages.withColumn("_group", dealt(pages, groups)).withColumn("_block", every(blocks))
    return right.join(left, ["_block", "_group"]).drop("_block", "_group")


def finite(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector, or list of vectors, is there and holds no null, NaN or infinite number."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    flat = lambda v: F.coalesce(F.forall(v, number), F.lit(False))
    nested = dict(df.dtypes)[vector].startswith("array<array<")
    return df.where(F.coalesce(F.forall(vector, flat), F.lit(False)) if nested else flat(F.col(vector)))


def _blocks(df: DataFrame, key: str, numbers: Column, least: int = 1) -> tuple[Column, int]:
    """In which block a row is, and how many there are."""
    total = df.agg(F.sum(numbers)).first()[0] or 0
    many = max(1, min(least, -(-total // 65536)), -(-total // BLOCK_NUMBERS))
    return F.pmod(F.xxhash64(key), F.lit(many)).cast("int"), many


def _best(values: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and values of the k largest of each row, ties to the smaller order."""
    many = min(k, values.shape[1])
    least = np.partition(values, values.shape[1] - many, axis=1)[:, values.shape[1] - many]
    rows, places = np.nonzero(values >= least[:, None])
    by = np.lexsort((order[places], -values[rows, places], rows))
    rows, places = rows[by], places[by]
    taken = np.arange(len(rows)) - np.searchsorted(rows, rows) < many
    rows, places = rows[taken], places[taken]
    return rows, places, values[rows, places]


def blocked_topk(queries: DataFrame, pages: DataFrame, k: int, length: Column, numbers: Column, score: Callable[[pa.Array, pa.Array], np.ndarray], scope: Sequence[str] = ()) -> DataFrame:
    """query, label, score, rank from queries (query, v) and pages (label, v): the k pages with the largest scores, rounded to
    six digits, ties to the smaller label. score gives a matrix for the vectors of two blocks, minus infinity where a page can't be
    among the k; only vectors of the same length meet, and of the same scope, which both sides then have and the result begins
    with. Vectors with a null, NaN or infinite number take no part. A task holds the scores of a slice of a block's queries.
    """
    kinds = {**dict(queries.dtypes), **dict(pages.dtypes)}
    ready = [finite(df.where(length > 0), "v") for df in (queries, pages)]
    (q_block, n_blocks), (p_block, n_groups) = _blocks(ready[0], "query", numbers), _blocks(ready[1], "label", numbers, queries.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ready[0].select(*scope, "query", "v", length.alias("_d"), q_block.alias("_block"), every(n_groups).alias("_group"))
    right = ready[1].select(*scope, "label", "v", length.alias("_d"), every(n_blocks).alias("_block"), p_block.alias("_group"))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows, places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and held.num_rows:
            v, labels = held.column("v").combine_chunks(), held.column("label").combine_chunks()
            order = pc.rank(labels, sort_keys="ascending", tiebreaker="dense").to_numpy()
            step = max(1, SCORES // held.num_rows)
            for first in range(0, asked.num_rows, step):
                scores = np.rint(score(asked.column("v").slice(first, step).combine_chunks(), v) * 1e6) / 1e6
                for all_, one in zip((rows, places, values), _best(scores, order, k), strict=True):
                    all_.append(one + first if all_ is rows else one)
        taken_from = lambda t, name, at: t.column(name).take(pa.array(np.concatenate(at), pa.int64()))
        found = {**{c: taken_from(asked, c, rows) for c in scope}, "query": taken_from(asked, "query", rows), "label": taken_from(held, "label", places)}
        return pa.table({**found, "score": pa.array(np.concatenate(values), pa.float64())})

    keys = (*scope, "_block", "_group", "_d")
    names = "".join(f"`{c}` {kinds[c]}, " for c in scope)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"{names}query {kinds['query']}, label {kinds['label']}, score double")
    return top_k(found, "query", "score", "label", k).select(*scope, "query", "label", "score", "rank")


def _numbers(vectors: pa.Array) -> np.ndarray:
    """The numbers of (nested) lists, end to end."""
    while pa.types.is_list(vectors.type) or pa.types.is_large_list(vectors.type):
        vectors = vectors.flatten()
    return vectors.to_numpy(zero_copy_only=False).astype(float)


def _cosines(asked: pa.Array, held: pa.Array) -> np.ndarray:
    q, p = (_numbers(v).reshape(len(v), -1) for v in (asked, held))
    return (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)) @ (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)).T


#: Groups that the tokens of a block of pages are told apart by, tokens these are taken from, and pages that are scored first (k at least).
GROUPS, DRAWN, FIRST = 64, 2048, 32


def _grouped(tokens: np.ndarray) -> np.ndarray:
    """Each token's group: the nearest of up to GROUPS tokens that lie far from each other, of DRAWN ones evenly spaced."""
    drawn = tokens[:: -(-len(tokens) // DRAWN)]
    chosen, far = [0], np.square(drawn - drawn[0]).sum(axis=1)
    while len(chosen) < min(GROUPS, len(drawn)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(drawn - drawn[chosen[-1]]).sum(axis=1))
    seeds = drawn[chosen]
    return (tokens @ seeds.T - 0.5 * np.square(seeds).sum(axis=1)).argmax(axis=1)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(_starts(lengths), lengths) + np.repeat(starts, lengths)


def late_interactions(asked: pa.Array, held: pa.Array, k: int) -> tuple[np.ndarray, int]:
    """Per query and page: each query token's best product over the page's tokens, summed; minus infinity for pages that can't be
    among the query's k best; and how many pairs were scored.

    A page's tokens fall into groups of near ones, each with a centre and a radius. A query token's best product is at most its
    largest q * centre + |q| * radius, so the sum of these bounds a page's score. The pages with the largest bounds are scored
    first; of the others only those whose bound reaches the k-th score.
    """
    width = len(asked[0][0])
    q, p = (_numbers(v).reshape(-1, width) for v in (asked, held))
    q_lengths, lengths = (v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for v in (asked, held))
    starts = _starts(lengths)
    page = np.repeat(np.arange(len(held)), lengths)
    group = _grouped(p)
    order = np.lexsort((group, page))
    p, group = p[order], group[order]
    run_starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (page[1:] != page[:-1])]))
    runs = np.bincount(page[run_starts], minlength=len(held))
    run_lengths = np.diff(np.append(run_starts, len(p)))
    centres = np.add.reduceat(p, run_starts, axis=0) / run_lengths[:, None]
    radii = np.maximum.reduceat(np.linalg.norm(p - np.repeat(centres, run_lengths, axis=0), axis=1), run_starts)
    out, scored = np.full((len(asked), len(held)), -np.inf), 0
    for i, (a, n) in enumerate(zip(_starts(q_lengths), q_lengths, strict=True)):
        tokens = q[a : a + n]
        most = tokens @ centres.T + np.linalg.norm(tokens, axis=1)[:, None] * radii
        bounds = np.maximum.reduceat(most, _starts(runs), axis=1).sum(axis=0)
        order = np.argsort(-bounds, kind="stable")
        first = max(k, FIRST)
        for turn in range(2):
            pages = order[:first] if not turn else order[first:][bounds[order[first:]] >= np.sort(out[i, order[:first]])[-k] - 2e-6]
            if len(pages):
                products = tokens @ p[_gathered(starts[pages], lengths[pages])].T
                out[i, pages] = np.maximum.reduceat(products, _starts(lengths[pages]), axis=1).sum(axis=0)
                scored += len(pages)
            if len(order) <= first:
                break
    return out, scored


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(score), F.col(tie))
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def dense_topk(queries: DataFrame, pages: DataFrame, k: int, scope: Sequence[str] = (), existing: DataFrame | None = None) -> DataFrame:
    """Cosine ranking. queries: query, qv and scope; pages: label, v and scope; existing keeps only its labels.

    Ties go to the smaller label. An unknown scope value finds nothing; vectors with a null, NaN or infinite number take no part. Without a scope, and
    where a scope has LARGE_SCOPE pages, the result is the scope's columns, query, label, score, rank.
    """
    if existing is not None:
        pages = pages.join(existing.select("label"), "label", "left_semi")
    if not scope:
        return blocked_topk(queries.select("query", F.col("qv").alias("v")), pages.select("label", "v"), k, F.size("v"), F.size("v"), _cosines)
    ready = pages.withColumn("v", l2_normalize(F.col("v")))
    asked = queries.withColumn("qv", l2_normalize(F.col("qv")))
    if (pages.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0) >= LARGE_SCOPE:  # more than one task should get
        known = [df.dropna(subset=list(scope)) for df in (queries, pages)]
        return blocked_topk(known[0].select(*scope, "query", F.col("qv").alias("v")), known[1].select(*scope, "label", "v"), k, F.size("v"), F.size("v"), _cosines, scope)
    scored = score_pairs(finite(asked, "qv"), finite(ready, "v"), scope).withColumn("score", F.round(dot(F.col("qv"), F.col("v")), 6))
    return top_k(scored.drop("qv", "v"), "query", "score", "label", k)


def maxsim(q: Column, d: Column) -> Column:
    """Late interaction of token arrays: per query token its best product over the page's tokens, summed."""
    return F.aggregate(F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))), F.lit(0.0), lambda s, x: s + x)


def maxsim_topk(queries: DataFrame, pages: DataFrame, k: int, scope: Sequence[str] = ()) -> DataFrame:
    """Queries: query, qv (array of vectors); pages: label, v (array of vectors). With a scope, an unknown value is an error."""
    if scope:
        missing = queries.join(pages.select(*scope).distinct(), list(scope), "left_anti").limit(1).count()
        if missing:
            raise ValueError("a query names a deck that has no page")
    else:
        width, numbers = F.size(F.get("v", F.lit(0))), F.size(F.flatten("v"))
        return blocked_topk(queries.select("query", F.col("qv").alias("v")), pages.select("label", "v"), k, width, numbers, lambda asked, held: late_interactions(asked, held, k)[0])
    scored = score_pairs(finite(queries, "qv"), finite(pages, "v"), scope).withColumn("score", F.round(maxsim(F.col("qv"), F.col("v")), 6))
    return top_k(scored.drop("qv", "v"), "query", "score", "label", k)


def maxsim_long(query_tokens: DataFrame, page_tokens: DataFrame) -> DataFrame:
    """R5 over exploded tokens: query_tokens (query, qtok, qv), page_tokens (label, tok, v) -> query, label, score of all pairs.

    Tokens are gathered by query and page, and blocks of both are scored by matrix products; pairs of tokens are never rows.
    """
    asked = query_tokens.groupBy("query").agg(F.collect_list("qv").alias("v"))
    held = page_tokens.groupBy("label").agg(F.collect_list("v").alias("v"))
    every = (1 << 31) - 1
    scored = blocked_topk(asked, held, every, F.size(F.get("v", F.lit(0))), F.size(F.flatten("v")), lambda q, p: late_interactions(q, p, every)[0])
    return scored.select("query", "label", "score")


def first_unseen(ranked: DataFrame, seen: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per episode the best-ranked label not yet seen in it; null where none is left.

    ranked: episode, label, rank; seen: episode, label; episodes: episode.
    """
    fresh = ranked.join(seen, ["episode", "label"], "left_anti")
    best = fresh.groupBy("episode").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))
    return episodes.join(best, "episode", "left")


def recall_report(ranked: DataFrame, gold: DataFrame, ks: Sequence[int], group: str | None = None) -> DataFrame:
    """Per k and group ("all" and each value): recall, all_gold and any_gold at k over queries with gold, and n.

    ranked: query, label, rank; gold: query, label and the group's column.
    """
    keys = ["query", *([group] if group else [])]
    sizes = gold.groupBy(*keys).agg(F.count_distinct("label").alias("_gold"))
    hits = ranked.select("query", "label", "rank").join(gold.select("query", "label"), ["query", "label"], "left_semi")
    at = F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")
    found = hits.select("query", "rank", at).where(F.col("rank") <= F.col("k")).groupBy("query", "k").agg(F.count("*").alias("_hits"))
    each = sizes.select("*", at).join(found, ["query", "k"], "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    names = [F.lit("all"), *([F.coalesce(F.col(group).cast("string"), F.lit("None"))] if group else [])]
    per = each.withColumn("slice", F.explode(F.array(*names)))
    return per.groupBy("slice", "k").agg(
        F.round(F.avg(F.col("_hits") / F.col("_gold")), 4).alias("recall"),
        F.round(F.avg((F.col("_hits") == F.col("_gold")).cast("double")), 4).alias("all_gold"),
        F.round(F.avg((F.col("_hits") > 0).cast("double")), 4).alias("any_gold"), F.count("*").alias("n"),
    )


def index_stats(pages: DataFrame, vector: str = "v") -> DataFrame:
    """Pages, mean, min and max number of tokens."""
    n = F.size(vector)
    return pages.agg(F.count("*").alias("pages"), F.avg(n).alias("mean_tokens"), F.min(n).cast("long").alias("min_tokens"), F.max(n).cast("long").alias("max_tokens"))


def augment_index(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base, then new's labels that base lacks, normalised; `part` 0 or 1 keeps the order."""
    more = new.join(base.select("label"), "label", "left_anti").dropDuplicates(["label"])
    both = base.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)))
    return both.withColumn("v", l2_normalize(F.col("v")))


def check_index(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per deck: entries, vectors, and labels that only one side has. entries: label, deck; vectors: label, deck."""
    e = entries.select("label", F.col("deck").alias("_de"), F.lit(1).alias("_e"))
    v = vectors.select("label", F.col("deck").alias("_dv"), F.lit(1).alias("_v"))
    both = e.join(v, "label", "full")
    return both.groupBy(F.coalesce("_de", "_dv").alias("deck")).agg(
        F.count("_e").alias("entries"), F.count("_v").alias("vectors"), F.count(F.when(F.col("_e").isNull() | F.col("_v").isNull(), 1)).alias("unmatched")
    )


def gold_rank(ranked: DataFrame, gold: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """Per query the best rank of a gold page, null where none is ranked, and whether it lies in low..high."""
    best = gold.select("query", "label").join(ranked.select("query", "label", "rank"), ["query", "label"], "left").groupBy("query").agg(F.min("rank").alias("best_rank"))
    return best.withColumn("near_miss", F.coalesce(F.col("best_rank").between(low, high), F.lit(False)))
