"""Near-duplicate groups with SetSketch registers.

A document is the set of its distinct word shingles. A register is floor(1 - log_b(min of exponential hash values)): an
exponentially spaced, truncated minimum. Registers of a union are the larger ones of both sides (`merge_registers`), and
two sets agree on a register about as often as their Jaccard similarity.

1. One pass gives each document its set size, a 128-bit fingerprint of the set and its registers. Documents with equal
   sets form a class at once; from here on one row stands for a class, so exact copies cost nothing.
2. Registers are banded; classes that agree on a band share a bucket. Every class of a bucket is paired with the bucket's
   hub only, the class that meets most others over all bands, so a large group gives as many pairs as it has members.
3. A pair goes on if sizes allow the similarity and the joint likelihood of its registers' orders (larger, smaller,
   equal) does not rule it out; then the full sets decide.
4. Links are folded into components, and buckets that still hold several are tested across components: nothing that
   shares a bucket is left untested unless it is connected already. Buckets of up to SMALL classes give their pairs, which
   go through step 3. Larger ones with the same hub make one group, whose members outside the hub's component meet all
   members in blocks of bounded size; a task works out all intersections of two blocks at once and gives links only.

No bucket or candidate list is capped. With 36 bands of 4 registers a pair at the threshold 0.75 shares no bucket with
probability (1 - 0.75^4)^36, about one in a million.

Joins by a bucket, a hub, a component or a class go through `matched`: keys that hold more than a 1,024th of the rows are
joined by sending their rows of the other side, which has one row a key, to all tasks, so that no such key meets in one task.

Defined cases: texts that are null or have no word have the size 0 and are linked with nothing; texts with fewer words
than a shingle are one shingle; repeated rows fall in one class; rows without an id link others and take their smallest id, null
where a group has none; of equal sets (ties) the smallest id stands for all; a text of any length is one
set, whose hashes one task holds while it works on that text; an empty table gives an empty result; columns other than
the id and the text are not read, and `deduplicated` hands all columns on whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import busy_keys, id_and_text, matched, row_key, settle, slices, texts_of

SHINGLE, BANDS, ROWS = 5, 36, 4
REGISTERS = BANDS * ROWS
BASE, SHIFT, TOP = 1.0005, 16000, 65535
#: A pair is dropped unread if its most likely similarity is further below the threshold: over five standard errors.
MARGIN = 0.2
#: Shingles whose registers are taken at a time, and word hashes a worker remembers.
BLOCK, REMEMBERED = 1 << 17, 150_000
#: Classes of a bucket whose pairs are written out, and of a block of a larger one.
SMALL, MEMBERS = 32, 256
#: Shingles per matrix product, and documents whose full sets are held at a time.
COLUMNS, SETS = 4096, 256

_random = np.random.default_rng(20240131)
_WORD_FACTORS = _random.integers(0, 1 << 63, 16, np.uint64) * 2 + 1
_FACTORS = _random.integers(0, 1 << 63, REGISTERS, np.uint64) * 2 + 1
_OFFSETS = _random.integers(0, 1 << 63, REGISTERS, np.uint64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def shingle_hashes(text: bytes | None, size: int = SHINGLE, known: _WordHashes | None = None) -> np.ndarray:
    """The document's set as sorted 64-bit hashes; A-Z count as a-z. known: word hashes that a task remembers."""
    known = _WordHashes() if known is None else known
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < size:
        return _mixed(np.array([(h * _WORD_FACTORS[:n]).sum() + np.uint64(n)], np.uint64), n)
    sums = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        sums += h[i : n - size + 1 + i] * _WORD_FACTORS[i]
    return np.unique(_mixed(sums, 0))


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of REGISTERS numbers for each set; starts: where each of the sets, none of them empty, begins in hashes."""
    least = np.empty((REGISTERS, len(starts)), np.uint64)
    held = np.empty_like(hashes)
    for i in range(REGISTERS):
        np.multiply(hashes, _FACTORS[i], out=held)
        np.add(held, _OFFSETS[i], out=held)
        least[i] = np.minimum.reduceat(held, starts)
    exponential = -np.log1p(-(least.T.astype(float) + 1) / 2.0**64 * (1 - 2.0**-50))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + SHIFT, 0, TOP).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def likely_similarity(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of most likelihood, given in how many registers a's is larger, smaller or equal, and both sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    spaced = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = spaced(u - v * j), spaced(v - u * j)
        return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        up = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def _sketched(size: int):
    names = ["_id", "_row", "_n", "_f1", "_f2", "_registers"]

    def block(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        return np.add.reduceat(_mixed(joined, 1), starts), np.add.reduceat(_mixed(joined, 2), starts), registers(joined, starts)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches):
            n, f1, f2, regs = [], [], [], []
            held: list[np.ndarray] = []
            waiting = 0

            def flush() -> None:
                nonlocal held, waiting
                if held:
                    a, b, r = block(held)
                    f1.extend(a.view(np.int64).tolist())
                    f2.extend(b.view(np.int64).tolist())
                    regs.extend(x.tobytes() for x in r)
                held, waiting = [], 0

            at = []
            for text in texts_of(batch.column(2)):
                hashes = shingle_hashes(text, size, known)
                n.append(len(hashes))
                if len(hashes):
                    at.append(len(n) - 1)
                    held.append(hashes)
                    waiting += len(hashes)
                    if waiting > BLOCK:
                        flush()
            flush()
            index = np.full(len(n), -1)
            index[at] = np.arange(len(at))
            take = pa.array([int(i) if i >= 0 else None for i in index], pa.int64())
            sketched = [pa.array(values, kind).take(take) for values, kind in ((f1, pa.int64()), (f2, pa.int64()), (regs, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *sketched], names)

    return sketch


def _full_sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches, SETS):
            found = [shingle_hashes(t, size, known) for t in texts_of(batch.column(0))]
            prints = [[_mixed(s, salt).sum().astype(np.uint64).view(np.int64).item() if len(s) else 0 for s in found] for salt in (1, 2)]
            numbers = [pa.array(values, pa.int64()) for values in ([len(s) for s in found], *prints)]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([s.tobytes() for s in found], pa.binary())], ["_n", "_f1", "_f2", "_set"])

    return sets


def _likely(threshold: float):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("_ra", "_rb"))
            larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
            j = likely_similarity(larger, smaller, a.shape[1] - larger - smaller, batch.column("_na").to_numpy(), batch.column("_nb").to_numpy())
            yield batch.select(["_a", "_b"]).filter(pa.array(j >= threshold - MARGIN))

    return likely


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("_sa"), batch.column("_sb"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def block_links(percent: int):
    """For two blocks of sets: the pairs in different components that are similar enough.

    Shingles that a sixteenth of the sets have are counted by one matrix product, the others where they occur.
    """

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        if left.num_rows and right.num_rows:
            sets = [[np.frombuffer(x, np.uint64) for x in t.column("_set").to_pylist()] for t in (left, right)]
            sizes = [np.array([len(x) for x in side]) for side in sets]
            _, ids, times = np.unique(np.concatenate([*sets[0], *sets[1]]), return_inverse=True, return_counts=True)
            common = times * 16 > left.num_rows + right.num_rows
            place = np.cumsum(common) - 1
            n = sizes[0].sum()
            rare, often = [], []
            for part, size in zip((ids[:n], ids[n:]), sizes, strict=True):
                row, is_common = np.repeat(np.arange(len(size)), size), common[part]
                often.append((row[is_common], place[part[is_common]]))
                order = np.argsort(part[~is_common], kind="stable")
                rare.append((part[~is_common][order], row[~is_common][order]))
            counts = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
            for start in range(0, int(common.sum()), COLUMNS):
                matrices = []
                for (row, column), size in zip(often, sizes, strict=True):
                    matrix = np.zeros((len(size), COLUMNS), np.float32)
                    here = (column >= start) & (column < start + COLUMNS)
                    matrix[row[here], column[here] - start] = 1
                    matrices.append(matrix)
                counts += matrices[0] @ matrices[1].T
            for i in np.intersect1d(rare[0][0], rare[1][0]):
                rows = [r[slice(*np.searchsorted(x, (i, i + 1)))] for x, r in rare]
                counts[np.ix_(*rows)] += 1
            roots = [t.column("_root").to_numpy() for t in (left, right)]
            linked = ((100 + percent) * counts.astype(np.int64) >= percent * (sizes[0][:, None] + sizes[1])) & (roots[0][:, None] != roots[1])
            sides = [t.column("_node").to_numpy()[at] for t, at in zip((left, right), np.nonzero(linked), strict=True)]
        a, b = sides or ([], [])
        return pa.table({"_a": pa.array(np.minimum(a, b) if len(a) else [], pa.int64()), "_b": pa.array(np.maximum(a, b) if len(a) else [], pa.int64())})

    return both


def components(links: DataFrame) -> DataFrame:
    """_node, _root (the smallest node reachable) of all nodes that links (_a, _b) name: rounds of smallest neighbour and shortcut."""
    both = settle(links.select(F.col("_a").alias("_x"), F.col("_b").alias("_y")).union(links.select("_b", "_a")))
    busy = busy_keys(both, "_y")
    labels = settle(both.groupBy("_x").agg(F.min("_y").alias("_m")).select(F.col("_x").alias("_node"), F.least("_x", "_m").alias("_root")))
    while True:
        near = matched(both, labels.select(F.col("_node").alias("_y"), "_root"), "_y", busy).groupBy("_x").agg(F.min("_root").alias("_near"))
        closer = labels.join(near, labels["_node"] == near["_x"]).select("_node", F.col("_root").alias("_old"), F.least("_root", "_near").alias("_up"))
        closer = settle(closer)
        far = closer.select("_node", F.col("_up").alias("_far")).withColumnRenamed("_node", "_up")
        next_labels = matched(closer, far, "_up", busy_keys(closer, "_up"), "left").select("_node", "_old", F.least("_up", F.coalesce("_far", "_up")).alias("_root"))
        next_labels = settle(next_labels)
        if next_labels.where("_old <> _root").isEmpty():
            return next_labels.drop("_old")
        labels = next_labels.drop("_old")


def _buckets(classes: DataFrame) -> DataFrame:
    """_bucket, _node, _n, _many (classes of the bucket), _hub (_node, _n) of all classes that share a bucket with others."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("_band")
    values = F.expr(f"substring(_registers, {2 * ROWS} * _band + 1, {2 * ROWS})")
    banded = classes.select("_node", "_n", "_registers", band).select("_node", "_n", F.xxhash64("_band", values).alias("_bucket"))
    many = settle(banded.groupBy("_bucket").agg(F.count("*").alias("_many")).where("_many > 1"))
    large = busy_keys(many, "_bucket", "_many")
    shared = settle(matched(banded, many, "_bucket", large))
    meets = shared.groupBy("_node").agg(F.sum("_many").alias("_meets"))
    hubs = shared.join(meets, "_node").groupBy("_bucket").agg(F.max(F.struct("_meets", "_node", "_n")).alias("_hub"))
    hubs = hubs.select("_bucket", F.struct("_hub._node", "_hub._n").alias("_hub"))
    return settle(matched(shared, hubs, "_bucket", large))


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _linked_pairs(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (_a, _b) whose full sets are similar enough. _a may be the same in many pairs, _b is not."""
    side = lambda x: classes.select(F.col("_node").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_registers").alias(f"_r{x}"))
    pairs = settle(pairs)
    sketched = matched(pairs, side("a"), "_a", busy_keys(pairs, "_a")).join(side("b"), "_b")
    likely = settle(sketched.mapInArrow(_likely(percent / 100), "_a long, _b long"))
    set_a, keys = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_sa")), ["_a"]
    if (busy := busy_keys(likely, "_a")) is not None:
        # a full set has no bound that fits a broadcast: a busy hub's goes to as many tasks as its pairs have shares
        share = F.coalesce(F.pmod(F.xxhash64("_b"), "_shares"), F.lit(0)).cast("int")
        likely, keys = likely.join(F.broadcast(busy), "_a", "left").withColumn("_share", share).drop("_shares"), ["_a", "_share"]
        each = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("_share")
        set_a = set_a.join(F.broadcast(busy), "_a", "left").select("_a", "_sa", each)
    set_b = sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_sb"))
    return settle(likely.join(set_a, keys).join(set_b, "_b").mapInArrow(_linked(percent), "_a long, _b long"))


def _linked_in_blocks(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """large: _group (its hub), _node, _root: links of members outside the hub's component with all members."""
    about = large.groupBy("_group").agg(
        F.ceil(F.count("*") / MEMBERS).cast("int").alias("_blocks"), F.max(F.when(F.col("_group") == F.col("_node"), F.col("_root"))).alias("_hub_root"),
    )
    dealt = matched(large, about, "_group", busy_keys(large, "_group"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    held = settle(dealt.join(sets, "_node"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = held.where("_root <> _hub_root").select("_group", F.col("_block").alias("_l"), every.alias("_r"), "_node", "_root", "_set")
    right = held.select("_group", every.alias("_l"), F.col("_block").alias("_r"), "_node", "_root", "_set")
    keys = ("_group", "_l", "_r")
    return settle(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_links(percent), "_a long, _b long").distinct())


def _decided(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _row (equal in rows with the same id and text), _n, _component (the smallest id, null where no row of the group has one), _root."""
    source = id_and_text(docs, id_col, text_col).select("_id", row_key(F.col("_id"), F.col("_text")).alias("_row"), "_text")
    kind = dict(source.dtypes)["_id"]
    node = F.xxhash64("_n", "_f1", "_f2")
    sketches = source.mapInArrow(_sketched(shingle), f"_id {kind}, _row long, _n long, _f1 long, _f2 long, _registers binary")
    sketches = settle(sketches.withColumn("_node", F.when(F.col("_n") > 0, node)))
    some = (F.first(c).alias(c) for c in ("_n", "_registers"))
    classes = settle(sketches.where("_n > 0").groupBy("_node").agg(F.min("_id").alias("_first"), F.min("_row").alias("_row"), F.count("*").alias("_copies"), *some))

    members = _buckets(classes)
    # a class's set is made of the text of any of its rows; rows without an id have one, too
    texts = source.join(classes.join(members.select("_node").distinct(), "_node", "left_semi").select("_row"), "_row", "left_semi").select("_text")
    sets = texts.mapInArrow(_full_sets(shingle), "_n long, _f1 long, _f2 long, _set binary").select(node.alias("_node"), "_set")
    sets = settle(sets.dropDuplicates(["_node"]))

    hub = F.col("_hub._node")
    stars = members.where((F.col("_node") != hub) & _fits(F.col("_n"), F.col("_hub._n"), percent)).select(hub.alias("_a"), F.col("_node").alias("_b")).distinct()
    links = _linked_pairs(stars, classes, sets, percent)
    labels = components(links)
    placed = settle(members.join(labels, "_node", "left").withColumn("_root", F.coalesce("_root", "_node")))
    mixed = placed.groupBy("_bucket").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where("_low <> _high").select("_bucket")
    placed = settle(matched(placed, mixed, "_bucket", busy_keys(placed, "_bucket")))
    few = placed.where(F.col("_many") <= SMALL)
    other = few.select("_bucket", F.col("_node").alias("_node2"), F.col("_n").alias("_n2"), F.col("_root").alias("_root2"))
    across = few.join(other, "_bucket").where((F.col("_root") < F.col("_root2")) & _fits(F.col("_n"), F.col("_n2"), percent))
    across = across.select(F.least("_node", "_node2").alias("_a"), F.greatest("_node", "_node2").alias("_b")).distinct()
    tested = stars.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    more = _linked_pairs(across.join(tested, ["_a", "_b"], "left_anti"), classes, sets, percent)
    large = placed.where(F.col("_many") > SMALL).select(F.col("_hub._node").alias("_group"), "_node", "_root").distinct()
    more = more.union(_linked_in_blocks(settle(large), sets, percent))
    if not more.isEmpty():
        labels = components(links.union(more))

    rooted = settle(classes.select("_node", "_first", "_copies").join(labels, "_node", "left").withColumn("_root", F.coalesce("_root", "_node")))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("_component"))
    named = settle(matched(rooted, smallest, "_root", busy_keys(rooted, "_root")).select("_node", "_component", "_root", "_copies"))
    copied = busy_keys(named, "_node", "_copies")
    rows = sketches.select("_id", "_row", "_n", "_node")
    found = matched(rows.where("_n > 0"), named.drop("_copies"), "_node", copied).select("_id", "_row", "_n", "_component", "_root")
    # wordless rows are linked with nothing
    return found.unionByName(rows.where("_n = 0").select("_id", "_row", "_n", F.col("_id").alias("_component"), F.col("_row").alias("_root")))


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links, itself included), kept (id = component_id).

    A row without an id takes its group's smallest id and isn't kept; where no row of the group has one, component_id is null and
    its rows are marked kept, of which `deduplicated` takes one.
    """
    decided = _decided(docs, percent, shingle, id_col, text_col)
    kept = F.col("_component").eqNullSafe(F.col("_id"))
    return decided.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group: the smallest id, and one row of those that share it.

    A row without an id goes where a row of its group has one; of a group without any id one row stays. Of rows with the
    same id and text any one stays, of those with the same id and different texts always the same one.
    """
    kept = _decided(docs, percent, shingle, id_col, text_col).where(F.col("_component").eqNullSafe(F.col("_id")))
    with_id = kept.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_row").alias("_row")).select(F.col("_row").alias("__row"))
    without = kept.where("_id IS NULL").groupBy("_root", F.col("_n") > 0).agg(F.min("_row").alias("__row")).select("__row")
    one_each = docs.withColumn("__row", row_key(F.col(id_col), F.col(text_col).cast("string"))).dropDuplicates(["__row"])
    return one_each.join(with_id.union(without), "__row", "left_semi").select(*docs.columns)
