"""Ranked lexical search by presence masks: which of an item's terms a document has decides how much it can score at most.

Each task takes a block of documents and goes through the items. Setting one bit a term over the block's postings gives each
document the mask of the item's terms that it has; documents with one mask are one group. What each term adds at most in the
block, summed over a mask's bits by tables of eight bits, bounds the group's scores. Groups are evaluated exactly by falling
bound, until the k-th score found is above the next group's bound; groups at the k-th score still count, for ties.

Documents are read once, for their terms among the items', and these counts are written. They give the statistics of all
documents and are then scored where they lie: no term, item or document is a shuffle key, and k rows an item leave a block.
Items are taken in slices of bounded bytes, each broadcast, one pass a slice.

Defined cases: a null text has no terms and takes no part; texts of any length are read whole, in parts; a repeated term of an
item counts each time, items of any number of terms are taken; equal items are one, items with one id and different texts are
several, each with ranks of its own; equal documents rank each, in any order as they look alike; documents or items without an
id take part, a null id coming last among equal scores; items without terms, and empty tables, give no rows; columns other
than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, settle, slices, texts_of

#: Documents of a block, and postings from which a block ends early.
BLOCK, POSTINGS = 32768, 4_000_000
#: Bytes of item texts that are broadcast at once; a single longer item is a slice of its own.
ITEM_BYTES = 8_000_000
#: Bytes of a text that are cut into terms at a time.
PART = 1 << 20
#: A turn takes one group, or as many as hold so many documents; each further turn takes twice as many.
FIRST = 64

# Letters of a term: digits, ASCII letters (lower-cased) and all that is not ASCII; everything else parts terms.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's terms in order, part by part."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _counted(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """_id, _n (terms with repeats), _terms (places of those among the items' terms), _tfs of each document, written."""
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in slices(batches):
            lengths, sizes, terms, tfs = [], [0], [], []
            for text in texts_of(batch.column(1)):
                n, counts = 0, Counter()
                for part in terms_of(text):
                    n += len(part)
                    counts.update(part)
                lengths.append(n)
                for term in counts.keys() & known.keys():
                    terms.append(known[term])
                    tfs.append(counts[term])
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["_id", "_n", "_terms", "_tfs"])

    kind = dict(docs.dtypes)["_id"]
    return settle(docs.mapInArrow(run, f"_id {kind}, _n long, _terms array<int>, _tfs array<long>"))


class Block:
    """Documents of one task, with their terms' occurrences; `impacts` is what an occurrence adds for an item that has the term once."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n: int, total: int):
        if 75 * int(lengths.max(initial=0)) * n < 1 << 63:
            m = 25 + (75 * lengths * n) // total
        else:  # as whole numbers of any size
            m = np.array([25 + 75 * x * n // total for x in lengths.tolist()], np.int64)
        self.starts, self.terms = starts, terms
        docs = np.repeat(np.arange(len(lengths)), np.diff(starts))
        self.impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
        order = np.argsort(terms, kind="stable")
        self.by_term, self.docs_by_term, self.impacts_by_term = terms[order], docs[order], self.impacts[order]

    def postings(self, term: int) -> slice:
        return slice(*np.searchsorted(self.by_term, [term, term + 1]))

    def scores(self, docs: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; factors: how often the item has each term."""
        counts = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(counts)
        at = np.arange(counts.sum()) - np.repeat(ends - counts, counts) + np.repeat(self.starts[docs], counts)
        sums = np.cumsum(np.concatenate([[0], self.impacts[at] * factors[self.terms[at]]]))
        return sums[ends] - sums[ends - counts]


def masks_of(block: Block, terms: np.ndarray, repeats: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's mask, in words of 64 bits; and what each term adds at most."""
    masks, most = np.zeros((n_docs, -(-len(terms) // 64)), np.uint64), np.zeros(len(terms), np.int64)
    for i, term in enumerate(terms):
        at = block.postings(term)
        if at.start < at.stop:
            masks[block.docs_by_term[at], i // 64] |= np.uint64(1 << (i % 64))
            most[i] = block.impacts_by_term[at].max() * repeats[i]
    return masks, most


def bounds_of(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The sum of `most` over each mask's bits."""
    out, bits = np.zeros(len(masks), np.int64), np.arange(256)
    for first in range(0, len(most), 8):
        table = sum(((bits >> j) & 1) * x for j, x in enumerate(most[first : first + 8].tolist()))
        out += table[(masks[:, first // 64] >> np.uint64(first % 64)).astype(np.int64) & 255]
    return out


def best_of(block: Block, n_docs: int, terms: np.ndarray, repeats: np.ndarray, factors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best documents of a block, ties to the earlier place; and how many documents were scored."""
    masks, most = masks_of(block, terms, repeats, n_docs)
    docs = np.flatnonzero(masks.any(axis=1))
    if not len(docs):
        return docs, docs, 0
    docs = docs[np.lexsort(masks[docs].T)]
    sorted_masks = masks[docs]
    firsts = np.flatnonzero(np.r_[True, (sorted_masks[1:] != sorted_masks[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[firsts, len(docs)])
    bounds = bounds_of(sorted_masks[firsts], most)
    order = np.argsort(-bounds, kind="stable")
    reached = np.cumsum(sizes[order])
    places, scores, done, wanted = np.zeros(0, int), np.zeros(0, np.int64), 0, FIRST
    while done < len(order):
        least = scores[k - 1] if len(scores) >= k else 1
        if bounds[order[done]] < least:
            break
        within = int(np.searchsorted(reached, (reached[done - 1] if done else 0) + wanted, "right"))
        end = min(max(done + 1, within), int(np.searchsorted(-bounds[order], -least, "right")))
        groups = order[done:end]
        many = sizes[groups]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(firsts[groups], many)
        places, scores = np.r_[places, docs[at]], np.r_[scores, block.scores(docs[at], factors)]
        kept = np.lexsort((places, -scores))[:k]
        kept = kept[scores[kept] > 0]
        places, scores, done, wanted = places[kept], scores[kept], end, 2 * wanted
    return places, scores, int(reached[done - 1])


def _scored(counts: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """_item (place among the items), _doc, _score: each block's k best."""
    sent = counts.sparkSession.sparkContext.broadcast((items, weights))
    kind = dict(counts.dtypes)["_id"]

    def of_block(table: pa.Table) -> pa.RecordBatch:
        items, weights = sent.value
        table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending")], null_placement="at_end"))
        terms, tfs = (table.column(c).combine_chunks() for c in ("_terms", "_tfs"))
        starts = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        block = Block(table.column("_n").to_numpy(), starts, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, n, total)
        factors = np.zeros(len(weights), np.int64)
        found = ([], [], [])
        for i, (terms, repeats) in enumerate(items):
            factors[terms] = repeats
            places, scores, _ = best_of(block, table.num_rows, terms, repeats, factors, k)
            factors[terms] = 0
            for column, values in zip(found, (np.full(len(places), i), places, scores), strict=True):
                column.append(values)
        item, place, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        ids = table.column("_id").combine_chunks().take(pa.array(place, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], ["_item", "_doc", "_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in slices(batches):
            held, rows, postings = [*held, batch], rows + batch.num_rows, postings + len(batch.column("_terms").flatten())
            if rows >= BLOCK or postings >= POSTINGS:
                yield of_block(pa.Table.from_batches(held))
                held, rows, postings = [], 0, 0
        if held:
            yield of_block(pa.Table.from_batches(held))

    return counts.where("size(_terms) > 0").mapInArrow(run, f"_item int, _doc {kind}, _score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank from 1, doc_id, score: the k highest-scoring documents of each item, scores above 0 only."""
    spark = docs.sparkSession
    read, asked = id_and_text(docs, id_col, text_col), settle(id_and_text(items, item_id, item_text).distinct())
    kind, item_kind = dict(read.dtypes)["_id"], dict(asked.dtypes)["_id"]
    n_slices = max(1, -(-(asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // ITEM_BYTES))
    slices_found = []
    for i in range(n_slices):
        # at most about ITEM_BYTES of texts, a longer single one apart
        asked_now = asked.where(F.col("_text").isNotNull() & (F.pmod(F.xxhash64("_text"), F.lit(n_slices)) == i)).select("_id", F.col("_text").cast("binary").alias("_text"))
        slice_ = [(r["_id"], Counter(t for part in terms_of(bytes(r["_text"])) for t in part)) for r in asked_now.collect()]
        places = {term: place for place, term in enumerate(sorted({t for _, counts in slice_ for t in counts}))}
        if not places:
            continue
        counts = _counted(read, places)
        n, total = counts.agg(F.count(F.when(F.col("_n") > 0, 1)), F.sum("_n")).first()
        held = dict(map(tuple, counts.select(F.explode("_terms").alias("_t")).groupBy("_t").count().collect()))  # no more rows than the slice has terms
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(places))], np.int64)
        known = [tuple(np.array(sorted((places[t], c) for t, c in counted.items()), np.int64).reshape(-1, 2).T) for _, counted in slice_]
        scored = _scored(counts, known, weights, n, total or 1, k)
        names = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(slice_)], f"_item int, item_id {item_kind}")
        key = (F.col("_item") * n_slices + i).cast("long").alias("_key")
        slices_found.append(scored.join(F.broadcast(names), "_item").select(key, "item_id", F.col("_doc").alias("doc_id"), F.col("_score").alias("score")))
    if not slices_found:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    found = reduce(DataFrame.unionByName, slices_found)
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
