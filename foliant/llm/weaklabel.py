"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or nothing (-1) on each document. Expectation-maximisation fits,
for a hidden class, each labeller's chances of its three votes, on the table of distinct vote patterns and their counts
(at most 3^labellers rows, whatever the input). The posterior of each pattern then labels documents for a logistic scorer
over hashed features: words, word shapes and a few whole-text features. The scorer is fitted on at most FIT_ROWS
documents, those with the smallest hashes of id and text, and scores every document.

Defined cases: a null text is an empty one; it has no word features, and the labellers that measure it vote as on any
other; repeated rows count as often in the votes, once in the fit, and are scored each; rows without an id are like any
other; ties of hashes go by the text; texts are read whole, whatever their length; with an empty table there is nothing
to fit and no row; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import FIELDS, measures_of
from .shared import annotated, id_and_text, row_key, settle, slices, texts_of


@dataclass(frozen=True)
class Labeller:
    """SQL conditions over the ledger's measurements; where both or neither hold it says nothing."""

    name: str
    good: str
    bad: str


LABELLERS = (
    Labeller("length", "n_words >= 100", "n_words < 30"),
    Labeller("symbols", "100 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Labeller("windows", "100 * n_repeat_words < 15 * n_words", "100 * n_repeat_words > 50 * n_words"),
    Labeller("lines", "10 * n_dup_lines < n_lines", "10 * n_dup_lines > 4 * n_lines"),
    Labeller("words", "10 * word_chars BETWEEN 42 * n_words AND 62 * n_words", "word_chars < 3 * n_words OR word_chars > 9 * n_words"),
    Labeller("case", "5 * n_upper < n_lower", "n_upper > n_lower"),
)
BUCKETS, FIT_ROWS, STEPS = 1 << 16, 8000, 150
REMEMBERED = 300_000

_SHAPES = bytes.maketrans(bytes(range(256)), bytes(0x41 if 0x41 <= i < 0x5B else 0x61 if 0x61 <= i < 0x7B or i >= 0x80 else 0x30 if 0x30 <= i < 0x3A else i for i in range(256)))
_RUN = re.compile(rb"(.)\1+")


def fit_labellers(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good documents, and chances[class, labeller, vote + 1], by expectation-maximisation."""
    votes = np.array(list(patterns), int)
    n = np.array(list(patterns.values()), float)
    said = (votes >= 0).sum(axis=1)
    good = np.where(said > 0, (votes == 1).sum(axis=1) / np.maximum(said, 1), 0.5)
    good = 0.1 + 0.8 * good  # the majority's lean
    for _ in range(rounds):
        share = float((n * good).sum() / n.sum())
        chances = np.ones((2, votes.shape[1], 3))
        for c, weight in ((0, n * (1 - good)), (1, n * good)):
            for v in (-1, 0, 1):
                chances[c, :, v + 1] += ((votes == v) * weight[:, None]).sum(axis=0)
        chances /= chances.sum(axis=2, keepdims=True)
        good = posterior(votes, share, chances)
    return share, chances


def posterior(votes: np.ndarray, share: float, chances: np.ndarray) -> np.ndarray:
    """The chance that documents with these votes are good."""
    each = np.arange(votes.shape[1])
    logs = [math.log(max(p, 1e-12)) + np.log(chances[c, each, votes + 1]).sum(axis=1) for c, p in ((0, 1 - share), (1, share))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) % BUCKETS


def _word_buckets(word: bytes) -> tuple[int, int]:
    return _bucket(b"w", word.lower()), _bucket(b"s", _RUN.sub(rb"\1", word.translate(_SHAPES)))


def _text_buckets(words: list[bytes]) -> list[int]:
    """Whole-text features: length, share of distinct words, share of distinct lines' worth of letters."""
    n = len(words)
    distinct = 10 * len(set(words)) // max(1, n)
    return [_bucket(b"n", str(n.bit_length()).encode()), _bucket(b"d", f"{distinct} {min(n.bit_length(), 9)}".encode())]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, value = [], []
        for text in texts_of(batch.column(0)):
            words = (text or b"").split()
            held: Counter[int] = Counter(b for w in words for b in _word_buckets(w))
            scale = 1 / max(1, len(words))
            found = {b: m * scale for b, m in held.items()}
            for b in _text_buckets(words):
                found[b] = found.get(b, 0) + 1.0
            at.append(list(found))
            value.append(list(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), batch.column(1)], ["at", "value", "good"])


def fit_scorer(at: np.ndarray, value: np.ndarray, starts: np.ndarray, good: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by adaptive gradient steps on soft labels; both classes weigh the same."""
    weights, bias = np.zeros(BUCKETS), 0.0
    rows = np.repeat(np.arange(len(good)), np.diff(np.append(starts, len(at))))
    weigh = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    share = good / max(good.sum(), 1e-9) / np.maximum(weigh, 1e-12)
    squares, own = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        margin = np.add.reduceat(weights[at] * value, starts) + bias
        error = weigh * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - share)
        gradient = np.bincount(at, weights=value * error[rows], minlength=BUCKETS) + 1e-5 * weights
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
        own += error.sum() ** 2
        bias -= 0.5 * error.sum() / math.sqrt(own)
    return weights, bias


class _WordWeights(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        a, b = _word_buckets(word)
        weight = float(self.weights[a] + self.weights[b])
        if len(self) < REMEMBERED:
            self[word] = weight
        return weight


def weak_quality(docs: DataFrame, labellers: tuple[Labeller, ...] = LABELLERS, fit_rows: int = FIT_ROWS, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_votes (labellers that said something), posterior (from their votes), score (of the linear scorer), kept (score >= least)."""
    spark = docs.sparkSession
    vote = lambda x: F.when(F.expr(f"({x.good}) AND NOT ({x.bad})"), 1).when(F.expr(f"({x.bad}) AND NOT ({x.good})"), 0).otherwise(-1)
    code = sum(((vote(x) + 1) * 3**i for i, x in enumerate(labellers)), F.lit(0))
    source = id_and_text(docs, id_col, text_col).select("_id", row_key(F.col("_id"), F.col("_text")).alias("_row"), "_text")
    measured, _ = annotated(source, "_text", FIELDS, measures_of)
    votes = settle(measured.select(F.col("_c0").alias("_id"), F.col("_c1").alias("_row"), code.cast("int").alias("_votes")))
    counts = {r["_votes"]: r["n"] for r in votes.groupBy("_votes").agg(F.count("*").alias("n")).collect()}  # at most 3^labellers
    read = lambda c: tuple(c // 3**i % 3 - 1 for i in range(len(labellers)))
    table: list[tuple[int, int, float]] = []
    if counts:
        share, chances = fit_labellers({read(c): n for c, n in counts.items()})
        good = posterior(np.array([read(c) for c in counts]), share, chances)
        table = [(c, sum(v >= 0 for v in read(c)), float(g)) for c, g in zip(counts, good, strict=True)]
    judged = F.broadcast(spark.createDataFrame(table, "_pattern int, n_votes int, posterior double"))

    # first about half as many again as are wanted, so that ordering them is small work at any size
    share = F.lit(min(1 << 31, (3 * fit_rows << 30) // max(1, sum(counts.values()))))
    likely = votes.where(F.xxhash64("_row").bitwiseAND(F.lit((1 << 31) - 1)) < share).select("_row", "_votes").distinct()
    chosen = likely.orderBy(F.xxhash64("_row").bitwiseAND(F.lit((1 << 31) - 1)), "_row").limit(fit_rows)
    labelled = chosen.join(judged, F.col("_votes") == F.col("_pattern")).select(F.col("_row").alias("_lrow"), F.col("posterior").alias("good"))
    sample = source.join(F.broadcast(labelled), source["_row"] == labelled["_lrow"])  # at most fit_rows keys
    sample = sample.groupBy("_row").agg(F.first("_text").alias("_text"), F.first("good").alias("good")).select("_text", "good")
    fitted = sample.mapInArrow(_features, "at array<int>, value array<float>, good double").toArrow()
    weights, bias = np.zeros(BUCKETS), 0.0
    if fitted.num_rows:
        at, value = fitted.column("at").combine_chunks(), fitted.column("value").combine_chunks()
        weights, bias = fit_scorer(at.flatten().to_numpy(), value.flatten().to_numpy().astype(float), at.offsets.to_numpy()[:-1].astype(np.int64), fitted.column("good").to_numpy())
    sent = spark.sparkContext.broadcast((weights, bias))

    def scores(batch: list[bytes | None]) -> list[pa.Array]:
        weights, bias = sent.value
        known = _WordWeights(weights)
        out = []
        for text in batch:
            words = (text or b"").split()
            margin = bias + sum(map(known.__getitem__, words)) / max(1, len(words)) + sum(weights[b] for b in _text_buckets(words))
            out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, margin)))))
        return [pa.array(out, pa.float64())]

    scored, _ = annotated(source, "_text", [T.StructField("_score", T.DoubleType())], scores)
    scored = scored.select(F.col("_c0").alias("_id"), F.col("_c1").alias("_row"), F.lit(None).cast("int").alias("_votes"), "_score")
    # votes and scores meet by row; rows with the same id and text have the same of both
    both = votes.withColumn("_score", F.lit(None).cast("double")).unionByName(scored).groupBy("_id", "_row")
    both = both.agg(F.max("_votes").alias("_votes"), F.max("_score").alias("score"), F.count("_score").alias("_times"))
    each = both.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).join(judged, F.col("_votes") == F.col("_pattern"))
    return each.select(F.col("_id").alias(id_col), "n_votes", "posterior", "score", (F.col("score") >= least).alias("kept"))
