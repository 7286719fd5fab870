"""Language-model scores by prediction by partial matching over a byte trie, beside a word-count baseline.

A text is the byte stream of its words, each followed by a space, and an end mark; A-Z count as a-z. The trie holds, for
every context of 0 to ORDER bytes, how often each byte followed in the training texts. A byte is predicted in the longest
context that training saw; a context with C occurrences of D different bytes gives a byte seen c times (2c - 1) / 2C and
an escape D / 2C to the next shorter context, where the bytes of the longer one are excluded; below the empty context all
bytes left are alike. So a byte's cost depends on its last ORDER bytes only, and is worked out once per distinct string
of ORDER + 1 bytes by joins between neighbouring levels of the trie, never in a document.

Counts cover all training texts. To score, the HEAD strings (and HEAD_WORDS words for the baseline) that are commonest in
all texts go to every task, a bound that the data can't exceed; what a document has besides is joined by key, and no such
key is frequent. The scores are the same doubles whatever HEAD is, but for the order of sums.

Defined cases: a null text is empty and consists of the end mark alone; with no training text all bytes cost the same;
repeated rows, with an id or without one, give repeated results; texts of any length are worked on in stretches of BLOCK
bytes that carry the last ORDER bytes on; ties don't matter, since nothing is ranked but whole steps of counts; an empty
table gives an empty one; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, settle, slices, texts_of

ORDER = 5
HEAD, HEAD_WORDS = 1 << 21, 1 << 18
#: The end mark can't stand in a word.
END = b"\n"
#: Bytes of text that are worked on at a time, about.
BLOCK = 1_000_000
#: Distinct strings and words that a task sums up before it hands them on.
HELD, HELD_WORDS = 700_000, 100_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _parts(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """The text in parts of about BLOCK bytes, cut behind white space, and whether a part is the last one."""
    start = 0
    while len(text) - start > BLOCK and (space := _SPACE.search(text, start + BLOCK)):
        yield text[start : space.end()], False
        start = space.end()
    yield text[start:], True


@dataclass
class Stretch:
    """Some bytes of a row's stream, the ORDER bytes before them, and the words that begin there."""

    row: int
    before: bytes
    body: bytes
    words: list[bytes]


def _stretches(texts: list[bytes | None]) -> Iterator[list[Stretch]]:
    held: list[Stretch] = []
    size = 0
    for row, text in enumerate(texts):
        before = END * ORDER
        for part, last in _parts(text or b""):
            words = part.lower().split()
            body = b"".join([w + b" " for w in words]) + (END if last else b"")
            for at in range(0, len(body), BLOCK):
                piece = body[at : at + BLOCK]
                if held and size + len(piece) > BLOCK:
                    yield held
                    held, size = [], 0
                held.append(Stretch(row, before, piece, [] if at else words))
                before = (before + piece)[-ORDER:]
                size += len(piece)
    if held:
        yield held


def _codes(stretches: list[Stretch]) -> tuple[np.ndarray, np.ndarray]:
    """Each place's last ORDER + 1 bytes as one number, and where each stretch's places end."""
    stream = np.frombuffer(b"".join([s.before + s.body for s in stretches]), np.uint8)
    code = np.zeros(len(stream), np.uint64)
    for back in range(ORDER + 1):
        code[back:] |= stream[: len(stream) - back].astype(np.uint64) << np.uint64(8 * back)
    lengths = np.array([len(s.body) for s in stretches])
    starts = np.cumsum([0, *(lengths[:-1] + ORDER)])
    real = np.ones(len(stream), bool)
    real[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return code[real], np.cumsum(lengths)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, how often the rows that are trained on have it, how often all have it; null stands for the end mark."""
    counters: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    ends = [0, 0]

    def out() -> Iterator[pa.RecordBatch]:
        for is_trained, held in enumerate(counters):
            words, n = pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([words, n if is_trained else pa.array([0] * len(held), pa.int64()), n], ["word", "n", "m"])
            held.clear()

    for batch in slices(batches):
        for text, is_trained in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for part, _ in _parts(text or b""):
                counters[bool(is_trained)].update(part.lower().split())
                if sum(map(len, counters)) > HELD_WORDS:
                    yield from out()
            ends[bool(is_trained)] += 1
    yield from out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends[1]], pa.int64()), pa.array([sum(ends)], pa.int64())], ["word", "n", "m"])


def _summed(runs: list[np.ndarray]) -> np.ndarray:
    """Rows (code, n, m) of all runs, one for each code."""
    joined = np.concatenate(runs, axis=1)
    joined = joined[:, np.argsort(joined[0], kind="stable")]
    first = np.flatnonzero(np.append(True, joined[0, 1:] != joined[0, :-1]))
    return np.stack([joined[0, first], np.add.reduceat(joined[1], first), np.add.reduceat(joined[2], first)])


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, how often the rows that are trained on have it, how often all have it."""
    runs: list[np.ndarray] = []

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, rows.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[i : i + (1 << 16)])) for r in rows], ["code", "n", "m"])

    for batch in slices(batches):
        trained = np.array(batch.column(2).to_pylist(), bool)
        for stretches in _stretches(texts_of(batch.column(1))):
            code, ends = _codes(stretches)
            of = np.repeat(trained[[s.row for s in stretches]], np.diff(ends, prepend=0))
            for some, weight in ((code[of], 1), (code[~of], 0)):
                if len(some):
                    u, n = np.unique(some, return_counts=True)
                    runs.append(np.stack([u.astype(np.int64), n * weight, n]))
            if sum(r.shape[1] for r in runs) > HELD:
                rows = _summed(runs)
                often = rows[2] >= 4  # these come again; the others are handed on
                if often.sum() > HELD // 2:
                    often[:] = False
                yield from out(rows[:, ~often])
                runs = [rows[:, often]]
    if any(r.shape[1] for r in runs):
        yield from out(_summed(runs))


def _low(code: str | Column, n_bytes: int) -> Column:
    return (F.col(code) if isinstance(code, str) else code).bitwiseAND(F.lit((1 << 8 * n_bytes) - 1))


@dataclass
class Trie:
    """levels[k]: code (a byte and the k before it), n. nodes[k]: ctx (k bytes), C and D, and Cx, Dx: those of the next shorter context without ctx's bytes."""

    levels: dict[int, DataFrame]
    nodes: dict[int, DataFrame]
    seen_bytes: int


def build_trie(strings: DataFrame) -> Trie:
    """From code and n of the strings of ORDER + 1 bytes."""
    levels = {ORDER: strings.where("n > 0").select("code", "n")}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = settle(levels[k + 1].groupBy(_low("code", k + 1).alias("code")).agg(F.sum("n").alias("n")))
    nodes: dict[int, DataFrame] = {}
    context = F.shiftright("code", 8)
    for k in range(ORDER + 1):
        level = levels[k]
        if k == 0:
            whole = level.groupBy(context.alias("ctx")).agg(F.sum("n").alias("C"), F.count("*").alias("D"))
            nodes[k] = settle(whole.selectExpr("ctx", "C", "D", "0L AS Cx", "0L AS Dx"))
            continue
        below = levels[k - 1].select(F.col("code").alias("_low"), F.col("n").alias("_n"))
        seen = level.withColumn("_low", _low("code", k)).join(below, "_low")
        seen = seen.groupBy(context.alias("ctx")).agg(F.sum("n").alias("C"), F.count("*").alias("D"), F.sum("_n").alias("_X"))
        under = nodes[k - 1].select(F.col("ctx").alias("_under"), F.col("C").alias("_C"), F.col("D").alias("_D"))
        joined = seen.withColumn("_under", _low("ctx", k - 1)).join(under, "_under")
        nodes[k] = settle(joined.select("ctx", "C", "D", (F.col("_C") - F.col("_X")).alias("Cx"), (F.col("_D") - F.col("D")).alias("Dx")))
    return Trie(levels, nodes, levels[0].count())  # at most 256


def seen_costs(trie: Trie, strings: DataFrame) -> DataFrame:
    """code, cost (log10), m of the strings that training saw."""
    seen = strings.where("n > 0").withColumn("ctx", F.shiftright("code", 8)).join(trie.nodes[ORDER], "ctx")
    return seen.select("code", F.log10((2 * F.col("n") - 1) / (2 * F.col("C"))).alias("cost"), "m")


def unseen_costs(trie: Trie, strings: DataFrame) -> DataFrame:
    """code, cost (log10), m of strings (code, m) that training did not see, by escapes through the shorter contexts."""
    out = []
    left = strings.selectExpr("code", "m", "0D AS acc", "false AS begun", "0L AS eC", "0L AS eD")
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            entries = trie.levels[k].select(F.col("code").alias("_entry"), "n")
            here = left.withColumn("_entry", _low("code", k + 1)).join(entries, "_entry", "left").drop("_entry")
        else:
            here = left.withColumn("n", F.lit(None).cast("long"))
        here = here.withColumn("ctx", F.shiftright(_low("code", k + 1), 8)).join(trie.nodes[k], "ctx", "left")
        total = F.when(F.col("begun"), F.col("eC")).otherwise(F.col("C"))
        kinds = F.when(F.col("begun"), F.col("eD")).otherwise(F.col("D"))
        here = settle(here.withColumn("_t", total).withColumn("_k", kinds))
        out.append(here.where("n IS NOT NULL").selectExpr("code", "acc + log10((2 * n - 1) / (2 * _t)) AS cost", "m"))
        left = here.where("n IS NULL").selectExpr(
            "code", "m", "acc + CASE WHEN C IS NOT NULL AND _k > 0 THEN log10(_k / (2 * _t)) ELSE 0D END AS acc", "begun OR C IS NOT NULL AS begun",
            "CASE WHEN C IS NOT NULL THEN Cx ELSE eC END AS eC", "CASE WHEN C IS NOT NULL THEN Dx ELSE eD END AS eD",
        )
    costs = left.select("code", (F.col("acc") - math.log10(max(1, 256 - trie.seen_bytes))).alias("cost"), "m")
    for more in out:
        costs = costs.unionByName(more)
    return costs


@dataclass
class PpmModel:
    """words: word, n (in training), m (in all rows given). costs: code, cost, m. tokens and vocabulary count the end mark, which `texts` occurrences have."""

    words: DataFrame
    costs: DataFrame
    trie: Trie
    tokens: int
    vocabulary: int
    texts: int


def train(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text") -> PpmModel:
    """From the rows of docs where `trained` holds; strings of the other rows get their costs too, not their counts."""
    marked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), trained.alias("_trained"))
    sums = (F.sum("n").alias("n"), F.sum("m").alias("m"))
    words = settle(marked.mapInArrow(_count_words, "word string, n long, m long").groupBy("word").agg(*sums))
    total, vocabulary, texts = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1)), F.max(F.when(F.col("word").isNull(), F.col("n")))).first()
    strings = settle(marked.mapInArrow(_count_strings, "code long, n long, m long").groupBy("code").agg(*sums))
    trie = build_trie(strings)
    costs = settle(seen_costs(trie, strings).unionByName(unseen_costs(trie, strings.where("n = 0").select("code", "m"))))
    return PpmModel(words.where("word IS NOT NULL"), costs, trie, total or 0, vocabulary or 0, texts or 0)


def _head(counted: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The rows with the largest m, at most `most` of them, and the condition on m that takes them."""
    step = F.floor(F.log2(F.col("m") + 1) * 8).cast("int")
    at_step = {r["s"]: r["rows"] for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("rows")).collect()}  # at most 512 steps
    total, least = 0, max(at_step, default=0) + 1
    for s in sorted(at_step, reverse=True):
        if (total := total + at_step[s]) > most:
            break
        least = s
    return counted.where(step >= least), step >= least


class StringCosts:
    """Costs by code in hash order, with the place where each hash begins; looked up for many codes at once."""

    def __init__(self, codes: np.ndarray, costs: np.ndarray):
        self.bits = max(8, 1 + int(len(codes)).bit_length())  # so most hashes have one code or none
        codes = codes.astype(np.uint64)
        order = np.argsort(self._hash(codes), kind="stable")
        # one entry more, which equals no code, stands behind the last
        self.codes, self.costs = np.append(codes[order], np.uint64(2**64 - 1)), np.append(costs[order].astype(float), 0.0)
        self.starts = np.searchsorted(self._hash(codes[order]), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each code (0 where it isn't known), and the places that aren't known."""
        hashes = self._hash(codes)
        at = self.starts[hashes]
        hit = self.codes[at] == codes
        out = np.where(hit, self.costs[at], 0.0)
        left = np.flatnonzero(~hit)
        at, end, missing = at[left] + 1, self.starts[hashes[left] + 1], []
        while len(left):
            more = at < end
            missing.append(left[~more])
            left, at, end = left[more], at[more], end[more]
            hit = self.codes[at] == codes[left]
            out[left[hit]] = self.costs[at[hit]]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out, np.sort(np.concatenate(missing)) if missing else left


_SCORED = "_hash long, _word string, _code long, _n long, n_tokens long, n_known long, base_score double, score double"


def _scorer(sent, end_count: int, of_all: int):
    """Per row its tokens, known tokens and scores as far as the heads go, and rows for the words and strings beyond them."""
    bottom, end_cost = math.log10(of_all), math.log10(end_count + 1) - math.log10(of_all)
    names = ["_id", *(field.split()[0] for field in _SCORED.split(", "))]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def made(batch: pa.RecordBatch, rows: np.ndarray, **values) -> pa.RecordBatch:
        index = pa.array(rows, pa.int64())
        columns = (pa.array(values[name], kind) if name in values else pa.nulls(len(rows), kind) for name, kind in zip(names[2:], kinds, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(2).take(index), *columns], names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, costs = sent.value
        for batch in slices(batches):
            sums = np.zeros((4, batch.num_rows))
            sums[:] = [[1], [end_count > 0], [end_cost], [0]]
            rare: Counter[tuple[int, bytes]] = Counter()
            for stretches in _stretches(texts_of(batch.column(1))):
                code, ends = _codes(stretches)
                each, missing = costs.look_up(code)
                of = np.array([s.row for s in stretches])
                np.add.at(sums[3], of, np.add.reduceat(each, np.append(0, ends[:-1])))
                for s in stretches:
                    n = np.array([counts.get(w, -1) for w in s.words], float)
                    there = n >= 0
                    sums[0, s.row] += len(n)
                    sums[1, s.row] += (n > 0).sum()
                    sums[2, s.row] += np.log10(n[there] + 1).sum() - bottom * there.sum()
                    if not there.all():
                        rare.update((s.row, s.words[i]) for i in np.flatnonzero(~there))
                if len(missing):
                    rows, codes = of[np.searchsorted(ends, missing, side="right")], code[missing].astype(np.int64)
                    order = np.lexsort((codes, rows))
                    rows, codes = rows[order], codes[order]
                    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])))
                    yield made(batch, rows[first], _code=codes[first], _n=np.diff(np.append(first, len(rows))))
            if rare:
                yield made(batch, np.array([row for row, _ in rare]), _word=[w.decode() for _, w in rare], _n=list(rare.values()))
            whole_numbers = sums[:2].astype(np.int64)
            yield made(batch, np.arange(batch.num_rows), n_tokens=whole_numbers[0], n_known=whole_numbers[1], base_score=sums[2], score=sums[3])

    return scored


def score(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score; scores are log10 probabilities, the base's with add-one word counts.

    docs may be others than those the model was trained on.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    source = source.select("_id", "_text", F.xxhash64("_text").alias("_hash"))
    kind = dict(source.dtypes)["_id"]
    head_words, is_head_word = _head(model.words, HEAD_WORDS)
    head_strings, is_head = _head(model.costs, HEAD)
    w, s = head_words.toArrow(), head_strings.select("code", "cost").toArrow()
    known = dict(zip(texts_of(w.column("word")), w.column("n").to_pylist(), strict=True))
    sent = spark.sparkContext.broadcast((known, StringCosts(s.column("code").to_numpy(), s.column("cost").to_numpy())))
    of_all = model.tokens + model.vocabulary + 1

    rows = settle(source.mapInArrow(_scorer(sent, model.texts, of_all), f"_id {kind}, {_SCORED}"))
    whole = rows.where("_n IS NULL").select("_id", "_hash", F.lit(1).alias("_times"), "n_tokens", "n_known", "base_score", "score")

    tail_words = model.words.where(~is_head_word).select(F.col("word").alias("_word"), "n")
    rare_words = rows.where("_word IS NOT NULL").select("_id", "_hash", "_word", "_n").join(tail_words, "_word", "left")
    count = F.coalesce("n", F.lit(0))
    of_words = (F.col("_n") * (F.log10(count + 1) - math.log10(of_all))).alias("base_score")
    by_word = rare_words.select("_id", "_hash", F.lit(0).alias("_times"), F.lit(0).alias("n_tokens"), F.when(count > 0, F.col("_n")).otherwise(0).alias("n_known"), of_words, F.lit(0.0).alias("score"))

    tail = model.costs.where(~is_head).select(F.col("code").alias("_code"), "cost")
    rare = settle(rows.where("_code IS NOT NULL").select("_id", "_hash", "_code", "_n").join(tail, "_code", "left"))
    new = rare.where("cost IS NULL").select(F.col("_code").alias("code"), F.lit(0).cast("long").alias("m")).distinct()
    if not new.isEmpty():
        more = unseen_costs(model.trie, settle(new)).select(F.col("code").alias("_code"), F.col("cost").alias("_more"))
        rare = rare.join(more, "_code", "left").withColumn("cost", F.coalesce("cost", "_more"))
    by_string = rare.select("_id", "_hash", F.lit(0).alias("_times"), F.lit(0).alias("n_tokens"), F.lit(0).alias("n_known"), F.lit(0.0).alias("base_score"), (F.col("_n") * F.col("cost")).alias("score"))

    # rows with the same id and text say the same, so their sums are that many times what each is
    values = ("n_tokens", "n_known", "base_score", "score")
    summed = whole.unionByName(by_word).unionByName(by_string).groupBy("_id", "_hash").agg(F.sum("_times").alias("_times"), *(F.sum(c).alias(c) for c in values))
    each = [(F.col(c) / F.col("_times")).cast("long" if c.startswith("n_") else "double").alias(c) for c in values]
    return summed.select(F.col("_id").alias(id_col), *each, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_t")).drop("_t")
