"""Quality rules as a bitmask ledger.

`build_ledger` evaluates every rule once per document and keeps the measurements and one failure bit per rule.
A policy is a named, versioned set of rules, so `apply_policy` is one bitwise AND, and `ablate` works on the
table of distinct bit patterns (at most 2^rules rows), never on the documents again.

Defined cases: null and empty texts measure 0 everywhere and fail `too_few_words` and `no_words`; a value on a rule's
border does not fail it (all comparisons say so themselves); texts are measured whole, whatever their length; repeated rows,
with an id or without one, get one ledger row each; an empty table gives an empty ledger; the ledger carries no columns of
the input other than the id, and `passing` hands all columns on whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotated, id_and_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


FIELDS = [T.StructField(m, T.LongType()) for m in MEASURES]


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, an SQL condition over MEASURES, holds."""

    name: str
    fails: str


#: The bit of a rule is its place here; add new rules at the end so that stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("shouting", "n_upper > n_lower"),
    Rule("no_words", "n_words = 0"),
)

#: Policies by name. v3 lets short texts pass: fewer than 50 words don't make a text bad.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": ("too_few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting"),
    "v3": ("no_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting"),
}

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


def _measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
            n_lines += 1
        elif line.strip():
            seen.add(line)
            n_lines += 1
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        until = 0  # words before this place are counted
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    without = lambda gone: len(text.translate(None, gone))
    return (
        len(words), without(_SPACE + _CONTINUATION), len(text) - without(b"#*$%&|<>"), n_lines, n_dup, repeated,
        len(text) - without(_UPPER), len(text) - without(_LOWER),
    )


def measures_of(texts: list[bytes | None]) -> list[pa.Array]:
    rows = [_measure(t) for t in texts]
    return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]


def _bits(rules: Sequence[Rule]) -> Column:
    if len(rules) > 62:
        raise ValueError("a ledger holds at most 62 rules")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def build_ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, MEASURES, and `fail_bits` with bit i set where rule i fails."""
    found, _ = annotated(id_and_text(docs, id_col, text_col), "_text", FIELDS, measures_of)
    return found.withColumn("fail_bits", _bits(rules)).select(F.col("_c0").alias(id_col), *MEASURES, "fail_bits")


def mask_of(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[name] for name in set(policy))


def apply_policy(ledger: DataFrame, policy: Sequence[str], column: str = "kept", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds a boolean: true where no rule of the policy fails."""
    return ledger.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0)


def passing(docs: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that fail no rule of the policy, with all their columns."""
    found, own = annotated(docs, text_col, FIELDS, measures_of)
    return own(apply_policy(found.withColumn("fail_bits", _bits(rules)), policy, rules=rules).where("kept"))


def ablate(ledger: DataFrame, policies: Mapping[str, Sequence[str]] | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule of it: documents, rejected, failed (by this rule), sole (by it alone), kept_without (kept if it went)."""
    spark = ledger.sparkSession
    asked = [(name, r, mask_of(p, rules), mask_of([r], rules)) for name, p in (policies or POLICIES).items() for r in p]
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    row = lambda p, r, m, b: F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"))
    each = F.explode(F.array(*(row(*x) for x in asked))).alias("x")
    if not asked:
        return spark.createDataFrame([], "policy string, rule string, documents long, rejected long, failed long, sole long, kept_without long")
    hit = F.col("fail_bits").bitwiseAND(F.col("x.mask"))
    many = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    return (
        patterns.select("fail_bits", "n", each)
        .groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule"))
        .agg(
            F.sum("n").alias("documents"), many(hit != 0, "rejected"), many(hit.bitwiseAND(F.col("x.bit")) != 0, "failed"),
            many(hit == F.col("x.bit"), "sole"), many(hit.bitwiseAND(F.bitwise_not(F.col("x.bit"))) == 0, "kept_without"),
        )
    )
