"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letter bytes: A-Z, a-z, and everything outside ASCII. Its score for a language is the sum of log
probabilities of its byte trigrams (with its edges), hashed to BUCKETS; its script, read from its UTF-8 lead bytes,
leaves only the languages that the training texts write in that script. A path over the words of a document pays SWITCH
for each change of language; the best path's runs are the spans. The document's language is the one that has most letter
bytes in the spans, and its score is their share.

Training counts trigrams and scripts of all given rows; what reaches the driver is at most MAX_LANGUAGES * BUCKETS
counts, and the same bound holds for the model that is sent to the tasks.

Defined cases: `und` with score 0 if the text is null or has no letter, or no language was learned; words in a script no
language is known to use say nothing, and a text of such words alone gets the most trained language with score 0; ties
go to the language that sorts first; repeated rows give repeated results; a text of any length is one path, whose bytes
are scored in parts and of which only numbers per word are held; an empty table gives an empty one; `in_known_language`
hands all columns on whatever they are called, the others read the id, the text and the language only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotated, id_and_text, slices

BUCKETS, SWITCH, MAX_LANGUAGES = 1 << 17, 6.0, 64
#: A language uses a script if so much of its letters are in it.
USES = 0.005
#: Characters of text whose bytes are worked on at a time, about.
BLOCK = 2_000_000

#: Script by lead byte: 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and Hebrew, 5 Arabic and neighbours, 6 Indic to Georgian, 7 kana, 8 Han, 9 Hangul, 10 beyond.
SCRIPTS = 11
_SCRIPT = np.zeros(256, np.uint8)
for _low, _high, _s in (
    (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCB, 1), (0xCD, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD7, 4), (0xD8, 0xDF, 5), (0xE0, 0xE1, 6), (0xE3, 0xE3, 7),
    (0xE4, 0xE9, 8), (0xEA, 0xED, 9), (0xF0, 0xF4, 10),
):
    _SCRIPT[_low : _high + 1] = _s
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_ANY = re.compile(r"[^\W\d_]")
_BETWEEN = re.compile(r"[\x00-@\[-`{-\x7f]")


@dataclass
class LanguageModel:
    """languages; log probability by (language, bucket); which scripts each uses; the most trained language."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray
    usual: int


def _has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _ANY.finditer(text))


class _Block:
    """Words and trigram buckets of some texts laid end to end."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        letter = _LETTER[data]
        at = np.flatnonzero(letter)
        edged = np.where(letter, data, 32).astype(np.uint32)
        grams = (edged[at - 1] << 16) | (edged[at] << 8) | edged[at + 1]
        self.buckets = (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        self.scripts = _SCRIPT[data[at]]
        self.starts = np.flatnonzero(~letter[at - 1])  # among letters
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.doc_letters = np.searchsorted(at, begins)
        self.doc_words = np.searchsorted(at[self.starts] if len(at) else at, begins)
        self.lengths = np.diff(np.append(self.starts, len(at)))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK characters, cut between words."""
    start = 0
    while len(text) - start > BLOCK and (cut := _BETWEEN.search(text, start + BLOCK)):
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def _blocks(texts: Iterable[tuple[int, str | None]]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbered texts in lists of about BLOCK characters; a longer text stands alone."""
    rows, held, size = [], [], 0
    for i, text in texts:
        if text is None:
            continue
        if rows and size + len(text) > BLOCK:
            yield rows, held
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(text)
        size += len(text)
    if rows:
        yield rows, held


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """From all rows of docs that have a text and a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("_lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    at = {lang: i for i, lang in enumerate(languages)}
    width = BUCKETS + SCRIPTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) * width, np.int64)
        for batch in slices(batches):
            labels = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            for rows, texts in _blocks((i, part) for i, text in enumerate(batch.column(1).to_pylist()) for part in _parts(text)):
                block = _Block(texts)
                of = np.repeat(labels[rows] * width, np.diff(block.doc_letters))
                total += np.bincount(of + block.buckets, minlength=len(total))
                total += np.bincount(of + BUCKETS + block.scripts, minlength=len(total))
        full = np.flatnonzero(total)
        for i in range(0, len(full), 1 << 16):
            part = full[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["cell", "n"])

    counts = np.zeros((len(languages), width))
    if languages:
        summed = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts.reshape(-1)[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:].copy()
    scripts[:, 0] = 0
    totals = grams.sum(axis=1, keepdims=True)
    logs = np.log((grams + 0.5) / (totals + 0.5 * BUCKETS)).astype(np.float32)
    uses = scripts >= USES * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, logs, uses, int(totals.argmax()) if languages else 0)


def _best_path(scores: np.ndarray, first: np.ndarray, n: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word, all documents side by side; document d has the words first[d] ... first[d] + n[d] - 1."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    labels = np.zeros(len(scores), np.int64)
    stayed = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.int16)
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left") if longest else []
    now = np.zeros((len(n), scores.shape[1]))
    for t in range(longest):
        words = first[: live[t]] + t
        best = now[: live[t]].argmax(axis=1)
        peak = now[np.arange(live[t]), best][:, None] - (switch if t else 0)
        stayed[words] = now[: live[t]] >= peak
        came[words] = best
        now[: live[t]] = np.maximum(now[: live[t]], peak) + scores[words]
    state = now.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        words = first[: live[t]] + t
        s = state[: live[t]]
        labels[words] = s
        state[: live[t]] = np.where(stayed[words, s], s, came[words])
    return labels


@dataclass
class _Words:
    """Of some texts' words, end to end: language, letter bytes, whether the script leaves any language; and where each text's words begin."""

    labels: np.ndarray
    lengths: np.ndarray
    known: np.ndarray
    begins: np.ndarray


def _word_scores(block: _Block, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    scores, known = np.zeros((len(block.starts), len(model.languages))), np.zeros(len(block.starts), bool)
    if len(block.starts):
        for i in range(len(model.languages)):
            scores[:, i] = np.add.reduceat(model.logs[i][block.buckets], block.starts)
        allowed = model.uses[:, np.maximum.reduceat(block.scripts, block.starts)].T
        known = allowed.any(axis=1)
        scores[known[:, None] & ~allowed] = -1e9
        scores[~known] = 0
    return scores, known


def _labelled(texts: list[str], model: LanguageModel, switch: float) -> _Words:
    scores, known, lengths, counts = [], [], [], np.zeros(len(texts), int)
    for rows, parts in _blocks((i, part) for i, text in enumerate(texts) for part in _parts(text)):
        block = _Block(parts)
        found = _word_scores(block, model)
        scores.append(found[0])
        known.append(found[1])
        lengths.append(block.lengths)
        np.add.at(counts, rows, np.diff(block.doc_words))
    begins = np.cumsum([0, *counts])
    labels = _best_path(np.concatenate(scores), begins[:-1], counts, switch)
    return _Words(labels, np.concatenate(lengths), np.concatenate(known), begins)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def _predictor(docs: DataFrame, model: LanguageModel, switch: float):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(raw: list[bytes | None]) -> list[pa.Array]:
        model, whole = sent.value, [None if t is None else t.decode() for t in raw]
        n = len(model.languages)
        found, scores = ["und"] * len(whole), [0.0] * len(whole)
        for rows, texts in _blocks(enumerate(whole)) if n else ():
            words = _labelled(texts, model, switch)
            of = np.repeat(np.arange(len(texts)), np.diff(words.begins))
            share = np.bincount(of * n + words.labels, weights=words.lengths * words.known, minlength=len(texts) * n).reshape(-1, n)
            for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
                if _has_letter(text):
                    total = share[i].sum()
                    best = int(share[i].argmax()) if total else model.usual
                    found[row], scores[row] = model.languages[best], float(share[i, best] / total) if total else 0.0
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

    return predict


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    found, _ = annotated(id_and_text(docs, id_col, text_col), "_text", FIELDS, _predictor(docs, model, switch))
    return found.select(F.col("_c0").alias(id_col), "lang_pred", "score")


def in_known_language(docs: DataFrame, model: LanguageModel, least: float = 0.5, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that have a language and a score of at least `least`."""
    found, own = annotated(docs, text_col, FIELDS, _predictor(docs, model, switch))
    return own(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def language_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of words in one language: id, span from 0, lang, first_word, n_words."""
    source = id_and_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            for rows, texts in _blocks(enumerate(batch.column(1).to_pylist())) if model.languages else ():
                words = _labelled(texts, model, switch)
                out: list[list] = [[], [], [], [], []]
                for i, row in enumerate(rows):
                    own = words.labels[words.begins[i] : words.begins[i + 1]]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (row, k, model.languages[own[a]], a, b - a), strict=True):
                            column.append(value)
                columns = [pa.array(values, pa.string() if i == 1 else pa.int64()) for i, values in enumerate(out[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *columns], ["_id", "span", "lang", "first_word", "n_words"])

    kind = dict(source.dtypes)["_id"]
    return source.mapInArrow(spans, f"_id {kind}, span long, lang string, first_word long, n_words long").withColumnRenamed("_id", id_col)
