"""Token counts by a public tokenizer, with huge documents encoded in overlapping chunks that are spliced again.

Short documents are encoded whole. A document over `limit` characters is cut into chunks, each of which reaches
`overlap` characters into the next. Neighbours are spliced at a boundary that both find and that is proven stable:

- The pre-tokenizer's pattern scans from left to right and looks only ahead, so from a common match start on, both scans
  are the same. Byte pairs merge only inside a match.
- The left chunk's end can change a match only within `MARGIN` characters of it (the look-ahead, the longest contraction
  and the longest special string, whichever is longer), so boundaries nearer than that are not used.

Where no boundary is common, the document is encoded again with an overlap four times as wide, and so on until one
chunk holds it all. Chunks are dealt over the cluster, so a huge document is never one task's work unless it has no
boundary at all.

Other tokenizers than byte-level BPE have no boundary that is proven stable; theirs encode every text whole.

Defined cases: a null text is an empty one and has 0 tokens; special strings inside texts are what the library makes of
them by default; repeated rows give repeated results, with an id or without one, and a repeated huge document is encoded
once; no result depends on an order, so there are no ties; an empty table gives an empty one; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_and_text, settle

#: Documents over LIMIT characters are spliced; low enough that a fair share of any corpus is.
CHUNK, OVERLAP, LIMIT, MARGIN = 4096, 256, 8192, 24
#: Pieces whose ids a worker remembers in each of two generations, at most, and characters it encodes at a time, about.
REMEMBERED, AT_ONCE = 50_000, 1 << 20

_LOW = [chr(i) for i in range(0x250)]
_L = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "N")
_S = "\t-\r \x85\xa0"
#: The byte-level pre-tokenizer's pattern, for texts whose characters are all below U+0250.
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_HIGH = re.compile("[ɐ-\U0010ffff]")
_CUT = re.compile("[A-Za-z] (?=[A-Za-z])")


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about AT_ONCE characters, cut where a space stands between two letters: a piece starts there in any case."""
    start = 0
    while len(text) - start > AT_ONCE and (cut := _CUT.search(text, start + AT_ONCE // 2)):
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:]


class _Pieces(dict):
    """Ids by piece. Two generations: when the younger is full the older one goes, so pieces that keep coming stay."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.encoder.merged(piece)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers, by tokenizers (.json) or sentencepiece (.model).

    For byte-level BPE, texts are matched by pieces here and each piece is merged apart. Where `merges_by_rank` holds for
    the file, the merging is left to tiktoken, which gives the same ids in less time.
    """

    def __init__(self, path: str, by_rank: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_part, self.texts, self.alone = False, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: self.pack(self.pieces.encode(text, num_threads=1))
            return
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = lambda text: self.pack(self.library.encode(text, add_special_tokens=False).ids)
        about = json.loads(self.library.to_str())
        pre, model = about["pre_tokenizer"] or {}, about["model"]
        byte_level = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        plain_specials = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and len(t["content"]) + 4 <= MARGIN for t in about["added_tokens"])
        self.by_part = not about["normalizer"] and byte_level and model["type"] == "BPE" and not model["dropout"] and plain_specials
        if not self.by_part:
            return
        self.specials = {t["content"]: self.pack([t["id"]]) for t in about["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.spaced = any(" " in t for t in self.specials)
        self.model, self.split = self.library.model, self.library.pre_tokenizer
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}  # what the library writes for each byte
        for text in map(chr, (*range(0x100), *range(0x100, 0x800, 0x40), *range(0x800, 0x10000, 0x800), 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000)):
            if not 0xD800 <= ord(text) < 0xE000:
                self.letters |= zip(text.encode(), plain.pre_tokenize_str(text)[0][0], strict=True)
        self.known = _Pieces(self)
        if by_rank:
            import tiktoken

            written = {letter: byte for byte, letter in self.letters.items()}
            ranks = {bytes(map(written.__getitem__, token)): i for token, i in model["vocab"].items() if all(c in written for c in token)}
            self.texts, self.alone = (tiktoken.Encoding(path, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_PIECE.pattern, r"[\s\S]+"))

    def merges_by_rank(self) -> bool:
        """Whether merging the pair whose union has the smallest id gives what the library's list of merges gives, on any text.

        It does if ids rise along the list and every token, taken as a text, is encoded as itself. For let t be the
        shortest union that one rule makes of a pair (x, y) and the list does not have so. What happens inside t does not
        depend on its surroundings, and all earlier merges in it are the list's, so the library is left with x, y on t alone.
        """
        model = json.loads(self.library.to_str())["model"] if self.by_part else {}
        plain = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if not self.by_part or any(model.get(key) for key in plain) or not all(letter in model["vocab"] for letter in self.letters.values()):
            return False
        made = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
        return made == sorted(set(made)) and all([t.id for t in self.model.tokenize(token)] == [i] for token, i in model["vocab"].items())

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, piece: str) -> bytes:
        if self.alone:
            return self.pack(self.alone.encode_ordinary(piece))
        written = piece.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(written)])

    def by_pieces(self, text: str) -> bytes:
        if not text.isascii() and _HIGH.search(text):
            return b"".join([self.known[text[a:b]] for _, (a, b) in self.split.pre_tokenize_str(text)])
        if self.texts:
            return self.pack(self.texts.encode_ordinary(text))
        return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_part:
            return self.whole(text)
        return b"".join(map(self._ids, [text] if self.spaced else _slices(text)))

    def _ids(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return b"".join(self.specials[x] if i % 2 else self.by_pieces(x) for i, x in enumerate(self.special.split(text)))
        return self.by_pieces(text)

    def boundaries(self, text: str) -> list[tuple[int, int]]:
        """(place of each piece's start, tokens before it), and the text's end."""
        out, place, tokens = [], 0, 0
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                found = [(0, len(part), self.specials[part])]
            elif not part.isascii() and _HIGH.search(part):
                found = [(a, b, self.known[part[a:b]]) for _, (a, b) in self.split.pre_tokenize_str(part)]
            else:
                found = [(m.start(), m.end(), self.known[m[0]]) for m in _PIECE.finditer(part)]
            for start, _, ids in found:
                out.append((place + start, tokens))
                tokens += len(ids) // 4
            place += len(part)
        return [*out, (place, tokens)]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_rank: bool = False) -> Encoder:
    """One per worker process and path."""
    if (path, by_rank) not in _ENCODERS:
        _ENCODERS[path, by_rank] = Encoder(path, by_rank)
    return _ENCODERS[path, by_rank]


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_hash", "_k", "_chunks", "_start", "_piece"]
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                one = batch.slice(row, 1)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    index = pa.array([0] * len(some))
                    pieces = [text[s : s + chunk + overlap] for s in some]
                    pieces = [text[s:] if s == starts[-1] else p for s, p in zip(some, pieces, strict=True)]
                    numbers = [pa.array(values, pa.int64()) for values in (range(at, at + len(some)), [len(starts)] * len(some), some)]
                    yield pa.RecordBatch.from_arrays([one.column(0).take(index), one.column(1).take(index), *numbers, pa.array(pieces, pa.string())], names)

    return cut


_MARKS = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("n", T.LongType())]))


def _encode_chunks(path: str, by_rank: bool, chunk: int, overlap: int):
    kind = pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, by_rank)
        for batch in batches:
            totals, heads, tails = [], [], []
            for start, piece in zip(batch.column("_start").to_pylist(), batch.column("_piece").to_pylist(), strict=True):
                marks = enc.boundaries(piece)
                totals.append(marks[-1][1])
                heads.append([{"p": start + p, "n": n} for p, n in marks if p < overlap])
                tails.append([{"p": start + p, "n": n} for p, n in marks if chunk <= p <= len(piece) - MARGIN])
            found = [pa.array(totals, pa.int64()), pa.array(heads, kind), pa.array(tails, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *found], ["_id", "_hash", "_k", "_chunks", "_total", "_head", "_tail"])

    return encode


def _spliced(huge: DataFrame, path: str, by_rank: bool, chunk: int, overlap: int) -> DataFrame:
    """_id, _hash, _tokens (null where a pair of chunks has no common stable boundary) of documents that occur once each."""
    fields = dict(huge.dtypes)
    cut = huge.select("_id", "_hash", "_text").mapInArrow(_cut(chunk, overlap), f"_id {fields['_id']}, _hash long, _k long, _chunks long, _start long, _piece string")
    schema = T.StructType([*cut.schema.fields[:4], T.StructField("_total", T.LongType()), T.StructField("_head", _MARKS), T.StructField("_tail", _MARKS)])
    chunks = cut.repartition("_id", "_hash", "_k").mapInArrow(_encode_chunks(path, by_rank, chunk, overlap), schema)
    order = Window.partitionBy("_id", "_hash").orderBy("_k")
    places = lambda c: F.transform(c, lambda m: m["p"])
    chunks = chunks.withColumn("_next", F.lead("_head").over(order))
    chunks = chunks.withColumn("_at", F.array_min(F.array_intersect(places(F.col("_tail")), places(F.col("_next")))))
    count_at = lambda marks, at: F.get(F.filter(marks, lambda m: m["p"] == at), F.lit(0))["n"]
    until = F.when(F.col("_next").isNull(), F.col("_total")).otherwise(count_at(F.col("_tail"), F.col("_at")))
    since = F.when(F.col("_k") == 0, F.lit(0)).otherwise(count_at(F.col("_head"), F.col("_in")))
    counted = chunks.withColumn("_in", F.lag("_at").over(order)).withColumn("_n", until - since)
    return counted.groupBy("_id", "_hash").agg(F.when(F.count("_n") == F.count("*"), F.sum("_n")).alias("_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every whole text."""
    if not MARGIN < overlap <= chunk < limit:
        raise ValueError("MARGIN < overlap <= chunk < limit is needed")
    source = id_and_text(docs, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    kind = dict(source.dtypes)["_id"]
    by_rank = encoder(path).merges_by_rank()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, by_rank)
        for batch in batches:
            tokens = [len(enc.ids(t.as_py())) // 4 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    with_bytes = source.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    as_counts = lambda df: df.mapInArrow(whole, f"_id {kind}, n_bytes long, n_tokens long")
    if not encoder(path).by_part:
        return as_counts(with_bytes).withColumnRenamed("_id", id_col)
    out = as_counts(with_bytes.where(F.length("_text") <= limit))
    huge = source.where(F.length("_text") > limit).groupBy("_id", F.xxhash64("_text").alias("_hash"))
    huge = settle(huge.agg(F.first("_text").alias("_text"), F.count("*").alias("_times")).withColumn("n_bytes", F.octet_length("_text").cast("long")))
    left = huge
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_hash"] == b["_hash"])
    while True:
        done = settle(_spliced(left, path, by_rank, chunk, overlap))
        failed, good = done.where("_tokens IS NULL"), done.where("_tokens IS NOT NULL")
        counts = huge.drop("_text").join(good, same(huge, good)).select(huge["_id"], "n_bytes", F.col("_tokens").alias("n_tokens"), "_times")
        out = out.unionByName(counts.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_t", "_times"))
        if failed.isEmpty():
            return out.withColumnRenamed("_id", id_col)
        left = huge.join(failed, same(huge, failed), "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
