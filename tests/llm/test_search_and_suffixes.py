"""Ranked search, hard negatives and repeated bytes against plain versions, over awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hardneg, lexical, suffixes

from .conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def asked():
    rows = [(1, prose(7, 30)), (2, prose(8, 5) + " winter WINTER winter"), (3, "nothing here"), (4, None), (5, ""), (6, " ".join(prose(i, 40) for i in range(6))), (1, prose(7, 30)), (2, "Häuser grüße"), (None, "old stone")]
    return [(*r, 9) for r in rows]


@pytest.mark.parametrize("block", [32768, 4])
def test_ranks(spark, awkward, awkward_rows, asked, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "FIRST", 2)
    items = spark.createDataFrame(asked, "item_id long, text string, score long")
    docs = awkward if block > 4 else awkward.repartition(2)
    got = lexical.rank_documents(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_ranks([r[:2] for r in awkward_rows], [r[:2] for r in asked])


def test_slices_of_items(spark, awkward, awkward_rows, asked, nothing, monkeypatch):
    items = spark.createDataFrame(asked, "item_id long, text string, score long")
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    monkeypatch.setattr(lexical, "PART", 50)
    assert Counter(map(tuple, lexical.rank_documents(awkward, items).collect())) == plain_ranks([r[:2] for r in awkward_rows], [r[:2] for r in asked])
    assert lexical.rank_documents(nothing, items).count() == 0 and lexical.rank_documents(awkward, items.where("false")).count() == 0


def test_masks_save_work():
    """Common words in most documents, a rare one in few: groups without the rare one are never scored."""
    rnd, n = np.random.default_rng(3), 5000
    has = np.column_stack([rnd.random(n) < p for p in (0.7, 0.6, 0.5, 0.004)])
    terms_ = [np.flatnonzero(h) for h in has]
    starts = np.cumsum([0, *map(len, terms_)])
    flat = np.concatenate(terms_)
    weights = np.array([300, 500, 700, 9000])
    block = lexical.Block(np.full(n, 50), starts, flat, np.ones(len(flat), np.int64), weights, n, 50 * n)
    item, repeats = np.arange(4), np.array([1, 2, 1, 1])
    places, scores, scored = lexical.best_of(block, n, item, repeats, repeats, 10)
    want = sorted((-int((block.impacts[starts[d] : starts[d + 1]] * repeats[flat[starts[d] : starts[d + 1]]]).sum()), d) for d in range(n))[:10]
    assert [(-s, d) for d, s in zip(places.tolist(), scores.tolist(), strict=True)] == want and scored < n / 10
    wide = np.arange(200)
    masks, most = lexical.masks_of(block, wide, np.ones(200, np.int64), n)
    assert masks.shape == (n, 4) and lexical.bounds_of(masks[:50], most).tolist() == [int(most[flat[starts[d] : starts[d + 1]]].sum()) for d in range(50)]


def plain_negatives(rows, anchor, n_positives=5, k=10, scale=256):
    ok = [(i, a, [math.floor(scale * x) for x in v]) for i, a, v in rows if i is not None and a is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], []
    for q in ok:
        if not anchor(q[0]) or q in done:
            continue
        done.append(q)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q[2], v, strict=True)))), i, a) for i, a, v in ok if i != q[0] and len(v) == len(q[2]))
        for p, i, _ in [s for s in scored if s[2] == q[1]][:n_positives]:
            fits = [s for s in scored if s[2] != q[1] and 30 * -p <= 100 * -s[0] <= 90 * -p][:k]
            out += [(q[0], i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(fits)]
    return Counter(out)


VECTORS = "vec_id long, label long, embedding array<double>, rank int, _tile string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)


def test_negatives(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "LEAF", 8)
    monkeypatch.setattr(hardneg, "FAN", 3)
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(4), [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(None, 1, [1.0] * 6), (401, None, [1.0] * 6), (402, 1, None), (403, 1, []), (404, 1, [None, 1.0]), (405, 1, [float("nan")] * 6), (406, 1, [float("inf")] * 6), (500, 2, [0.5, 0.5]), (501, 2, [0.5, 0.4]), (502, 1, [0.25, 0.2])]
    rows += [(600 + i, 1, rows[0][2]) for i in range(150)] + [rows[0], rows[100], (100, 3, rows[7][2]), (2**40, 2**53 + 1, rows[3][2]), (2**40 + 1, 2**53 + 1, rows[4][2])]  # ties, repeated rows, one id twice, large labels
    df = vectors(spark, rows)
    for tile in (32768, 60):
        monkeypatch.setattr(hardneg, "TILE", tile)
        got = hardneg.hard_negatives(df, F.col("vec_id") % 20 == 0)
        assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 20 == 0)
    assert hardneg.hard_negatives(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_numbers_beyond_a_double(spark):
    rnd = random.Random(4)
    rows = [(i, i % 3, [rnd.uniform(-1, 1) * 10 ** rnd.choice([0, 7, 12]) for _ in range(3)]) for i in range(80)]
    got = hardneg.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_boxes_are_pruned_and_equal_rows_spread():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(40, 8)) * 50
    x = np.floor(centres[rnd.integers(0, 40, 8000)] + rnd.normal(size=(8000, 8)))
    labels, ids = rnd.integers(0, 10, 8000), np.arange(8000)
    tree = hardneg.Tree(labels, x, ids)
    q, top = x[17], sorted((-int(s), i) for s, i, a in zip(x @ x[17], ids, labels, strict=True) if a == 3 and i != 17)[:5]
    found, opened = hardneg.search(tree, q, 17, lambda a: a == 3, lambda low, high: (low <= 3) & (high >= 3), [(-(10**12), 10**12)], 5)
    assert [(-s, i) for s, i in found[0]] == top and opened < 0.1 * len(tree.lows[0])
    points = np.column_stack([np.full(9000, 4), np.tile([[1, 2, 3]], (9000, 1))])
    cuts = hardneg.cuts_of(points[:500], 9, [0, 1, 2, 3])
    tiles = hardneg.tile_of(cuts, points, rnd.integers(0, 1 << 62, 9000))
    assert np.bincount(tiles).max() < 0.4 * 9000


def plain_removed(docs, length):
    order = sorted(range(len(docs)), key=lambda n: (docs[n][0] is None, docs[n][0] or 0, docs[n][2]))
    seen, out = set(), []
    for n in order:
        b = (docs[n][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((docs[n][0], len(b), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(map(str, out))


def removed(df, length):
    rows = suffixes.without_repeats(df, length).collect()
    return Counter(str((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], hashlib.sha256(bytes(r.kept)).hexdigest())) for r in rows)


def hashed(spark, rows):
    """The order of rows with one id is that of a hash of their texts."""
    df = spark.createDataFrame([(n, r[1]) for n, r in enumerate(rows)], "n int, text string").select("n", F.xxhash64("text").alias("h"))
    by = {r.n: r.h for r in df.collect()}
    return [(*r[:2], by[n]) for n, r in enumerate(rows)]


@pytest.mark.parametrize(("block", "buckets"), [(2_000_000, 4), (3000, 40)])
def test_repeats(spark, awkward, awkward_rows, block, buckets, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        docs = hashed(spark, awkward_rows)
        for length in (100, 20):
            assert removed(awkward, length) == plain_removed(docs, length)
        assert removed(awkward.where("false"), 100) == Counter()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_passage_everywhere(spark, monkeypatch):
    """A passage that all documents share, with another number in it each time, fills several buckets."""
    monkeypatch.setattr(suffixes, "BLOCK", 2000)
    passage = prose(5, 40)
    rows = [(i, f"{prose(i + 50, 12)} {passage[:90]} {i % 7} {passage} {i % 5} {prose(i + 50, 5)}" + " aaaa" * (40 * (i % 9 == 0))) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    crossed = []
    across = suffixes._across
    monkeypatch.setattr(suffixes, "_across", lambda *a: crossed.append(1) or across(*a))
    try:
        got = removed(spark.createDataFrame(rows, "doc_id long, text string"), 60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain_removed([(*r, 0) for r in rows], 60) and crossed


def test_multikey_order():
    rnd = np.random.default_rng(2)
    texts = [bytes(rnd.choice(np.frombuffer(b"ab\0", np.uint8), rnd.integers(0, 40)).tolist()) for _ in range(3000)]
    buffer = np.frombuffer(b"".join(texts) + b"-", np.uint8)
    sizes = np.array(list(map(len, texts)))
    order, shared = suffixes.multikey_order(suffixes.laid_out(buffer, np.cumsum(sizes) - sizes, sizes, 1, 40))
    padded = [texts[i].ljust(40, b"\0") for i in order]
    assert padded == sorted(padded)
    common = lambda a, b: next((i for i in range(40) if a[i] != b[i]), 40)
    assert shared[1:].tolist() == [common(a, b) for a, b in zip(padded, padded[1:])]
