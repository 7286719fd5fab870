import functools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid, mixing, packing, ppm, queries, rules, setsketch, tokens, weaklabel

from . import brute
from .conftest import prose

JSON = queries.vocabulary("byte_bpe_50k.json")


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(text, path=JSON):
    return library(path).encode(text or "", add_special_tokens=False).ids


# rules


def test_ledger_measures(awkward, awkward_rows):
    got = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rules.build_ledger(awkward).collect())
    assert got == Counter((r[0], brute.measures(r[1])) for r in awkward_rows)


def test_policies_and_ablation(awkward):
    ledger = rules.build_ledger(awkward).cache()
    rows = [r.fail_bits for r in ledger.collect()]
    for r in rules.ablate(ledger).collect():
        policy = rules.POLICIES[r.policy]
        mask, bit = rules.mask_of(policy), rules.mask_of([r.rule])
        assert r.documents == len(rows)
        assert r.rejected == sum(b & mask != 0 for b in rows)
        assert r.failed == sum(b & bit != 0 for b in rows)
        assert r.sole == sum(b & mask == bit for b in rows)
        assert r.kept_without == sum(b & mask & ~bit == 0 for b in rows)
    kept = rules.apply_policy(ledger, rules.POLICIES["v2"]).where("kept").select("doc_id").collect()
    passing = rules.passing(awkward, rules.POLICIES["v2"])
    assert passing.columns == awkward.columns
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in passing.collect()) and 4 in {r.doc_id for r in kept}


# near-duplicates


def test_components_against_all_pairs(spark, awkward, awkward_rows):
    rnd = random.Random(5)
    rows = [(r[0], r[1]) for r in awkward_rows if r[0] is not None]
    for g in range(12):  # families of copies with more and more words changed, around the threshold
        w = prose(100 + g, 90).split()
        for c in range(10):
            v = list(w)
            for _ in range(rnd.randrange(6)):
                v[rnd.randrange(len(v))] = f"z{rnd.randrange(999)}"
            rows.append((1000 + 10 * g + c, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = setsketch.near_duplicates(docs).collect()
    want = brute.components(dict(rows).items())
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingles(dict(rows)[r.doc_id])) for r in got)
    kept = setsketch.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({i for i, c in want.items() if i == c})


def test_rows_without_an_id(awkward):
    got = setsketch.near_duplicates(awkward).where("doc_id IS NULL").collect()
    assert len(got) == 3 and all(r.component_id is None and r.kept for r in got)
    assert setsketch.deduplicated(awkward).where("doc_id IS NULL").count() == 2


def test_rows_without_an_id_link_others(spark):
    w = prose(61, 84).split()
    left, right = ["z1", "z2", "z3", *w[3:]], [*w[:-3], "y1", "y2", "y3"]
    texts = [" ".join(x) for x in (left, w, right)]
    sets = [brute.shingles(t) for t in texts]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) >= 0.75 <= share(sets[1], sets[2]) and share(sets[0], sets[2]) < 0.9
    far = [" ".join(["q1", "q2", "q3", "q4", "q5", "q6", *w[6:]]), " ".join(w), " ".join([*w[:-6], "p1", "p2", "p3", "p4", "p5", "p6"])]
    assert share(*(brute.shingles(far[i]) for i in (0, 2))) < 0.75
    docs = spark.createDataFrame([(1, far[0], "a"), (None, far[1], "b"), (None, far[1], "c"), (3, far[2], "d")], "doc_id long, text string, _row string")
    got = Counter((r.doc_id, r.component_id) for r in setsketch.near_duplicates(docs).collect())
    assert got == Counter({(1, 1): 1, (3, 1): 1, (None, 1): 2})
    assert [r.doc_id for r in setsketch.near_duplicates(docs).where("kept").collect()] == [1]
    kept = setsketch.deduplicated(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.component_id, r.kept) for r in setsketch.near_duplicates(unnamed).collect()} == {(None, True)} and setsketch.deduplicated(unnamed).count() == 1


def test_busy_keys(spark, monkeypatch):
    """The same components where buckets, hubs, roots and classes are joined by sending the other side."""
    from foliant.llm import shared

    monkeypatch.setattr(shared, "SHARES", 3)
    rnd, base, rows = random.Random(19), prose(78, 100).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(9999)}"
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w)), (3 * i + 2, " ".join(base))]
    rows += [(1000 + i, None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()} == brute.components(rows)
    assert sorted(r.doc_id for r in setsketch.deduplicated(docs).collect()) == sorted({c for c in brute.components(rows).values()})


def test_many_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, prose(i % 50 + 900, 40)) for i in range(400)], "doc_id long, text string")
    assert setsketch.deduplicated(docs).count() == 50
    assert mixing.mixed_documents(docs.withColumn("source", F.lit("s"))).count() == 600


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "SMALL", 4)
    monkeypatch.setattr(setsketch, "MEMBERS", 8)
    rnd, base, rows = random.Random(9), prose(77, 110).split(), []
    for i in range(90):  # copies of one text, some of which are like each other but not like it
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(9999)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:105]))]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.components(rows)


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(1)
    whole = rnd.integers(0, 1 << 63, 900, np.uint64)
    a, b = whole[:700], whole[200:]
    parts = setsketch.registers(np.concatenate([a, b, whole]), np.array([0, 700, 1400]))
    assert (setsketch.merge_registers(parts[0], parts[1]) == parts[2]).all()
    larger, smaller = (parts[0] > parts[1]).sum(), (parts[0] < parts[1]).sum()
    j = setsketch.likely_similarity(np.array([larger]), np.array([smaller]), np.array([setsketch.REGISTERS - larger - smaller]), np.array([700]), np.array([700]))[0]
    assert abs(j - 500 / 900) < 0.15


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "_a long, _b long")
    assert {r._node: r._root for r in setsketch.components(links).collect()} == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


# mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    mass, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = mass - sum(capped.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > most * sizes[s] + 1e-9]
        if not over:
            return now | capped
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark, awkward, awkward_rows, sf):
    for docs, rows in ((awkward, [(r[0], r[1], r[3]) for r in awkward_rows]), (queries.table(spark, sf, "documents"), None)):
        rows = rows or [(r.doc_id, r.text, r.source) for r in docs.collect()]
        sizes = Counter()
        for _, text, source in rows:
            sizes[source] += len(brute.words(text))
        want = targets(sizes)
        got = mixing.mix(docs).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(brute.words(t))) for i, t, _ in rows)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
            assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
            taken[r.source] += r.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= 2.5 * max(r.size for r in got if r.source == s)
        assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)
        copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
        assert copies == Counter({i: n for i, n in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if n})


def test_mixed_rows_are_their_own(spark, monkeypatch):
    """Rows that share an id, or have none, are copied as often as each of them is drawn; reruns agree."""
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows = [(i % 3 or None, prose(i, 5 + i % 7), "ab"[i % 2], i % 5) for i in range(60)] + [(None, "the same", "a", 1)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = [Counter(map(tuple, mixing.mixed_documents(d).collect())) for d in (docs, docs.repartition(7))]
    assert got[0] == got[1] and set(got[0]) <= set(rows)
    size = lambda counts: Counter({(i, s, n): m for (i, t, s, n), m in counts.items()})
    drawn = Counter()
    for r in mixing.mix(docs).collect():
        drawn[r.doc_id, r.source, r.size] += r.copies
    by_size = Counter()
    for (i, text, source, _), m in got[0].items():
        by_size[i, source, len(brute.words(text))] += m
    assert by_size == +drawn and size(got[0])


# language identification


def test_against_plain_predictions(spark, awkward, awkward_rows):
    want = brute.languages([(r[1], r[2]) for r in awkward_rows])
    got = langid.identify(awkward, langid.train(awkward)).collect()
    by_row = sorted(((r[0] is None, r[0] or 0, *w) for r, w in zip(awkward_rows, want, strict=True)), key=str)
    for g, w in zip(sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in got), key=str), by_row, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-9)


def test_languages_of_long_texts_in_parts(spark, awkward, awkward_rows, monkeypatch):
    whole = sorted(map(str, langid.identify(awkward, langid.train(awkward)).collect()))
    spans = sorted(map(str, langid.language_spans(awkward, langid.train(awkward)).collect()))
    monkeypatch.setattr(langid, "BLOCK", 300)
    assert sorted(map(str, langid.identify(awkward, langid.train(awkward)).collect())) == whole
    assert sorted(map(str, langid.language_spans(awkward, langid.train(awkward)).collect())) == spans


def test_languages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    got = {r.doc_id: r for r in queries.op5_script_viterbi(spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(lang) and all(r.held_out == (brute.remainder(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held)


def test_spans_and_scripts(spark, awkward):
    model = langid.train(awkward)
    assert model.languages == ["de", "en", "ru"]
    got = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7, 15))
    assert got[14].lang_pred == "ru" and got[12].lang_pred == "de" and got[4].lang_pred == "en"
    mixed = spark.createDataFrame([(1, "Schöne Grüße über Straßen und Bäume " * 3 + "the old house of winter rain over the green hill and morning light " * 3 + "тест на русском")], "doc_id long, text string")
    spans = langid.language_spans(mixed, model).orderBy("span").collect()
    assert [s.lang for s in spans] == ["de", "en", "ru"] and spans[0].n_words == 18
    assert langid.identify(mixed, langid.train(awkward.where("false"))).first().lang_pred == "und"


def test_best_path_is_the_best():
    rnd = np.random.default_rng(3)
    scores, n, switch = rnd.normal(size=(14, 3)) * 2, np.array([6, 0, 8]), 1.5
    first = np.array([0, 6, 6])
    got = langid._best_path(scores, first, n, switch)
    import itertools

    for f, m in zip(first, n, strict=True):
        worth = lambda p: sum(scores[f + i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if m:
            assert worth(tuple(got[f : f + m])) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=int(m)))))


# language model


@pytest.mark.parametrize("small", [False, True])
def test_ppm(spark, awkward, awkward_rows, monkeypatch, small):
    if small:  # so that words and strings are joined, too, and texts are worked on in stretches
        for name, value in (("HEAD", 300), ("HEAD_WORDS", 10), ("BLOCK", 700), ("HELD", 500), ("HELD_WORDS", 20)):
            monkeypatch.setattr(ppm, name, value)
    held_out = lambda i: brute.remainder(i, 7) == 2
    want = brute.ppm_scores([(r[0], r[1]) for r in awkward_rows], held_out)
    model = ppm.train(awkward, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2)
    got = ppm.score(awkward, model).collect()
    assert model.tokens == want[0][2]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    plain = sorted(((r[0], n, known, score, base) for r, (n, known, _, base, score) in zip(awkward_rows, want, strict=True)), key=key)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.score, r.base_score) for r in got), key=key), plain, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_ppm_on_other_documents(spark, awkward, awkward_rows):
    """A trained model scores texts that it has never met."""
    new = [(100, "unheard of wörds 123"), (101, prose(2, 30)), (102, "")]
    rows = [(r[0], r[1]) for r in awkward_rows if r[0] is not None]
    want = brute.ppm_scores(rows + new, lambda i: i >= 100)[-3:]
    model = ppm.train(awkward.where("doc_id IS NOT NULL"), F.lit(True))
    got = sorted(map(tuple, ppm.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()))
    for g, (n, known, _, base, score) in zip(got, want, strict=True):
        assert g[1:3] == (n, known) and g[3:] == pytest.approx((base, score), rel=1e-9)


def test_ppm_without_training(awkward):
    model = ppm.train(awkward, F.lit(False))
    got = {r.doc_id: r for r in ppm.score(awkward, model).collect()}
    assert model.tokens == 0 and got[8].score == pytest.approx(-5 * math.log10(256)) and got[8].n_known == 0


# packing


def check_packing(got, docs, gaps=False):
    """docs: list of (id, text); every id exactly once, no gap in a sequence (unless rows were left out). Gives the padding's share."""
    ids = {i: library_ids(t) + [0] for i, t in docs}
    sequences, held = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        sequences[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id].append((r.start, r.length))
    times = Counter(i for i, _ in docs)
    assert set(held) == set(times)
    for i, parts in held.items():
        seen = Counter(p for s, n in parts for p in range(s, s + n))
        assert seen == Counter({p: times[i] for p in range(len(ids[i]))})
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at or gaps and offset > at
            at = offset + length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    return padding / total


def test_pack(spark, awkward, awkward_rows, sf):
    check_packing(packing.pack(awkward.where("doc_id IS NOT NULL"), JSON).collect(), [(r[0], r[1]) for r in awkward_rows if r[0] is not None])
    assert packing.pack(awkward, JSON).agg(F.sum("length")).first()[0] == sum(len(library_ids(r[1])) + 1 for r in awkward_rows)
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert check_packing(queries.op7_nnls_pack(spark, sf).collect(), docs) < 0.02


def test_lengths_that_do_not_fit_are_cut(spark):
    docs = [(i, prose(7, 300)) for i in range(40)]
    assert check_packing(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), JSON).collect(), docs) < 0.1


def test_nonnegative_counts_are_the_least():
    combos = packing.combinations(12)
    assert all(sum(c) == 12 and 2 <= len(c) <= 3 for c in combos) and len(set(combos)) == len(combos)
    h = np.zeros(13)
    for c, n in ((combos[0], 5), (combos[4], 7), (combos[-1], 3)):
        for b in c:
            h[b] += n
    x = packing.nonnegative_counts(combos, h)
    a = np.array([[c.count(b) for c in combos] for b in range(13)])
    assert x.min() >= 0 and np.abs(a @ x - h).max() < 1e-4
    plan = packing.plan_patterns({b: int(n) for b, n in enumerate(h) if n}, 12, 0.98)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 12
        for b in pattern:
            used[b] += n
    assert all(used[b] <= h[b] for b in used)


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(awkward, awkward_rows, name):
    path = queries.vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t or ""))
    else:
        count = lambda t: len(library_ids(t, path))
    want = Counter((r[0], len((r[1] or "").encode()), count(r[1])) for r in awkward_rows)
    assert Counter(map(tuple, tokens.count_tokens(awkward, path).collect())) == want


def test_token_counts_in_chunks(awkward, awkward_rows):
    want = Counter((r[0], len((r[1] or "").encode()), len(library_ids(r[1]))) for r in awkward_rows)
    assert Counter(map(tuple, tokens.count_tokens(awkward, JSON, limit=90, chunk=60, overlap=26).collect())) == want


def test_merges_by_rank():
    assert tokens.encoder(JSON).merges_by_rank() and not tokens.encoder(queries.vocabulary("word_bpe_49k.json")).merges_by_rank()


@pytest.mark.parametrize("by_rank", [False, True])
def test_ids_of_random_texts(monkeypatch, by_rank):
    rnd = random.Random(8)
    letters = [*map(chr, range(0x20, 0x250)), *"\n\t \r\x85\xa0\x1c'’“—日本テ🙂ɐёЖ٣१", *" " * 60, *["'s", "'ll", "<|endoftext|>"] * 3]
    enc = tokens.encoder(JSON, by_rank)
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(800)] + [prose(5, 400), "x" * 3000, " " * 3000]
    for _ in range(2):
        for text in texts:
            ids = enc.ids(text)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(text) and enc.boundaries(text)[-1] == (len(text), len(ids) // 4)
        monkeypatch.setattr(tokens, "AT_ONCE", 40)  # the second time in slices
        monkeypatch.setattr(tokens, "REMEMBERED", 50)


@pytest.mark.parametrize("text", ["it's we'll they'RE 12³ x\u00a0 y", "日本語 テスト\u3000ok 🙂🙂", "a\x1cb \x85 c\n\n\n  d", "<|endoftext|><|endof", " lead", "tail \n", "é" * 50])
def test_ids_are_the_library_s(text):
    ids = tokens.encoder(JSON).ids(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(text)


# weak labels


def test_weak_labels(spark, sf, awkward):
    got = {r.doc_id: r for r in queries.op1_weak_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    assert sum(got[i].kept == bool(q) for i, q in labels.items()) >= 0.93 * len(labels)
    assert len(weaklabel.weak_quality(awkward).collect()) == awkward.count()


def test_weak_labels_against_a_plain_version(spark, awkward, awkward_rows):
    want = brute.weak_quality([(r[0], r[1]) for r in awkward_rows], weaklabel)
    got = weaklabel.weak_quality(awkward).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    plain = sorted(((r[0], *w) for r, w in zip(awkward_rows, want, strict=True)), key=key)
    for g, w in zip(sorted(((r.doc_id, r.n_votes, r.posterior, r.score) for r in got), key=key), plain, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-5)
    again = weaklabel.weak_quality(awkward.repartition(5), fit_rows=7)
    assert sorted(map(str, again.select("doc_id", "n_votes", "kept").collect())) == sorted(map(str, weaklabel.weak_quality(awkward, fit_rows=7).select("doc_id", "n_votes", "kept").collect()))


def test_labellers_accuracies_are_found():
    rnd = np.random.default_rng(4)
    good = rnd.random(20000) < 0.7
    right = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(rnd.random(20000) < 0.2, -1, np.where(rnd.random(20000) < p, good, ~good)) for p in right], axis=1).astype(int)
    share, chances = weaklabel.fit_labellers(dict(Counter(map(tuple, votes.tolist()))))
    assert abs(share - 0.7) < 0.05
    for i, p in enumerate(right):
        assert abs(chances[1, i, 2] / (chances[1, i, 1] + chances[1, i, 2]) - p) < 0.05


def test_empty_tables(nothing):
    assert rules.build_ledger(nothing).count() == rules.passing(nothing, rules.POLICIES["v2"]).count() == 0
    assert setsketch.near_duplicates(nothing).count() == setsketch.deduplicated(nothing).count() == 0
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    assert ppm.score(nothing, ppm.train(nothing, F.lit(True))).count() == 0
    assert packing.pack(nothing, JSON).count() == tokens.count_tokens(nothing, JSON).count() == 0
    assert weaklabel.weak_quality(nothing).count() == 0
