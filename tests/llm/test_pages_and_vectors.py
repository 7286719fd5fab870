import math

from pyspark.sql import functions as F

from foliant.llm import topk, urls


def test_urls(spark):
    from foliant.llm.queries import URL_RULES

    rows = [
        (1, "http://a.example.com/en/700?x#y"), (2, "https://EXAMPLE.com/en/6"), (3, "http://notexample.com/en/7"), (4, "https://b.net/de/8"), (5, "x://c.example.net/de/81"),
        (6, "http://org/es/"), (7, "http://org/es"), (8, None), (9, "no scheme"), (10, "http://h?q/en/"), (11, "a\nb://com/en/"), (11, "a\nb://com/en/"),
    ]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, URL_RULES).collect()}
    assert got == {
        1: ("a.example.com", "/en/700", "example.com/en/7", "allow"), 2: ("example.com", "/en/6", "com/en/", "block"), 3: ("notexample.com", "/en/7", "com/en/", "block"),
        4: ("b.net", "/de/8", "net/de/", "allow"), 5: ("c.example.net", "/de/81", "example.net/de/8", "block"), 6: ("org", "/es/", "org/es/", "block"), 7: ("org", "/es", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("h", "", None, "allow"), 11: ("com", "/en/", "com/en/", "block"),
    }
    assert urls.judge_urls(df, URL_RULES).count() == 12 and urls.judge_urls(df.where("false"), URL_RULES).count() == 0


def test_longest_rule_wins(spark):
    rules = [urls.UrlRule(*r) for r in (("block", "com", "/a/very/long/path"), ("allow", "x.com", "/a"), ("block", "b.y.net", "/c"), ("allow", "y.net", "/c/d"), ("allow", "z.org", ""), ("block", "z.org", ""))]
    rows = [(1, "http://x.com/a/very/long/path/1"), (2, "http://x.com/a/very"), (3, "http://b.y.net/c/d"), (4, "http://z.org/"), (5, "http://y.net/c/" + "d/" * 5000)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: ("com/a/very/long/path", "block"), 2: ("x.com/a", "allow"), 3: ("b.y.net/c", "block"), 4: ("z.org", "block"), 5: ("y.net/c/d", "allow")}


def test_many_rules_on_one_host():
    import time

    began = time.time()
    trie = urls.HostPathTrie([urls.UrlRule("block", "x.com", f"/p{i}") for i in range(100_000)] + [urls.UrlRule("allow", "x.com", "/p7/q")])
    assert trie.match("a.x.com", "/p99999x") == ("x.com/p99999", "block") and trie.match("x.com", "/p7/q1") == ("x.com/p7/q", "allow") and trie.match("x.com", "/r") is None
    for i in range(20_000):
        trie.match("x.com", f"/p{i}/abc")
    assert time.time() - began < 10


def test_scores_beyond_a_long(spark):
    big = 1e18
    rows = [(0, [big, big]), (1, [big, big]), (2, [big, 0.0]), (3, [-big, -big]), (20, [1e300, 0.0])]
    got = topk.segment_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()}
    most = 2**63 - 1
    assert found[0, 1] == (1, most) and found[0, 2] == (2, most) and found[0, 3] == (20, most) and found[20, 1] == (0, most)


def test_equal_candidates_spread(spark):
    rows = [(i, [0.5, 0.25]) for i in range(300)] + [(1000 + i, [0.01 * i, -0.3]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.segment_topk(df, F.col("vec_id") == 1000).collect())) == sorted(r for r in plain_search(rows, 1000))


def plain_search(rows, query, k=20):
    q = [math.floor(64 * x) for x in dict(rows)[query]]
    best = sorted((-sum(a * math.floor(64 * b) for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != query)[:k]
    return [(query, n + 1, i, -s) for n, (s, i) in enumerate(best)]


def plain_topk(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = [r for n, r in enumerate(ok) if r[0] % 20 == 0 and r not in ok[:n]]
    want = []
    for q, vector in queries:
        best = sorted((-sum(a * b for a, b in zip(vector, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(vector))[:k]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


def test_repeated_rows_and_large_numbers(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) * (1e8 if i % 2 else 1) for _ in range(3)]) for i in range(60)]
    rows += [rows[20], rows[20], rows[7], (20, [0.5, 0.25, -1.0]), (None, [1.0, 1.0, 1.0]), (2000, [1.5] * 600), (2001, [0.5] * 600)]
    got = topk.segment_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == plain_topk(rows)


def test_levels_leave_few_where_few_directions_matter():
    import numpy as np

    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(40, 64)) * (rnd.permutation(64) < 6) * 60  # what tells vectors apart is six directions, turned at random
    turn = np.linalg.qr(rnd.normal(size=(64, 64)))[0]
    x = np.floor((centres[rnd.integers(0, 40, 6000)] + rnd.normal(size=(6000, 64)) * 2) @ turn * 4).astype(np.int64)
    q, ids = x[::30], np.arange(6000)
    axes = topk.principal_axes(x[:500])
    j, i, scores, left = topk.best_of(q, ids[::30], x, ids, 20, axes)
    pairs = len(q) * (len(x) - 1)
    assert left[0] >= left[1] >= left[2] and left[1] < 0.6 * pairs and left[2] < 0.15 * pairs
    whole = q @ x.T
    for n in range(len(q)):
        best = sorted((-s, k) for k, s in enumerate(whole[n].tolist()) if k != 30 * n)[:20]
        assert sorted((-s, k) for a, k, s in zip(j, i, scores, strict=True) if a == n) == best


def test_topk_against_all_pairs(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(10)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [float("nan")] * 10), (303, [None, 1.0]), (304, [0.5, 0.5]), (320, [1.0, 1.0]), (305, [float("inf")] * 10)]
    rows += [(i, rows[0][1]) for i in range(400, 430)]  # ties
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score long")
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = topk.segment_topk(df, F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.segment_topk(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
