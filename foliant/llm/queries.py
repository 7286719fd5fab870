"""The thin queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hardneg import hard_negatives
from .langid import identify, train
from .lexical import rank_documents
from .mixing import mix
from .packing import pack
from . import ppm
from .rules import POLICIES, apply_policy, build_ledger
from .setsketch import near_duplicates
from .shared import crc_mod
from .suffixes import without_repeats
from .tokens import count_tokens
from .topk import segment_topk
from .urls import UrlRule, judge_urls
from .weaklabel import weak_quality

URL_RULES = (
    UrlRule("block", "com", "/en/"), UrlRule("allow", "example.com", "/en/7"), UrlRule("allow", "net", "/de/"), UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = build_ledger(table(spark, sf_dir, "documents"))
    decided = apply_policy(apply_policy(ledger, POLICIES["base"], "_base"), POLICIES["v2"])
    return decided.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "fail_bits")


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model = ppm.train(docs, ~held_out)
    scored = ppm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def vocabulary(name: str) -> str:
    """The file of a public tokenizer; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_nnls_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_mask_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    digest = removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", *digest)


_ALL = (
    op1_weak_quality, op2_rule_ledger, op3_setsketch_dedup, op4_systematic_mix, op5_script_viterbi, op6_ppm_score, op7_nnls_pack, op8_token_count, op9_url_trie,
    op10_segment_topk, op11_mask_rank, op12_rtree_negatives, op13_suffix_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2]) AS t(j) GROUP BY r),
lines AS (SELECT r, l, count(*) AS n FROM d, unnest(string_split(text, chr(10))) AS t(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
dup AS (SELECT r, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup FROM lines GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
 coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
 FROM d LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
 + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT + 32 * (n_upper > n_lower)::INT + 64 * (n_words = 0)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits FROM b
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS mass FROM s),
l AS (SELECT *, (mass - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
 row_number() OVER o AS place FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, place) FROM l WHERE level <= cap / w)) AS target FROM l),
k AS (SELECT d.*, CASE WHEN size = 0 THEN 0 ELSE 1 + (length(bin(size)) - 1) * 16 + ((size * 16) // (1::BIGINT << (length(bin(size)) - 1)::BIGINT)) % 16 END AS class,
 ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % 64 AS bucket FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, md5(doc_id::VARCHAR), doc_id) AS place FROM k),
j AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
 ('0x' || substr(md5('mix-' || coalesce('s' || p.source, 'null')), 1, 4))::INT / 65536.0::DOUBLE AS u FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(floor(u + rate * place)::BIGINT - floor(u + rate * (place - 1))::BIGINT, ceil(rate)::BIGINT))::BIGINT AS taken FROM j
"""

_RULES = "(VALUES " + ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES) + ") AS r(verdict, rhost, rpath)"
OP9 = rf"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, translate(coalesce(regexp_extract(url, '^(?s:.)*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hit AS (SELECT n, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(r.verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
 FROM p JOIN {_RULES} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (n)
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

OP3 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS h FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
u AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, r.x = min(r.y) AS kept FROM r LEFT JOIN n ON r.x = n.doc_id GROUP BY r.x
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH i AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest({TERMS}) AS term FROM i) GROUP BY q, term),
d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, g GROUP BY term),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n_docs) // total AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT q, doc_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
 FROM it JOIN t USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY q, doc_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s JOIN i USING (q) WHERE score > 0 QUALIFY rank <= 10
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
 FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score,
 score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM d, unnest(range(0, n - 99)) AS t(p)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true)::INT AS new FROM r),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g) GROUP BY doc_id, span),
parts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp
 UNION ALL SELECT d.doc_id, coalesce(max(b), 0), n FROM d LEFT JOIN sp USING (doc_id) GROUP BY d.doc_id, n),
k AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept, count(*) - 1 AS n_spans FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n - (strlen(kept) // 2)::BIGINT AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (doc_id)
"""

ORACLE_SQL = {
    "op2_rule_ledger": OP2, "op3_setsketch_dedup": OP3, "op4_systematic_mix": OP4, "op9_url_trie": OP9, "op10_segment_topk": OP10, "op11_mask_rank": OP11,
    "op12_rtree_negatives": OP12, "op13_suffix_dedup": OP13,
}
