from collections import Counter

from pyspark.sql import functions as F

from . import brute
from .test_documents import check_packing


def test_stages(spark, awkward, nothing, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", awkward.doc_id + 10_000))
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        before, rows = docs.collect(), out.collect()
        ids = lambda found: sorted(str(r.doc_id) for r in found)
        if k == 0:
            assert ids(rows) == ids(r for r in before if brute.passes(r.text))
        if k == 1:
            found = brute.languages([(r.text, r.lang) for r in before])
            assert ids(rows) == ids(r for r, (lang, score) in zip(before, found, strict=True) if lang != "und" and score >= 0.5)
        if k == 2:
            named = {r.doc_id: r.text for r in before if r.doc_id is not None}
            roots = brute.components(named.items())
            assert ids(rows) == sorted([*(str(i) for i, c in roots.items() if i == c), *("None" for _ in {r.text for r in before if r.doc_id is None})])
        if k == 3:
            assert Counter(rows) == Counter({r: n for r, n in brute.mixed(before).items() if n})
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        else:
            check_packing([r for r in rows if r.doc_id is not None], [(r.doc_id, r.text) for r in before if r.doc_id is not None], gaps=True)
        docs = out
    clashing = ["_id", "_text", "_c0", "_row", "n_words", "score", "_n", "copies", "lang_pred"]
    wide = awkward.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(i).alias(c) for i, c in enumerate(clashing)))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, wide, sf).columns == wide.columns and stage(spark, wide, sf).select(*clashing).distinct().count() == 1
    assert pipeline.STAGES[-1][1](spark, wide, sf).count() > 20
    empty = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
