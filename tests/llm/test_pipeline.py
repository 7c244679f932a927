import hashlib

import corpus_pipeline
from quillon.llm import kernels, quality
from quillon.llm.common import table

from . import brute
from .test_operators import empty, odd_docs

TINY = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, TINY, "documents")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if verdict[r["doc_id"]]]
    best = {}
    for i, t in rows:
        key = hashlib.sha256(t.encode()).digest()
        best[key] = max(best.get(key, i), i)
    rows = [(i, t) for i, t in rows if i in set(best.values())]
    near = brute.near(rows)
    want = {i for i, _ in rows if near[i][1] == i}
    got = corpus_pipeline.run(spark, TINY).toPandas()
    assert set(got.doc_id) == want
    assert all(own.length.sum() == own.doc_tokens.iloc[0] for _, own in got.groupby("doc_id"))


def test_stages_return_the_columns(spark):
    docs = table(spark, TINY, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 4 and kernels.shingles(b"").size == 0


def test_stages_take_odd_rows(spark):
    kept, docs = [], odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TINY)
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is None, i)))
    # Short and repetitive texts go; of equal ones the largest id stays; 8 has the words of 4.
    assert kept == [[3, 4, 4, 8, None], [4, 8], [4]]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).toPandas()
    assert set(packed.doc_id) == {4} and packed.length.sum() == packed.doc_tokens.iloc[0]


def test_stages_take_empty_tables(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TINY)
        assert docs.collect() == []
