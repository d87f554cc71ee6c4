"""Stored indexes: pruned searches against full ones, refresh against an index made anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.operators import retrieval as R

from test_operators import rows


def brute(vectors, queries, k):
    out = []
    for q, own in queries.items():
        scores = sorted((-round(max(float(np.dot(np.asarray(v, np.float32).astype(float), u)) for u in own), 6), c) for c, v in vectors.items() if v is not None)
        out += [(q, c, -s, n + 1) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_pruned_cells_are_exact(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 3
    vectors = {k: (centres[k % 12] + 0.2 * rng.standard_normal(16)).astype(np.float32).tolist() for k in range(900)}
    vectors |= {1000 + k: vectors[5] for k in range(30)}  # ties
    vectors[2000] = None
    queries = {q: [vectors[q * 7], *([vectors[q * 5 + 1]] if q % 2 else [])] for q in range(20)} | {99: [[0.0] * 16]}
    table = spark.createDataFrame(list(vectors.items()), "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(q, [float(x) for x in v]) for q, own in queries.items() for v in own], "query_id long, vector array<double>")
    index = R.VectorIndex(table, cells=24)
    assert int(index.sizes.sum()) == 930
    for k in (1, 10, 2000):
        for block in (4096, 7):
            assert rows(R.vector_top_k(index, asked, k, block)) == brute(vectors, queries, k)
    R.vector_top_k(index, asked.filter("query_id < 20"), 10).count()
    assert index.visited["pairs"] < 0.3 * index.visited["of"]  # most cells are not looked into
    assert rows(R.vector_top_k(R.VectorIndex(table, cells=1), asked, 10)) == brute(vectors, queries, 10)
    assert R.vector_top_k(index, asked, 0).count() == 0 and R.vector_top_k(R.VectorIndex(table.limit(0)), asked, 5).count() == 0


def texts(seed, n):
    """A word that is in nearly all texts, some that are rare, and very unlike lengths."""
    rng = random.Random(seed)
    return [(k, " ".join(["the"] * rng.choice([0, 1, 1, 2, 9]) + [f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.choice([1, 5, 30, 200]))] + ["rare"] * (k % 97 == 0))) for k in range(n)] + [(n + 5, None), (n + 6, "")]


QUERIES = [(q, f"the w{q} rare w{q + 1} unknown") for q in range(12)] + [(50, "the"), (99, "nowhere")]


def test_a_bucket_is_one_task(spark, tmp_path):
    """Postings of a bucket lie in one file, and a bucket's size does not grow with the table; all scores are made by bucket, without an exchange by term."""
    index = R.Index(spark.range(20_000).selectExpr("id AS chunk_id", "concat('the w', id % 50) AS text"), f"file://{tmp_path}/index")
    own = index.segments[0]
    assert own.buckets == 10
    assert R.Index(spark.range(40_000).selectExpr("id AS chunk_id", "'a' AS text"), f"file://{tmp_path}/more").segments[0].buckets == 20
    files = index._posts(own).select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count()
    assert files.filter("count > 1").count() == 0
    plan = R.bm25(index, spark.createDataFrame([(1, "the w3")], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "hashpartitioning(term" not in plan.split("BroadcastHashJoin")[0]


def test_blocks_that_do_not_matter_are_not_read(spark):
    corpus = spark.createDataFrame(texts(1, 1500), "chunk_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    index = R.Index(corpus, block_postings=8)
    want = rows(R.top_k(R.bm25(index, queries), "bm25", 5))
    got = R.bm25_top_k(index, queries, 5)
    assert rows(got) == want == rows(R.bm25_top_k(R.Index(corpus), queries, 5, block=3))
    assert 0 < index.read_blocks["read"] < 0.6 * index.read_blocks["blocks"]
    # The stored buckets are those that scoring groups by: only what a task has found is exchanged.
    plan = index._needed(index.segments[0], spark.createDataFrame([("the", 1.0, 0.0)], "term string, idf double, least double")).groupBy("bucket").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_refreshed_index_is_one_made_anew(spark):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    data = dict(texts(2, 400))
    table = lambda items: spark.createDataFrame(list(items), "chunk_id long, text string")
    index = R.Index(table((k, t) for k, t in data.items() if k < 200), block_postings=16)
    index.add(table((k, t) for k, t in data.items() if k >= 200))
    changed = {k: f"{data[k]} rare the w3" for k in range(0, 400, 9)}
    index.replace(table(changed.items()))
    index.delete(table((k, "") for k in [*range(5, 400, 13), 100_000]))
    now = {k: t for k, t in {**data, **changed}.items() if k not in range(5, 400, 13)}
    fresh = R.Index(table(now.items()))

    def same(a, b):
        assert (a.n_docs, round(a.avg_len, 9)) == (b.n_docs, round(b.avg_len, 9))
        assert rows(R.bm25_top_k(a, queries, 7)) == rows(R.bm25_top_k(b, queries, 7))
        assert rows(a.terms(R.query_terms(queries)), "term", "df") == rows(b.terms(R.query_terms(queries)), "term", "df")
        assert rows(a.postings) == rows(b.postings)

    same(index, fresh)
    same(R.Index.open(spark, index.path), fresh)
    index.compact()
    assert len(index.segments) == 1
    same(R.Index.open(spark, index.path), fresh)


def test_short_extracts(spark):
    ranked = spark.createDataFrame([(1, 1, 0.5, 10, 0), (1, 2, 0.4, 11, 1)], "query_id long, rank long, score double, chunk_id long, extract_id long")
    extracts = spark.createDataFrame([(0, "  abcdef "), (1, None)], "extract_id long, text string")
    assert rows(R.parent_extracts(ranked, extracts, None, 3), "extract_id", "text") == [(0, "abc"), (1, "")]


def test_near_chunks_are_scored_in_one_pass(spark, monkeypatch):
    """Chunks that a query's essential terms leave are scored by bucket, so the passes over postings do not grow with their number."""
    from lanternflow.operators import lexical

    monkeypatch.setattr(lexical, "PAIR_BLOCK", 20)
    monkeypatch.setattr(R.Index, "scores", lambda *_: pytest.fail("near chunks must not be joined to all postings"))
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    data = texts(3, 900)
    index = R.Index(spark.createDataFrame(data, "chunk_id long, text string").filter("chunk_id < 600"), block_postings=8)
    index.add(spark.createDataFrame(data, "chunk_id long, text string").filter("chunk_id >= 600"))
    index.delete(spark.range(0, 900, 11).withColumnRenamed("id", "chunk_id"))
    assert rows(R.bm25_top_k(index, queries, 5)) == rows(R.top_k(R.bm25(index, queries), "bm25", 5))
