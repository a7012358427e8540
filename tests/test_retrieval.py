"""Block-wise lexical search against the plain join, and by hand."""

import random

import numpy as np
import pytest

from corpusmill.operators import retrieval
from corpusmill.plans import retrieval as plans


@pytest.mark.parametrize("most,block", [(32 << 20, 8 << 20), (0, 1500)])
def test_bm25_top_is_the_top_of_bm25(spark, monkeypatch, most, block):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(["the"] * rng.randint(0, 3) + rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, "?!"), (903, texts[3][1]), (904, texts[3][1]), (905, "the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    queries = docs.filter("doc_id % 7 = 0 or doc_id > 899").selectExpr("doc_id as qid", "text as query")
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", most)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
    want = retrieval.top(retrieval.bm25(queries, docs, "qid", "doc_id", "text"), "qid", "doc_id", "score", 5)
    got = retrieval.bm25_top(queries, docs, "qid", "doc_id", "text", 5)
    rows = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_bm25_top_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    as_queries = lambda df: df.selectExpr("doc_id as qid", "text as query")
    assert retrieval.bm25_top(as_queries(none), docs, "qid", "doc_id", "text", 5).count() == 0
    assert retrieval.bm25_top(as_queries(docs), none, "qid", "doc_id", "text", 5).count() == 0


def test_bm25_top_shuffles_no_blocks(spark, monkeypatch):
    """Blocks of queries are sent one after the other and tasks keep the best of all their blocks, so rows do not grow with blocks."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=30))) for i in range(400)], "doc_id long, text string").repartition(2)
    kept = []
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(retrieval, "stored", lambda df, name, f=retrieval.stored: kept.append((name, f(df, name))) or kept[-1][1])
    got = retrieval.bm25_top(docs.filter("doc_id % 4 = 0").selectExpr("doc_id as qid", "text as query"), docs, "qid", "doc_id", "text", 3)
    assert "FlatMapCoGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert [n for n, _ in kept].count("hits") > 1
    hits = [df for n, df in kept if n == "hits"]
    assert got.count() == 300 and sum(df.count() for df in hits) <= 300 * max(df.rdd.getNumPartitions() for df in [kept[0][1].coalesce(3 * spark.sparkContext.defaultParallelism)])


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_vectors_meet_in_bounded_blocks(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    given = rng.normal(size=(90, 6)).astype(np.float32)
    given[40:70] = given[3]  # copies: ties go to the smaller key
    given[80] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(given)] + [(90, None)], "doc_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(retrieval, "MOST_CELLS", 40)  # a few queries at a time
    found = retrieval.vector_top_k(df.withColumnRenamed("doc_id", "qid"), df, "qid", "doc_id", 5, metric=metric, threshold=-9.0, rows=11)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()}
    x = given.astype(float)
    s = x @ x.T
    if metric == "l2":
        s = 1 - np.sqrt(((x[:, None] - x) ** 2).sum(2))
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)
        s = s / np.where(n == 0, 1, n) / np.where(n == 0, 1, n)[:, None]
    want = {}
    for q in range(90):
        order = [i for i in np.lexsort((np.arange(90), -np.round(s[q], 6))) if i != q][:5]
        want |= {(q, r + 1): (i, s[q, i]) for r, i in enumerate(order) if np.round(s[q, i], 6) > -9}
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 2e-6 for p in want)


@pytest.mark.parametrize("query", ["ev08", "rt06", "rt05"])
def test_both_searches_run_once(spark, query):
    rows = getattr(plans, query)(spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroupsInPandas" not in rows._jdf.queryExecution().toString() and rows.count() > 0


@pytest.mark.parametrize("features", [3, 25, 40, 100, 5000])
def test_tfidf_top_is_the_top_of_tfidf(spark, monkeypatch, features):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)] + ["x y", "the", "é"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(90)]
    texts += [(900, None), (901, ""), (902, "?!"), (903, texts[3][1]), (904, texts[3][1]), (905, "alone alone alone")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    queries = docs.filter("doc_id % 7 = 0 or doc_id > 899").selectExpr("doc_id as qid", "text as query")
    monkeypatch.setattr(retrieval, "MOST_WEIGHED", 7)
    given = (queries, docs, "qid", "doc_id", "text", ["the"])
    want = retrieval.top(retrieval.tfidf(*given, features=features), "qid", "doc_id", "score", 5)
    got = retrieval.tfidf_top(*given, 5, features=features)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 20
