"""Merged lists, fallbacks, percentiles and splits by hand."""

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators import mining as M
from corpusmill.operators import ranking as K
from corpusmill.operators import relational as R
from corpusmill.operators import retrieval as RT


def test_expansions_are_deduplicated_and_fall_back(spark):
    content = spark.createDataFrame([(1, "a" * 250), (2, "a" * 200 + "b"), (3, "c"), (4, "d"), (5, "e")], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 3), (1, 1, 1, 2), (1, 1, 2, 4), (1, 1, 3, 5), (1, 4, 1, 5)], "qid long, variant int, rank int, doc_id long")
    fallback = spark.createDataFrame([(1, 1, 5), (2, 1, 4), (2, 2, 3)], "qid long, rank int, doc_id long")
    got = sorted(map(tuple, K.expansion_retrieval(hits, fallback, content, "qid", "doc_id", "text", 4).collect()))
    assert got == [(1, 1, 1), (1, 3, 2), (1, 4, 3), (2, 3, 2), (2, 4, 1)]


def test_modes_fall_back(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "qid long, mode string")
    a, b, c = (spark.createDataFrame(x, "qid long, doc_id long") for x in ([(1, 10)], [(2, 20), (4, 40)], [(q, 99) for q in (1, 2, 3, 4)]))
    got = {r["qid"]: (r["doc_id"], r["mode"]) for r in K.with_fallback(asked, [("a", a), ("b", b), ("c", c)], "qid", "mode").collect()}
    assert got == {1: (10, "a"), 2: (20, "b"), 3: (99, "c"), 4: (99, "c")}


def test_query_blocks_of_sessions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(60)] + [(60, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, label int")
    found = []
    for most in (RT.MOST_BROADCAST, 0):
        monkeypatch.setattr(RT, "MOST_BROADCAST", most)
        got = RT.vector_top_k(df.withColumnRenamed("doc_id", "qid"), df, "qid", "doc_id", 4, rows=10, session="label")
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and len(found[0]) == 240 and all(q % 3 == k % 3 and q != k for q, k, *_ in found[0])


def test_percentiles_by_slices(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=999).tolist(), "b": [5.0] * 40, "c": [1.0], None: rng.exponential(size=500).tolist()}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["p50"], r["p95"]) for r in R.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, [0.5, 0.95]))
    near = {r["g"]: r["p90"] for r in R.nearest_percentiles(df, ["g"], "v", {"p90": 0.9}).collect()}
    assert all(near[g] == sorted(vs)[min(int(0.9 * len(vs)), len(vs) - 1)] for g, vs in groups.items())


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(1000)], "id long, rare boolean")
    got = M.stratified_split(df, "rare", F.md5(F.col("id").cast("string")), [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    counts = {(r["rare"], r["part"]): r["count"] for r in got.groupBy("rare", "part").count().collect()}
    assert counts == {(False, "train"): 720, (False, "validation"): 90, (False, "test"): 90, (True, "train"): 80, (True, "validation"): 10, (True, "test"): 10}


def test_contrastive_pairs(spark):
    terms = spark.createDataFrame([(k, f"t{k}_{j}") for k in range(50) for j in range(4)] + [(k, "shared") for k in range(50)], "k long, term string")
    got = M.contrastive_pairs(terms, "k", "term", 3).collect()
    own = {(r["k"], r["term"]) for r in got if r["label"] == 1}
    negatives = [(r["k"], r["term"]) for r in got if r["label"] == 0]
    assert len(own) == 250 and 140 <= len(negatives) <= 150 and not own & set(negatives)


def test_set_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (1, 4, "z"), (1, 5, "w"), (1, 6, "v")], "qid long, rank int, name string")
    truth = spark.createDataFrame([(1, "x"), (1, "v"), (1, "q"), (1, "w")], "qid long, name string")
    m = E.set_metrics(hits, truth, "qid", "name", 5).first()
    assert (m["precision"], m["recall"]) == (0.4, 0.5)
    dcg = 1 + 1 / np.log2(3) + 1 / np.log2(5)
    assert abs(E.listed_ndcg(hits, truth, "qid", "name", 5).first()["ndcg"] - dcg / (1 + 1 / np.log2(2) + 1 / np.log2(3) + 1 / np.log2(4))) < 1e-6


def test_privacy_and_references(spark):
    texts = ["This is CONFIDENTIAL", "plain words", "", None, "please do  not\tdisclose", "x\n" * 9 + "Restricted", "not for public eyes"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [r["p"] for r in df.select("i", K.confidentiality(F.col("text")).alias("p")).orderBy("i").collect()]
    assert got == ["private", "public", "public", "public", "private", "private", "private"]
    refs = spark.createDataFrame([("See section 3.2 and refer to Annex, as shown in Figure (see page 9) [12]",)], "text string").select(K.cross_references(F.col("text")).alias("r")).first()["r"]
    assert refs == ["3", "9)", "Annex", "Figure", "3.2", "9", "12", "page 9"]


def test_streams_write_their_last_result(spark, tmp_path):
    from corpusmill.streaming import events as S

    data = "/root/testdata/sf0.001"
    stream = S.event_stream(spark, data)
    got = {r["event_type"]: r["n"] for r in S.finished(S.counters(stream, "event_type"), str(tmp_path)).collect()}
    assert got == {r["event_type"]: r["count"] for r in spark.read.parquet(f"{data}/events.parquet").groupBy("event_type").count().collect()}
