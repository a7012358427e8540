"""Small cases whose results follow by hand."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation as E
from corpusmill.operators import relational as R
from corpusmill.operators import retrieval as RT
from corpusmill.streaming import events as S


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, True), (3, 1, False)], "qid long, rank int, relevant boolean")
    got = {r["qid"]: (r["hit"], r["mrr"], r["ndcg"]) for r in E.ranking_metrics(hits, "qid", 3).collect()}
    assert got == {1: (1, 0.333333, 0.5), 2: (1, 1.0, 1.0), 3: (0, 0.0, 0.0)}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "int"), ("b", "int"), ("c", "int"), ("n", None)], "k string, t string")
    new = spark.createDataFrame([("a", "int"), ("b", "long"), ("d", "int"), ("n", "int")], "k string, t string")
    got = {(r["k"], r["change"]) for r in R.snapshot_diff(old, new, ["k"], ["t"]).collect()}
    assert got == {("b", "MODIFIED"), ("c", "REMOVED"), ("d", "ADDED")}


def test_upsert_prefers_batch(spark):
    a = spark.createDataFrame([(1, 5, "old"), (2, 1, "old")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 1, "new"), (3, 1, "new")], "k int, o int, v string")
    assert sorted((r["k"], r["v"]) for r in R.upsert(a, b, ["k"], "o").collect()) == [(1, "new"), (2, "old"), (3, "new")]


def test_context_strategies(spark):
    rows = [(1, 10, "a", 9.0, 40), (1, 11, "a", 8.0, 40), (1, 12, "b", 7.0, 40), (1, 13, "c", 6.0, 40), (1, 14, "a", 5.0, 40), (1, 15, "d", 4.0, 40)]
    df = spark.createDataFrame(rows, "qid long, key long, source string, score double, tokens int")
    pick = lambda s, budget: [r["key"] for r in RT.pack_context(df, "qid", s, budget).orderBy("position").collect()]
    assert pick("balanced", 100) == [10, 11]
    assert pick("diverse", 200) == [10, 11, 12, 13, 15]
    assert pick("deep", 170) == [10, 11, 14, 12]


def test_sliding_limit_does_not_count_rejected(spark):
    rows = [(i, 1, t) for i, t in enumerate([0, 10, 20, 65, 70])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["accepted"] for r in S.sliding_limit(df, 2, 60.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_ttl_is_not_extended(spark):
    rows = [(i, 1, "x", t) for i, t in enumerate([0, 50, 99, 100, 150, 200])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["hit"] for r in S.ttl_cache(df, 100.0).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False}


def test_streams_agree_with_batch(spark):
    data = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = spark.conf.get("spark.checkpoint.dir")
    for f in (lambda e: S.sliding_limit(e, 3, 3600.0), lambda e: S.ttl_cache(e, 86400.0)):
        streamed = S.appended(f(S.event_stream(spark, data)), folder)
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, f(batch).collect()))
    counted = S.finished(S.counters(S.event_stream(spark, data), "event_type"), folder)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, S.counters(batch, "event_type").collect()))


def test_text_functions(spark):
    df = spark.createDataFrame([("  Is  it «Éléve» ab_1, ok? ",)], "t string")
    got = df.select(T.tokens("t").alias("a"), T.normal_query("t").alias("b"), T.overlap(T.tokens("t"), F.array(F.lit("ok"))).alias("c")).first()
    assert got["a"] == ["is", "it", "éléve", "ab_1", "ok"]
    assert got["b"] == "is it «éléve» ab_1 ok"
    assert got["c"] == 0.2
