"""Tests of two groups against known values of the t distribution, plug points with other models, and table functions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, plugs, table_functions


# both tails of Student's t, from printed tables: degrees of freedom, alpha, t
TABLE = [(1, 0.05, 12.706), (2, 0.05, 4.303), (5, 0.01, 4.032), (10, 0.05, 2.228), (10, 0.001, 4.587), (30, 0.05, 2.042), (60, 0.1, 1.671), (120, 0.05, 1.980), (10**6, 0.05, 1.960), (10**6, 0.01, 2.576)]


@pytest.mark.parametrize("df,alpha,t", TABLE)
def test_t_distribution(df, alpha, t):
    assert abs(evaluation.t_reach(alpha, df) - t) < 6e-4 * max(1, t / 4)
    assert abs(evaluation.t_both_tails(t, df) - alpha) < 2e-3 * alpha + 1e-5 * (df == 1) + 3e-3 * alpha


def test_significance(spark):
    rng = random.Random(2)
    a, b = [rng.gauss(10, 2) for _ in range(40)], [rng.gauss(8, 3) for _ in range(55)]
    rows = [("a", x) for x in a] + [("b", x) for x in b] + [("c", 1.0)] * 5 + [("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = evaluation.significance(evaluation.two_sample(df, "g", "v", "a", "b")).first()
    gap, va, vb = statistics.mean(a) - statistics.mean(b), statistics.pvariance(a), statistics.pvariance(b)
    d = gap / math.sqrt((39 * va + 54 * vb) / 93)
    reach = evaluation.t_reach(0.05, 93) * math.sqrt(va / 40 + vb / 55)
    assert abs(got["effect_size"] - d) < 1e-5 and abs(got["low"] - (gap - reach)) < 1e-5 and abs(got["high"] - (gap + reach)) < 1e-5
    assert got["significant"] and got["better"] == "a" and got["effect"] == ("large" if d > 0.8 else "medium") and got["p"] < 0.01
    back = evaluation.significance(evaluation.two_sample(df, "g", "v", "b", "a")).first()
    assert back["better"] == "b" or back["better"] == "a" and back["effect"] == "negligible"  # d is taken with its sign
    none = evaluation.significance(evaluation.two_sample(df, "g", "v", "a", "e")).first()
    assert (none["p"], none["low"], none["significant"]) == (1.0, 0.0, False)
    still = evaluation.significance(evaluation.two_sample(df, "g", "v", "c", "c")).first()
    assert still["p"] is None and not still["significant"]


def test_another_embedder_and_scorer(spark):
    """A factory runs once a task, and what it makes is given whole batches."""

    def lengths():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            return [[float(len(t)), float(len(calls))] for t in texts]

        return embed

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 30)] + [(99, None)], "id long, text string").repartition(1)
    got = {r["id"]: r["v"] for r in df.select("id", plugs.embedding("text", lengths).alias("v")).collect()}
    assert got[99] is None and all(got[i] == [float(i), 1.0] for i in range(1, 30))

    def longest():
        return lambda questions, passages: [None if "no" in p else float(len(p)) for p in passages]

    hits = spark.createDataFrame([(1, 10, 0.5), (1, 11, 900.0), (1, 12, 0.1), (2, 10, 0.2)], "qid long, doc_id long, score double")
    questions = spark.createDataFrame([(1, "q"), (2, None)], "qid long, query string")
    passages = spark.createDataFrame([(10, "four"), (11, "no score"), (12, "sixsix")], "doc_id long, passage string")
    ranked = plugs.reranked(hits, questions, passages, "qid", "doc_id", 5, longest)
    assert [(r["qid"], r["doc_id"], r["score"]) for r in ranked.orderBy("qid", "rank").collect()] == [(1, 11, 900.0), (1, 12, 6.0), (1, 10, 4.0), (2, 10, 0.2)]


def test_table_functions(spark):
    spark.createDataFrame([(1, "f1", "manual", "p", "public", 0.5), (2, "f2", "manual", "q", "private", 0.75), (3, "f3", "guide", "p", "public", 0.25)], "doc_id long, file_name string, document_type string, product_name string, privacy_level string, confidence double").createOrReplaceTempView("catalog")
    spark.createDataFrame([("HTTP", "hyper text transfer protocol", 0.9), ("TCP", "transmission control protocol", 0.8)], "acronym string, definition string, confidence double").createOrReplaceTempView("acronyms")
    spark.createDataFrame([("error", "fault", "noun", 0.9)], "term string, synonym string, term_type string, confidence double").createOrReplaceTempView("synonyms")
    spark.createDataFrame([("error code", "fault", "synonym", 0.9), ("error", "part", "part_of", 0.9)], "primary_term string, related_term string, relationship_type string, confidence double").createOrReplaceTempView("relations")
    table_functions.register(spark)
    ask = lambda sql: sorted(tuple(r) for r in spark.sql(sql).collect())
    assert ask("SELECT doc_id FROM search_documents_by_category()") == [(1,), (3,)]
    assert ask("SELECT doc_id FROM search_documents_by_category('manual', search_privacy => 'all')") == [(1,), (2,)]
    assert ask("SELECT document_type, document_count, avg_confidence FROM get_categorization_statistics()") == [("guide", 1, 0.25), ("manual", 1, 0.5), ("manual", 1, 0.75)]
    assert ask("SELECT acronym FROM get_relevant_acronyms('Protocol, transfer')") == [("HTTP",)] and ask("SELECT acronym FROM get_relevant_acronyms('tcp')") == [("TCP",)]
    assert ask("SELECT synonym FROM get_relevant_synonyms('FAULT')") == [("fault",)] and ask("SELECT synonym FROM get_relevant_synonyms('fault', 'verb')") == []
    assert ask("SELECT related_term FROM get_term_context('error')") == [("fault",)]
    assert ask("SELECT s.* FROM VALUES ('Ab, cd'), (null), ('') v(t), LATERAL spans_of(t) s") == [(0, 2, "Ab"), (4, 6, "cd")]
    assert ask("SELECT p.* FROM VALUES ('one two three four') v(t), LATERAL pieces_of(t, 9) p") == [(0, 0, "one two"), (1, 8, "three"), (2, 14, "four")]
    assert ask("SELECT c.doc_id, w.word FROM catalog c, LATERAL words_of(c.file_name) w WHERE c.doc_id = 3") == [(3, "f3")]


def test_derived_columns_follow_the_content(spark):
    df = spark.createDataFrame([("B a, b!", 5), (None, 6)], "content string, at int")
    got = table_functions.derived_columns(df, "at").select("content_length", "lexemes", "updated_at").collect()
    assert [tuple(r) for r in got] == [(7, ["a", "b"], 5), (None, [], 6)]
    assert df.select(F.lit(1)).count() == 2


def test_embedders_get_pieces(spark):
    def make():
        def embed(texts):
            assert len(texts) <= 256 and None not in texts
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    df = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * (i % 11)) for i in range(700)], "i long, text string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", plugs.embedding("text", make).alias("v")).collect()}
    assert got == {i: None if i % 7 == 0 else [float(i % 11), 1.0] for i in range(700)}
