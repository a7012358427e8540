"""Decomposed questions, histogram quantiles and counter increases by hand."""

import datetime as dt
import math
import random

import duckdb
from pyspark.sql import functions as F

from corpusmill.operators import questions
from corpusmill.streaming import events


def test_no_part_of_a_question_is_lost(spark):
    texts = ["review if " + ". ".join(f"part {i} of it" for i in range(n)) + "?" for n in range(2, 45)]
    texts += ["compare the first thing of them all and design the second thing or explain that when it is the third thing", "short and simple", "what is " + "word " * 20, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in questions.decompose(df, ["id"], "text").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == set(range(len(texts)))
    for n in range(2, 45):
        rows = sorted(got[n - 2], key=lambda r: r["i"] or 0)
        words = len(texts[n - 2].split())
        if words < 15:
            assert [r["part"] for r in rows] == [None]
            continue
        parts = [f"part {i} of it" for i in range(n)]
        parts[0] = "review if " + parts[0]
        groups = [[p] for p in parts]
        while len(groups) > 5:
            pairs = len(groups) // 2 if len(groups) > 10 else len(groups) - 5
            groups = [groups[2 * i] + groups[2 * i + 1] for i in range(pairs)] + groups[2 * pairs :]
        assert [r["part"] for r in rows] == [" and ".join(g) for g in groups]
        assert [r["i"] for r in rows] == list(range(1, len(groups) + 1)) and {r["n_parts"] for r in rows} == {len(groups)}
        assert {r["confidence"] for r in rows} == {0.72 if words < 20 else 0.68 if words > 100 else 0.8}
    clauses = sorted(got[43], key=lambda r: r["i"])
    assert [r["topic"] for r in clauses] == ["compare the first", "design the second", "explain that when"]
    assert [r["part_complexity"] for r in clauses] == ["moderate", "moderate", "moderate"] and clauses[0]["complexity"] == "complex"
    assert all(got[i][0]["part"] is None and got[i][0]["confidence"] == 1.0 for i in range(44, 48))


def test_question_complexity(spark):
    cases = {"Design it": "moderate", "Explain it?": "simple", "a? b? c?": "moderate", "compare if given": "moderate", "compare and design": "complex", "list the review when done ": "complex", "": "simple"}
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", questions.complexity(F.col("t"))).collect()} == cases


def test_histogram_quantile(spark):
    start = dt.datetime(2024, 1, 1)
    values = {0: [1.0] * 10, 1: [15.0] * 19 + [500.0], 2: [500.0] * 3, 3: [None, None], 4: [5.0, 10.0, 20.0, 20.0], 5: [-3.0, 4.0]}
    rows = [(start + dt.timedelta(minutes=15 * w, seconds=i), v) for w, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    got = {r["start"]: r["p"] for r in events.histogram_quantiles(df, [10.0, 20.0, 40.0]).collect()}
    got = [got[start + dt.timedelta(minutes=15 * w)] for w in range(6)]
    # the rank 9.5 of 10 in the first bucket; 19 of 19 up to 20; beyond the last bound; none; rank 3.8 of 2 + 2; rank 1.9 of 2
    assert got == [9.5, 20.0, 40.0, None, 19.0, 9.5]


def test_counter_increase_with_resets(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows, t = [], 0
    for series in ("a", "b"):
        value, t = 0.0, 0
        for _ in range(300):
            t += rng.randint(1, 3000)
            value = rng.choice([0.0, 2.0]) if rng.random() < 0.05 else value + rng.randint(0, 9)
            rows.append((series, start + dt.timedelta(seconds=t), value))
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(5)
    got = {(r["series"], r["start"]): (r["samples"], r["increase"]) for r in events.counter_increase(df, "series").collect()}
    want = {}
    for series in ("a", "b"):
        for half in range(-1, math.ceil(t / 43200) + 20):
            low = start + dt.timedelta(hours=12 * half)
            inside = [v for s, ts, v in rows if s == series and low <= ts < low + dt.timedelta(hours=24)]
            if inside:
                want[series, low] = (len(inside), sum(v if v < p else v - p for p, v in zip(inside, inside[1:])))
    assert got == want and any(x[1] > 0 for x in got.values())


def test_question_types(spark):
    cases = {
        "How to set up the pump?": "technical_docs", "the manual": "technical_docs", "what is new": "current_events", "it happened in 2031": "current_events", "show an example": "code_examples",
        "how do i  swim": "how_to", "a step by step way": "how_to", "which is better": "comparison", "pros and cons": "comparison", "it is broken": "troubleshooting", "errors": "general_knowledge",
        "newly made": "general_knowledge", "": "general_knowledge",
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)] + [(99, None)], "id long, t string")
    got = {r["id"]: r for r in questions.search_params(df, ["id"], "t", 2030, technical=["pump"]).collect()}
    assert [got[i]["kind"] for i in range(len(cases))] == list(cases.values()) and got[99]["kind"] == "general_knowledge"
    assert (got[0]["threshold"], got[0]["chunks"], got[0]["strategy"]) == (0.2, 8, "rag_first")
    assert (got[2]["threshold"], got[2]["prefer_web"], got[2]["confidence"]) == (0.7, True, 0.9)


def test_document_intents(spark):
    cases = [
        ("List all documents", ("list_all", None, None, None, False)),
        ("show me private files, top 5", ("list_by_type", "private", "private", 5, False)),
        ("find manual documents first", ("list_by_type", "manual", None, 10, False)),
        ("List documents for Pump 12 manuals", ("list_all", None, None, None, False)),
        ("what documents do you have on Valve docs", ("list_all", None, None, None, False)),
        ("search for files containing the new rule", ("search_documents", "the new rule", None, None, True)),
        ("count documents, top 99", ("get_stats", None, None, 20, False)),
        ("the newest document", ("find_recent", None, None, None, True)),
        ("document count", ("count_documents", None, None, None, False)),
        ("hello public world", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "id long, q string")
    got = {r["id"]: tuple(r)[1:] for r in questions.document_intent(df, ["id"], "q").collect()}
    for i, (q, want) in enumerate(cases):
        assert got[i] == want, q


def test_csv_fields_keep_line_separators(spark, tmp_path):
    from corpusmill.sources import files

    (tmp_path / "a.csv").write_bytes('h,i\r\na b\x0bc,"d\ne"\r\n'.encode())
    assert files.csv_lines(spark, str(tmp_path)).first()["content"] == "CSV Headers: h | i\na b\x0bc | d\ne"


def test_map_keys_are_found(spark):
    from corpusmill.sources import files

    df = spark.createDataFrame([(1, {"b": 1.0}), (2, {"a": 2.0, "b": 3.0}), (3, None)], "id long, m map<string,double>")
    got = files.flatten_maps(df, {"m": ("p", None)})
    assert got.columns == ["id", "p_a", "p_b"] and [tuple(r) for r in got.orderBy("id").collect()] == [(1, None, 1.0), (2, 2.0, 3.0), (3, None, None)]


def test_question_analysis(spark):
    cases = {
        "How and why (or when) is it so": ("complex", "factual", 0.6, 0.65, 0.8, "fusion"),
        "design a latest server": ("creative", "technical", 0.6, 0.3, 0.8, "web_preferred"),
        "fix the network": ("simple", "technical", 0.6, 0.45, 0.6, "rag_only"),
        "exactly and roughly calculate it": ("moderate", "math", 0.7, 0.65, 0.75, "hybrid_balanced"),
        "": ("simple", "factual", 0.6, 0.4, 0.5, "hybrid_balanced"),
    }
    df = spark.createDataFrame([(x,) for x in cases], "q string")
    got = {r["q"]: tuple(r)[2:] for r in questions.question_analysis(df, ["q"], "q").collect()}
    assert got == cases
    assert questions.question_analysis(spark.createDataFrame([(1, None)], "i int, q string"), ["i"], "q").first()["score"] == 0.0


def test_words_end_where_sql_ends_them(spark):
    """A letter beyond ASCII ends a word in SQL, and in Java only from 19 on."""
    texts = ["bestß enst einver", "bestü problem", "nichtfixé", "fixé", "bester", "der best", "ébest"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["kind"] for r in questions.search_params(rows, ["i"], "text", 2030).collect()}
    con = duckdb.connect()
    sql = lambda patterns, t: any(con.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0] for p in patterns)
    want = {i: "comparison" if sql(questions.COMPARISON, t) else "troubleshooting" if sql(questions.TROUBLE, t) else "general_knowledge" for i, t in enumerate(texts)}
    assert got == want and [want[i] for i in range(4)] == ["comparison", "comparison", "general_knowledge", "troubleshooting"]
