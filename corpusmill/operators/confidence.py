"""Confidence in a list of results: likeness to the question, wording, agreement among results, doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

#: Words of doubt and of certainty. Fixed values.
DOUBT = [
    r"\b(might|maybe|perhaps|possibly|potentially|could be|may be)\b",
    r"\b(uncertain|unclear|unknown|varies|depends)\b",
    r"\b(approximately|roughly|about|around|estimates?)\b",
    r"\b(typically|usually|generally|often|sometimes)\b",
    r"\b(probably|likely|unlikely|doubtful)\b",
]
CERTAIN = [
    r"\b(always|never|definitely|certainly|guaranteed)\b",
    r"\b(exactly|precisely|specifically|explicitly)\b",
    r"\b(required|mandatory|must|shall|will)\b",
    r"\b(standard|official|documented|specified)\b",
]
#: Marks of technical questions. Fixed values.
TECHNICAL = [r"\b[A-Z]{2,}\b", r"\b\d+\.\d+\b", r"\b\w+[-_]\w+\b", r"\b(config|setup|install|debug|error|fault|troubleshoot)\b"]
#: Factors of question classes. Fixed values.
FACTORS = {"simple": 1.0, "moderate": 0.95, "complex": 0.9, "expert": 0.85}


def counted(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(T.ascii_bounds(p))) for p in patterns), F.lit(0))


def question_class(question: Column) -> Column:
    """``simple``, ``moderate``, ``complex`` or ``expert``, by technical marks, length, connectives and quotes."""
    marks, words = counted(question, TECHNICAL), F.size(T.tokens(question))
    operators = question.rlike(T.ascii_bounds(r"\b(and|or|not|AND|OR|NOT)\b"))
    return (
        F.when((marks >= 3) | ((marks >= 2) & (words > 10)), "expert")
        .when((marks >= 2) | operators | (words > 8), "complex")
        .when((marks >= 1) | F.contains(question, F.lit('"')) | (words > 4), "moderate")
        .otherwise("simple")
    )


def list_similarity(hits: DataFrame, questions: DataFrame, qid: str, stop: list[str], features: int = 1000) -> DataFrame:
    """``qid, semantic``: mean over the results of their cosine with the question, each divided by its rank.

    Weights are ``tf (ln((1 + n) / (1 + df)) + 1)`` **inside each list**: n and df count the list's texts and the question, not the
    corpus. Terms are tokens of two characters or more but stop words; a list keeps its ``features`` most frequent, ties to the
    smaller. ``hits`` has ``rank, text``; a list is a few rows, so its terms are one small group.
    """
    both = hits.select(qid, "rank", "text").unionByName(questions.select(qid, F.lit(0).alias("rank"), F.col("query").alias("text")).join(hits.select(qid).distinct(), qid, "left_semi"))
    terms = both.select(qid, "rank", F.explode(F.filter(T.tokens("text"), lambda w: (F.length(w) > 1) & ~w.isin(*stop))).alias("t"))
    counts = terms.groupBy(qid, "rank", "t").agg(F.count("*").alias("tf"))
    n = both.groupBy(qid).agg(F.count("*").alias("n"))
    stats = counts.groupBy(qid, "t").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = stats.withColumn("i", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("total"), "t"))).filter(F.col("i") <= features)
    idf = kept.join(n, qid).select(qid, "t", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(idf, [qid, "t"]).select(qid, "rank", "t", (F.col("tf") * F.col("idf")).alias("w"))
    asked = weights.filter("rank = 0").select(qid, "t", F.col("w").alias("q"))
    found = weights.filter("rank > 0").join(asked, [qid, "t"], "left").groupBy(qid, "rank").agg(F.sum(F.col("w") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("d"))
    length = asked.groupBy(qid).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q"))
    scored = hits.select(qid, "rank").join(found, [qid, "rank"], "left").join(length, qid, "left")
    cosine = F.coalesce(F.col("dot") / (F.col("d") * F.col("q")), F.lit(0.0))
    return scored.groupBy(qid).agg(F.avg(cosine / F.col("rank")).alias("semantic"))


def result_confidence(hits: DataFrame, questions: DataFrame, qid: str, stop: list[str]) -> DataFrame:
    """``qid, semantic, content, consistency, penalty, question_class, confidence`` of ``hits (qid, rank, text, score, source)``.

    - semantic: ``list_similarity`` of the first five results.
    - content: mean of the first three of 0.1 a certain word, 0.05 a sentence up to 0.3 and 0.2 for a digit, less 0.15 a doubtful
      word, between 0 and 1. Texts are lower-cased before, so that capitals of technical terms count for nothing.
    - consistency: 0.3 for few sources, 0.4 less the population deviation of the first five scores, 0.3 for the share of the first
      three texts' tokens that come twice; 0.8 for a single result, 0.5 where the texts have no tokens.
    - penalty: ten times the mean share of doubtful words in the first three, at most 1.
    Confidence is 0.4, 0.3, 0.2 and 0.1 of these, the penalty from 1, times the factor of the question's class. A null text is empty;
    questions without results give no row.
    """
    top5 = hits.filter("rank <= 5").withColumn("text", F.coalesce("text", F.lit("")))
    low = F.lower("text")
    doubts, words = counted(low, DOUBT), F.size(T.split_words(low))
    structure = F.least(F.lit(0.3), 0.05 * F.size(T.sentences(low))) + F.when(low.rlike(r"\d"), 0.2).otherwise(0.0)
    content = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.1 * counted(low, CERTAIN) + structure - 0.15 * doubts))
    density = doubts / F.greatest(F.lit(1), words)
    first = F.col("rank") <= 3
    judged = top5.select(qid, "rank", "score", "source", content.alias("_content"), density.alias("_density"))
    parts = judged.groupBy(qid).agg(
        F.count("*").alias("n"), F.avg(F.when(first, F.col("_content"))).alias("content"), F.least(F.lit(1.0), 10 * F.avg(F.when(first, F.col("_density")))).alias("penalty"),
        F.countDistinct("source").alias("sources"), F.stddev_pop("score").alias("deviation"),
    )
    tokens = top5.filter(first).select(qid, F.explode(T.tokens("text")).alias("t")).groupBy(qid, "t").agg(F.count("*").alias("n"))
    shared = tokens.groupBy(qid).agg((F.count_if(F.col("n") > 1) / F.count("*")).alias("shared"))
    joined = parts.join(shared, qid, "left").join(list_similarity(top5, questions, qid, stop), qid).join(questions.select(qid, question_class(F.col("query")).alias("question_class")), qid)
    mixed = 0.3 * (1 - F.col("sources") / F.col("n")) + 0.4 * F.greatest(F.lit(0.0), 1 - F.col("deviation")) + 0.3 * F.col("shared")
    consistency = F.when(F.col("n") < 2, 0.8).when(F.col("shared").isNull(), 0.5).otherwise(mixed)
    joined = joined.withColumn("consistency", consistency)
    factor = F.coalesce(*(F.when(F.col("question_class") == c, F.lit(f)) for c, f in FACTORS.items()))
    raw = 0.4 * F.col("semantic") + 0.3 * F.col("content") + 0.2 * F.col("consistency") + 0.1 * (1 - F.col("penalty"))
    rounded = [F.round(c, 6).alias(c) for c in ("semantic", "content", "consistency", "penalty")]
    return joined.select(qid, *rounded, "question_class", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * factor)), 6).alias("confidence"))
