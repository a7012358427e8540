"""Quality rules in DataFrame expressions: counts a text must satisfy, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, SPACES, hidden

#: Buckets of the hashed multinomials, and pseudo-counts spread over them.
BUCKETS = 1 << 15
PRIOR = 1.0
#: A document is kept if the mean log ratio of its n-grams is at least this.
THRESHOLD = -0.1
#: Trusted documents are taken from at most so many labelled rows, those of smallest hash.
MOST_TRUSTED = 20_000


def words_of(text: str) -> Column:
    """Words, as the runs of characters other than ASCII white space; null and blank texts have none."""
    trimmed = F.expr(f"trim(BOTH '{SPACES}' FROM coalesce({text}, ''))")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN + "+"))


def grams_of(words: str, buckets: int = BUCKETS) -> Column:
    """Buckets of all one- and two-word grams."""
    w = F.col(words)
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(buckets)).cast("int")
    )
    return F.concat(one, two)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED) -> list[float]:
    """For each bucket the log of its probability among trusted documents over that among all documents.

    Trusted documents are labelled of quality 1 and not toxic. Counts over all documents are summed in each task
    before they move, so no more than ``buckets`` rows a task are shuffled and ``buckets`` rows reach the driver.
    """
    trusted = (
        labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(most_trusted)
    )
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of("text").alias("words"))
    flagged = words.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = flagged.select(F.col("trusted_id").isNotNull().cast("long").alias("trusted"), F.explode(grams_of("words", buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw) + PRIOR * buckets, sum(target) + PRIOR * buckets
    if not sum(target):
        return [0.0] * buckets
    return [math.log((t + PRIOR) / all_target) - math.log((r + PRIOR) / all_raw) for t, r in zip(target, raw)]


def repeated_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only texts in which one repeats sort their windows.
    """
    w = F.col("words")
    h = F.transform(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    df = df.withColumn("_h", h)
    with_places = F.array_sort(F.transform(F.col("_h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), with_places)).drop("_h")
    s = F.col("_s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    repeated = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
    covered = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return df.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")).drop("_s")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`` added.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows. ``score`` is the
    mean over a text's one- and two-word grams of the log ratio between trusted and all documents, so it does not
    depend on length; a text without words scores 0. Every row is scored, and kept if its base holds and the score
    reaches the threshold. Null texts have no words. Rows with null or repeated ids are judged as rows. Columns of
    these names in the input are replaced. Without labels all scores are 0.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs, back = hidden(docs.drop(*added), "doc_id", "text")
    table = ",".join(f"{x:.6f}" for x in log_ratios(docs, labels, buckets))
    weights = F.split(F.lit(table), ",").cast("array<double>")
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("words", words_of("text")).withColumn("_lines", lines)
    rows = repeated_words(rows)
    total = F.aggregate(F.col("_grams"), F.lit(0.0), lambda acc, g: acc + F.get(weights, g))
    rows = rows.withColumn("_grams", grams_of("words", buckets))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.coalesce(total / F.nullif(F.size("_grams"), F.lit(0)), F.lit(0.0)).alias("score"),
    )
    verdict = ~F.col("base_failed") & (F.col("score") >= threshold)
    # a filter on the verdict must not be pushed below this step: it would repeat the array work inside its lambdas
    return rows.withColumn("kept", F.explode(F.array(verdict))).select(*back, *added)
