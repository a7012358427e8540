"""Quality classifier with site priors: document evidence joined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, materialize
from .substrings import Words

BUCKETS = 1 << 18
#: At most so many labelled rows fit the classifier, those of smallest hash.
MOST_LABELLED = 20_000
#: Log ratios below this tell a bad document on their own and count in full, whatever the length of the text.
TELLING = -3.0
#: A word's bucket counts only if so many labelled documents hold it.
LEAST_DOCUMENTS = 4

#: Lower-cases ASCII letters and drops commas and full stops.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,.", b"abcdefghijklmnopqrstuvwxyz  ")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, bucket)`` of the different words of each text."""
    w = Words(texts, _TABLE)
    both = np.unique(w.text_no.astype(np.int64) << 18 | (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64))
    return both >> 18, both & (BUCKETS - 1)


def _slices(pdf: pd.DataFrame, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    group = pdf["text"].str.len().to_numpy().cumsum() // characters
    for _, part in pdf.groupby(group, sort=False):
        yield part


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> np.ndarray:
    """Log ratios of each bucket's document rate among good and bad labelled documents; good: quality 1, not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min(good.cast("int")).alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(most)
    )
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "good")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for pdf in batches:
            for part in _slices(pdf):
                label = part["good"].to_numpy()
                text, bucket = features(part["text"].tolist())
                counts += [np.bincount(bucket[label[text] == c], minlength=BUCKETS + 1) for c in (0, 1)]
                counts[:, BUCKETS] += [(label == 0).sum(), (label == 1).sum()]
        at = np.flatnonzero(counts.sum(axis=0))
        yield pd.DataFrame({"bucket": at, "bad": counts[0, at], "good": counts[1, at]})

    sums = rows.mapInPandas(count, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    bad, ok = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in sums.collect():  # BUCKETS + 1 rows at most
        bad[r["bucket"]], ok[r["bucket"]] = r["bad"], r["good"]
    n_bad, n_ok = bad[BUCKETS], ok[BUCKETS]
    if not n_bad or not n_ok:
        return np.zeros(BUCKETS)
    ratio = np.log((ok[:BUCKETS] + 1) / (n_ok + 2)) - np.log((bad[:BUCKETS] + 1) / (n_bad + 2))
    return np.where(ok[:BUCKETS] + bad[:BUCKETS] >= LEAST_DOCUMENTS, ratio, 0.0)


def evidence(docs: DataFrame, weights: np.ndarray, others: list[str]) -> DataFrame:
    """``others`` and the log evidence for a good document.

    It is the sum of its words' ratios over the root of their number, as words of one text are not independent, and
    the sum of telling ratios in full, so that a few abusive words weigh alike in short and in long texts.
    """
    telling = np.where(weights < TELLING, weights, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                text, bucket = features(part["text"].tolist())
                n = np.bincount(text, minlength=len(part))
                total = np.bincount(text, weights[bucket], minlength=len(part))
                told = np.bincount(text, telling[bucket], minlength=len(part))
                yield part.drop(columns=["text"]).assign(evidence=total / np.sqrt(np.maximum(n, 1)) + told)

    kept = docs.select(*others)
    return docs.select(*others, "text").mapInPandas(run, kept.schema.add("evidence", "double"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: str, least: float = 1.0, most: float = 1e4) -> Column:
    """Pseudo-documents of a prior, by moments: ``m (1 - m) / variance between groups - 1``."""
    m, var = F.avg(rate), F.var_pop(rate)
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(m * (1 - m) / F.nullif(var, F.lit(0.0)) - 1, F.lit(most)))).alias("strength")


def site_quality(docs: DataFrame, labels: DataFrame, host: str, path: str, threshold: float = 0.5) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, score, kept`` for every document.

    A word classifier, fitted on at most ``MOST_LABELLED`` labelled rows, gives each document's log evidence. Every
    document's chance under the global rate is summed by host and path, in tasks before it moves. A host's rate is its
    mean drawn toward the global rate, a path's its mean drawn toward its host's; the strength of each prior is
    estimated from the spread of groups, so sparse sites stay near it. A document's score is its evidence at its
    path's rate. Null texts and texts without words have no evidence and take their path's rate; null hosts and paths
    are groups of their own; without labels every rate is one half and everything is kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(id_key().alias("doc_key"), text.alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    weights = fit(rows.select(id_back("doc_key").alias("doc_id"), "text"), labels)
    scored = materialize(evidence(rows, weights, ["doc_key", "host", "path"]), "evidence")
    chance = scored.withColumn("chance", 1 / (1 + F.exp(-F.col("evidence"))))
    by_path = materialize(chance.groupBy("host", "path").agg(F.sum("chance").alias("good"), F.count("*").alias("n")), "paths")
    by_host = by_path.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    everything = by_host.agg(
        F.coalesce(F.sum("host_good") / F.sum("host_n"), F.lit(0.5)).alias("rate"), _strength(by_host, F.col("host_good") / F.col("host_n"))
    )
    hosts = by_host.crossJoin(F.broadcast(everything)).withColumn(
        "host_rate", (F.col("host_good") + F.col("strength") * F.col("rate")) / (F.col("host_n") + F.col("strength"))
    )
    inner = F.broadcast(by_path.agg(_strength(by_path, F.col("good") / F.col("n")).alias("inner")))
    paths = by_path.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).crossJoin(inner)
    paths = paths.withColumn("path_rate", (F.col("good") + F.col("inner") * F.col("host_rate")) / (F.col("n") + F.col("inner")))
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "rate", "host_rate", "path_rate")
    joined = scored.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))
    return joined.select(
        id_back("doc_key").alias("doc_id"), "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("kept")
    )
