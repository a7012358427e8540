"""From raw documents to packed sequences: five stages, each on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, quality_rules, simhash, substrings
from corpusmill.llm.common import materialize, read, shielded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or fall below the threshold of the log-likelihood ratio."""
    labels = read(spark, sf_dir, "labels")
    return shielded(docs, lambda d: quality_rules.quality_rules(d, labels).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies: five words, similarity 0.8."""
    return shielded(docs, simhash.near_dedup)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of passages that an earlier document holds; every document stays, ``n_chars`` follows its text."""

    def strip(d: DataFrame) -> DataFrame:
        return substrings.strip_repeats(d).withColumn("text", F.col("kept_text"))

    out = shielded(docs, strip)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that sources meet their targets; each row by its own decision."""

    def repeat(d: DataFrame) -> DataFrame:
        taken = mixing.mix(d).select(F.col("mark").alias("_mark"), F.col("nth").alias("_nth"), F.col("copies").alias("_copies"))
        rows = d.withColumn("mark", mixing.row_mark())
        if not taken.filter("_nth > 0").isEmpty():
            # equal rows have decisions of their own: they are numbered as the operator does
            rows = mixing.numbered(materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered"))
        else:
            rows = rows.withColumn("nth", F.lit(0).cast("long"))
        rows = rows.join(taken, (F.col("mark") == F.col("_mark")) & (F.col("nth") == F.col("_nth")))
        return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))

    return shielded(docs, repeat, "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every piece of every document in a sequence; copies of one document are packed each on its own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]

#: Tokenizers and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
