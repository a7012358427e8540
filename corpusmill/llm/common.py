"""Helpers shared by the operators: shared scratch tables, row keys, document columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; it sorts before every other id, as nulls do.
NULL_ID = -(2**63)

#: Spark drops an execution's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space, the separators of words in every operator here.
SPACES = " \t\n\x0b\x0c\r"

#: Java and RE2 pattern of one separator.
SPACE_PATTERN = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set and all run on one machine, a local one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, and a costly input is not run again by later joins.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")  # what was written needs its shuffle files no more
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def id_key(col: str = "doc_id") -> Column:
    """The id as a non-null long, for joins and groups that must keep rows with null ids."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_back(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(NULL_ID))


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """Only what an operator needs: ``doc_id`` as a long, ``text`` with null as empty, and the named columns."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *extra,
    )


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle that feeds Python: the session's setting, which grows with the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hidden(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``keep`` under names that no operator uses, and what gives its columns back."""
    names = {c: f"_column{i}" for i, c in enumerate(docs.columns) if c not in keep}
    renamed = docs.select(*keep, *(F.col(f"`{c}`").alias(h) for c, h in names.items()))
    return renamed, [F.col(names[c]).alias(c) if c in names else F.col(c) for c in docs.columns]


def shielded(docs: DataFrame, op, *keep: str) -> DataFrame:
    """Apply ``op`` to rows whose columns other than ``doc_id``, ``text`` and ``keep`` are hidden, and give back ``docs``' columns."""
    renamed, back = hidden(docs, "doc_id", "text", *keep)
    return op(renamed).select(*back)
