"""Token-id output: ORC files with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, array_batches
from .common import documents, id_back, id_key

END_ID = 1

#: Distinct chunks that a worker keeps the ids of.
MOST_CHUNKS = 300_000

STORED = "doc_key long, n_tokens int, part int, part_start long, ids array<int>"


@lru_cache(1)
def encoder_of(tokenizer: str, byte_level: bool) -> ChunkEncoder:
    """A worker's encoder, which later tasks of the same worker use again."""
    return ChunkEncoder(tokenizer, byte_level, limit=MOST_CHUNKS)


def give_back() -> None:
    """Return to the system what a task has freed. A worker lives on beside the executor's heap and would keep it in
    reserve through all later stages, which took more than the encoder itself."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def closed(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts in a row with ``end_id`` after each, and where each text's begin and the last ends."""
    return np.insert(flat, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))


def encode_documents(df: DataFrame, tokenizer: str, byte_level: bool, end_id: int = END_ID) -> DataFrame:
    """``(doc_key, n_tokens, part, part_start, ids)`` for rows ``(doc_key, text)``: ids of the whole text and ``end_id``.

    ``part`` is the task's partition and ``part_start`` the ids that stand before the row in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, byte_level)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for begin, end in array_batches(texts):
                for lo, hi, *found in encoder.encode_parts(texts.slice(begin, end - begin)):
                    ids, ends = closed(*found, end_id)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_key").slice(begin + lo, hi - lo),
                            pa.array(np.diff(ends).astype(np.int32)),
                            pa.array(np.full(hi - lo, part, np.int32)),
                            pa.array(before + ends[:-1]),
                            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        ],
                        names=["doc_key", "n_tokens", "part", "part_start", "ids"],
                    )
                    before += int(ends[-1])
            batch = texts = found = ids = ends = None  # a batch may have no rows
            give_back()

    return df.select("doc_key", "text").mapInArrow(run, STORED)


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, byte_level: bool = False, stripe_mb: int = 16) -> None:
    """Encode every text and write ``doc_key, n_tokens, part, part_start, ids`` as ORC in ascending document order.

    Documents are range-partitioned on their id, and on a hash of their text within equal ids, before they are
    encoded, so files, stripes and row groups hold ascending id ranges: stripe and row-group statistics prune a range
    lookup, the Bloom filter prunes a point lookup, and integer run-length encoding (ORC's default for ints) stores
    the ids. Null ids come first, stored as the smallest long, and are spread over files by their texts; null and
    empty texts hold the end id alone; rows with the same id follow one another by the hash of their text. An empty
    table gives a folder without rows.
    """
    rows = documents(docs).select(id_key().alias("doc_key"), F.xxhash64("text").alias("text_hash"), "text")
    ordered = rows.repartitionByRange("doc_key", "text_hash").sortWithinPartitions("doc_key", "text_hash")
    (
        encode_documents(ordered, tokenizer, byte_level)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", "1000")
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_key")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_orc(spark, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; with ``doc_ids`` the reader skips stripes and row groups by statistics and Bloom filter."""
    df = spark.read.schema(STORED).orc(path)
    if doc_ids is not None:
        df = df.filter(F.col("doc_key").isin(doc_ids))
    return df.withColumn("doc_id", id_back("doc_key")).select("doc_id", "n_tokens", "ids")


def token_digest(spark, path: str) -> DataFrame:
    """Per stored document its global start, length and crc32 of its ids, read back from the files.

    A row's start is what its part stored before it plus the totals of the parts before its own. Parts hold ascending
    ranges, and there is one row a part in the only sum that has an order, so no file is ever sorted or held whole.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())
            names = ["doc_key", "n_tokens", "part", "part_start"]
            columns = [batch.column("doc_key"), batch.column("n_tokens").cast(pa.int64()), batch.column("part"), batch.column("part_start")]
            yield pa.RecordBatch.from_arrays([*columns, sums], names=[*names, "ids_crc32"])

    stored = spark.read.schema(STORED).orc(path)
    rows = stored.mapInArrow(crc, "doc_key long, n_tokens long, part int, part_start long, ids_crc32 long")
    # the sums read the stored counts only: the ids column is pruned from that scan
    per_part = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "part").select(
        id_back("doc_key").alias("doc_id"), (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
