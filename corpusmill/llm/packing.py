"""Hierarchical multi-length packing of token sequences.

Documents are cut at the longest window. The lengths of all pieces are counted, and the packing is planned on that
histogram: it has at most as many entries as the window has tokens, whatever the corpus holds. The plan is a list of
patterns with multiplicities, and a piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import array_batches
from .common import documents, id_back, id_key, materialize
from .output import END_ID, closed, encode_documents, encoder_of, give_back

TIERS = (256, 512, 1024, 2048)


def plan_tiers(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int, int]]:
    """Place every counted length; rows ``(length, first_rank, count, first_sequence, per_sequence, offset, window)``.

    A length is routed to the smallest tier whose window holds it. The longest tier is packed first: each window
    takes the longest length left of the tier and then, again and again, the longest length that still fits, so
    shorter tiers fill its gaps. Shorter tiers are packed the same way but keep only windows that come out full;
    what is left over goes up into the longest windows, where it leaves less padding. One pattern is laid out as often
    as its scarcest length allows, so there are about as many patterns as lengths.
    """
    left = {k: v for k, v in histogram.items() if v}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    sequence = 0

    def fill(window: int, seed: int) -> tuple[dict[int, int], int]:
        pattern, gap, at = {seed: 1}, window - seed, len(lengths)
        while gap and (at := min(at, bisect_right(lengths, gap))):
            length = lengths[at - 1]
            n = min(left[length] - pattern.get(length, 0), gap // length)
            if n:
                pattern[length] = pattern.get(length, 0) + n
                gap -= n * length
            at -= 1
        return pattern, gap

    def lay(pattern: dict[int, int], window: int) -> None:
        nonlocal sequence
        times = min(left[length] // n for length, n in pattern.items())
        offset = 0
        for length, n in pattern.items():
            rows.append((length, used[length], n * times, sequence, n, offset, window))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
                lengths.remove(length)
        sequence += times

    longest, *shorter = sorted(tiers, reverse=True)
    routes = [*zip([longest, *shorter], [*shorter, 0])]
    for window, below in routes:
        seed = bisect_right(lengths, window)
        while seed and lengths[seed - 1] > below:
            length = lengths[seed - 1]
            pattern, gap = fill(window, length)
            if window == longest or not gap:
                lay(pattern, window)
                seed = min(seed, bisect_right(lengths, length))
            else:
                seed -= 1
    while lengths:
        lay(fill(longest, lengths[-1])[0], longest)
    return rows


def cut_documents(docs: DataFrame, tokenizer: str, window: int = TIERS[-1], with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut the ids at multiples of ``window``.

    Rows ``(doc_key, start, length, ids_crc32, doc_tokens)`` and, if asked for, ``ids``. Null and empty texts have the
    end id alone. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, ids in zip(pdf["doc_key"], pdf["ids"]):
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    out.append((key, start, len(piece), zlib.crc32(np.asarray(piece, "<u4").tobytes()), len(ids), piece))
            yield pd.DataFrame(out, columns=["doc_key", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    schema = "doc_key long, start long, length int, ids_crc32 long, doc_tokens long, ids array<int>"
    rows = documents(docs).select(id_key().alias("doc_key"), "text")
    if not with_ids:
        return encode_digests(rows, tokenizer, window)
    return encode_documents(rows, tokenizer, byte_level=True).select("doc_key", "ids").mapInPandas(run, schema)


def encode_digests(rows: DataFrame, tokenizer: str, window: int, end_id: int = END_ID) -> DataFrame:
    """The pieces of :func:`cut_documents` without their ids, which never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digests(batches, tokenizer, window, end_id)

    return rows.mapInArrow(run, "doc_key long, start long, length int, ids_crc32 long, doc_tokens long")


def digests(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int, end_id: int = END_ID) -> Iterator[pa.RecordBatch]:
    """Batches of pieces from batches of ``(doc_key, text)``."""
    encoder = encoder_of(tokenizer, True)
    for batch in batches:
        keys, texts = batch.column("doc_key"), batch.column("text")
        for begin, end in array_batches(texts):
            for lo, hi, *found in encoder.encode_parts(texts.slice(begin, end - begin)):
                ids, ends = closed(*found, end_id)
                tokens = np.diff(ends)
                pieces = -(-tokens // window)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(tokens[doc] - start, window)
                at, data = ends[doc] + start, ids.astype("<u4", copy=False)
                sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin + lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(sums, pa.int64()), pa.array(tokens[doc])],
                    names=["doc_key", "start", "length", "ids_crc32", "doc_tokens"],
                )
        batch = keys = texts = found = ids = ends = data = None
        give_back()


def pack(pieces: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 17) -> DataFrame:
    """Add ``sequence_id``, ``offset``, ``window``, ``step_id`` to pieces that have ``doc_key, start, length``.

    ``pieces`` must be stored, as it is read three times. Ranks within a length are counted in two steps, by (length,
    slice of a hash) and then within the slice, so that a length shared by a third of all pieces is ranked by many
    tasks. The histogram, ``max(tiers)`` rows at most, is all that reaches the driver. Steps deal the sequences of
    each window size out in turn, so each step holds like mixtures of them and about ``step_tokens`` tokens.
    """
    spark = pieces.sparkSession
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_key", "start"), F.lit(512)).cast("int"))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(sorted(plan_tiers(histogram, tiers)) or [(0,) * 7], dtype=np.int64)
    total = sum(k * v for k, v in histogram.items())
    steps = max(1, -(-total // step_tokens))

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("doc_key", "start", "ids_crc32")
    ranked = sliced.join(starts, ["length", "slice"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = plan[:, 0] << 44 | plan[:, 1]
        for pdf in batches:
            row = np.searchsorted(keys, pdf["length"].to_numpy(np.int64) << 44 | pdf["rank"].to_numpy(np.int64), "right") - 1
            length, first_rank, _, first_sequence, per_sequence, offset, window = plan[row].T
            nth = pdf["rank"].to_numpy(np.int64) - first_rank
            sequence = first_sequence + nth // per_sequence
            yield pdf.drop(columns=["rank"]).assign(
                sequence_id=sequence, offset=offset + nth % per_sequence * length, window=window.astype(np.int32), step_id=sequence % steps
            )

    kept = pieces.schema.simpleString()[7:-1].replace(":", " ")
    return ranked.select(*pieces.columns, "rank").mapInPandas(place, f"{kept.replace(',', ', ')}, sequence_id long, offset long, window int, step_id long")


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Where each piece of each document goes; one row a piece, no id is left out or doubled.

    Rows with null ids are packed like others, as are equal rows. An empty input gives no rows.
    """
    pieces = materialize(cut_documents(docs, tokenizer, max(tiers)), "pieces")
    return pack(pieces, tiers).withColumn("doc_id", id_back("doc_key")).drop("doc_key")


def packed_sequences(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """The sequences themselves: ``(sequence_id, window, step_id, ids, doc_ids, offsets)``, ids padded by none."""
    pieces = materialize(cut_documents(docs, tokenizer, max(tiers), with_ids=True), "pieces")
    placed = pack(pieces, tiers)
    ordered = F.sort_array(F.collect_list(F.struct("offset", id_back("doc_key").alias("doc_id"), "ids")))
    rows = placed.groupBy("sequence_id").agg(F.first("window").alias("window"), F.first("step_id").alias("step_id"), ordered.alias("p"))
    return rows.select(
        "sequence_id",
        "window",
        "step_id",
        F.flatten("p.ids").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"),
    )
