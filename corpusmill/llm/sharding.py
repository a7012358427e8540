"""Sharding by sampled splitters: size-weighted samples give range boundaries, overfull ranges are subdivided."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_back, id_key, materialize

#: Text hash, document and row.
Key = tuple[int, int, int]


def range_of(h: np.ndarray, key: np.ndarray, row: np.ndarray, splitters: list[Key]) -> np.ndarray:
    """Index of the range of each key; a splitter is the first key of the range it opens."""
    first = np.array([s[0] for s in splitters], dtype=np.int64)
    lo, hi = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
    out = hi.copy()
    for i in np.flatnonzero(lo < hi):  # keys whose hash is that of a splitter
        out[i] = bisect_right(splitters, (int(h[i]), int(key[i]), int(row[i])))
    return out


def with_ranges(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = range_of(pdf["h"].to_numpy(), pdf["doc_key"].to_numpy(), pdf["row"].to_numpy(), splitters)
            yield pdf.assign(range=at.astype(np.int32))

    return rows.mapInPandas(run, "doc_key long, size long, text_crc32 long, h long, row long, range int")


def draw(rows: DataFrame, per_byte: dict[int, float], seed: int) -> list[tuple[int, int, int, int, float]]:
    """Keys of rows drawn with a chance proportional to their size, by range; ``(range, h, doc_key, row, weight)`` sorted.

    A row larger than the sampling step is certain and weighs its size, any other weighs one step. About as many rows
    as steps reach the driver, a number that the caller bounds.
    """
    spark = rows.sparkSession
    rates = spark.createDataFrame(list(per_byte.items()), "range int, per_byte double")
    u = (F.pmod(F.xxhash64("doc_key", "size", "row", F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    drawn = rows.join(F.broadcast(rates), "range").filter(u < F.col("size") * F.col("per_byte"))
    weight = F.greatest(F.col("size").cast("double"), 1 / F.col("per_byte"))
    return sorted(tuple(r) for r in drawn.select("range", "h", "doc_key", "row", weight).collect())


def quantiles(sample: list[tuple[int, int, int, float]], parts: int) -> list[Key]:
    total = sum(w for *_, w in sample)
    out, seen, k = [], 0.0, 1
    for *key, w in sample:
        seen += w
        if seen >= total * k / parts and k < parts:
            out.append(tuple(key))
            k = int(seen * parts / total) + 1
    return out


def cut_groups(ranged: DataFrame, splitters: list[Key], sums: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(h, bytes, begin)`` of the groups of equal texts that lie in several ranges; there are fewer than splitters.

    A group that goes on in the next range ends its first one, so what stands there before it is the rest of that range.
    """
    cut = sorted({h for h, key, row in splitters if (key, row) != (NULL_ID, 0)})
    if not cut:
        return []
    hashes = ranged.sparkSession.createDataFrame([(h,) for h in cut], "h long")
    parts: dict[int, dict[int, int]] = {}
    for r in ranged.join(F.broadcast(hashes), "h").groupBy("h", "range").agg(F.sum("size").alias("bytes")).collect():
        parts.setdefault(r["h"], {})[r["range"]] = r["bytes"]
    before = dict(zip(sorted(sums), np.cumsum([0] + [sums[r][0] for r in sorted(sums)]).tolist()))
    return [(h, sum(p.values()), int(before[min(p)] + sums[min(p)][0] - p[min(p)])) for h, p in parts.items() if len(p) > 1]


def shard(docs: DataFrame, shards: int = 8, rows_per_range: int = 50_000, most_ranges: int = 8192, samples: int = 16, tolerance: float = 0.04) -> DataFrame:
    """Put rows into ``shards`` of near equal bytes: ``doc_id, size, text_crc32, shard, slot``.

    Rows are ordered by the hash of their text, then id, then where they stand, so equal texts lie side by side. Ranges
    hold about equal bytes by sampled splitters, which fall between groups of equal texts; a range of more than twice
    its share, as a large group makes it, is sampled anew and cut inside the group, so that no task sorts one whole, not
    even where rows are equal in text and id. Sums by range then place the shard boundaries, and only positions within a
    range are sorted. A boundary keeps a group of equal texts together, in however many ranges it lies, where the group
    has at most ``tolerance`` of a shard's bytes, else it cuts the group between documents.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty. Null ids take part, equal rows go side by
    side, and which of them comes first makes no difference to the result. Other columns are not read; an empty table gives no
    rows. The driver gets ``samples`` keys and one sum a range, ``most_ranges`` ranges at most, and one sum a cut group.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            id_key().alias("doc_key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(most_ranges, max(32 * shards, n // rows_per_range)))
    most = 2 * total / ranges
    splitters: list[Key] = []
    if n:
        sample = draw(rows.withColumn("range", F.lit(0)), {0: samples * ranges / total}, seed=0)
        splitters = sorted({(h, NULL_ID, 0) for h, *_ in quantiles([s[1:] for s in sample], ranges)})
    for step in range(1, 9):
        ranged = with_ranges(rows, splitters)
        sums = {r["range"]: (r["bytes"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        overfull = {r: b for r, (b, k) in sums.items() if b > most and k > 1}
        if not overfull:
            break
        sample = draw(ranged, {r: samples * ranges / total for r in overfull}, seed=step)
        more = set()
        for r, b in overfull.items():
            more |= set(quantiles([s[1:] for s in sample if s[0] == r], int(np.ceil(b * ranges / total))))
        if more <= set(splitters):
            break
        splitters = sorted(set(splitters) | more)

    order = sorted(sums)
    base_bytes = np.cumsum([0] + [sums[r][0] for r in order]).tolist()
    base_rows = np.cumsum([0] + [sums[r][1] for r in order]).tolist()
    bases = docs.sparkSession.createDataFrame(
        [(r, int(b), int(c)) for r, b, c in zip(order, base_bytes, base_rows)] or [(-1, 0, 0)], "range int, base_bytes long, base_rows long"
    )
    spread = docs.sparkSession.createDataFrame(cut_groups(ranged, splitters, sums) if n else [], "h long, all_bytes long, all_begin long")
    by_key = Window.partitionBy("range").orderBy("h", "doc_key", "row")
    group = Window.partitionBy("range", "h")
    placed = (
        ranged.join(F.broadcast(bases), "range")
        .withColumn("begin", F.col("base_bytes") + F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("position", F.col("base_rows") + F.row_number().over(by_key) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_begin", F.min("begin").over(group))
        .join(F.broadcast(spread), "h", "left")
        .withColumn("group_bytes", F.coalesce("all_bytes", "group_bytes"))
        .withColumn("group_begin", F.coalesce("all_begin", "group_begin"))
    )
    whole = F.col("group_bytes") <= F.lit(tolerance * total / shards)
    middle = F.when(whole, F.col("group_begin") + F.col("group_bytes") / 2).otherwise(F.col("begin") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
    placed = materialize(placed.select("doc_key", "size", "text_crc32", "shard", "position"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_back("doc_key").alias("doc_id"), "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )
