"""Spelling variants: generated edits are looked up in Bloom filters, and only positives meet the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, tasks

#: Runs of letters in Latin-1 bytes, lower-cased before.
RUNS = re.compile(rb"[a-z\xc0-\xff]+")
#: Different words that a task counts before it passes them on.
MOST_COUNTED = 500_000
#: Words of this length and longer share one shard of the filter.
LONGEST_SHARD = 64
#: A block of the filter has four lanes of 64 bits, and a word one bit in each; so many bits are kept a word.
LANES, BITS_PER_WORD = 4, 16
#: Characters of words whose edits are made at once.
CHUNK = 1 << 18
#: Base of the polynomial hash modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
_WORD = "word string, n long"


def word_counts(docs: DataFrame, one_in: int = 97, least_length: int = 5) -> DataFrame:
    """``(word, n)``: words of whole texts, of ``least_length`` letters at least, and how often they occur.

    Words are runs of ASCII letters and those from U+00C0 to U+00FF with A-Z lower-cased. Where the crc32 of
    ``<doc_id>:<word>`` is a multiple of ``one_in``, the word loses one letter, as a slip of the pen would. A null id is
    written as ``null``. Counts are summed in tasks before they move.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())})
            counts.clear()
            return out

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for w, n in Counter(RUNS.findall(text.encode("latin-1", "replace").lower())).items():
                    crc = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                    if crc % one_in == 0:
                        at = crc % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= least_length:
                        counts[w] += n
                if len(counts) > MOST_COUNTED:
                    yield flush()
        if counts:
            yield flush()

    rows = documents(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text")
    return rows.mapInPandas(run, _WORD).groupBy("word").agg(F.sum("n").alias("n"))


def powers(n: int) -> np.ndarray:
    """``BASE`` to the powers 0 to ``n - 1``."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)[:n]


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.uint64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * powers(codes.shape[1])[::-1]).sum(axis=1, dtype=np.uint64)


def by_length(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words of one length, as many at once as their edits may take memory."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(part):
            step = max(1, CHUNK // int(sizes[part[0]]))
            yield from (part[i : i + step] for i in range(0, len(part), step))


def hashed(words: DataFrame) -> DataFrame:
    """``(word, n, h, length)`` with the polynomial hash of the word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coded = [w.encode("latin-1") for w in pdf["word"]]
            h = np.zeros(len(coded), np.uint64)
            for part in by_length(coded):
                h[part] = word_hashes(letters([coded[i] for i in part]))
            yield pdf.assign(h=h.view(np.int64), length=list(map(len, coded)))

    return words.mapInPandas(run, f"{_WORD}, h long, length int")


def edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of edits of words of one length: ``(row, hash, change of length)``.

    Every deletion, and every replacement of a letter by a later one. A pair of words one edit apart is met so from one
    side: from the longer word, or from the one with the smaller letter.
    """
    n, size = codes.shape
    power = powers(size + 1)
    step = max(1, CHUNK // max(1, n))
    terms = codes * power[:size][::-1]
    whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    # what stands before the deleted letter moves one place down: the hash of the prefix is carried on letter by letter
    prefix = np.zeros((n, size), np.uint64)
    for i in range(1, size):
        prefix[:, i] = prefix[:, i - 1] * np.uint64(BASE) + codes[:, i - 1]
    shorter = prefix * power[:size][::-1] + (whole - upto)
    yield np.repeat(np.arange(n), size), shorter.ravel(), -1
    for lo in range(0, size, step):
        part = slice(lo, min(size, lo + step))
        place = power[:size][::-1][part]
        rest = whole - terms[:, part]
        for x in alphabet:
            row, at = np.nonzero(codes[:, part] < x)
            if len(row):
                yield row, rest[row, at] + x * place[at], 0


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def block_of(h: np.ndarray, first: int | np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    """The block of each hash among the ``blocks`` of its shard, which begin at ``first``."""
    top = (h >> np.uint64(32)) * np.asarray(blocks, np.uint64)
    return (top >> np.uint64(32)).astype(np.int64) + first


def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
    return np.uint64(1) << ((h >> np.uint64(6 * lane)) & np.uint64(63))


def filter_rows(words: DataFrame, shards: dict[int, tuple[int, int]]) -> DataFrame:
    """``(block, b0, b1, b2, b3)``: the bits of all words, or-ed a block where the rows are and then by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = np.array([shards.get(i, (0, 1))[0] for i in range(LONGEST_SHARD + 1)])
        blocks = np.array([shards.get(i, (0, 1))[1] for i in range(LONGEST_SHARD + 1)])
        for pdf in batches:
            h, at = mixed(pdf["h"].to_numpy().view(np.uint64)), np.minimum(pdf["length"].to_numpy(), LONGEST_SHARD)
            out = {"block": block_of(h, first[at], blocks[at])}
            yield pd.DataFrame(out | {f"b{k}": lane_bit(h, k).view(np.int64) for k in range(LANES)})

    schema = "block long, " + ", ".join(f"b{k} long" for k in range(LANES))
    return words.select("h", "length").mapInPandas(run, schema).groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(LANES)))


def probe(words: DataFrame, shards: dict[int, tuple[int, int]], low: int, bits: np.ndarray, alphabet: np.ndarray) -> DataFrame:
    """``(word, n, h)``: edits of words, by hash, that the filter blocks from ``low`` on may hold."""
    shared = words.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            coded, n = [w.encode("latin-1") for w in pdf["word"]], pdf["n"].to_numpy()
            for part in by_length(coded):
                codes, rows, found = letters([coded[i] for i in part]), [], []
                for row, h, change in edits(codes, alphabet):
                    shard = shards.get(min(codes.shape[1] + change, LONGEST_SHARD))
                    if shard is None:
                        continue
                    mix = mixed(h)
                    block = block_of(mix, *shard) - low
                    keep = np.flatnonzero((block >= 0) & (block < len(table)))
                    for lane in range(LANES):
                        bit = lane_bit(mix[keep], lane)
                        keep = keep[table[block[keep], lane] & bit != 0]
                    rows.append(row[keep])
                    found.append(h[keep])
                if rows:
                    made = pd.DataFrame({"row": np.concatenate(rows), "h": np.concatenate(found).view(np.int64)}).drop_duplicates()
                    at = part[made["row"].to_numpy()]
                    yield pd.DataFrame({"word": pdf["word"].to_numpy()[at], "n": n[at], "h": made["h"].to_numpy()})

    return words.select("word", "n").mapInPandas(run, f"{_WORD}, h long")


def near_words(words: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """``(word, n, near, near_n)``: pairs of words ``(word, n, h, length)`` one edit apart, each from both sides.

    The filter is sharded by the length of words and blocked. It is sent to all tasks, at most ``most_bytes`` at a
    time: more blocks take more passes, each over the words whose edits may fall into its blocks. What the filter lets
    through is joined with the vocabulary by hash, and the words decide, so no pair is lost and none is false.
    """
    shard = F.least("length", F.lit(LONGEST_SHARD))
    sizes = {r["shard"]: r["n"] for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    alphabet = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c != ''").collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in alphabet), np.uint64)
    shards, first = {}, 0
    for s in sorted(sizes):
        shards[s] = (first, -(-sizes[s] * BITS_PER_WORD // (64 * LANES)))
        first += shards[s][1]
    step = max(1, most_bytes // (8 * LANES))
    pairs = None
    for low in range(0, first, step):
        high = min(first, low + step)
        held = [s for s, (f, n) in shards.items() if f < high and f + n > low]
        blocks = filter_rows(words.filter(shard.isin(held)), shards).filter((F.col("block") >= low) & (F.col("block") < high)).toPandas()
        bits = np.zeros((high - low, LANES), np.uint64)
        bits[blocks["block"].to_numpy() - low] = blocks[[f"b{k}" for k in range(LANES)]].to_numpy(np.int64).view(np.uint64)
        asked = words.filter(shard.isin(held) | F.least(F.col("length") - 1, F.lit(LONGEST_SHARD)).isin(held)).repartition(tasks(words.sparkSession))
        positives = probe(asked, shards, low, bits, alphabet)
        other = words.select("h", F.col("word").alias("near"), F.col("n").alias("near_n"))
        met = positives.join(other, "h").filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
        met = materialize(met, "near-words")
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        pairs = words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back)


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: forms followed to the last, in as many rounds as the logarithm of the longest way."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError("roots did not settle")


def spelling_variants(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word that occurs ``least_n`` times in ``docs``.

    Near words are one inserted, deleted or replaced letter apart. A word's form is its near word of largest n, the
    smallest in code-point order among equal ones, if that n is ``ratio`` times the word's or more; its root is where
    forms lead. Null and empty texts have no words; repeated rows count each; rows of one id and different texts count
    each; other columns are not read; an empty table gives no rows. A long run of letters is one word, its edits are made
    in parts.
    """
    words = materialize(hashed(word_counts(docs, one_in, least_length).filter(F.col("n") >= least_n)), "vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    judged = words.select("word", "n").join(best, "word", "left")
    takes = F.col("near_n") >= ratio * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n"))
    judged = materialize(judged, "forms")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
