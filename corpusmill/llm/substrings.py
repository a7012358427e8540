"""Substring dedup: words of windows that also start in an earlier document, found by FM-indexes of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, id_key, materialize, tasks
from .fmindex import FMIndex

WINDOW = 13
#: Words of the grams by which windows are routed to shards.
GRAM = 3
#: A segment holds at most so many windows.
MOST_WINDOWS = 64
#: Segments a shard's index holds, about.
SHARD_SEGMENTS = 40_000
#: Routes of more different segments are not indexed; their windows are compared one by one.
ROUTE_SEGMENTS = 4_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240229).integers(1, 2**64, size=256, dtype=np.uint64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of several texts at once: byte offsets, the text of each, and 64-bit hashes."""

    def __init__(self, texts: list[str], table: bytes | None = None):
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        if table is not None:
            data = [d.translate(table) for d in data]
        self.data = b"\n".join(data)
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.concatenate([[0], (~_SPACE[raw]).view(np.int8), [0]]))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.cumsum([0] + [len(d) + 1 for d in data])
        #: first word of each text, and one past the last text's words
        self.first = np.searchsorted(self.begin, offsets)
        self.text_no = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.offsets = offsets
        n = len(raw)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[raw] * _powers(_BASE, n), dtype=np.uint64)])
        self.hash = _mix((total[self.end] - total[self.begin]) * _powers(_INVERSE, n + 1)[self.begin] + (self.end - self.begin).astype(np.uint64))


def segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text routed alike: ``(route, first window, windows)`` by word position in the batch.

    A window is routed by the least of its grams, in the order of their length, longest first, and hash. The length
    is that of the words without what separates them, so equal windows have equal routes wherever they stand and
    however they are spaced. Long grams are rare, so most routes have few different windows.
    """
    n = len(w.hash)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = n - GRAM + 1
    gram = np.zeros(g, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(_BASE) + w.hash[k : g + k]
    size = w.end - w.begin
    length = np.minimum(sum(size[k : g + k] for k in range(GRAM)), 63).astype(np.uint64)
    least = ((np.uint64(63) - length) << np.uint64(58)) | (_mix(gram) >> np.uint64(6))
    span, have = WINDOW - GRAM + 1, 1
    while have < span:
        shift = min(have, span - have)
        least = np.minimum(least[:-shift], least[shift:])
        have += shift
    inside = w.text_no[: n - WINDOW + 1] == w.text_no[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    route = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (route[1:] != route[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.cumsum(new) - 1
    place = np.arange(len(at)) - np.flatnonzero(new)[run] if len(at) else at
    starts = np.flatnonzero(new | (place % MOST_WINDOWS == 0))
    return route[starts], at[starts], np.diff(np.append(starts, len(at)))


def _batches(pdf: pd.DataFrame, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Rows in slices of about so many characters; a slice has one text at least."""
    size = pdf["text"].str.len().to_numpy().cumsum()
    group = size // characters
    for _, part in pdf.groupby(group, sort=False):
        yield part


def _find_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments as ``(meet, row_key, place)``; rows of one ``meet`` meet in one task.

    A route that several texts of a batch hold is known to be shared: its places are negated, one of them is sent
    where all rows of the route meet, and the others anywhere. So a route that a third of all texts hold puts one row
    a batch in one place, not one a text.
    """
    for pdf in batches:
        for part in _batches(pdf):
            w = Words(part["text"].tolist())
            route, at, n = segments(w)
            if not len(at):
                continue
            text = w.text_no[at]
            row_key = part["row_key"].to_numpy()[text]
            order = np.argsort(route, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], route[order][1:] != route[order][:-1]]))
            sizes = np.diff(np.append(starts, len(order)))
            several = text[order][starts] < text[order][starts + sizes - 1]
            known, sent = np.zeros(len(at), bool), np.zeros(len(at), bool)
            known[order] = np.repeat(several, sizes)
            sent[order[starts]] = True
            place = (at - w.first[text]) << 8 | n
            anywhere = _mix(route + _mix(row_key.view(np.uint64) + at.astype(np.uint64)))
            meet = np.where(sent | ~known, route, anywhere).view(np.int64)
            yield pd.DataFrame({"meet": meet, "row_key": row_key, "place": np.where(known, ~place, place)})


def _keep_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of routes that more than one row holds, from rows sorted by ``meet``."""

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        meet, row_key, place = (pdf[c].to_numpy() for c in ("meet", "row_key", "place"))
        starts = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1]]))
        several = np.minimum.reduceat(row_key, starts) < np.maximum.reduceat(row_key, starts)
        several |= np.minimum.reduceat(place, starts) < 0
        keep = np.repeat(several, np.diff(np.append(starts, len(meet))))
        return pd.DataFrame({"row_key": row_key[keep], "place": np.where(place < 0, ~place, place)[keep]})

    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if rest and pdf["meet"].iloc[-1] == rest[0]["meet"].iloc[0]:
            rest.append(pdf)
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True)
        open_group = (pdf["meet"] == pdf["meet"].iloc[-1]).to_numpy()
        rest = [pdf[open_group]]
        if not open_group.all():
            yield shared(pdf[~open_group])
    if rest:
        yield shared(pd.concat(rest, ignore_index=True))


def _cut_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of marked segments, 32 bits each; in a batch a text that occurs again is not repeated."""
    for pdf in batches:
        for part in _batches(pdf):
            w = Words(part["text"].tolist())
            marks = part["marks"].tolist()
            count = np.fromiter(map(len, marks), np.int64, len(marks))
            marked = np.repeat(np.arange(len(marks)), count) << 44 | np.concatenate(marks).astype(np.int64)
            route, at, n = segments(w)
            text = w.text_no[at]
            start = at - w.first[text]
            here = np.isin(text << 44 | start << 8 | n, marked)
            route, at, n, text, start = route[here], at[here], n[here], text[here], start[here]
            powers = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * _powers(_BASE, len(w.hash)), dtype=np.uint64)])
            words = n + WINDOW - 1
            content = _mix((powers[at + words] - powers[at]) * _powers(_INVERSE, len(w.hash) + 1)[at] + words.astype(np.uint64))
            _, once = np.unique(content, return_index=True)
            small = w.hash.astype(np.uint32)
            blobs: list[bytes | None] = [None] * len(at)
            for i in once:
                blobs[i] = small[at[i] : at[i] + words[i]].tobytes()
            rows = part.iloc[text]
            yield pd.DataFrame(
                {"route": route.view(np.int64), "row_key": rows["row_key"].to_numpy(), "doc_key": rows["doc_key"].to_numpy(), "start": start, "content": content.view(np.int64), "words": blobs}
            )


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each different segment of a shard the least document of each of its windows.

    Matching statistics of the segments against the shard's index tell where a match reaches the threshold of
    ``WINDOW`` words; the interval of the suffix order there holds all places of that window.
    """
    parts = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    index = FMIndex(np.concatenate(parts), lengths)
    windows = lengths - WINDOW + 1
    segment = np.repeat(np.arange(len(parts)), windows)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = index.starts[segment] + nth + WINDOW
    first = pdf["first"].to_numpy()
    owner = np.repeat(np.arange(len(parts)), lengths + 1)  # segment of each text position
    by_order = first[owner[index.order]]
    least = first[segment]
    matched, lo, hi = index.matching_statistics(ends, WINDOW)
    which = np.flatnonzero(matched == WINDOW)
    lo, hi = lo[which], hi[which]
    if len(which):
        intervals, back = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
        low = np.minimum.reduceat(np.append(by_order, by_order[-1]), intervals.ravel())[::2]
        least[which] = low[back.ravel()]
    cuts = np.cumsum(windows)
    return pd.DataFrame({"content": pdf["content"], "least": [x.tobytes() for x in np.split(least, cuts[:-1])]})


def _cut_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of different segments as ``(content, first, nth, window)``, the window by a 64-bit hash of its words."""
    for pdf in batches:
        if not len(pdf):
            continue
        parts = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = np.concatenate(parts).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(symbols) * _powers(_BASE, len(symbols)), dtype=np.uint64)])
        windows = lengths - WINDOW + 1
        segment = np.repeat(np.arange(len(parts)), windows)
        nth = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (np.cumsum(lengths) - lengths)[segment] + nth
        window = _mix((total[at + WINDOW] - total[at]) * _powers(_INVERSE, len(symbols) + 1)[at])
        yield pd.DataFrame({"content": pdf["content"].to_numpy()[segment], "first": pdf["first"].to_numpy()[segment], "nth": nth, "window": window.view(np.int64)})


def window_least(different: DataFrame) -> DataFrame:
    """What ``_search`` finds, without an index: the least document of each window by a sum over equal windows.

    Least documents are found in tasks before they move. A window of many segments meets one row when it is joined
    back, which adaptive execution splits. Of a segment at most ``MOST_WINDOWS`` rows are collected.
    """
    windows = different.mapInPandas(_cut_windows, "content long, first long, nth long, window long")
    sums = windows.groupBy("window").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    shared = materialize(sums.filter("n > 1").select("window", "least"), "shared-windows")
    each = windows.join(shared, "window", "left").select("content", F.struct("nth", F.coalesce("least", "first").alias("least")).alias("w"))
    listed = each.groupBy("content").agg(F.sort_array(F.collect_list("w")).alias("w")).select("content", F.col("w.least").alias("least"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"content": pdf["content"], "least": [np.asarray(x, np.int64).tobytes() for x in pdf["least"]]})

    return listed.mapInPandas(pack, "content long, least binary")


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word intervals of windows that start in an earlier document."""
    for pdf in batches:
        least = [np.frombuffer(x, np.int64) for x in pdf["least"]]
        count = np.fromiter(map(len, least), np.int64, len(least))
        row = np.repeat(np.arange(len(least)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = (np.concatenate(least) if least else np.zeros(0, np.int64)) < pdf["doc_key"].to_numpy()[row]
        row, at = row[hit], (pdf["start"].to_numpy()[row] + nth)[hit]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1
        yield pd.DataFrame({"row_key": pdf["row_key"].to_numpy()[row[begin]], "span": at[begin] << 32 | (at[end[: len(begin)]] + WINDOW)})


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, spans, copy in zip(pdf["text"], pdf["spans"], pdf["copy"]):
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            if copy and len(words) >= WINDOW:  # every window of a copy starts in the first one
                out.append((len(words), len(words), hashlib.sha256(b"").hexdigest(), ""))
                continue
            if copy or spans is None or not len(spans):
                out.append((len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text))
                continue
            spans = np.asarray(spans, np.int64)
            delta = np.zeros(len(words) + 1, np.int64)
            np.add.at(delta, spans >> 32, 1)
            np.add.at(delta, spans & 0xFFFFFFFF, -1)
            gone = np.cumsum(delta)[:-1] > 0
            kept = [x for x, g in zip(words, gone) if not g]
            w = Words([text])
            # white space after a removed word goes with it
            upto = np.append(w.begin[1:], len(data))
            rest = b"".join(data[b:e] for b, e in zip(w.begin[~gone], upto[~gone]))
            out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), rest.decode("utf-8", "surrogatepass")))
        made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"], index=pdf.index)
        yield pd.concat([pdf.drop(columns=["text", "spans", "copy"]), made], axis=1)


def repeated_spans(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(row_key, spans)`` for rows ``(row_key, doc_key, text)``: word intervals to remove, start and end in one long.

    ``row_key`` tells texts apart, ``firsts`` has the least document of each: only that one's segments are cut.

    1. Each text gives its segments' routes and places, no words, in one shuffle. Routes of one row only are dropped.
    2. Rows that are left are read again and give the words of their segments; equal segments are merged with their
       least document before they move, so a passage in a third of all documents is one row a task.
    3. Shards of different segments are indexed; a segment that occurs in many documents is there once. Where windows
       reach from a common passage into each document's own words, a route has a different segment a document: routes of
       more than ``ROUTE_SEGMENTS`` are not indexed, their windows are grouped one by one. So an index is bounded.
    4. The least document of each window goes back to the places where its segment stands.
    """
    spark = rows.sparkSession
    found = rows.select("row_key", "text").mapInPandas(_find_segments, "meet long, row_key long, place long")
    meeting = found.repartition(tasks(spark), "meet").sortWithinPartitions("meet")
    marks = meeting.mapInPandas(_keep_shared, "row_key long, place long").groupBy("row_key").agg(F.collect_list("place").alias("marks"))
    marked = rows.join(marks.join(firsts, "row_key"), "row_key").filter("doc_key = first_doc").drop("first_doc")
    cut = marked.mapInPandas(_cut_segments, "route long, row_key long, doc_key long, start long, content long, words binary")
    cut = materialize(cut, "cut-segments")
    shards = max(1, cut.count() // SHARD_SEGMENTS)
    different = cut.groupBy("route", "content").agg(F.min("doc_key").alias("first"), F.max("words").alias("words"))
    different = materialize(different, "different-segments")
    hot = materialize(different.groupBy("route").count().filter(F.col("count") > ROUTE_SEGMENTS).select("route"), "hot-routes")
    any_hot = not hot.isEmpty()  # at most one route in ROUTE_SEGMENTS segments, so they are broadcast
    few = different.join(F.broadcast(hot), "route", "left_anti") if any_hot else different
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    least = few.select(shard, "content", "first", "words").groupBy("shard").applyInPandas(_search, "content long, least binary")
    if any_hot:
        least = least.unionByName(window_least(different.join(F.broadcast(hot), "route", "left_semi")))
    covered = cut.select("row_key", "doc_key", "start", "content").join(least, "content").mapInPandas(_cover, "row_key long, span long")
    return covered.groupBy("row_key").agg(F.collect_list("span").alias("spans"))


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_sha256`` added and ``kept_text``, the text without removed words.

    A word goes if a window of 13 words covers it whose words also start in a document with a smaller id. Windows are
    judged on the input. Texts of fewer words, null and empty ones lose nothing. A null id counts as the smallest;
    rows with equal ids are not earlier than each other. Of equal texts the least document's is searched, the others go whole.
    Words are told apart by hash: windows agree in 64 bits of their longest three-word gram and 32 bits of each word.
    """
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs, back = hidden(docs.drop(*added), "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("was", F.col("text")).withColumn("text", text).withColumn("doc_key", id_key())
    keyed = keyed.withColumn("row_key", F.xxhash64("text")).withColumn("row_check", F.xxhash64(F.lit(1), "text"))
    firsts = materialize(keyed.groupBy("row_key", "row_check").agg(F.min("doc_key").alias("first_doc")), "first-copies")
    # different texts of one 64-bit hash, about n * n / 2 ** 65 of n texts, go by their other hash
    clash = [r["row_key"] for r in firsts.groupBy("row_key").count().filter("count > 1").collect()]
    key = F.when(F.col("row_key").isin(clash), F.col("row_check")).otherwise(F.col("row_key")) if clash else F.col("row_key")
    keyed, firsts = keyed.withColumn("row_key", key).drop("row_check"), firsts.select(key.alias("row_key"), "first_doc")
    spans = repeated_spans(keyed.select("row_key", "doc_key", "text"), firsts)
    found = firsts.join(spans, "row_key", "left")
    joined = keyed.join(found, "row_key").withColumn("copy", F.col("doc_key") > F.col("first_doc")).drop("row_key", "doc_key", "first_doc")
    kept = joined.drop("text", "spans", "copy")
    schema = kept.schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    return joined.mapInPandas(_strip, schema).withColumnRenamed("was", "text").select(*back, *added)
