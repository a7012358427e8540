"""Hierarchical chunks: sections by a stack of headings, cut at sentences, typed, overlapped and linked."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import ranking as K
from corpusmill.sources.scratch import stored

#: What makes a line a heading. Fixed values.
MARKED = re.compile(r"(#+)\s+(.+)")
NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\s+(.+)")
CAPITALS = re.compile(r"[A-Z][A-Z\s]+")
COLON = re.compile(r"([A-Z][^:]+):")
#: Characters from which a line of capitals is no heading. Fixed value.
LONG_LINE = 100
#: Where one sentence ends and the next begins.
BREAK = r"(?<=[.!?])\s+"

#: Patterns of chunk types, the first that is found; the first three look at lines. Fixed values.
TYPES = [
    ("heading", r"\A(?:#+\s+|[A-Z][A-Z\s]+(?:\n|\z))"),
    ("list_item", r"(?m)^\s*(?:[-*+]|\d+\.)\s+"),
    ("code_block", r"```"),
    ("table", r"(?s)(?:\|.*){4}"),
    ("technical_spec", r"(?i)\b(?:parameter|config|setting|value|option)\s*[=:]\s*"),
    ("procedure", r"(?i)\b(?:step|procedure|method|instruction)\s*\d*[:.]\s*"),
]


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a stripped line that is a heading."""
    if m := MARKED.fullmatch(line):
        return len(m[1]), m[2].strip()
    if m := NUMBERED.fullmatch(line):
        return m[1].count(".") + 1, m[2].strip()
    if len(line) < LONG_LINE and CAPITALS.fullmatch(line):
        return 1, line
    if m := COLON.fullmatch(line):
        return 2, m[1].strip()
    return None


def last_fit(parts: list[str], gap: int, room: int) -> int:
    """End of the last part that ends within ``room``, parts standing ``gap`` characters apart; 0 if none does."""
    end, at = 0, 0
    for p in parts:
        if at + len(p) > room:
            break
        end = at + len(p)
        at = end + gap
    return end


def cut(text: str, most: int, least: int, overlap: int) -> Iterator[tuple[list[str], bool, str]]:
    """Chunks of a text in order: titles above it, whether it was cut off at a sentence, content.

    A heading closes what was gathered and takes its place on the stack: titles of its level and below go. Gathered lines
    of more than ``most`` characters are cut once, after the last sentence or else paragraph that leaves room for the
    overlap; what stands behind the cut is gathered on. Without such a place all is one chunk. Chunks shorter than ``least``
    are dropped, but for those cut off.
    """
    titles: list[str] = []
    held: list[str] = []

    def whole() -> Iterator[tuple[list[str], bool, str]]:
        content = "\n".join(held).strip()
        if held and len(content) >= least:
            yield titles, False, content

    for line in text.split("\n"):
        if found := heading(line.strip()):
            yield from whole()
            level, title = found
            titles, held = [*titles[: level - 1], title], []
        held.append(line)
        if sum(map(len, held)) > most:
            joined = "\n".join(held)
            at = last_fit(re.split(BREAK, joined), 1, most - overlap) or last_fit(joined.split("\n\n"), 2, most - overlap)
            if at:
                yield titles, True, joined[:at].strip()
                held = joined[at:].split("\n")
            else:
                yield from whole()
                held = []
    yield from whole()


def chunk_type(content: Column, cut_off: Column) -> Column:
    out = F.when(cut_off, F.lit("paragraph"))
    for name, pattern in TYPES:
        out = out.when(content.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("paragraph"))


def hierarchical_chunks(docs: DataFrame, key: str, text: str, most: int = 512, least: int = 100, overlap: int = 50, terms: str = r"([A-Z]{2,}[0-9]*|[0-9]+[.][0-9]+)") -> DataFrame:
    """``key, chunk_no, titles, chunk_type, content, n_words, n_sentences, importance, readability, refs, overlap, depends``.

    A document is cut in one pass over its lines, as headings are a stack; all else are expressions over chunks.
    ``overlap`` is the last two sentences of the chunk before, where they are short enough. ``depends`` lists the chunks
    that one needs: the one it overlaps, and those under a title that holds one of its cross references. Links are found by
    a join of a document's different references with its different titles. Null texts have no chunks; keys must be unique.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, titles, cut_off, content) for k, t in zip(pdf["key"], pdf["text"]) for i, (titles, cut_off, content) in enumerate(cut(t, most, least, overlap))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "titles", "cut_off", "content"])

    kind = dict(docs.dtypes)[key]
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.mapInPandas(run, f"key {kind}, chunk_no int, titles array<string>, cut_off boolean, content string")
    n_words, found = F.size(T.split_words("content")), F.array_distinct(F.regexp_extract_all("content", F.lit(terms), 1))
    parts = F.filter(F.split("content", BREAK), lambda s: s != "")
    tail = F.array_join(F.slice("_parts", F.greatest(F.lit(1), F.size("_parts") - 1), F.lit(2)), " ")
    rows = rows.select("key", "chunk_no", "titles", "content", "cut_off", n_words.alias("n_words"), parts.alias("_parts"), found.alias("_found"))
    rows = rows.select(
        "key", "chunk_no", "titles", "content", chunk_type(F.col("content"), F.col("cut_off")).alias("chunk_type"), "n_words",
        F.size("_parts").alias("n_sentences"), F.round(K.importance(F.col("content"), F.col("_found")), 6).alias("importance"),
        F.round(K.readability(F.col("n_words"), F.size("_parts"), F.col("_found")), 6).alias("readability"), K.cross_references(F.col("content")).alias("refs"),
        tail.alias("_tail"),
    )
    # all below reads these rows again, and cutting and matching is most of the work
    rows = stored(rows, "chunks")
    asked = rows.select("key", "chunk_no", F.explode(F.array_distinct(F.transform("refs", F.lower))).alias("ref")).filter("ref != ''")
    under = rows.select("key", F.col("chunk_no").alias("other"), F.explode(F.array_distinct("titles")).alias("title"))
    refs, named = asked.select("key", "ref").distinct(), under.select("key", "title").distinct()
    met = refs.join(named, (refs.key == named.key) & F.contains(F.lower("title"), F.col("ref"))).select(refs.key, "ref", "title")
    links = asked.join(met, ["key", "ref"]).join(under, ["key", "title"]).filter("chunk_no != other").select("key", "chunk_no", "other", F.lit(None).cast("string").alias("overlap"))
    # a chunk's tail is the overlap of the next; what stands behind the last chunk finds none
    overlaps = rows.filter(F.length("_tail").between(1, overlap)).select("key", (F.col("chunk_no") + 1).alias("chunk_no"), F.col("chunk_no").alias("other"), F.col("_tail").alias("overlap"))
    links = links.unionByName(overlaps).groupBy("key", "chunk_no").agg(F.max("overlap").alias("overlap"), F.sort_array(F.collect_set("other")).alias("depends"))
    out = rows.drop("_tail").join(links, ["key", "chunk_no"], "left").withColumn("depends", F.coalesce("depends", F.array().cast("array<int>")))
    return out.withColumnRenamed("key", key)
