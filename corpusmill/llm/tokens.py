"""Token counts by section: whole documents are encoded once, tokens are mapped to sections by character spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, text_batches
from .common import documents

RULES = ("start", "majority", "fraction")

SCHEMA = (
    "doc_id long, section_no int, start_char long, end_char long, n_tokens double, n_whole long, n_crossing long, doc_tokens long"
)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of token spans with gapless ascending sections; shares, whole tokens and crossing tokens a section.

    ``start``: a token belongs to the section that holds its first character. ``majority``: to the section that holds
    most of its characters, the earlier one on a tie. ``fraction``: to each section in proportion to its characters.
    """
    n = len(sections)
    begin, end = spans[:, 0], spans[:, 1]
    first = np.clip(np.searchsorted(sections[:, 0], begin, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(sections[:, 0], np.maximum(end - 1, begin), "right") - 1, 0, n - 1)
    crossing = last > first
    whole = np.bincount(first[~crossing], minlength=n)
    touched = np.zeros(n, np.int64)
    shares = whole.astype(float)
    for b, e, lo, hi in zip(begin[crossing], end[crossing], first[crossing], last[crossing]):
        touched[lo : hi + 1] += 1
        overlap = np.minimum(sections[lo : hi + 1, 1], e) - np.maximum(sections[lo : hi + 1, 0], b)
        if rule == "start":
            shares[lo] += 1
        elif rule == "majority":
            shares[lo + int(np.argmax(overlap))] += 1
        else:
            shares[lo : hi + 1] += overlap / (e - b)
    return shares, whole, touched


def line_sections(text: str) -> np.ndarray:
    """``[start, end)`` of each line with the line feed that ends it; an empty text is one empty section."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.array([cuts[:-1], cuts[1:]], dtype=np.int64).T


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """One row for each line of each document: its characters and the tokens allotted to it.

    Every document is encoded whole and once, so counts of a document's sections add up to ``doc_tokens``, which
    encoding each section alone would not give. A token covers the characters from its start to the next token's
    start; pieces of one character split over tokens share its start, and all but the last of them cover it.
    Null and empty texts give one section without tokens. Rows with equal or null ids are kept apart, as rows.
    No shuffle: one pass over the input.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder(tokenizer, byte_level=True, starts=True)
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for lo, hi in text_batches(texts):
                parts = []
                for doc_id, text, at in zip(ids[lo:hi], texts[lo:hi], encoder.token_starts(texts[lo:hi])):
                    sections = line_sections(text)
                    ends = np.append(at[1:], len(text))
                    spans = np.stack([at, np.maximum(ends, np.minimum(at + 1, len(text)))], axis=1)
                    shares, whole, touched = attribute(spans, sections, rule)
                    n = len(sections)
                    parts.append(
                        pd.DataFrame(
                            {
                                "doc_id": pd.array([doc_id] * n, dtype="Int64"),
                                "section_no": np.arange(n, dtype=np.int32),
                                "start_char": sections[:, 0],
                                "end_char": sections[:, 1],
                                "n_tokens": shares,
                                "n_whole": whole,
                                "n_crossing": touched,
                                "doc_tokens": len(at),
                            }
                        )
                    )
                yield pd.concat(parts, ignore_index=True)

    return documents(docs).mapInPandas(run, SCHEMA)


def source_tokens(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Tokens and lines by source, from the section rows; sources are few, rows are summed before they move."""
    per_doc = sections.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_sections"))
    return per_doc.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_sections").alias("n_sections")
    )
