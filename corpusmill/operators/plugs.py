"""Places where a model can be plugged in: texts to vectors, and pairs of question and passage to scores.

Both take a factory. It is called once a task, in the worker, so a model is loaded there and never sent; what it returns is
called with pieces of the batches that Arrow brings.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from corpusmill.operators import retrieval

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def hashed_bag(size: int = 768, most_words: int = 100) -> Callable[[], Embedder]:
    """An embedder without a model: the first words hashed to places, weighted by one over their position, of length one."""

    def make() -> Embedder:
        place: dict[str, int] = {}

        def embed(texts: Sequence[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * size
                for p, w in enumerate(t.lower().split()[:most_words]):
                    if w not in place:
                        place[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size
                    v[place[w]] += 1.0 / (p + 1)
                n = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / n for x in v])
            return out

        return embed

    return make


#: Texts that an embedder gets at once; its vectors are packed before the next.
TEXTS_AT_ONCE = 256


def embedding(text: Column | str, make: Callable[[], Embedder] = hashed_bag()) -> Column:
    """A vector of each text; a null text has none."""

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = make()
        for texts in batches:
            known = texts.drop_null()
            found = [np.zeros(0, np.float32)]
            for i in range(0, len(known), TEXTS_AT_ONCE):
                found += (np.asarray(v, np.float32) for v in embed(known.slice(i, TEXTS_AT_ONCE).to_pylist()))
            lengths = np.zeros(len(texts), np.int32)
            lengths[texts.is_valid().to_numpy(zero_copy_only=False)] = list(map(len, found[1:]))
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), mask=texts.is_null())

    return run(text)


def token_overlap() -> Scorer:
    """A scorer without a model: the share of a question's different tokens that the passage holds."""
    import re

    find = re.compile(r"\w+").findall

    def score(questions: Sequence[str], passages: Sequence[str]) -> list[float]:
        out = []
        for q, p in zip(questions, passages):
            asked = set(find(q.lower()))
            out.append(len(asked & set(find(p.lower()))) / len(asked) if asked else 0.0)
        return out

    return score


def pair_score(question: Column | str, passage: Column | str, make: Callable[[], Scorer] = token_overlap) -> Column:
    """A score of each pair; null where question or passage is null or the scorer gives none."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for q, p in batches:
            known = q.notna() & p.notna()
            scores = score(q[known].tolist(), p[known].tolist()) if known.any() else []
            yield pd.Series(scores, index=q.index[known], dtype="float64").reindex(q.index)

    return run(question, passage)


def reranked(hits: DataFrame, questions: DataFrame, passages: DataFrame, qid: str, key: str, k: int, make: Callable[[], Scorer] = token_overlap) -> DataFrame:
    """``qid, key, score, rank``: the ``k`` best of ``hits (qid, key, score)`` by the scorer; where it gives nothing, the
    first stage's score stands. Only passages that were hit are read whole."""
    pairs = hits.select(qid, key, F.col("score").alias("_first")).join(questions.select(qid, "query"), qid).join(passages.select(key, "passage"), key)
    scored = pairs.withColumn("score", F.round(F.coalesce(pair_score("query", "passage", make), "_first"), 6))
    return retrieval.top(scored.select(qid, key, "score"), qid, key, "score", k)
