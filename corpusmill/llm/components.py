"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tasks

#: Nodes that a task remembers while it thins edges; beyond it the task starts anew and keeps more edges.
MOST_NODES = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's edges those that join parts not joined before; they connect what all of them connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    for pdf in batches:
        keep = []
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(u), find(v)
            keep.append(a != b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            parent.clear()
        yield pdf[keep]


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: a dense group keeps about a tree a task, not its square of pairs."""
    few = max(4, tasks(edges.sparkSession) // 8)
    return edges.coalesce(few).mapInPandas(_forest, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter("u != v")
        .distinct()
    )


def connected(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``, root the smallest node of its component.

    Each round writes the edges to the shared folder, so lineage stays short; rounds grow with the logarithm of the
    size. Joins on a node with many edges meet one row on the other side and are split by adaptive execution.
    """
    edges = materialize(edges.filter("u != v").select("u", "v"), "edges")
    edges = materialize(thinned(edges), "thin-edges")
    seen = None
    for _ in range(most_rounds):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
    raise RuntimeError("components did not settle")
