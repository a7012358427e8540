"""Nearest neighbours by cosine: a vantage-point tree per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAF = 64


class VPTree:
    """Balanced tree over unit vectors, in arrays: nodes in heap order, points in leaf order.

    A node holds a vantage point, and the largest distance to it among its inner half and the least among its outer.
    Halves are cut by rank, so equal vectors split evenly and depth grows with the logarithm of the size.
    """

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        self.order = np.arange(n)
        self.cuts = [np.array([0, n])]
        self.vantage, self.inner, self.outer = [], [], []
        for _ in range(self.depth):
            cuts = self.cuts[-1]
            points, inner, outer, new = np.zeros((len(cuts) - 1, unit.shape[1])), [], [], [0]
            for i in range(len(cuts) - 1):
                lo, hi = cuts[i], cuts[i + 1]
                part = self.order[lo:hi]
                middle = (hi - lo) // 2
                if hi - lo > 1:
                    # the point farthest from the mean sees the others at spread-out distances
                    vantage = unit[part[np.argmin(unit[part] @ unit[part].mean(axis=0))]]
                    distance = np.sqrt(np.maximum(0, 2 - 2 * (unit[part] @ vantage)))
                    by = np.argpartition(distance, middle)
                    self.order[lo:hi] = part[by]
                    points[i] = vantage
                    inner.append(distance[by[:middle]].max())
                    outer.append(distance[by[middle:]].min())
                else:
                    inner.append(np.inf)
                    outer.append(0.0)
                new += [lo + middle, hi]
            self.vantage.append(points)
            self.inner.append(np.array(inner))
            self.outer.append(np.array(outer))
            self.cuts.append(np.array(new))

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{name}{i}": a for name in ("cuts", "vantage", "inner", "outer") for i, a in enumerate(getattr(self, name))}
        np.savez(out, order=self.order, depth=self.depth, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> VPTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            self.order, self.depth = z["order"], int(z["depth"])
            self.cuts = [z[f"cuts{i}"] for i in range(self.depth + 1)]
            self.vantage, self.inner, self.outer = ([z[f"{k}{i}"] for i in range(self.depth)] for k in ("vantage", "inner", "outer"))
        return self

    def search(self, unit: np.ndarray, queries: np.ndarray, k: int, factor: float, leaf) -> None:
        """Visit leaves for blocks of queries; ``leaf(queries, points)`` scores them and returns their k-th distances.

        A half is skipped if every point of it must lie at least ``factor`` times a query's k-th distance away by the
        triangle inequality. At factor 1 nothing nearer is skipped: exact. Below 1 more is skipped.
        """
        self._kth = np.full(len(queries), np.inf)
        self._factor, self._leaf, self._queries = factor, leaf, queries
        self._visit(0, 0, np.arange(len(queries)))

    def _visit(self, level: int, node: int, which: np.ndarray) -> None:
        if not len(which):
            return
        if level == self.depth:
            lo, hi = self.cuts[level][node], self.cuts[level][node + 1]
            if hi > lo:
                self._kth[which] = self._leaf(which, self.order[lo:hi])
            return
        q = self._queries[which]
        distance = np.sqrt(np.maximum(0, 2 - 2 * (q @ self.vantage[level][node])))
        inner, outer = self.inner[level][node], self.outer[level][node]
        inside = distance < (inner + outer) / 2
        slack = 1e-9
        for first, mine in ((0, inside), (1, ~inside)):
            at = which[mine]
            self._visit(level + 1, 2 * node + first, at)
            # least distance that the triangle inequality leaves to the other half
            bound = (outer - distance[mine]) if first == 0 else (distance[mine] - inner)
            self._visit(level + 1, 2 * node + 1 - first, at[bound <= self._factor * self._kth[at] + slack])


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v, dim)``: vectors with only finite components, not all zero; null ids take no part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .filter(F.forall("v", lambda x: x.isNotNull()))
        .filter(finite & F.exists("v", lambda x: x != 0))
        .withColumn("dim", F.size("v"))
    )


#: Factors that are tried, from the one that prunes most to exact search.
FACTORS = (0.05, 0.1, 0.16, 0.25, 0.4, 0.65, 1.0)

#: Queries whose vectors take no more bytes in all are sent to every task of the index; more are dealt to shards in blocks.
MOST_BROADCAST = 32 << 20


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    factor: float | None = None,
    recall: float = 0.95,
    sample: int = 128,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 16384,
    block_rows: int = 16384,
) -> DataFrame:
    """``(query_id, rank, vec_id, score, factor, sample_recall)``: each query's ``k`` nearest rows other than itself by
    cosine, ties to smaller ids.

    Rows are dealt to shards of about ``shard_rows`` by a hash of their id, one tree a shard, stored once. Queries, in
    blocks of about ``block_rows``, visit every shard of their dimension, and the shards' best are merged by rank. If
    all blocks are small, measured by ``MOST_BROADCAST``, they are broadcast past the shards and no index moves; else
    each block meets each shard in a task of bounded size. ``factor`` 1 is exact; smaller factors prune more: a half is
    skipped where the triangle inequality leaves no point within ``factor`` times the k-th distance found so far.
    Without ``factor``, ``sample`` queries at most are searched on the whole index at each of ``FACTORS``, and the least is
    taken whose results hold ``recall`` of those at factor 1. How far a factor may go depends on the vectors: the same one
    that finds 0.95 in 64 dimensions may find 0.65 in 16. ``sample_recall`` is what was measured, null for a given factor.

    Rows equal in id and vector count once. Rows of one id and different vectors are queries and candidates of their
    own, but no row finds its own id. A query with fewer candidates gets all of them. Null ids, null, zero or not
    finite vectors take no part; an empty table gives no rows. Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    shards = max(1, round(rows.count() / shard_rows))
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "v"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(bytes=[_blob(x) for x in pdf["v"]]).drop_duplicates(["vec_id", "bytes"]).sort_values(["vec_id", "bytes"])
        v = np.stack(pdf["v"].to_numpy())
        scaled = v / np.abs(v).max(axis=1, keepdims=True)  # components of at most 1 keep squares finite
        tree = VPTree(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
        ids = pdf["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [_blob(ids)], "points": [_blob(v)], "tree": [tree.dump()]})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = materialize(sharded.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, points binary, tree binary"), "vp-index")

    shape = (k, shards, block_rows)
    if factor is not None:
        best = best_of(index, asked, (factor,), *shape).withColumn("sample_recall", F.lit(None).cast("double"))
        return best.select("query_id", "rank", "vec_id", "score", "factor", "sample_recall")
    tried = asked.orderBy(F.xxhash64("vec_id", "v", F.lit(5)), "vec_id").limit(sample)
    found = materialize(best_of(index, tried, FACTORS, *shape), "vp-sample")
    exact = found.filter(F.col("factor") == 1.0).select("query_id", "query_hash", "vec_id")
    hits = found.join(exact, ["query_id", "query_hash", "vec_id"]).groupBy("factor").agg(F.count("*").alias("n")).collect()
    hits = {r["factor"]: r["n"] for r in hits}
    shares = {f: hits.get(f, 0) / hits[1.0] if hits.get(1.0) else 1.0 for f in FACTORS}
    factor = min(f for f in FACTORS if shares[f] >= recall or f == 1.0)
    best = best_of(index, asked, (factor,), *shape).withColumn("sample_recall", F.lit(shares[factor]))
    return best.select("query_id", "rank", "vec_id", "score", "factor", "sample_recall")


def best_of(index: DataFrame, asked: DataFrame, factors: tuple[float, ...], k: int, shards: int, block_rows: int) -> DataFrame:
    """``(factor, query_id, query_hash, vec_id, score, rank)``: the best of all shards of ``index`` for each query and factor."""
    size = asked.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    blocks_n = max(1, round(size[0] / block_rows))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "query_ids": [_blob(pdf["vec_id"].to_numpy(np.int64))], "queries": [_blob(v)]})

    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks_n)).cast("int"))
    blocks = blocked.groupBy("dim", "block").applyInPandas(gather, "dim int, block int, query_ids binary, queries binary")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for f in factors:
                    yield search_block(r, k, f).assign(factor=f)

    if 8 * size[1] + 8 * size[0] <= MOST_BROADCAST:
        # one shard is one task's unit, however few files the index came in
        spread = index.repartition(max(1, min(shards, 4096)), "shard")
        visits = spread.join(F.broadcast(blocks), "dim")
    else:
        visits = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, ["dim", "shard"])
        visits = visits.repartition(max(1, min(shards * blocks_n, 4096)), "shard", "block")
    visits = visits.select("dim", "ids", "points", "tree", "query_ids", "queries")
    found = visits.mapInPandas(search, "query_id long, query_hash long, vec_id long, score double, factor double")
    order = Window.partitionBy("factor", "query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("factor", "query_id", "query_hash", "vec_id", "score", F.col("rank").cast("int").alias("rank"))


def search_block(r, k: int, factor: float) -> pd.DataFrame:
    ids, points = np.frombuffer(r.ids, np.int64), np.frombuffer(r.points).reshape(-1, r.dim)
    query_ids, queries = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.queries).reshape(-1, r.dim)
    tree = VPTree.load(r.tree)
    scale_p, scale_q = np.abs(points).max(axis=1, keepdims=True), np.abs(queries).max(axis=1, keepdims=True)
    # components of at most 1 keep squares finite; a common factor does not change a cosine
    points, queries = points / scale_p, queries / scale_q
    norm_p, norm_q = np.sqrt(np.einsum("ij,ij->i", points, points)), np.sqrt(np.einsum("ij,ij->i", queries, queries))
    best_score = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def leaf(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        # einsum sums each pair alike, so equal vectors get equal scores in any leaf
        scores = np.einsum("ij,kj->ik", queries[which], points[at]) / (norm_q[which, None] * norm_p[at])
        scores[query_ids[which, None] == ids[at]] = -np.inf
        better = scores.max(axis=1) >= best_score[which, -1]  # the rest keep what they have
        some, scores = which[better], scores[better]
        every = np.concatenate([best_score[some], scores], axis=1)
        every_id = np.concatenate([best_id[some], np.broadcast_to(ids[at], scores.shape)], axis=1)
        top = np.lexsort((every_id, -every), axis=1)[:, :k]
        best_score[some], best_id[some] = np.take_along_axis(every, top, 1), np.take_along_axis(every_id, top, 1)
        return np.sqrt(np.maximum(0, 2 - 2 * best_score[which, -1]))

    unit = queries / norm_q[:, None]
    tree.search(points, unit, k, factor, leaf)
    row, col = np.nonzero(best_score > -np.inf)
    digest = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in np.frombuffer(r.queries).reshape(-1, r.dim)], np.uint64).view(np.int64)
    return pd.DataFrame({"query_id": query_ids[row], "query_hash": digest[row], "vec_id": best_id[row, col], "score": best_score[row, col]})
