"""Filters, joins, aggregates, windows, paging and set operations as functions from DataFrames to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters and paging -------------------------------------------------------------------------------------------
def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each named column whose wanted value is neither None nor ``'all'``."""
    return reduce(lambda d, kv: d if kv[1] in (None, "all") else d.filter(F.col(kv[0]) == kv[1]), wanted.items(), df)


def any_ilike(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows in which some column holds the term, whatever its case."""
    if not term:
        return df
    pattern = f"%{term.lower()}%"
    return df.filter(reduce(Column.__or__, (F.lower(c).like(pattern) for c in columns)))


def paged(df: DataFrame, sort: str, allowed: tuple[str, ...], default: str, key: str, limit: int, offset: int = 0, descending: bool = True) -> DataFrame:
    """One page in a whitelisted order, with the total count and whether more rows follow."""
    column = F.col(sort if sort in allowed else default)
    limit, offset = max(1, min(limit, 100)), max(0, offset)
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(column.desc() if descending else column.asc(), key).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def since(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows no older than the interval before the newest row; the anchor is in the data, never the clock."""
    anchor = df.agg((F.max(ts) - F.expr(f"INTERVAL {interval}")).alias("anchor"))
    return df.join(F.broadcast(anchor), F.col(ts) >= F.col("anchor")).drop("anchor")


def ellipsis(column: str, length: int) -> Column:
    return F.when(F.length(column) <= length, F.col(column)).otherwise(F.concat(F.substring(column, 1, length), F.lit("...")))


# --- joins --------------------------------------------------------------------------------------------------------
def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with their number of children: children are counted before the join."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """``keys, change``: ADDED and REMOVED keys, MODIFIED where a compared column differs; nulls do not differ."""
    added = new.join(old, keys, "left_anti").select(*keys, F.lit("ADDED").alias("change"))
    removed = old.join(new, keys, "left_anti").select(*keys, F.lit("REMOVED").alias("change"))
    o = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in compared))
    differs = reduce(Column.__or__, (F.col(c) != F.col(f"old_{c}") for c in compared))
    modified = new.join(o, keys).filter(differs).select(*keys, F.lit("MODIFIED").alias("change"))
    return added.unionByName(removed).unionByName(modified)


def merge_candidates(left: DataFrame, right: DataFrame, keys: list[str], left_score: str, right_score: str) -> DataFrame:
    """Union of two candidate lists by key; a missing score is zero."""
    both = left.select(*keys, left_score).join(right.select(*keys, right_score), keys, "full_outer")
    return both.select(*keys, F.coalesce(left_score, F.lit(0.0)).alias(left_score), F.coalesce(right_score, F.lit(0.0)).alias(right_score))


# --- writes as DataFrames -----------------------------------------------------------------------------------------
def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The target after the batch: of rows of a key the one with the greatest ``order`` stays, the batch's on a tie."""
    both = target.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_batch"), F.desc(order))
    return both.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth", "_batch")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those rows of the batch whose key it lacks."""
    return target.unionByName(batch.dropDuplicates(keys).join(target, keys, "left_anti").select(*target.columns))


def replace_by(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in the batch are deleted, then the batch is added."""
    return target.join(batch.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(batch)


# --- windows ------------------------------------------------------------------------------------------------------
def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1, "_nth").drop("_nth")


def min_max(df: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """The score scaled to [0, 1] in its group; a group of equal scores gets 0.5."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, F.when(high == low, F.lit(0.5)).otherwise((F.col(score) - low) / (high - low)))


def prefix_in_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs, none negative, add up to the budget or less."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).filter(F.col("used") <= budget)


def trailing(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return top_k(df, by, order, n, "_nth").drop("_nth")


# --- aggregates ---------------------------------------------------------------------------------------------------
def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Join condition of equal keys, nulls included."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_{c}"]) for c in by))


def at_positions(df: DataFrame, by: list[str], value: str, wanted: dict[str, Column], slices: int = 4096) -> DataFrame:
    """For each group the values at given positions, from 0, of its sorted values without nulls: one column a name.

    ``wanted`` are expressions over ``_n``, the group's size. Each group's range of values is cut into slices; counts of
    slices tell which ones hold a wanted position, and only their rows are ranked. So no group is sorted in one task, or
    gathered in one value, unless most of its values lie in one slice.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    bounds = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    named = bounds.select(*(F.col(c).alias(f"_{c}") for c in by), "_low", "_high", "_n")
    cut = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * slices)).otherwise(F.lit(0)).alias("_slice")
    sliced = rows.join(named, _same(rows, named, by)).select(*by, "_v", "_n", cut)
    counts = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    base = F.sum("_k").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("long").alias("at")) for n, c in wanted.items())))
    holding = counts.withColumn("_base", base).withColumn("_w", asked).filter((F.col("_w.at") >= F.col("_base")) & (F.col("_w.at") < F.col("_base") + F.col("_k")))
    holding = holding.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_slice").alias("_s"), F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_base")).alias("_at"))
    places = holding.groupBy(*(f"_{c}" for c in by), "_s").agg(F.collect_list(F.struct("_name", "_at")).alias("_places"))
    met = sliced.join(places, _same(sliced, places, by) & (sliced["_slice"] == places["_s"])).select(*by, "_slice", "_v", "_places")
    nth = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_v")) - 1
    hit = met.withColumn("_nth", nth).withColumn("_p", F.explode("_places")).filter(F.col("_p._at") == F.col("_nth"))
    return hit.groupBy(*by).agg(*(F.max(F.when(F.col("_p._name") == n, F.col("_v"))).alias(n) for n in wanted))


def nearest_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], before: dict[str, int] | None = None) -> DataFrame:
    """``sorted[floor(p * n)]`` by position from 0, less ``before`` positions, at least the first."""
    before = before or {}
    at = {name: F.greatest(F.least(F.floor(F.lit(p) * F.col("_n")) - before.get(name, 0), F.col("_n") - 1), F.lit(0)) for name, p in shares.items()}
    return at_positions(df, by, value, at)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles, between two values in proportion. Groups without values give no row."""
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    at = {f"{name}{side}": f(place(p)) for name, p in shares.items() for side, f in (("_lower", F.floor), ("_upper", F.ceil))}
    found = at_positions(df, by, value, at)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("_n"))
    rows = found.join(sizes, _same(found, sizes, by))
    between = lambda name, p: F.col(f"{name}_lower") + (place(p) - F.floor(place(p))) * (F.col(f"{name}_upper") - F.col(f"{name}_lower"))
    return rows.select(*by, *(between(name, p).alias(name) for name, p in shares.items()))


def trend(df: DataFrame, by: list[str], order: str, value: str, flat: float = 0.1) -> DataFrame:
    """Least-squares slope of the value over its index, and its label."""
    rows = df.withColumn("x", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("double"))
    out = rows.groupBy(*by).agg(F.count("*").alias("points"), F.regr_slope(value, "x").alias("slope"))
    label = (
        F.when(F.col("points") < 2, "insufficient")
        .when(F.abs("slope") < flat, "stable")
        .when(F.col("slope") > 0, "improving")
        .otherwise("declining")
    )
    return out.withColumn("trend", label)


def share_of_total(df: DataFrame, by: str, name: str = "share") -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy()))
