"""Mixing sources to target weights: whole copies first, then a Pareto order sample of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_back, id_key, materialize, word_count

BUCKETS = 4096


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by the key and the seed, the same on every run and in any partitioning."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def row_mark(source: str = "source") -> Column:
    """A digest of id, whole text and source; rows that agree in it are interchangeable."""
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", doc_id, F.md5(F.coalesce(F.col("text"), F.lit(""))), F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))))


def numbered(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` with ``nth``, from 0 among rows of one ``mark``; ``_row`` is a row's ``monotonically_increasing_id``.

    Repeated rows are numbered where they lie, and what earlier partitions hold is added from counts, so a row repeated
    any number of times is never in one task. Tables without repeated rows are not shuffled for it.
    """
    repeated = materialize(rows.groupBy("mark").agg(F.count("*").alias("_n")).filter("_n > 1").select("mark"), "repeated-rows")
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    part = F.shiftright("_row", 33).alias("_part")
    some = rows.join(repeated, "mark", "left_semi").select("*", part)
    before = Window.partitionBy("mark").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = some.groupBy("mark", "_part").agg(F.count("*").alias("_n")).select("mark", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = F.row_number().over(Window.partitionBy("mark", "_part").orderBy("_row")) - 1
    some = some.withColumn("_here", here).join(bases, ["mark", "_part"]).select(*rows.columns, (F.col("_base") + F.col("_here")).alias("nth"))
    return rows.join(repeated, "mark", "left_anti").withColumn("nth", F.lit(0).cast("long")).select(*some.columns).unionByName(some)


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets of sources ``(source, source_size)``: weight shares of ``share`` times all sizes, none above its cap.

    Weights repeat over sources in code-point order, null last. Resharing the excess by weight until no target is
    above its cap ends where uncapped targets are one level times their weights. With caps per weight in ascending
    order, the level is that of the first source that stays below its cap. One row a source.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("nth", order).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("most").over(by_cap), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - capped) / weight_left
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    level = F.coalesce(F.max(fits).over(everything), F.max("level").over(everything))
    return rows.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def inclusion_levels(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source ``l`` the ``level`` and the greatest importance ``fit`` that is not certain.

    A document is included with chance ``level * importance``, one at most, such that sizes times chances add up to the
    words ``wanted`` of its source. Documents above ``fit`` would exceed one and are certain. Sums go over distinct
    importances, so a source with a third of all rows is one row an importance.
    """
    groups = rows.filter((F.col("size") > 0) & (F.col("importance") > 0)).groupBy("source", "importance").agg(F.sum("size").cast("double").alias("words"))
    groups = groups.join(wanted.filter("wanted > 0").select("s", "wanted"), F.col("source").eqNullSafe(F.col("s")))
    above = Window.partitionBy("source").orderBy(F.desc("importance")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("importance").rowsBetween(Window.unboundedPreceding, 0)
    level = (F.col("wanted") - F.coalesce(F.sum("words").over(above), F.lit(0.0))) / F.sum(F.col("words") * F.col("importance")).over(upto)
    fits = groups.withColumn("level", level).filter(F.col("level") * F.col("importance") < 1)
    return fits.groupBy("source").agg(F.max(F.struct("importance", "level")).alias("at")).select(F.col("source").alias("l"), F.col("at.importance").alias("fit"), F.col("at.level").alias("level"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    cap: float = 2.0,
    seed: str = "mix",
    importance: Column | None = None,
) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, size, source, source_size, target, copies, taken, mark, nth``.

    A source's target is met by whole copies of all its documents, as many as fit, and by a fixed-size sample for the
    rest, drawn with unequal chances in proportion to ``importance``: an expression over ``size`` and the columns of
    ``docs``, by default the root of the size, so that long documents are likelier than short ones, and less than by
    their length. It is taken to two decimals; null, NaN and negative ones are zero. Documents whose chance would exceed
    one are certain and get one more whole copy. The others are ranked by random odds over inclusion odds,
    ``(u / (1 - u)) / (p / (1 - p))`` (Pareto order sampling), and taken while they fit into the words left, and then the
    one document whose size comes nearest to the last gap, if it brings the sum nearer.

    The order is cut without sorting a source: sums of 4,096 slices of the order show the slice where the words run
    out, and only that slice is sorted. So a source with a third of all rows is summed by many tasks. Numbers are
    drawn from ``mark``, a digest of id, text and source, and ``nth``, the number among rows equal in these: reruns agree,
    and rows of one id or without any, or equal rows, are drawn each on their own. Null texts and texts without words
    have size 0 and are never sampled; null sources form a source of their own. An empty table gives no rows; columns
    other than ``doc_id, text, source`` are read by ``importance`` only.
    """
    sized = docs.withColumn("size", word_count())
    weight = F.coalesce((F.sqrt("size") if importance is None else importance).cast("double"), F.lit(0.0))
    weight = F.when(F.isnan(weight) | (weight < 0), 0.0).otherwise(F.round(weight, 2))
    rows = sized.select(id_key().alias("doc_key"), row_mark().alias("mark"), "source", "size", weight.alias("importance"), F.monotonically_increasing_id().alias("_row"))
    rows = numbered(materialize(rows, "sizes")).drop("_row")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(per_source, share, weights, cap)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    wanted = wanted.withColumn("whole", F.floor(rate).cast("long")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    wanted = materialize(wanted.withColumnRenamed("source", "s"), "targets")
    levels = materialize(inclusion_levels(rows, wanted), "levels")

    drawn = rows.join(wanted, rows.source.eqNullSafe(wanted.s))
    drawn = drawn.join(levels, drawn.source.eqNullSafe(levels.l), "left").drop("l")
    may = (F.col("size") > 0) & (F.col("importance") > 0) & (F.col("wanted") > 0)
    drawn = drawn.withColumn("certain", may & (F.col("importance") > F.coalesce("fit", F.lit(0.0))))
    u = uniform(F.concat_ws(":", "mark", F.col("nth").cast("string")), seed)
    p = F.when(may & ~F.col("certain"), F.col("level") * F.col("importance"))
    pareto = (u / (1 - u)) / (p / (1 - p))
    drawn = drawn.withColumn("place", F.when(p > 0, pareto / (1 + pareto)))
    drawn = drawn.withColumn("slice", F.floor(F.col("place") * BUCKETS).cast("int"))
    sure = drawn.filter("certain").groupBy("s").agg(F.sum("size").alias("sure")).withColumnRenamed("s", "c")
    left = materialize(wanted.select("s", "wanted").join(sure, F.col("s").eqNullSafe(F.col("c")), "left").select("s", (F.col("wanted") - F.coalesce("sure", F.lit(0))).alias("rest")), "words-left")
    eligible = drawn.filter(F.col("place").isNotNull()).drop("wanted").withColumnRenamed("s", "t")
    eligible = eligible.join(left, eligible.t.eqNullSafe(left.s)).drop("t").withColumnRenamed("rest", "wanted")

    slices = eligible.groupBy("s", "slice").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    upto = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("words").over(upto))
    cut = slices.groupBy("s").agg(
        F.min(F.when(F.col("upto") > F.col("wanted"), F.col("slice"))).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto"))), F.lit(0)).alias("base"),
    )
    cut = materialize(cut.withColumnRenamed("s", "c"), "cuts")
    placed = eligible.join(cut, eligible.s.eqNullSafe(cut.c)).drop("c")
    running = Window.partitionBy("s").orderBy("place", "mark", "nth").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(F.col("slice") == F.col("cut")).withColumn("upto", F.col("base") + F.sum("size").over(running))
    # words taken from the cut slice before its first document that does not fit, and where that document stands
    last = edge.groupBy("s").agg(
        F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto"))).alias("reached"),
        F.min(F.when(F.col("upto") > F.col("wanted"), F.struct("place", "mark", "nth"))).alias("stop"),
    )
    last = materialize(last.withColumnRenamed("s", "l"), "edges")
    at = F.struct("place", "mark", "nth")
    joined = placed.join(last, placed.s.eqNullSafe(last.l)).drop("l")
    gap = F.col("wanted") - F.coalesce(F.col("reached"), F.col("base"))
    rest = joined.filter(at >= F.col("stop")).withColumn("gap", gap)
    nearest = rest.groupBy("s").agg(
        F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "place", "mark", "nth")).alias("best"), F.first("gap").alias("gap")
    )
    filler = materialize(nearest.filter("best.miss < gap").select(F.col("s").alias("f"), "best"), "fillers")

    chosen = (
        drawn.join(last, drawn.s.eqNullSafe(last.l), "left")
        .join(filler, drawn.s.eqNullSafe(filler.f), "left")
        .withColumn(
            "sampled",
            F.col("certain")
            | (F.col("place").isNotNull() & (F.col("stop").isNull() | (at < F.col("stop")) | F.coalesce(at == F.struct("best.place", "best.mark", "best.nth"), F.lit(False)))),
        )
        .withColumn("copies", F.col("whole") + F.coalesce(F.col("sampled"), F.lit(False)).cast("long"))
    )
    return chosen.select(
        id_back("doc_key").alias("doc_id"), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark", "nth"
    )
