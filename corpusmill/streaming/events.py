"""Event streams: counters, rates, limits, caches, averages and alerts, each with the same rows as its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a file stream; ``ts`` with a time zone, as watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run an aggregate over all input there is and return its last result, from files that each batch writes anew.

    The result goes from the executors to the shared folder; a batch that is run again overwrites its own files.
    """
    path = f"{checkpoint}/stream-{uuid.uuid4().hex}"
    batches = []

    def store(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out-{batch_id}")
        batches.append(batch_id)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(store)
    writer.trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/out-{max(batches)}") if batches else spark.createDataFrame([], stream.schema)


def appended(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream over all input there is into Parquet files and read them; for results that grow with it."""
    path = f"{checkpoint}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


# --- built-in aggregates: the same expression serves stream and batch ----------------------------------------------
def counters(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def rates(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events a second and mean value in sliding windows."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    out = events.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "n", F.round(F.col("n") / seconds, 6).alias("rate"), F.round("mean", 6).alias("mean"))


def error_alerts(events: DataFrame, window: str = "1 hour", limit: float = 0.25) -> DataFrame:
    share = F.count_if(F.col("event_type") == "error") / F.count("*")
    out = events.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), share.alias("share"))
    return out.filter(F.col("share") > limit).select(F.col("w.start").alias("start"), "n", F.round("share", 6).alias("share"))


def interpolated(counts: Column, bounds: list[float], share: float) -> Column:
    """A quantile from cumulative ``counts`` of values up to each of ``bounds``, and of all values last.

    Within the bucket where the rank falls values are taken to lie evenly, from zero in the first one; ranks beyond the
    last bound give that bound, and no values give null.
    """
    total = F.element_at(counts, -1)
    rank = total * F.lit(share)
    edges = F.array(*(F.lit(float(b)) for b in bounds))
    at = F.array_size(F.filter(counts, lambda c: c < rank))  # buckets that end below the rank
    count = lambda i: F.get(counts, i)
    low = F.when(at == 0, F.least(F.lit(0.0), F.get(edges, F.lit(0)))).otherwise(F.get(edges, at - 1))
    before = F.when(at == 0, F.lit(0)).otherwise(count(at - 1))
    inside = F.when(count(at) == before, F.get(edges, at)).otherwise(low + (F.get(edges, at) - low) * (rank - before) / (count(at) - before))
    return F.when(total == 0, F.lit(None)).when(at >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside)


def histogram_quantiles(events: DataFrame, bounds: list[float], window: str = "15 minutes", share: float = 0.95) -> DataFrame:
    """``start, n, p``: a quantile of each window from cumulative bucket counts, which add up over tasks, batches and series.

    Batch or stream: state is one number a bucket and window, not the values. Null values fall into no bucket.
    """
    counts = [F.count_if(F.col("value") <= b).alias(f"c{i}") for i, b in enumerate(bounds)]
    out = events.groupBy(F.window("ts", window).alias("w")).agg(*counts, F.count("value").alias("n"))
    p = interpolated(F.array(*(F.col(f"c{i}") for i in range(len(bounds))), "n"), bounds, share)
    return out.select(F.col("w.start").alias("start"), "n", F.round(p, 6).alias("p"))


def counter_increase(samples: DataFrame, series: str, window: str = "24 hours", slide: str = "12 hours", slice_: str = "1 hour") -> DataFrame:
    """``series, start, samples, increase`` of counters ``(series, ts, value)`` in sliding windows; ``ts`` differs within a series.

    A counter that falls was reset, and counts from zero again. A window's increase is what its samples grew by after its
    first one; it is not stretched to the window's ends. Steps are found in slices of time, and the last value of the
    slice before is carried on from one row a slice, so a series of a third of all rows is not sorted by one task.
    """
    rows = samples.select(series, "ts", "value", F.window("ts", slice_).start.alias("_slice"))
    here = Window.partitionBy(series, "_slice").orderBy("ts")
    ends = rows.groupBy(series, "_slice").agg(F.max_by("value", "ts").alias("_last"))
    carried = ends.select(series, "_slice", F.lag("_last").over(Window.partitionBy(series).orderBy("_slice")).alias("_carried"))
    rows = rows.withColumn("_prev", F.lag("value").over(here)).join(carried, [series, "_slice"])
    before = F.coalesce("_prev", "_carried")
    rows = rows.withColumn("step", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))
    out = rows.groupBy(series, F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("samples"), (F.sum("step") - F.min_by("step", "ts")).alias("increase"))
    return out.select(series, F.col("w.start").alias("start"), "samples", F.round("increase", 6).alias("increase"))


def rollups(events: DataFrame) -> DataFrame:
    out = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def per_minute_limit(events: DataFrame, limit: int) -> DataFrame:
    """Requests of each user and minute, and how many of them a fixed-minute limit accepts."""
    out = events.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", F.least("n", F.lit(limit)).alias("accepted"))


def freshness(events: DataFrame, limit_s: float) -> DataFrame:
    """Seconds since each type's last event, against the newest event of all."""
    last = events.groupBy("event_type").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    lag = (F.unix_micros("newest") - F.unix_micros("last")) / 1e6
    return last.crossJoin(F.broadcast(newest)).select("event_type", F.round(lag, 3).alias("lag"), (lag > limit_s).alias("stale"))


def _timed(events: DataFrame, *columns: str) -> DataFrame:
    """Columns and the time in seconds; a stream keeps its event time, on which state expires."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    return events.withWatermark("ts", "1 hour").select(*columns, "ts", t) if events.isStreaming else events.select(*columns, t)


# --- keyed state ---------------------------------------------------------------------------------------------------
def _forget_at(pdf: pd.DataFrame, state: GroupState) -> int:
    """A day after the key's newest row, in milliseconds of event time."""
    return int(max(pdf["t"].max() * 1000, state.getCurrentWatermarkMs())) + 86_400_000


def _limit(times: list[float], accepted: list[float], limit: int, span: float) -> list[bool]:
    """Sliding log: a request is accepted if fewer than ``limit`` accepted ones lie in the last ``span`` seconds."""
    out = []
    for t in times:
        while accepted and accepted[0] <= t - span:
            accepted.pop(0)
        out.append(len(accepted) < limit)
        if out[-1]:
            accepted.append(t)
    return out


def sliding_limit(events: DataFrame, limit: int, span: float) -> DataFrame:
    """``event_id, user_id, accepted`` by a sliding log of accepted requests; rejected ones are not counted.

    Batch or stream. State is the accepted times of one user in the span, ``limit`` at most. In a stream rows of one
    batch are taken in order of time; a user without requests for a day is forgotten.
    """
    schema = "event_id long, user_id long, accepted boolean"
    rows = _timed(events, "event_id", "user_id")

    def judge(pdf: pd.DataFrame, log: list[float]) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        return pdf[["event_id", "user_id"]].assign(accepted=_limit(pdf["t"].tolist(), log, limit, span))

    if not events.isStreaming:
        return rows.groupBy("user_id").applyInPandas(lambda pdf: judge(pdf, []), schema)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches))
        yield judge(pdf, log)
        state.update((log,))
        state.setTimeoutTimestamp(_forget_at(pdf, state))

    return rows.groupBy("user_id").applyInPandasWithState(update, schema, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ttl_cache(events: DataFrame, ttl_s: float) -> DataFrame:
    """``event_id, hit`` of a cache keyed by user and type: a miss stores, a hit does not extend, expiry is fixed."""
    schema = "event_id long, hit boolean"
    rows = _timed(events, "event_id", "user_id", "event_type")

    def look_up(pdf: pd.DataFrame, expires: float) -> tuple[pd.DataFrame, float]:
        pdf, hits = pdf.sort_values(["t", "event_id"]), []
        for t in pdf["t"]:
            hits.append(t < expires)
            expires = expires if hits[-1] else t + ttl_s
        return pdf[["event_id"]].assign(hit=hits), expires

    if not events.isStreaming:
        return rows.groupBy("user_id", "event_type").applyInPandas(lambda pdf: look_up(pdf, float("-inf"))[0], schema)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches))
        out, expires = look_up(pdf, state.get[0] if state.exists else float("-inf"))
        yield out
        state.update((expires,))
        state.setTimeoutTimestamp(_forget_at(pdf, state))

    return rows.groupBy("user_id", "event_type").applyInPandasWithState(update, schema, "expires double", "append", GroupStateTimeout.EventTimeTimeout)


def running_averages(events: DataFrame, keep: float = 0.8, terms: int = 200) -> DataFrame:
    """Counts, means and the last value of ``e = keep * e + (1 - keep) * x`` by type.

    Older terms fade below a double's precision, so the last ``terms`` rows of a type give the whole sum.
    """
    plain = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") < 20).alias("successes"))
    back = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    last = events.withColumn("back", back).filter(F.col("back") <= terms).join(plain.select("event_type", "n"), "event_type")
    weight = F.pow(F.lit(keep), F.col("back") - 1) * F.when(F.col("back") == F.col("n"), 1.0).otherwise(1 - keep)
    ema = last.groupBy("event_type").agg(F.round(F.sum(weight * F.col("value")), 6).alias("ema"))
    return plain.join(ema, "event_type")


def unexpired(events: DataFrame, lifetime: str) -> DataFrame:
    """Rows of each user no later than the lifetime after the user's first row; activity does not extend it."""
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return events.withColumn("first", first).filter(F.col("ts") <= F.col("first") + F.expr(f"INTERVAL {lifetime}")).drop("first")
