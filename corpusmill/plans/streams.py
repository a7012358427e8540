"""Streams over the events table, run to the end of the input, and their batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import relational as R
from corpusmill.plans.text import COLL
from corpusmill.registry import query
from corpusmill.sources.scratch import folder
from corpusmill.sources.tables import table
from corpusmill.streaming import events as S


def batch(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("st02_counters", "select event_type, user_id, count(*) as n from events group by 1, 2")
def st02(spark, d):
    return S.finished(S.counters(S.event_stream(spark, d), "event_type", "user_id"), folder(spark))


@query("st03a_sliding_limit")
def st03a(spark, d):
    return S.appended(S.sliding_limit(S.event_stream(spark, d), 3, 3600.0), folder(spark))


@query("st03b_minute_limit", "select user_id, time_bucket(interval 1 minute, ts) as start, count(*) as n, least(count(*), 1) as accepted from events group by 1, 2")
def st03b(spark, d):
    return plain(S.per_minute_limit(batch(spark, d), 1), "start")


_TTL = """with recursive r as (select event_id, event_type, user_id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events),
    c as (select user_id, event_type, i, ts as stored, false as hit from r where i = 1 union all
    select r.user_id, r.event_type, r.i, case when r.ts < c.stored + interval 1 day then c.stored else r.ts end, r.ts < c.stored + interval 1 day from c join r on r.user_id = c.user_id and r.event_type = c.event_type and r.i = c.i + 1)"""


@query("st04_ttl_cache", _TTL + " select event_id, hit from c join r using (user_id, event_type, i)")
def st04(spark, d):
    return S.appended(S.ttl_cache(S.event_stream(spark, d), 86400.0), folder(spark))


@query("ag31_cache_hit_rate", _TTL + " select event_type, count(*) filter (where hit) as hits, count(*) as n, round(count(*) filter (where hit) / count(*), 6) as rate from c group by 1")
def ag31(spark, d):
    hits = S.ttl_cache(batch(spark, d), 86400.0).join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return hits.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"), F.round(F.count_if("hit") / F.count("*"), 6).alias("rate"))


@query(
    "st05_running_averages",
    """with r as (select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as b, count(*) over (partition by event_type) as n from events)
    select event_type, n, round(avg(value), 6) as mean, count(*) filter (where value < 20) as successes, round(sum(pow(0.8, b - 1) * (case when b = n then 1.0 else 0.2 end) * value), 6) as ema from r group by 1, 2""",
)
def st05(spark, d):
    return S.running_averages(table(spark, d, "events"))


@query(
    "st06_rates",
    """with w as (select unnest(list_transform(range(5), lambda i: time_bucket(interval 1 minute, ts) - to_minutes(i))) as start, value from events)
    select start, count(*) as n, round(count(*) / 300, 6) as rate, round(avg(value), 6) as mean from w group by 1""",
)
def st06(spark, d):
    return plain(S.rates(batch(spark, d)), "start")


@query(
    "st06_increase",
    """with c as (select event_type, ts, event_id, row_number() over (partition by event_type, time_bucket(interval 1 day, ts) order by ts, event_id) * 1.5::double as value from events),
    s as (select event_type, ts, max(value) as value from c group by 1, 2),
    w as (select *, unnest([time_bucket(interval 12 hours, ts), time_bucket(interval 12 hours, ts) - interval 12 hours]) as start from s),
    d as (select event_type, start, value, lag(value) over (partition by event_type, start order by ts) as prev from w)
    select event_type, start, count(*) as samples, round(sum(case when prev is null then 0 when value < prev then value else value - prev end), 6) as increase from d group by 1, 2""",
)
def st06_increase(spark, d):
    """A counter a type that starts anew each day, so that windows of a day hold a reset."""
    day = F.window("ts", "1 day").start
    order = F.row_number().over(Window.partitionBy("event_type", "_day").orderBy("ts", "event_id"))
    counted = batch(spark, d).select("event_type", "ts", "event_id", day.alias("_day")).withColumn("value", order * 1.5)
    return plain(S.counter_increase(counted.groupBy("event_type", "ts").agg(F.max("value").alias("value")), "event_type"), "start")


#: Upper bounds of buckets of values.
BOUNDS = [1.0, 5.0, 10.0, 20.0, 35.0, 50.0, 75.0, 100.0, 200.0]


@query(
    "st07_quantiles",
    f"""with e as (select time_bucket(interval 15 minutes, ts) as start, value from events), b as (select unnest({BOUNDS}::double[]) as le),
    t as (select start, count(value) as n from e group by 1), c as (select start, n, le, (select count(*) from e where e.start = t.start and value <= le) as c from t, b),
    g as (select *, lag(c, 1, 0) over w as before, lag(le, 1, 0.0) over w as low, n * 0.95::double as rank from c window w as (partition by start order by le))
    select start, n, round(coalesce(min(case when c >= rank and before < rank then case when c = before then le else low + (le - low) * (rank - before) / (c - before) end end), max(le)), 6) as p from g group by 1, 2""",
)
def st07(spark, d):
    return plain(S.finished(S.histogram_quantiles(S.event_stream(spark, d), BOUNDS), folder(spark)), "start")


@query("st08_freshness", "with l as (select event_type, max(ts) as last from events group by 1) select event_type, round(epoch((select max(last) from l)) - epoch(last), 3) as lag, epoch((select max(last) from l)) - epoch(last) > 600 as stale from l")
def st08(spark, d):
    return S.freshness(batch(spark, d), 600)


@query("st09_error_alerts", "select start, n, round(share, 6) as share from (select time_bucket(interval 1 hour, ts) as start, count(*) as n, count(*) filter (where event_type = 'error') / count(*) as share from events group by 1) where share > 0.25")
def st09(spark, d):
    return plain(S.finished(S.error_alerts(S.event_stream(spark, d)), folder(spark)), "start")


@query(
    "st10_question_tracking",
    "select sha256(regexp_replace(" + COLL("lower(text)") + r", '[^\p{L}\p{N}_\s?!.]', '', 'g')) as question, count(*) as uses, min(conv_id) as first from conversations where role = 'user' group by 1",
)
def st10(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", F.sha2(T.normal_question("text"), 256).alias("question"))
    return rows.groupBy("question").agg(F.count("*").alias("uses"), F.min("conv_id").alias("first"))


@query("st11_last_metrics", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events) where i <= 20")
def st11(spark, d):
    return R.trailing(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("st12_unexpired", "select event_id from (select event_id, ts, min(ts) over (partition by user_id) as f from events) where ts <= f + interval 5 days")
def st12(spark, d):
    return S.unexpired(table(spark, d, "events"), "5 DAYS").select("event_id")


@query("st13_rollups", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st13(spark, d):
    return plain(S.finished(S.rollups(S.event_stream(spark, d)), folder(spark)), "start")
