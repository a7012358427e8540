"""Relational queries: filters, joins, aggregates, windows, sorts and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import relational as R
from corpusmill.registry import query
from corpusmill.sources.tables import table, tables

D = "documents"


@query("pf01_searchable", "select v.vec_id, d.doc_id, d.source, d.lang from embeddings v join documents d on d.doc_id = v.vec_id where v.embedding is not null and d.lang = 'en'")
def pf01(spark, d):
    vectors, docs = tables(spark, d, "embeddings", D)
    rows = vectors.filter(F.col("embedding").isNotNull()).select("vec_id").join(docs, F.col("doc_id") == F.col("vec_id"))
    return R.equal_filters(rows, lang="en").select("vec_id", "doc_id", "source", "lang")


@query(
    "pf02_document_listing",
    """with f as (select doc_id, source, lang, n_chars from documents where lang = 'fr' and lower(source) like '%src1%')
    select doc_id, source, lang, n_chars, (select count(*) from f) as total, (select count(*) from f) > 30 as has_more
    from f order by n_chars desc, doc_id limit 20 offset 10""",
)
def pf02(spark, d):
    docs = table(spark, d, D).select("doc_id", "source", "lang", "n_chars")
    rows = R.any_ilike(R.equal_filters(docs, lang="fr", source="all"), "SRC1", "source")
    return R.paged(rows, "n_chars", ("n_chars", "doc_id"), "doc_id", "doc_id", limit=20, offset=10)


@query(
    "pf03_customer_search",
    """select c_custkey, c_name, n_name from customer left join nation on c_nationkey = n_nationkey
    where lower(c_name) like '%00012%' or lower(c_mktsegment) like '%00012%' order by c_custkey limit 50""",
)
def pf03(spark, d):
    customer, nation = tables(spark, d, "customer", "nation")
    found = R.any_ilike(customer, "00012", "c_name", "c_mktsegment")
    return found.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name").orderBy("c_custkey").limit(50)


@query("pf04_wildcard_filter", "select p_partkey, p_brand, p_type, p_size from part where p_type = 'ECONOMY' order by p_brand, p_size, p_partkey")
def pf04(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return R.equal_filters(part, p_type="ECONOMY", p_brand="all", p_size=None).orderBy("p_brand", "p_size", "p_partkey")


@query("pf06_anomalies", "select event_id, user_id, value from events where value is not null and value < 1.5 order by ts desc, event_id limit 50")
def pf06(spark, d):
    rows = table(spark, d, "events").filter(F.col("value").isNotNull() & (F.col("value") < 1.5))
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "value")


@query("pf07_long_texts", "select doc_id, length(text)::bigint as n from documents where length(text) > 200 order by doc_id limit 10000")
def pf07(spark, d):
    rows = table(spark, d, D).filter(F.length("text") > 200)
    return rows.orderBy("doc_id").limit(10000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("pf11_json_field", "select event_id, (props->>'$.k')::bigint as k from events where (props->>'$.k')::bigint >= 50")
def pf11(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query("pf12_slow_records", "select event_id, event_type, value from events where value > 100 or (event_type = 'error' and value < 0.5)")
def pf12(spark, d):
    rows = table(spark, d, "events").filter((F.col("value") > 100) | ((F.col("event_type") == "error") & (F.col("value") < 0.5)))
    return rows.select("event_id", "event_type", "value")


@query("pf13_recent", "select event_id, user_id from events where ts >= (select max(ts) from events) - interval 3 days")
def pf13(spark, d):
    return R.since(table(spark, d, "events"), "ts", "3 DAYS").select("event_id", "user_id")


@query(
    "pf14_truncation",
    """select conv_id, turn, case when length(text) <= 50 then text else substr(text, 1, 50) || '...' end as title,
    case when length(text) <= 200 then text else substr(text, 1, 200) || '...' end as snippet from conversations""",
)
def pf14(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.ellipsis("text", 50).alias("title"), R.ellipsis("text", 200).alias("snippet"))


@query("jn01_inner", "select l.doc_id, d.source, l.quality from labels l join documents d using (doc_id) where d.lang = 'en' order by l.doc_id")
def jn01(spark, d):
    labels, docs = tables(spark, d, "labels", D)
    return labels.join(R.equal_filters(docs, lang="en"), "doc_id").select("doc_id", "source", "quality").orderBy("doc_id")


@query(
    "jn02_three_way",
    """select o_orderkey, c_name, l_linenumber, l_quantity from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey where c_mktsegment = 'HOUSEHOLD' and l_quantity > 45""",
)
def jn02(spark, d):
    lineitem, orders, customer = tables(spark, d, "lineitem", "orders", "customer")
    rows = lineitem.filter("l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(customer.filter("c_mktsegment = 'HOUSEHOLD'"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", "l_linenumber", "l_quantity")


@query(
    "jn03_left_counts",
    "select c_custkey, coalesce(n, 0) as n_orders from customer left join (select o_custkey, count(*) n from orders group by 1) on c_custkey = o_custkey",
)
def jn03(spark, d):
    customer, orders = tables(spark, d, "customer", "orders")
    return R.with_counts(customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_orders")


@query("jn04_childless", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def jn04(spark, d):
    docs, labels = tables(spark, d, D, "labels")
    return R.childless(docs, labels, "doc_id").select("doc_id", "source")


@query(
    "jn05_hierarchy",
    """select r_name, n_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders from region join nation on r_regionkey = n_regionkey
    join customer on n_nationkey = c_nationkey left join orders on c_custkey = o_custkey where r_name <> 'ASIA' group by 1, 2""",
)
def jn05(spark, d):
    region, nation, customer, orders = tables(spark, d, "region", "nation", "customer", "orders")
    counted = R.with_counts(customer.select("c_custkey", "c_nationkey"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n")
    names = F.broadcast(nation.join(region.filter("r_name <> 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey")))
    rows = counted.join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))


@query(
    "jn06_snapshot_diff",
    """with o as (select p_partkey, p_size, p_brand from part where p_partkey % 10 <> 1),
    n as (select p_partkey, p_size + (case when p_partkey % 7 = 0 then 1 else 0 end) as p_size, p_brand from part where p_partkey % 10 <> 2)
    select p_partkey, 'ADDED' as change from n where p_partkey not in (select p_partkey from o)
    union all select p_partkey, 'REMOVED' from o where p_partkey not in (select p_partkey from n)
    union all select n.p_partkey, 'MODIFIED' from n join o using (p_partkey) where n.p_size <> o.p_size or n.p_brand <> o.p_brand""",
)
def jn06(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    old = part.filter("p_partkey % 10 <> 1")
    new = part.filter("p_partkey % 10 <> 2").withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0))
    return R.snapshot_diff(old, new, ["p_partkey"], ["p_size", "p_brand"])


@query("jn07_cross", "select r_name, n_name from region cross join nation where r_name = 'ASIA' or (r_name = 'EUROPE' and n_nationkey < 10)")
def jn07(spark, d):
    region, nation = tables(spark, d, "region", "nation")
    rows = nation.crossJoin(F.broadcast(region))
    return rows.filter((F.col("r_name") == "ASIA") | ((F.col("r_name") == "EUROPE") & (F.col("n_nationkey") < 10))).select("r_name", "n_name")


@query(
    "jn10_semi_join",
    "select conv_id, turn, role from conversations where conv_id in (select conv_id from conversations where role = 'system')",
)
def jn10(spark, d):
    c = table(spark, d, "conversations")
    return c.join(c.filter("role = 'system'").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "role")


@query(
    "jn11_scalar_subqueries",
    """select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer
    where c_acctbal > (select avg(c_acctbal) from customer)""",
)
def jn11(spark, d):
    customer, orders = tables(spark, d, "customer", "orders")
    mean = customer.agg(F.avg("c_acctbal").alias("mean"))
    rich = customer.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean")).select("c_custkey")
    return R.with_counts(rich, orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n")


@query(
    "jn13_lexicon_match",
    """with lex(term, category) as (values ('token =', 'secret'), ('license', 'legal'), ('copyright', 'legal'), ('@', 'contact'))
    select doc_id, category, count(*) as hits from documents join lex on contains(lower(text), term) group by 1, 2""",
)
def jn13(spark, d):
    lexicon = spark.createDataFrame([("token =", "secret"), ("license", "legal"), ("copyright", "legal"), ("@", "contact")], "term string, category string")
    low = table(spark, d, D).select("doc_id", F.lower("text").alias("low"))
    return low.crossJoin(F.broadcast(lexicon)).filter(F.contains("low", "term")).groupBy("doc_id", "category").agg(F.count("*").alias("hits"))


@query(
    "jn15_usage_join",
    "select event_id, user_id, c_name from events left join customer on user_id = c_custkey where event_type = 'purchase' order by ts desc, event_id limit 25",
)
def jn15(spark, d):
    events, customer = tables(spark, d, "events", "customer")
    newest = events.filter("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(25)
    return newest.join(customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", "c_name")


@query(
    "ag01_question_statistics",
    """select event_type, count(*) as uses, round(avg(value), 6) as avg_latency, count(*) filter (where value >= 50) as high,
    count(*) filter (where value < 5) as low, max(ts) as last_used, count(distinct user_id) as users from events group by 1""",
)
def ag01(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("uses"), F.round(F.avg("value"), 6).alias("avg_latency"), F.count_if(F.col("value") >= 50).alias("high"),
        F.count_if(F.col("value") < 5).alias("low"), F.max("ts").alias("last_used"), F.countDistinct("user_id").alias("users"),
    )


@query("ag02_totals", "select count(*) as n, count(distinct user_id) as users, round(avg(value), 6) as mean, round(avg(user_id), 6) as mean_user from events")
def ag02(spark, d):
    return table(spark, d, "events").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("user_id"), 6).alias("mean_user")
    )


@query("ag03_top_categories", "select source, count(*) as n, round(avg(n_chars), 4) as mean from documents group by 1 order by n desc, source limit 10")
def ag03(spark, d):
    return table(spark, d, D).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")).orderBy(F.desc("n"), "source").limit(10)


@query(
    "ag04_document_summary",
    """select o_orderkey, count(l_linenumber) as lines, count(*) filter (where l_returnflag = 'R') as returned
    from orders left join lineitem on o_orderkey = l_orderkey group by 1""",
)
def ag04(spark, d):
    orders, lineitem = tables(spark, d, "orders", "lineitem")
    per = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return orders.select("o_orderkey").join(per, "o_orderkey", "left").fillna(0, ["lines", "returned"])


@query(
    "ag05_categorization",
    """select quality, toxic, lang, count(*) as n, round(avg(n_chars), 3) as mean from documents join labels using (doc_id)
    group by 1, 2, 3 order by n desc, quality, toxic, lang""",
)
def ag05(spark, d):
    docs, labels = tables(spark, d, D, "labels")
    return docs.join(labels, "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("mean")).orderBy(
        F.desc("n"), "quality", "toxic", "lang"
    )


@query(
    "ag06_document_profile",
    """select count(*) as n, count(distinct source) as sources, count(distinct lang) as langs, count(distinct text) as texts,
    round(avg(n_chars), 4) as mean, max(n_chars) as longest, min(n_chars) as shortest from documents""",
)
def ag06(spark, d):
    return table(spark, d, D).agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("texts"),
        F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("longest"), F.min("n_chars").alias("shortest"),
    )


@query(
    "ag07_chunk_profile",
    """select role, count(*) as n, round(avg(length(text)), 4) as mean, max(length(text))::int as longest, min(length(text))::int as shortest,
    count(distinct conv_id) as conversations from conversations group by 1""",
)
def ag07(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean"), F.max(F.length("text")).alias("longest"),
        F.min(F.length("text")).alias("shortest"), F.countDistinct("conv_id").alias("conversations"),
    )


@query("ag08_embedding_profile", "select label, count(embedding) as n, max(len(embedding))::int as dimension from embeddings group by 1")
def ag08(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("embedding").alias("n"), F.max(F.size("embedding")).alias("dimension"))


@query("ag09_knowledge_base", "select lang, count(distinct source) as sources, count(*) as n, round(avg(n_chars), 4) as mean, sum(n_chars)::bigint as total, max(source) as last from documents group by 1")
def ag09(spark, d):
    return table(spark, d, D).groupBy("lang").agg(
        F.countDistinct("source").alias("sources"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.sum("n_chars").alias("total"), F.max("source").alias("last")
    )


@query(
    "ag10_processing_statistics",
    """select count(*) as n, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus = 'P') as pending,
    round(100.0 * count(*) filter (where o_orderstatus = 'F') / count(*), 4) as coverage from orders""",
)
def ag10(spark, d):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").agg(
        F.count("*").alias("n"), done.alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.round(100.0 * done / F.count("*"), 4).alias("coverage")
    )


@query("ag11_coverage", "select count(*) filter (where lang not in ('de', 'es')) as known, count(*) filter (where source <> 'src0') as placed from documents")
def ag11(spark, d):
    return table(spark, d, D).agg(F.count_if(~F.col("lang").isin("de", "es")).alias("known"), F.count_if(F.col("source") != "src0").alias("placed"))


@query(
    "ag12_role_members",
    """select n_name, count(distinct c_custkey) as customers, coalesce(list_sort(array_agg(distinct s_name) filter (where s_name is not null)), []) as suppliers
    from nation left join customer on c_nationkey = n_nationkey left join supplier on s_nationkey = n_nationkey group by 1""",
)
def ag12(spark, d):
    nation, customer, supplier = tables(spark, d, "nation", "customer", "supplier")
    # each side is grouped before the join, so their product is never made
    c = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_set("s_name")).alias("suppliers"))
    rows = nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return rows.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.array().cast("array<string>")).alias("suppliers"))


@query("ag13_full_text", "select conv_id, string_agg(text, ' ' order by turn) as full_text from conversations group by 1")
def ag13(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("listagg(text, ' ') within group (order by turn)").alias("full_text"))


@query(
    "ag14_levels",
    """select r_name, count(distinct n_nationkey) as nations, count(distinct c_custkey) as customers, count(distinct o_orderkey) as orders,
    max(o_orderdate) as last from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey
    left join orders on o_custkey = c_custkey group by 1""",
)
def ag14(spark, d):
    region, nation, customer, orders = tables(spark, d, "region", "nation", "customer", "orders")
    rows = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("r_name").agg(
        F.countDistinct("n_nationkey").alias("nations"), F.countDistinct("c_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"), F.max("o_orderdate").alias("last")
    )


@query(
    "ag16_today",
    """with t as (select max(ts) as last from events), r as (select * from events, t where ts >= date_trunc('day', last))
    select count(*) as n, round(avg(epoch(last) - epoch(ts)), 3) as mean_age, round(coalesce(sum(value), 0), 4) as total, max(ts) as newest from r""",
)
def ag16(spark, d):
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("last"))
    rows = events.join(F.broadcast(last), F.col("ts") >= F.date_trunc("day", "last").cast("timestamp_ntz"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(seconds("last") - seconds("ts")), 3).alias("mean_age"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.max("ts").alias("newest"),
    )


@query(
    "ag17_latency_summary",
    """select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95,
    round(quantile_cont(value, 0.99), 6) as p99, min(value) as least, max(value) as most, round(stddev_samp(value), 6) as sd from events group by 1""",
)
def ag17(spark, d):
    events = table(spark, d, "events").select("event_type", "value")
    sums = events.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("sd")
    )
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    found = R.percentiles(events, ["event_type"], "value", shares).select("event_type", *(F.round(n, 6).alias(n) for n in shares))
    return sums.join(found, "event_type", "left")


@query(
    "ag18_nearest_percentiles",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
    select event_type, max(case when i = floor(0.5 * n) then value end) as p50, max(case when i = floor(0.75 * n) then value end) as p75, max(case when i = floor(0.9 * n) then value end) as p90,
    max(case when i = floor(0.95 * n) then value end) as p95, max(case when i = floor(0.99 * n) then value end) as p99 from r group by 1""",
)
def ag18(spark, d):
    return R.nearest_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query(
    "ag19_histogram",
    """select case when l_discount <= 0.02 then 'to 0.02' when l_discount <= 0.04 then 'to 0.04' when l_discount <= 0.06 then 'to 0.06'
    when l_discount <= 0.08 then 'to 0.08' else 'above' end as bucket, count(*) as n from lineitem group by 1""",
)
def ag19(spark, d):
    x = F.col("l_discount")
    bucket = F.when(x <= 0.02, "to 0.02").when(x <= 0.04, "to 0.04").when(x <= 0.06, "to 0.06").when(x <= 0.08, "to 0.08").otherwise("above")
    return table(spark, d, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("ag20_thresholds", "select count(*) filter (where value > 5) as over5, count(*) filter (where value > 10) as over10, count(*) filter (where value > 20) as over20 from events")
def ag20(spark, d):
    return table(spark, d, "events").agg(*(F.count_if(F.col("value") > x).alias(f"over{x}") for x in (5, 10, 20)))


@query(
    "ag21_regressions",
    """with t as (select max(ts) - interval 7 days as cut from events), a as (select event_type, avg(case when ts >= cut then value end) as recent,
    avg(case when ts < cut then value end) as base from events, t group by 1)
    select event_type, round(recent, 6) as recent, round(base, 6) as base, case when base - recent > 10 then 'high' when base - recent > 5 then 'medium' else 'none' end as severity
    from a where recent is not null and base is not null""",
)
def ag21(spark, d):
    events = table(spark, d, "events")
    cut = events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("cut"))
    a = events.crossJoin(F.broadcast(cut)).groupBy("event_type").agg(
        F.avg(F.when(F.col("ts") >= F.col("cut"), F.col("value"))).alias("recent"), F.avg(F.when(F.col("ts") < F.col("cut"), F.col("value"))).alias("base")
    )
    drop = F.col("base") - F.col("recent")
    return a.filter(F.col("recent").isNotNull() & F.col("base").isNotNull()).select(
        "event_type", F.round("recent", 6).alias("recent"), F.round("base", 6).alias("base"), F.when(drop > 10, "high").when(drop > 5, "medium").otherwise("none").alias("severity")
    )


_DAILY = "select event_type, date_trunc('day', ts)::date as day, avg(value) as mean from events group by 1, 2"


@query(
    "ag22_trend",
    f"""with x as (select event_type, mean, row_number() over (partition by event_type order by day) - 1 as i from ({_DAILY})),
    s as (select event_type, count(*) as points, regr_slope(mean, i) as slope from x group by 1)
    select event_type, points, round(slope, 6) as slope, case when points < 2 then 'insufficient' when abs(slope) < 0.1 then 'stable' when slope > 0 then 'improving' else 'declining' end as trend from s""",
)
def ag22(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    return R.trend(daily, ["event_type"], "day", "mean").withColumn("slope", F.round("slope", 6))


@query(
    "ag23_quality_score",
    f"""with d as ({_DAILY} union all select 'all', date_trunc('day', ts)::date, avg(value) from events group by 2), x as (select *, row_number() over (partition by event_type order by day) - 1 as i from d),
    s as (select event_type, arg_max(mean, day) as current, coalesce(stddev_samp(mean), 0) as sd, regr_slope(mean, i) as slope, count(*) as points from x group by 1)
    select round(avg(case when event_type = 'all' then greatest(0, least(100, current + case when points > 1 and slope >= 0.1 then 5 else 0 end - least(5, sd))) else 0.8 * current + 0.2 * greatest(0, 10 - sd) end), 6) as score from s""",
)
def ag23(spark, d):
    """Mean of a score for each type's daily series, 0.8 of its last value and 0.2 of its evenness, and one for all events:
    the last value, five more if it improves, less the spread, up to five."""
    events = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    daily = events.unionByName(events.withColumn("event_type", F.lit("all"))).groupBy("event_type", "day").agg(F.avg("value").alias("mean"))
    s = daily.groupBy("event_type").agg(F.max_by("mean", "day").alias("current"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("sd"))
    s = s.join(R.trend(daily, ["event_type"], "day", "mean").select("event_type", "trend"), "event_type")
    every = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("current") + F.when(F.col("trend") == "improving", 5).otherwise(0) - F.least(F.lit(5.0), "sd")))
    score = F.when(F.col("event_type") == "all", every).otherwise(0.8 * F.col("current") + 0.2 * F.greatest(F.lit(0.0), 10 - F.col("sd")))
    return s.agg(F.round(F.avg(score), 6).alias("score"))


@query(
    "ag24_flaky",
    """with s as (select user_id, count(*) as runs, count(*) filter (where event_type = 'error') as failures, coalesce(var_samp(value) filter (where value > 0), 0) as variance, avg(value) filter (where value > 0) as mean,
    max(ts) filter (where event_type = 'error') as last_failure from events group by 1), r as (select *, failures / runs as rate from s where runs >= 3 and failures > 0 and failures < runs)
    select user_id, runs, failures, round(rate, 6) as rate, round(variance, 4) as variance, round(mean, 4) as mean, last_failure,
    round(least(1, case when rate between 0.2 and 0.8 then 0.8::double when rate between 0.1 and 0.9 then 0.6 else 0.3 end + least(0.2, runs * 0.02) + least(0.1, variance * 0.1)), 6) as confidence from r""",
)
def ag24(spark, d):
    failed, positive = F.col("event_type") == "error", F.when(F.col("value") > 0, F.col("value"))
    s = table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("failures"), F.coalesce(F.var_samp(positive), F.lit(0.0)).alias("variance"), F.avg(positive).alias("mean"),
        F.max(F.when(failed, F.col("ts"))).alias("last_failure"),
    )
    s = s.filter("runs >= 3 and failures > 0 and failures < runs").withColumn("rate", F.col("failures") / F.col("runs"))
    base = F.when(F.col("rate").between(0.2, 0.8), 0.8).when(F.col("rate").between(0.1, 0.9), 0.6).otherwise(0.3)
    sure = F.least(F.lit(1.0), base + F.least(F.lit(0.2), F.col("runs") * 0.02) + F.least(F.lit(0.1), F.col("variance") * 0.1))
    return s.select("user_id", "runs", "failures", F.round("rate", 6).alias("rate"), F.round("variance", 4).alias("variance"), F.round("mean", 4).alias("mean"), "last_failure", F.round(sure, 6).alias("confidence"))


@query(
    "ag25_duplicate_groups",
    "select md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) as signature, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1",
)
def ag25(spark, d):
    signature = F.md5(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    return table(spark, d, D).groupBy(signature.alias("signature")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query(
    "ag27_performance_score",
    """with w as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as i from events),
    s as (select event_type, count(*) as n, avg(case when value < 20 then 1.0 else 0.0 end) as success, avg(least(1.0, value / 100)) as sure, avg(value) as mean from w where i <= 200 group by 1 having count(*) >= 5),
    r as (select event_type, n, 0.5 * success + 0.3 * sure + 0.2 * 1000 / greatest(mean, 100) as score from s)
    select event_type, n, round(score, 6) as score, case when score > 0.8 then 'excellent' when score > 0.6 then 'good' when score > 0.4 then 'average' else 'poor' end as label, event_type = (select event_type from r order by score desc, event_type limit 1) as best from r""",
)
def ag27(spark, d):
    last = R.trailing(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 200)
    s = last.groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)).alias("success"), F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("sure"), F.avg("value").alias("mean")
    )
    score = 0.5 * F.col("success") + 0.3 * F.col("sure") + 0.2 * 1000 / F.greatest(F.col("mean"), F.lit(100.0))
    s = s.filter("n >= 5").withColumn("score", score)
    best = F.broadcast(s.agg(F.max_by("event_type", F.struct("score")).alias("_best")))
    label = F.when(F.col("score") > 0.8, "excellent").when(F.col("score") > 0.6, "good").when(F.col("score") > 0.4, "average").otherwise("poor")
    return s.crossJoin(best).select("event_type", "n", F.round("score", 6).alias("score"), label.alias("label"), (F.col("event_type") == F.col("_best")).alias("best"))


@query(
    "ag28_classification_statistics",
    """with j as (select lang, source, quality, toxic, n_chars from documents join labels using (doc_id)) select 'type' as kind, lang as name, count(*) as n, round(avg(quality), 4) as quality, round(avg(1 - toxic), 4) as confidence, round(avg(least(1, n_chars / 10000)), 4) as priority from j group by 2
    union all select 'domain', source, count(*), round(avg(quality), 4), round(avg(1 - toxic), 4), round(avg(least(1, n_chars / 10000)), 4) from j group by 2""",
)
def ag28(spark, d):
    docs, labels = tables(spark, d, D, "labels")
    joined = docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")
    named = joined.withColumn("_k", F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("lang").alias("name")), F.struct(F.lit("domain").alias("kind"), F.col("source").alias("name")))))
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    by = named.groupBy(F.col("_k.kind").alias("kind"), F.col("_k.name").alias("name"))
    return by.agg(F.count("*").alias("n"), mean(F.col("quality"), "quality"), mean(1 - F.col("toxic"), "confidence"), mean(F.least(F.lit(1.0), F.col("n_chars") / 10000), "priority"))


@query("ag32_metric_summary", "select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events group by 1")
def ag32(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(
    "ag33_failure_patterns",
    """select case when value > 50 then 'timeout' when value < 1 then 'empty' else 'other' end as pattern, user_id % 5 as suite, count(*) as n
    from events where event_type = 'error' group by 1, 2""",
)
def ag33(spark, d):
    pattern = F.when(F.col("value") > 50, "timeout").when(F.col("value") < 1, "empty").otherwise("other")
    return table(spark, d, "events").filter("event_type = 'error'").groupBy(pattern.alias("pattern"), (F.col("user_id") % 5).alias("suite")).agg(F.count("*").alias("n"))


@query("ag34_retrieval_rate", "with c as (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1) select round(avg(case when n > 0 then 1.0 else 0.0 end), 6) as rate, round(avg(n), 6) as mean, max(n) as most from c")
def ag34(spark, d):
    customer, orders = tables(spark, d, "customer", "orders")
    c = R.with_counts(customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n")
    return c.agg(F.round(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), 6).alias("rate"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query("ag36_best_run", "select event_type, max(value) as best, arg_max(event_id, (value, -event_id)) as event_id from events where event_type <> 'error' group by 1")
def ag36(spark, d):
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return table(spark, d, "events").filter("event_type <> 'error'").groupBy("event_type").agg(F.max("value").alias("best"), best.alias("event_id"))


@query(
    "ag38_consensus",
    """with a as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by length(text), turn) as i, count(*) over (partition by conv_id) as c,
    1.0::double / (1 + turn) as confidence from conversations where role = 'assistant')
    select conv_id, min(turn) as best_turn, max(turn) filter (where i = c // 2 + 1) as median_turn, round(greatest(0, least(1, 1 - stddev_samp(confidence))), 6) as agreement, round(least(1, max(confidence) / greatest(avg(confidence), 0.1)), 6) as lead,
    0.7::double as median_agreement from a group by 1 having count(*) > 1""",
)
def ag38(spark, d):
    """Three ways to one answer: of the greatest confidence, with evenness or lead as agreement, and of the median length."""
    answers = table(spark, d, "conversations").filter("role = 'assistant'").withColumn("confidence", 1.0 / (1 + F.col("turn")))
    w = Window.partitionBy("conv_id")
    a = answers.withColumn("i", F.row_number().over(w.orderBy(F.length("text"), "turn"))).withColumn("c", F.count("*").over(w))
    by = a.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.max_by("turn", "confidence").alias("best_turn"),
        F.max(F.when(F.col("i") == F.floor(F.col("c") / 2) + 1, F.col("turn"))).alias("median_turn"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_samp("confidence"))), 6).alias("agreement"),
        F.round(F.least(F.lit(1.0), F.max("confidence") / F.greatest(F.avg("confidence"), F.lit(0.1))), 6).alias("lead"),
    )
    return by.filter("n > 1").drop("n").withColumn("median_agreement", F.lit(0.7))


@query(
    "ag40_gate",
    """with s as (select event_type, quantile_cont(value, 0.95) as p95, avg(case when value > 100 then 1.0 else 0.0 end) as fails from events group by 1)
    select event_type, list_filter([case when p95 > 60 then 'p95' end, case when fails > 0.02 then 'failures' end], lambda x: x is not null) as reasons from s""",
)
def ag40(spark, d):
    events = table(spark, d, "events").select("event_type", "value")
    s = events.groupBy("event_type").agg(F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)).alias("fails")).join(R.percentiles(events, ["event_type"], "value", {"p95": 0.95}), "event_type", "left")
    reasons = F.array_compact(F.array(F.when(F.col("p95") > 60, "p95"), F.when(F.col("fails") > 0.02, "failures")))
    return s.select("event_type", reasons.alias("reasons"))


@query("ag41_archive_report", "select source, count(*) as n, round(avg(n_chars), 4) as mean_size, round(avg(length(source)), 4) as mean_name from documents group by 1")
def ag41(spark, d):
    return table(spark, d, D).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_size"), F.round(F.avg(F.length("source")), 4).alias("mean_name"))


@query(
    "ag43_completeness",
    """with f as (select unnest([{'field': 'text', 'filled': text <> ''}, {'field': 'lang', 'filled': lang <> ''}, {'field': 'source', 'filled': source <> ''}, {'field': 'contacts', 'filled': len(regexp_extract_all(text, '[a-z0-9._]+@[a-z0-9]+[.][a-z]+')) > 0}, {'field': 'licence', 'filled': contains(text, 'License')}], recursive := true) from documents)
    select field, count(*) filter (where filled) as filled, round(100.0 * count(*) filter (where filled) / count(*), 4) as share from f group by 1""",
)
def ag43(spark, d):
    """How many documents hold each field, plain ones and lists found in the text, and their share of all."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    contacts = F.size(F.regexp_extract_all("text", F.lit("([a-z0-9._]+@[a-z0-9]+[.][a-z]+)"), 1)) > 0
    fields = {"text": has(F.col("text")), "lang": has(F.col("lang")), "source": has(F.col("source")), "contacts": contacts, "licence": F.contains("text", F.lit("License"))}
    rows = table(spark, d, D).select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("filled")) for n, c in fields.items()))).alias("f")).select("f.*")
    filled = F.count_if("filled")
    return rows.groupBy("field").agg(filled.alias("filled"), F.round(100.0 * filled / F.count("*"), 4).alias("share"))


@query(
    "ag44_load_summary",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
    select event_type, max(case when i = floor(0.95 * n) then value end) as p95, max(case when i = floor(0.99 * n) - 1 then value end) as p99 from r group by 1""",
)
def ag44(spark, d):
    return R.nearest_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p95": 0.95, "p99": 0.99}, before={"p99": 1})


@query(
    "ag45_run_summary",
    """select user_id, round(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 6) as pass_rate, round(avg(value) filter (where value > 0), 6) as mean,
    round(median(value) filter (where value > 0), 6) as median from events group by 1""",
)
def ag45(spark, d):
    events, positive = table(spark, d, "events"), F.when(F.col("value") > 0, F.col("value"))
    sums = events.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.round(F.avg(positive), 6).alias("mean"))
    middle = R.percentiles(events.select("user_id", positive.alias("value")), ["user_id"], "value", {"median": 0.5})
    return sums.join(middle, "user_id", "left").withColumn("median", F.round("median", 6))


@query("wn01_top_k", "select * from (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id)::int as rank from events) where rank <= 10")
def wn01(spark, d):
    return R.top_k(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 10)


@query("wn02_latest", "select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def wn02(spark, d):
    return R.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query(
    "wn03_last_turns",
    """with t as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn desc) as r from conversations)
    select conv_id, turn from (select *, row_number() over (partition by conv_id order by n desc, turn) as b from t where r <= 4) where b <= 2""",
)
def wn03(spark, d):
    last = R.trailing(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 4)
    return R.trailing(last, ["conv_id"], [F.length("text").desc(), F.col("turn")], 2).select("conv_id", "turn")


@query(
    "wn04_neighbours",
    """select conv_id, turn, string_agg(text, chr(10) || chr(10)) over w as context from conversations
    where conv_id in (select conv_id from conversations group by 1 having count(*) >= 2) window w as (partition by conv_id order by turn rows between 1 preceding and 1 following)""",
)
def wn04(spark, d):
    w = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").withColumn("n", F.count("*").over(w)).filter("n >= 2")
    return rows.select("conv_id", "turn", F.array_join(F.collect_list("text").over(w.orderBy("turn").rowsBetween(-1, 1)), "\n\n").alias("context"))


@query(
    "wn05_lag",
    "select conv_id, turn, coalesce(lag(text) over (partition by conv_id order by turn) || ' ', '') || text as chunk from conversations",
)
def wn05(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce(F.concat(before, F.lit(" ")), F.lit("")), "text").alias("chunk"))


@query(
    "wn06_min_max",
    """select event_id, round(case when max(value) over w = min(value) over w then 0.5 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled
    from events window w as (partition by user_id)""",
)
def wn06(spark, d):
    return R.min_max(table(spark, d, "events"), ["user_id"], "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query(
    "wn07_rank_weights",
    """with r as (select event_type, user_id, row_number() over (partition by event_type order by value desc, event_id) as i from events)
    select event_type, round(sum(case when user_id % 2 = 0 then 1.0 / i else 0 end) / sum(1.0 / i), 6) as share from r where i <= 10 group by 1""",
)
def wn07(spark, d):
    top = R.top_k(table(spark, d, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 10)
    weight = 1.0 / F.col("rank")
    return top.groupBy("event_type").agg(F.round(F.sum(F.when(F.col("user_id") % 2 == 0, weight).otherwise(0.0)) / F.sum(weight), 6).alias("share"))


@query(
    "wn08_budget_prefix",
    """select conv_id, turn, used::bigint as used from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as used from conversations) where used <= 400""",
)
def wn08(spark, d):
    rows = table(spark, d, "conversations").withColumn("n", F.length("text"))
    return R.prefix_in_budget(rows, ["conv_id"], [F.col("turn")], "n", 400).select("conv_id", "turn", "used")


@query("wn09_first_wins", "select min(doc_id) as doc_id from documents group by substr(text, 1, 200)")
def wn09(spark, d):
    rows = table(spark, d, D).select("doc_id", F.substring("text", 1, 200).alias("head"))
    return rows.groupBy("head").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("wn11_share", "select event_type, count(*) as n, count(*) / sum(count(*)) over () as share from events group by 1")
def wn11(spark, d):
    return R.share_of_total(table(spark, d, "events"), "event_type")


@query("so01_global_top", "select event_id, value from events order by value desc, event_id limit 20")
def so01(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("so04_multi_sort", "select doc_id, lang, source from documents order by lang, source desc, doc_id")
def so04(spark, d):
    return table(spark, d, D).select("doc_id", "lang", "source").orderBy("lang", F.desc("source"), "doc_id")


@query("so06_first_examples", "select event_type, user_id from (select event_type, user_id, row_number() over (partition by event_type order by min(event_id)) as i from events group by 1, 2) where i <= 20")
def so06(spark, d):
    firsts = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    return R.top_k(firsts, ["event_type"], [F.col("first")], 20).select("event_type", "user_id")


@query("so07_keep_newest", "select event_id from events order by ts desc, event_id desc limit 1000")
def so07(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@query("se01_union", "select c_nationkey as k from customer where c_acctbal > 9000 union select s_nationkey from supplier where s_acctbal > 9000")
def se01(spark, d):
    customer, supplier = tables(spark, d, "customer", "supplier")
    return customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).union(supplier.filter("s_acctbal > 9000").select("s_nationkey")).distinct()


@query("se02_tagged_union", "select n_name, 'customer' as kind from nation where n_nationkey in (select c_nationkey from customer) union select n_name, 'supplier' from nation where n_nationkey in (select s_nationkey from supplier) order by 1, 2")
def se02(spark, d):
    nation, customer, supplier = tables(spark, d, "nation", "customer", "supplier")
    a = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_name", F.lit("customer").alias("kind"))
    b = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_name", F.lit("supplier").alias("kind"))
    return a.union(b).distinct().orderBy("n_name", "kind")


@query("se05_tagged_concat", "select 'document' as kind, doc_id as id, lang, null::varchar as url from documents union all select 'page', page_id, null, url from pages")
def se05(spark, d):
    docs, pages = tables(spark, d, D, "pages")
    a = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query(
    "snk01_upsert",
    """with b as (select doc_id, upper(lang) as lang, n_chars + 1 as n_chars from documents where doc_id % 3 = 0)
    select doc_id, coalesce(b.lang, d.lang) as lang, coalesce(b.n_chars, d.n_chars) as n_chars from documents d left join b using (doc_id)""",
)
def snk01(spark, d):
    docs = table(spark, d, D).select("doc_id", "lang", "n_chars")
    batch = docs.filter("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    return R.upsert(docs, batch, ["doc_id"], "n_chars")


@query("snk02_insert_ignore", "select doc_id, source from documents where doc_id % 2 = 0 union select doc_id, 'new' from documents where doc_id % 3 = 0 and doc_id % 2 <> 0")
def snk02(spark, d):
    docs = table(spark, d, D).select("doc_id", "source")
    return R.insert_ignore(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0").withColumn("source", F.lit("new")), ["doc_id"])


@query("snk03_replace", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 100 <> 7 union all select o_orderkey, 1, 0.0 from orders where o_orderkey % 100 = 7")
def snk03(spark, d):
    lines, orders = tables(spark, d, "lineitem", "orders")
    batch = orders.filter("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return R.replace_by(lines.select("l_orderkey", "l_linenumber", "l_quantity"), batch, "l_orderkey")


@query(
    "snk04_ingestion_metrics",
    """select source, count(*) as total, count(*) filter (where n_chars > 1000) as inserted, round(count(*) filter (where n_chars > 1000) / count(*), 6) as success_rate,
    round(sum(n_chars) filter (where lang = 'en') / nullif(count(*) filter (where lang = 'en'), 0), 4) as per_en from documents group by 1""",
)
def snk04(spark, d):
    inserted, en = F.count_if(F.col("n_chars") > 1000), F.count_if(F.col("lang") == "en")
    return table(spark, d, D).groupBy("source").agg(
        F.count("*").alias("total"), inserted.alias("inserted"), F.round(inserted / F.count("*"), 6).alias("success_rate"),
        F.round(F.try_divide(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), en), 4).alias("per_en"),
    )


@query(
    "src05_pad_vectors",
    "select vec_id, (embedding || list_transform(range(32), lambda x: 0.0::float))[1:96] as padded, embedding[1:32] as cut from embeddings",
)
def src05(spark, d):
    v = F.col("embedding")
    padded = F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), 96)), 1, 96)
    return table(spark, d, "embeddings").select("vec_id", padded.alias("padded"), F.slice(v, 1, 32).alias("cut"))
