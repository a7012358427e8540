"""Retrieval and evaluation queries: benchmark passages and every twentieth vector or document against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation as E
from corpusmill.operators import ranking as K
from corpusmill.operators import retrieval as R
from corpusmill.plans.catalog import CATALOG, catalog
from corpusmill.plans.text import TOK, WORDS, pairs
from corpusmill.registry import query
from corpusmill.sources.scratch import stored
from corpusmill.sources.tables import table, tables

_BM25 = f"""p as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as term from (select doc_id, {TOK('text')} as w from documents)) group by 1, 2),
    s as (select count(*) as n, avg(len({TOK('text')})) as mean from documents), f as (select term, count(*) as df from p group by 1),
    q as (select qid, term, count(*) as qf from (select qid, unnest({TOK('query')}) as term from queries) group by 1, 2),
    b as (select qid, doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) as score
    from q join f using (term) join p using (term), s group by 1, 2)"""
_BENCH = "queries as (select item_id as qid, text as query from benchmark)"
_TOP = "(select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id)::int as rank from {})".format


def bench_bm25(spark, d, k):
    queries, docs = tables(spark, d, "benchmark", "documents")
    return R.bm25_top(queries.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), docs, "qid", "doc_id", "text", k)


@query("rt04_bm25", f"with {_BENCH}, {_BM25} select * from {_TOP('b')} where rank <= 10")
def rt04(spark, d):
    return bench_bm25(spark, d, 10)


_COS = """cos as (select a.vec_id as qid, b.vec_id as doc_id, round({}, 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)""".format
_SIM = _COS("list_cosine_similarity(a.embedding::double[], b.embedding::double[])")


def asked(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def chunks(spark, d):
    """Vectors with what filters ask for; a vector's model is told by its number."""
    model = F.when(F.col("doc_id") % 4 == 0, "small").otherwise("large").alias("model")
    return vectors(spark, d).join(catalog(spark, d).select("doc_id", "document_type", "product_name", "privacy_level", "status"), "doc_id").select("*", model)


@query("rt01_vector_top_k", f"with {CATALOG}, {_SIM}, f as (select cos.* from cos join catalog using (doc_id) where status = 'completed' and privacy_level = 'public') select * from {_TOP('f')} where rank <= 10")
def rt01(spark, d):
    return R.match_chunks(asked(spark, d), chunks(spark, d), "qid", "doc_id", 10, status="completed", privacy_level="public", document_type="all")


@query("rt02_l2_top_k", f"with {CATALOG}, " + _COS("1 - list_distance(a.embedding::double[], b.embedding::double[])") + f", f as (select cos.* from cos join catalog using (doc_id) where doc_id % 4 <> 0) select * from {_TOP('f')} where rank <= 10")
def rt02(spark, d):
    return R.match_chunks(asked(spark, d), chunks(spark, d), "qid", "doc_id", 10, metric="l2", model="large")


@query("rt03_threshold", f"with {CATALOG}, {_SIM}, f as (select 'all' as filters, cos.* from cos join catalog using (doc_id) where score > 0.3 union all select 'en', cos.* from cos join catalog using (doc_id) where score > 0.05 and document_type = 'en' and privacy_level = 'private') select filters, qid, doc_id, score, rank from (select *, row_number() over (partition by filters, qid order by score desc, doc_id)::int as rank from f) where rank <= 20")
def rt03(spark, d):
    """Wildcards for all filters, and two of them set."""
    rows = chunks(spark, d)
    open_ = R.match_chunks(asked(spark, d), rows, "qid", "doc_id", 20, threshold=0.3, privacy_level="all", document_type="all", product_name="all")
    closed = R.match_chunks(asked(spark, d), rows, "qid", "doc_id", 20, threshold=0.05, privacy_level="private", document_type="en", product_name="all")
    return open_.withColumn("filters", F.lit("all")).unionByName(closed.withColumn("filters", F.lit("en")))


_HYBRID = f"""queries as (select doc_id as qid, text as query from documents join embeddings on doc_id = vec_id where doc_id % 20 = 0), {_BM25}, {_SIM},
    v as (select * from {_TOP('cos')} where rank <= 20), l as (select * from {_TOP('b')} where rank <= 20),
    u as (select qid, doc_id, coalesce(v.score, 0) as v, coalesce(l.score, 0) as b from v full outer join l using (qid, doc_id)),
    n as (select *, case when max(v) over w = min(v) over w then 0.5 else (v - min(v) over w) / (max(v) over w - min(v) over w) end as vs,
    case when max(b) over w = min(b) over w then 0.5 else (b - min(b) over w) / (max(b) over w - min(b) over w) end as bs from u window w as (partition by qid))"""


def arms(spark, d, k=20):
    """Both searches, each run once however often its few rows a query are used."""
    docs = table(spark, d, "documents")
    q = asked(spark, d)
    texts = q.join(docs, F.col("qid") == F.col("doc_id")).select("qid", F.col("text").alias("query"))
    vector = R.vector_top_k(q, vectors(spark, d), "qid", "doc_id", k)
    lexical = R.bm25_top(texts, docs, "qid", "doc_id", "text", k)
    return stored(vector, "vector-arm"), stored(lexical, "lexical-arm")


@query("rt05_hybrid", f"with {_HYBRID} select * from {_TOP('(select qid, doc_id, round(0.7 * vs + 0.3 * bs, 6) as score from n)')} where rank <= 10")
def rt05(spark, d):
    return R.fuse(*arms(spark, d), "qid", "doc_id", 0.7, 10)


@query(
    "rt06_method_comparison",
    f"with {_HYBRID} select * from (select alpha, qid, doc_id, score, row_number() over (partition by alpha, qid order by score desc, doc_id)::int as rank from (select alpha, qid, doc_id, round(alpha * vs + (1 - alpha) * bs, 6) as score from n, (values (0.0::double), (0.7), (1.0)) a(alpha))) where rank <= 5",
)
def rt06(spark, d):
    vector, lexical = arms(spark, d)
    out = None
    for alpha in (0.0, 0.7, 1.0):
        one = R.fuse(vector, lexical, "qid", "doc_id", alpha, 5).withColumn("alpha", F.lit(alpha))
        out = one if out is None else out.unionByName(one)
    return out


@query("jn12_merge_lists", f"with {_HYBRID} select qid, doc_id, v, b from u")
def jn12(spark, d):
    from corpusmill.operators.relational import merge_candidates

    vector, lexical = arms(spark, d)
    return merge_candidates(vector.withColumnRenamed("score", "v"), lexical.withColumnRenamed("score", "b"), ["qid", "doc_id"], "v", "b")


@query("rt15_ensemble_vector", "select label, i::int as i, round(sum(x * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 5) as weight from (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by 1, 2")
def rt15(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    w = 1 + F.col("vec_id") % 3
    return rows.groupBy("label", "i").agg(F.round(F.sum(F.col("x").cast("double") * w) / F.sum(w), 5).alias("weight"))


@query(
    "rt30_cross_modal",
    f"""with {_SIM}, f as (select '1 and 3' as types, c.* from cos c join embeddings e on e.vec_id = c.doc_id where e.label in (1, 3) union all select 'all', * from cos),
    r as (select *, row_number() over (partition by types, qid order by score desc, doc_id)::int as rank from f)
    select types, qid, doc_id, score, rank, round((doc_id % 10) / 10.0::double * score, 8) as confidence from r where rank <= 5""",
)
def rt30(spark, d):
    """Two types of content, and all; a vector's stored confidence is told by its number."""
    rows = vectors(spark, d).withColumn("confidence", (F.col("doc_id") % 10) / 10.0)
    some = R.cross_modal_search(asked(spark, d), rows, "qid", "doc_id", 5, [1, 3], "label").withColumn("types", F.lit("1 and 3"))
    return some.unionByName(R.cross_modal_search(asked(spark, d), rows, "qid", "doc_id", 5, None).withColumn("types", F.lit("all")))


@query("rt34_verify_vectors", "select vec_id, round(list_cosine_similarity(embedding::double[], list_transform(embedding, lambda x: round(x::double, 2))), 4) > 0.9 as ok from embeddings")
def rt34(spark, d):
    from corpusmill.functions.vectors import cosine

    known = table(spark, d, "embeddings").select("vec_id", "embedding")
    fresh = known.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("fresh"))
    return known.join(fresh, "vec_id").select("vec_id", (F.round(cosine(F.col("embedding"), F.col("fresh")), 4) > 0.9).alias("ok"))


@query("rt13_retrieval_quality", f"with {_BENCH}, {_BM25}, t as (select * from {_TOP('b')} where rank <= 10) select qid, count(distinct source) as sources, count(*) as n, round(avg(score), 9) as mean from t join documents using (doc_id) group by 1")
def rt13(spark, d):
    hits = bench_bm25(spark, d, 10).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return hits.groupBy("qid").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"))


@query(
    "rt10_multi_stage",
    f"""with {_BENCH}, {_BM25}, a as (select * from {_TOP('b')} where rank <= 50),
    r as (select a.qid, a.doc_id, a.score, round(len(list_intersect(list_distinct({TOK('query')}), list_distinct({TOK('text')}))) / len(list_distinct({TOK('query')})), 6) as rerank, contains(text, '|') as t
    from a join documents using (doc_id) join queries using (qid)), s2 as (select *, row_number() over (partition by qid order by rerank desc, doc_id) as i from r),
    f2 as (select qid, doc_id, round(0.4 * score / 100 + 0.4 * rerank + 0.2 * t::int, 6) as score from s2 where i <= 20) select * from {_TOP('f2')} where rank <= 5""",
)
def rt10(spark, d):
    queries, docs = tables(spark, d, "benchmark", "documents")
    found = R.looked_up(bench_bm25(spark, d, 50).drop("rank"), docs, "doc_id", w=F.array_distinct(T.tokens("text")), domain=F.contains("text", F.lit("|")).cast("int"))
    first = found.join(queries.select(F.col("item_id").alias("qid"), F.array_distinct(T.tokens("text")).alias("q")), "qid")
    scored = first.withColumn("rerank", F.round(T.overlap(F.col("q"), F.col("w")), 6)).select("qid", "doc_id", "score", "rerank", "domain")
    second = R.top(scored, "qid", "doc_id", "rerank", 20).drop("rank")
    final = second.select("qid", "doc_id", F.round(0.4 * F.col("score") / 100 + 0.4 * F.col("rerank") + 0.2 * F.col("domain"), 6).alias("score"))
    return R.top(final, "qid", "doc_id", "score", 5)


_CTX = f"with {_BENCH}, {_BM25}, r as (select t.*, source, floor(len({TOK('text')}) * 1.3)::bigint as tokens from {_TOP('b')} t join documents using (doc_id) where rank <= 30)"


def contexts(spark, d):
    hits = R.looked_up(bench_bm25(spark, d, 30), table(spark, d, "documents"), "doc_id", source=F.col("source"), tokens=F.floor(F.size(T.tokens("text")) * 1.3))
    return hits.withColumnRenamed("doc_id", "key")


@query("rt25_balanced_context", _CTX + " select qid, doc_id as key, rank as position from (select *, sum(tokens) over (partition by qid order by rank) as used from r) where used <= 3000")
def rt25(spark, d):
    return R.pack_context(contexts(spark, d), "qid", "balanced", 3000)


@query("rt26_diverse_context")
def rt26(spark, d):
    return R.pack_context(contexts(spark, d), "qid", "diverse", 3000)


@query("rt27_deep_context")
def rt27(spark, d):
    return R.pack_context(contexts(spark, d), "qid", "deep", 3000)


@query("rt28_window_efficiency", _CTX + " select qid, round(0.3 * least(sum(tokens) / 30000, 1) + 0.5 * avg(score) / 100 + 0.2 * count(distinct source) / count(*), 6) as efficiency from r group by 1")
def rt28(spark, d):
    e = 0.3 * F.least(F.sum("tokens") / 30000, F.lit(1.0)) + 0.5 * F.avg("score") / 100 + 0.2 * F.countDistinct("source") / F.count("*")
    return contexts(spark, d).groupBy("qid").agg(F.round(e, 6).alias("efficiency"))


_TOLD = """(select a.conv_id, a.turn, string_agg(b.text, ' ' order by b.turn) as context, count(*) as chunks from conversations a join conversations b on a.conv_id = b.conv_id and b.turn < a.turn group by 1, 2)"""


def told(spark, d):
    """``conv_id, turn, context, chunks``: what was said before each turn; a conversation's turns are few."""
    turns = table(spark, d, "conversations")
    earlier = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("said"))
    rows = turns.join(earlier, (F.col("conv_id") == F.col("c")) & (F.col("t") < F.col("turn"))).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("t", "said"))).alias("s"))
    return rows.select("conv_id", "turn", F.array_join("s.said", " ").alias("context"), F.size("s").alias("chunks"))


@query(
    "rt21_response_confidence",
    f"""with p as (select q.*, coalesce(x.context, '') as context, coalesce(x.chunks, 0) as chunks from (select a.conv_id, a.turn, a.text as q, b.text as a from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant') q left join {_TOLD} x using (conv_id, turn))
    select conv_id, turn, round(greatest(0, least(1, 0.5::double + case when chunks > 0 then least(0.2, chunks * 0.05) + case when len(list_intersect({WORDS('lower(q)')}, {WORDS('lower(context)')})) > 0 then 0.1 else 0 end + case when len(list_intersect({WORDS('lower(a)')}, {WORDS('lower(context)')})) > 0 then 0.1 else 0 end else -0.2 end
    + case conv_id % 3 when 0 then -0.1 when 1 then 0.05 else 0 end + case when len({WORDS('a')}) < 10 then -0.1 when len({WORDS('a')}) > 50 then 0.05 else 0 end
    - case when regexp_matches(lower(a), 'i''m not sure|uncertain|maybe|possibly|i think|perhaps') then 0.15 else 0 end)), 6) as confidence from p""",
)
def rt21(spark, d):
    rows = pairs(spark, d).join(told(spark, d), ["conv_id", "turn"], "left").fillna({"context": "", "chunks": 0})
    model = F.when(F.col("conv_id") % 3 == 0, -0.1).when(F.col("conv_id") % 3 == 1, 0.05).otherwise(0.0)
    score = K.response_confidence(F.col("q"), F.col("a"), F.col("context"), F.col("chunks"), model)
    return rows.select("conv_id", "turn", F.round(score, 6).alias("confidence"))


_EVAL = f"with {_BENCH}, {_BM25}, h as (select t.qid, rank, contains(lower(text), lower(query)) as relevant from {_TOP('b')} t join documents using (doc_id) join queries using (qid) where rank <= 10)"


def judged(spark, d):
    queries, docs = tables(spark, d, "benchmark", "documents")
    hits = bench_bm25(spark, d, 10).join(docs.select("doc_id", "text"), "doc_id").join(queries.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "qid")
    return hits.select("qid", "rank", F.contains(F.lower("text"), F.lower("query")).alias("relevant"))


_METRICS = """m as (select qid, max(case when rank <= 5 then relevant::int else 0 end) as hit, coalesce(1.0 / min(rank) filter (where relevant), 0) as mrr,
    sum(case when rank <= 5 and relevant then 1.0 / log2(rank + 1) else 0 end) as dcg, least(count(*) filter (where relevant), 5) as ideal from h group by 1),
    e as (select qid, hit, round(mrr, 6) as mrr, case when ideal = 0 then 0.0 else round(dcg / list_sum(list_transform(range(1, ideal + 1), lambda i: 1.0 / log2(i + 1.0))), 6) end as ndcg from m)"""


@query("ev01_ranking_metrics", _EVAL + ", " + _METRICS + " select * from e")
def ev01(spark, d):
    return E.ranking_metrics(judged(spark, d), "qid", 5)


@query("ev06_mean_metrics", _EVAL + ", " + _METRICS + " select round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from e")
def ev06(spark, d):
    m = E.ranking_metrics(judged(spark, d), "qid", 5)
    return m.agg(F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


_NAMED = f"""with {_BENCH}, {_BM25}, truth as (select distinct item_id as qid, source from benchmark join documents on doc_id in (item_id, item_id + 1)), h as (select t.qid, rank, source, g.source is not null as relevant
    from {_TOP('b')} t join documents using (doc_id) left join truth g using (qid, source) where rank <= 5), n as (select qid, count(*) as truths from truth group by 1)"""


def named(spark, d):
    """The five best documents of each passage by source, and the sources that are right: those of two documents of its number."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array("item_id", F.col("item_id") + 1)).alias("doc_id"))
    truth = bench.join(docs, "doc_id").select("qid", "source").distinct()
    return bench_bm25(spark, d, 5).join(docs, "doc_id"), truth


@query("ev04_recall_precision", _NAMED + " select qid, round(count(distinct source) filter (where relevant) / count(*), 6) as precision, round(count(distinct source) filter (where relevant) / any_value(truths), 6) as recall from h join n using (qid) group by 1")
def ev04(spark, d):
    return E.set_metrics(*named(spark, d), "qid", "source", 5)


@query(
    "ev05_ndcg_variant",
    _NAMED + """, g as (select qid, any_value(truths) as truths, sum(case when relevant then case when rank = 1 then 1.0::double else 1 / log2(rank) end else 0 end) as dcg from h join n using (qid) group by 1)
    select qid, round(dcg / list_sum(list_transform(range(1, least(truths, 5) + 1), lambda i: case when i = 1 then 1.0::double else 1 / log2(i) end)), 6) as ndcg from g""",
)
def ev05(spark, d):
    return E.listed_ndcg(*named(spark, d), "qid", "source", 5)


@query(
    "ev08_win_loss",
    f"""with {_HYBRID}, g as (select vs - bs as g from n), c as (select count(*) filter (where g > 0.05) as wins, count(*) filter (where g < -0.05) as losses, count(*) filter (where abs(g) <= 0.05) as ties, count(*) as t from g),
    x as (select *, (pow(wins - t / 2, 2) + pow(losses - t / 2, 2)) / (t / 2) as chi, wins / t as w, losses / t as l from c)
    select wins, losses, ties, round(1 - chi / (chi + 1), 6) as p, round(w - l - 1.96 * sqrt((w * (1 - w) + l * (1 - l)) / t), 6) as low, round(w - l + 1.96 * sqrt((w * (1 - w) + l * (1 - l)) / t), 6) as high from x""",
)
def ev08(spark, d):
    vector, lexical = arms(spark, d)
    v, b = (R.fuse(vector, lexical, "qid", "doc_id", a, 1000).select("qid", "doc_id", F.col("score").alias(n)) for a, n in ((1.0, "v"), (0.0, "b")))
    return E.wins(v.join(b, ["qid", "doc_id"]), "v", "b")


@query(
    "ev09_two_sample",
    """with s as (select avg(value) filter (where event_type = 'click') as a, avg(value) filter (where event_type = 'view') as b, var_pop(value) filter (where event_type = 'click') as va,
    var_pop(value) filter (where event_type = 'view') as vb, count(value) filter (where event_type = 'click') as na, count(value) filter (where event_type = 'view') as nb from events)
    select round(a, 6) as mean_a, round(b, 6) as mean_b, round((a - b) / sqrt((na * va + nb * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) as t, na + nb - 2 as df,
        round((a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as d, round(sqrt(va / na + vb / nb), 9) as error, na, nb from s""",
)
def ev09(spark, d):
    return E.two_sample(table(spark, d, "events"), "event_type", "value", "click", "view")


@query("ev09_significance")
def ev09_significance(spark, d):
    """p, interval and label of the same two groups, and of two that differ."""
    events = table(spark, d, "events")
    shifted = events.withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 15).otherwise(F.col("value")))
    both = [E.significance(E.two_sample(df, "event_type", "value", "click", "view")).withColumn("test", F.lit(name)) for name, df in (("as is", events), ("shifted", shifted))]
    return both[0].unionByName(both[1])


_KEYS = ["the", "de", "und", "en"]


@query("ev10_keyword_gate", "select conv_id, turn, round(len(list_filter(['the', 'de', 'und', 'en'], lambda k: contains(lower(text), k))) / 4, 6) as score, contains(lower(text), 'the') and contains(lower(text), 'en') and not contains(text, '|') as pass from conversations")
def ev10(spark, d):
    has = F.filter(F.array(*map(F.lit, _KEYS)), lambda k: F.contains(F.lower("text"), k))
    gate = F.contains(F.lower("text"), F.lit("the")) & F.contains(F.lower("text"), F.lit("en")) & ~F.contains("text", F.lit("|"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(F.size(has) / 4, 6).alias("score"), gate.alias("pass"))


_PAIRS = "(select a.conv_id, a.turn, a.text as q, b.text as a from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"


@query(
    "ev16_token_f1",
    f"with t as (select conv_id, turn, list_distinct({TOK('q')}) as x, list_distinct({TOK('a')}) as y, q = a as exact from {_PAIRS}), m as (select *, len(list_intersect(x, y)) as c from t) select conv_id, turn, exact, round(c / nullif(len(y), 0), 6) as precision, round(c / nullif(len(x), 0), 6) as recall, round(2 * c / nullif(len(x) + len(y), 0), 6) as f1 from m",
)
def ev16(spark, d):
    x, y = F.array_distinct(T.tokens("q")), F.array_distinct(T.tokens("a"))
    c = F.size(F.array_intersect(x, y))
    r = lambda n: F.round(F.try_divide(c, n), 6)
    return pairs(spark, d).select("conv_id", "turn", (F.col("q") == F.col("a")).alias("exact"), r(F.size(y)).alias("precision"), r(F.size(x)).alias("recall"), F.round(F.try_divide(2 * c, F.size(x) + F.size(y)), 6).alias("f1"))


@query("ev17_word_coverage", f"select conv_id, turn, case when q = a then 100.0 else round(100.0 * len(list_intersect({TOK('q')}, {TOK('a')})) / nullif(len(list_distinct({TOK('q')})), 0), 6) end as coverage from {_PAIRS}")
def ev17(spark, d):
    x = T.tokens("q")
    share = F.round(F.try_divide(100.0 * F.size(F.array_intersect(x, T.tokens("a"))), F.size(F.array_distinct(x)).cast("double")), 6)
    return pairs(spark, d).select("conv_id", "turn", F.when(F.col("q") == F.col("a"), F.lit(100.0)).otherwise(share).alias("coverage"))


@query(
    "ev19_known_source",
    f"with {_SIM}, t as (select t.qid, t.rank, t.score, a.label = b.label as same from {_TOP('cos')} t join embeddings a on a.vec_id = t.qid join embeddings b on b.vec_id = t.doc_id where rank <= 10) select qid, max((rank <= 1 and same)::int) as r1, max((rank <= 3 and same)::int) as r3, max((rank <= 5 and same)::int) as r5, max(same::int) as r10, round(avg(score) filter (where same), 9) as mean from t group by 1",
)
def ev19(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = R.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 10)
    hits = hits.join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b")), "doc_id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("a")), "qid")
    same = F.col("a") == F.col("b")
    at = lambda k: F.max(((F.col("rank") <= k) & same).cast("int")).alias(f"r{k}")
    return hits.groupBy("qid").agg(at(1), at(3), at(5), at(10), F.round(F.avg(F.when(same, F.col("score"))), 9).alias("mean"))
