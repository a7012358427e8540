"""Score formulas, expansions, comparisons and dataset rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import mining as M
from corpusmill.operators import questions as Q
from corpusmill.operators import ranking as K
from corpusmill.operators import relational as R
from corpusmill.operators import retrieval as RT
from corpusmill.plans.retrieval import _BENCH, _BM25, _HYBRID, _SIM, _TOP, arms, asked, bench_bm25, vectors
from corpusmill.plans.text import COLL, SENT, TOK, WORDS, cascade, pairs
from corpusmill.registry import query
from corpusmill.sources.tables import table, tables

C, D = "conversations", "documents"
_VERSIONS = ["4.16", "4.15", "4.14"]


@query(
    "ag30_strategy_comparison",
    f"""with c as (select 'lines' as strategy, unnest(string_split(text, chr(10))) as x from documents union all select 'sentences', unnest({SENT('text')}) from documents)
    select strategy, count(*) as n, round(avg(length(x)), 4) as mean, round(avg(len({WORDS('x')})), 4) as mean_words, count(*) filter (where regexp_matches(x, '[A-Z]{{2,}}|[0-9]+[.][0-9]+')) as technical, count(*) filter (where length(x) < 40) as short, count(*) filter (where length(x) between 40 and 400) as normal, count(*) filter (where length(x) > 400) as long from c group by 1""",
)
def ag30(spark, d):
    docs = table(spark, d, D)
    one = lambda name, x: docs.select(F.lit(name).alias("strategy"), F.explode(x).alias("x"))
    both = one("lines", F.split("text", "\n")).unionByName(one("sentences", T.sentences("text")))
    n = F.length("x")
    return both.groupBy("strategy").agg(
        F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.avg(F.size(T.split_words("x"))), 4).alias("mean_words"), F.count_if(F.col("x").rlike("[A-Z]{2,}|[0-9]+[.][0-9]+")).alias("technical"),
        F.count_if(n < 40).alias("short"), F.count_if(n.between(40, 400)).alias("normal"), F.count_if(n > 400).alias("long"),
    )


@query("ag35_embedding_store", "select label, count(*) as n, list_sort(list(distinct len(embedding)::int)) as dimensions, round(avg(embedding[1]::double), 5) as mean_first from embeddings group by 1")
def ag35(spark, d):
    first = F.get("embedding", F.lit(0)).cast("double")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.size("embedding"))).alias("dimensions"), F.round(F.avg(first), 5).alias("mean_first"))


@query("ag42_document_statistics", "select lang, source, count(*) as n, max(doc_id) as last, round(sum(n_chars) / count(*), 1) as per_document from documents group by grouping sets ((lang, source))")
def ag42(spark, d):
    return table(spark, d, D).groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.round(F.try_divide(F.sum("n_chars"), F.count("*")), 1).alias("per_document"))


@query("ag26_routing", "with m(event_type, expected) as (values ('click', 0), ('view', 1), ('error', 2), ('signup', 3), ('purchase', 4)) select event_type, round(avg((user_id % 5 = expected)::int), 6) as accuracy, count(*) / sum(count(*)) over () as share from events join m using (event_type) group by 1")
def ag26(spark, d):
    expected = F.broadcast(spark.createDataFrame([("click", 0), ("view", 1), ("error", 2), ("signup", 3), ("purchase", 4)], "event_type string, expected int"))
    rows = table(spark, d, "events").join(expected, "event_type").groupBy("event_type")
    out = rows.agg(F.round(F.avg((F.col("user_id") % 5 == F.col("expected")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))
    return out.select("event_type", "accuracy", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("wn10_trailing", "select event_id from (select event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as i from events) where i <= 50")
def wn10(spark, d):
    return R.trailing(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id")


@query("wn12_series_index", "select event_id, row_number() over (partition by user_id order by ts, event_id)::int - 1 as i from events")
def wn12(spark, d):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select("event_id", i.alias("i"))


@query("so02_paging", "select conv_id, turn, 1.0::double * length(text) as n, (select count(*) from conversations) as total, (select count(*) from conversations) > 70 as has_more from conversations order by n desc, conv_id, turn limit 50 offset 20")
def so02(spark, d):
    c = table(spark, d, C).select("conv_id", "turn", F.length("text").cast("double").alias("n"))
    total = c.agg(F.count("*").alias("total"))
    page = c.orderBy(F.desc("n"), "conv_id", "turn").offset(20).limit(50)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > 70)


@query("so03_dynamic_sort", "select doc_id, n_chars, (select count(*) from documents) as total, (select count(*) from documents) > 30 as has_more from documents order by n_chars, doc_id limit 30")
def so03(spark, d):
    return R.paged(table(spark, d, D).select("doc_id", "n_chars"), "n_chars", ("n_chars",), "doc_id", "doc_id", limit=30, descending=False)


@query("so05_frequency_top", f"select t as term, count(*) as n from (select unnest({TOK('text')}) as t from documents) group by 1 order by n desc, term limit 100")
def so05(spark, d):
    return M.term_counts(table(spark, d, D), "text", [T.WORD], 100)


@query("se03_change_union", "select doc_id, 'en' as tag from documents where lang = 'en' union all select doc_id, 'long' from documents where n_chars > 5000 union all select doc_id, 'hot' from documents where source = 'src0'")
def se03(spark, d):
    docs = table(spark, d, D)
    parts = [docs.filter("lang = 'en'").withColumn("tag", F.lit("en")), docs.filter("n_chars > 5000").withColumn("tag", F.lit("long")), docs.filter("source = 'src0'").withColumn("tag", F.lit("hot"))]
    return reduce(lambda a, b: a.unionByName(b), (p.select("doc_id", "tag") for p in parts))


@query("fn25_calibrated", "with p as (select doc_id, 1 / (1 + exp(-((n_chars % 100) / 50.0 - 1)))::double as p from documents), t as (select doc_id, pow(p, 1 / 1.5) as a, pow(1 - p, 1 / 1.5) as b from p) select doc_id, round(0.8 * greatest(a, b) / (a + b) + 0.2 * least(1, ln(1 + doc_id % 10) / ln(10)), 4) as confidence from t")
def fn25(spark, d):
    p = 1 / (1 + F.exp(-((F.col("n_chars") % 100) / 50.0 - 1)))
    scaled = F.map_values(F.transform_values(F.create_map(F.lit("a"), p, F.lit("b"), 1 - p), lambda _, v: F.pow(v, F.lit(1 / 1.5))))
    top = F.array_max(scaled) / F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)
    rich = F.least(F.lit(1.0), F.log1p((F.col("doc_id") % 10).cast("double")) / F.log(F.lit(10.0)))
    return table(spark, d, D).select("doc_id", F.round(0.8 * top + 0.2 * rich, 4).alias("confidence"))


_GROUPS = {"error": ["failure", "fault"], "install": ["setup", "deploy"], "the": ["il", "los"], "und": ["sowie"]}


@query(
    "tx08_expansion",
    "with g(t, x) as (values " + ", ".join(f"('{k}', {v})" for k, v in _GROUPS.items()) + ") select conv_id, turn, list_sort(list_distinct(flatten(list(x)))) as expansions from conversations join g on contains(lower(text), t) group by 1, 2",
)
def tx08(spark, d):
    lexicon = F.broadcast(spark.createDataFrame(list(_GROUPS.items()), "t string, x array<string>"))
    rows = table(spark, d, C).select("conv_id", "turn", F.lower("text").alias("low")).crossJoin(lexicon).filter(F.contains("low", "t"))
    return rows.groupBy("conv_id", "turn").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("x")))).alias("expansions"))


@query("tx11_fusion_weights", "select conv_id, turn, case when regexp_matches(text, '[0-9]') then 0.5::double when length(text) < 60 then 0.4 else 0.7 end - case when len(" + WORDS("text") + ") > 2 then 0.1 else 0 end as alpha from conversations")
def tx11(spark, d):
    base = F.when(F.col("text").rlike("[0-9]"), 0.5).when(F.length("text") < 60, 0.4).otherwise(0.7)
    return table(spark, d, C).select("conv_id", "turn", (base - F.when(F.size(T.split_words("text")) > 2, 0.1).otherwise(0.0)).alias("alpha"))


@query("tx13_question_type", "select conv_id, turn, " + cascade(K.QUESTION_TYPES, "text", "factual") + " as kind, case when length(text) > 400 then 'complex' when length(text) < 80 then 'simple' else 'moderate' end as complexity from conversations")
def tx13(spark, d):
    size = M.first_match([("complex", F.length("text") > 400), ("simple", F.length("text") < 80)], "moderate")
    return table(spark, d, C).select("conv_id", "turn", K.first_class(F.col("text"), K.QUESTION_TYPES, "factual").alias("kind"), size.alias("complexity"))


#: The tiers with words of the generated prose, which asks no questions.
_TIERS = {k: v + more for (k, v), more in zip(Q.TIERS.items(), (["the ", "la "], [" und ", " of ", " de "], ["thing", "ción", "ung "]))}


def _level(text: str) -> str:
    """SQL of a question's complexity."""
    plain = "lower(regexp_replace(" + COLL(text) + ", '[?!.]+$', ''))"
    held = lambda words: " + ".join(f"contains({plain}, '{w}')::int" for w in words)
    tiers = " + ".join(f"case when {held(words)} > 0 then {i + 1} else 0 end" for i, words in enumerate(_TIERS.values()))
    score = f"({tiers} + len(regexp_extract_all({plain}, '[?]')) + {held(Q.CONDITIONS)})"
    return f"case when {score} >= 4 then 'complex' when {score} >= 2 then 'moderate' else 'simple' end"


@query(
    "tx16_decomposition",
    rf"""with q as (select conv_id, turn, {_level('text')} as complexity, len({WORDS('text')}) as words, {SENT('text')} as s,
        list_filter(list_transform(regexp_split_to_array(text, '(?i)\s+(?:and|or)\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as c from conversations),
    r as (select conv_id, turn, complexity, case when words >= 15 and complexity <> 'simple' then case when len(s) > 1 then s when len(c) > 1 then c end end as parts,
        greatest(0.5::double, (case when len(s) > 1 then 0.8::double else 0.7 end) * (case when words < 20 then 0.9::double when words > 100 then 0.85 else 1 end)) as confidence from q),
    e as (select conv_id, turn, complexity, confidence, len(parts) as n, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as i from r where parts is not null),
    w as (select *, {_level('part')} as level, array_to_string({WORDS('part')}[1:3], ' ') as topic, pow(2, greatest(0, ceil(log2(n / 10.0) - 1e-9))) as step from e),
    a as (select *, floor(i / step)::int as at_, greatest(0, ceil(n / step)::int - 5) as over_ from w),
    g as (select *, case when at_ < 2 * over_ then at_ // 2 else at_ - over_ end + 1 as place from a)
    select conv_id, turn, complexity, least(n, 5)::int as n_parts, round(confidence, 6) as confidence, place::int as i, string_agg(part, ' and ' order by i) as part, max(level) as part_complexity, string_agg(topic, ' + ' order by i) as topic from g group by all
    union all select conv_id, turn, complexity, 0, 1.0::double, null, null, null, null from r where parts is null""",
)
def tx16(spark, d):
    return Q.decompose(table(spark, d, C), ["conv_id", "turn"], "text", _TIERS)


_LINES = "len(string_split(text, chr(10)))"
_BULLETS = r"len(regexp_extract_all(text, '(?m)^[-*#|].*$'))"


@query(
    "tx25_priority",
    f"""with f as (select doc_id, case when contains(lower(text), 'license') then 'manual' when contains(text, '|') then 'report' else 'unknown' end as kind, {_LINES} as sections, {_BULLETS} as bullets, length(text) as n,
    len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1) as upper, len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) as digits,
    (contains(lower(text), 'token')::int + contains(lower(text), 'http')::int + contains(text, '@')::int) / 2 as domain from documents)
    select doc_id, round(least(1, 0.35::double * least(1, (sections + bullets / 2) / 25) + 0.3 * least(1, ln(1 + n) / 8) + 0.2 * (1 - abs(upper - 0.1)) + 0.15 * least(1, digits * 5)), 4) as quality,
    round(least(1, 0.4::double * case kind when 'manual' then 0.85 when 'report' then 0.75 else 0.5 end + 0.25 * least(1, (sections + bullets / 2) / 20) + 0.2 * domain / 6 + 0.15 * least(1, ln(1 + n) / 8)), 4) as priority from f""",
)
def tx25(spark, d):
    low, n = F.lower("text"), F.length("text")
    kind = F.when(F.contains(low, F.lit("license")), "manual").when(F.contains("text", F.lit("|")), "report").otherwise("unknown")
    share = lambda p: F.regexp_count("text", F.lit(p)) / F.greatest(n, F.lit(1))
    lines, bullets = F.size(F.split("text", "\n")), F.regexp_count("text", F.lit("(?m)^[-*#|].*$"))
    domain = (F.contains(low, F.lit("token")).cast("int") + F.contains(low, F.lit("http")).cast("int") + F.contains("text", F.lit("@")).cast("int")) / 2
    return table(spark, d, D).select("doc_id", K.quality(lines, bullets, n, share("[A-Z]"), share("[0-9]")).alias("quality"), K.priority(kind, lines, bullets, domain, n).alias("priority"))


_AUDIT = {"ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "mail": "[a-z0-9._]+@[a-z0-9]+[.][a-z]+", "key": "[0-9a-f]{32,}"}


@query("tx49_audit", "select unnest([" + ", ".join(f"{{'pattern': '{k}', 'matches': sum(len(regexp_extract_all(text, '{p}')))::bigint, 'documents': count(*) filter (where regexp_matches(text, '{p}'))}}" for k, p in _AUDIT.items()) + "], recursive := true) from documents")
def tx49(spark, d):
    counts = F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in _AUDIT.items()))
    rows = table(spark, d, D).select(F.explode(counts).alias("c")).select("c.*")
    return rows.groupBy("pattern").agg(F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("documents"))


@query("tx52_indicators", "select doc_id, list_filter([case when contains(text, '|') then 'table' end, case when contains(text, '@') then 'contact' end, case when regexp_matches(text, '[0-9]{4}') then 'number' end], lambda x: x is not null) as indicators from documents")
def tx52(spark, d):
    flags = F.array(F.when(F.contains("text", F.lit("|")), "table"), F.when(F.contains("text", F.lit("@")), "contact"), F.when(F.col("text").rlike("[0-9]{4}"), "number"))
    return table(spark, d, D).select("doc_id", F.array_compact(flags).alias("indicators"))


@query("rt07_corpus_fusion", f"with {_BENCH}, {_BM25}, m as (select min(score) as lo, max(score) as hi from b), f4 as (select qid, doc_id, round((score - lo) / (hi - lo + 1e-10), 6) as score from b, m) select * from {_TOP('f4')} where rank <= 5")
def rt07(spark, d):
    queries, docs = tables(spark, d, "benchmark", D)
    scored = RT.bm25(queries.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), docs, "qid", "doc_id", "text")
    bounds = F.broadcast(scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    scaled = scored.crossJoin(bounds).select("qid", "doc_id", F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10), 6).alias("score"))
    return RT.top(scaled, "qid", "doc_id", "score", 5)


DOMAIN = {"common": ["the", "und", "que"], "endings": ["tion", "ment", "heit"], "codes": ["src1", "src2", "en"]}
_MATCHED = " + ".join(
    "case when " + " or ".join(f"contains(lower(query), '{t}')" for t in ts) + " then " + " + ".join(f"contains(lower(text), '{t}')::int + 0.5 * contains(name, '{t}')::int" for t in ts) + " else 0 end" for ts in DOMAIN.values()
)
_VERSION = " or ".join(f"contains(lower({{0}}), '{v}')" for v in _VERSIONS)


@query(
    "rt11_domain_score",
    f"""with {_BENCH}, {_BM25}, t as (select t.qid, t.doc_id, query, text, source || '-' || lang as name from {_TOP('b')} t join documents using (doc_id) join queries using (qid) where rank <= 10)
    select qid, doc_id, round(least(({_MATCHED} + case when ({_VERSION.format('query')}) and ({_VERSION.format('text')}) then 2 else 0 end + case when contains(name, '-en') and contains(lower(query), 'the') then 1.5 when contains(name, '-de') and contains(lower(query), 'und') then 1.5 else 0 end) / 10, 1)::double, 6) as domain from t""",
)
def rt11(spark, d):
    """For each category that the question names, one for each of its terms in the text and a half for each in the name; two for a
    version where the question has one; 1.5 for the kind of document that it asks for; a tenth of the sum, 1 at most."""
    bench, docs = tables(spark, d, "benchmark", D)
    named = docs.select("doc_id", F.lower("text").alias("c"), F.concat_ws("-", "source", "lang").alias("name"))
    rows = bench_bm25(spark, d, 10).join(named, "doc_id").join(bench.select(F.col("item_id").alias("qid"), F.lower("text").alias("q")), "qid")
    has = lambda column, terms: reduce(lambda a, b: a | b, (F.contains(column, F.lit(t)) for t in terms))
    inside = lambda terms: sum(F.contains("c", F.lit(t)).cast("int") + 0.5 * F.contains("name", F.lit(t)).cast("int") for t in terms)
    score = sum(F.when(has("q", terms), inside(terms)).otherwise(0.0) for terms in DOMAIN.values())
    score = score + F.when(has("q", _VERSIONS) & has("c", _VERSIONS), 2.0).otherwise(0.0)
    score = score + F.when(has("name", ["-en"]) & has("q", ["the"]), 1.5).when(has("name", ["-de"]) & has("q", ["und"]), 1.5).otherwise(0.0)
    return rows.select("qid", "doc_id", F.round(F.least(score / 10, F.lit(1.0)), 6).alias("domain"))


@query(
    "rt12_rerank_fallback",
    f"""with {_BENCH}, {_BM25}, t as (select * from {_TOP('b')} where rank <= 20), r as (select t.qid, t.doc_id, score, case when t.qid % 5 <> 0 then len(list_intersect(list_distinct({TOK('query')}), list_distinct({TOK('text')}))) / len(list_distinct({TOK('query')})) end as rerank
    from t join documents using (doc_id) join queries using (qid)), f2 as (select qid, doc_id, round(coalesce(rerank, score), 6) as score from r) select * from {_TOP('f2')} where rank <= 5""",
)
def rt12(spark, d):
    """Token overlap reranks the first stage; where the reranker gave nothing (every fifth question) its order stays."""
    queries, docs = tables(spark, d, "benchmark", D)
    rows = RT.looked_up(bench_bm25(spark, d, 20), docs, "doc_id", w=T.tokens("text")).join(queries.select(F.col("item_id").alias("qid"), T.tokens("text").alias("q")), "qid")
    rerank = F.when(F.col("qid") % 5 != 0, T.overlap(F.col("q"), F.col("w")))
    return RT.top(rows.select("qid", "doc_id", F.round(F.coalesce(rerank, "score"), 6).alias("score")), "qid", "doc_id", "score", 5)


@query("rt14_ensemble_weights", "with w as (select conv_id, turn, m, (case m when 'a' then 0.5 when 'b' then 0.3 else 0.2 end * case when m = 'a' and contains(text, '?') then 1.5 when m = 'b' and length(text) > 200 then 1.3 else 1 end)::double as w from conversations, (values ('a'), ('b'), ('c')) v(m)) select conv_id, turn, m, round(w / sum(w) over (partition by conv_id, turn), 6) as weight from w")
def rt14(spark, d):
    models = F.broadcast(spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "m string, base double"))
    boost = F.when((F.col("m") == "a") & F.contains("text", F.lit("?")), 1.5).when((F.col("m") == "b") & (F.length("text") > 200), 1.3).otherwise(1.0)
    rows = table(spark, d, C).crossJoin(models).withColumn("w", F.col("base") * boost)
    return rows.select("conv_id", "turn", "m", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("conv_id", "turn")), 6).alias("weight"))


_ASKS = ["the", "und", "que"]


@query(
    "rt16_ensemble_score",
    f"""with {_SIM}, t as (select t.qid, t.doc_id, t.score, lower(a.text) as q, lower(b.text) as c, a.lang as ql, b.lang as cl from {_TOP('cos')} t join documents a on a.doc_id = t.qid join documents b on b.doc_id = t.doc_id where rank <= 10)
    select qid, doc_id, round(score + 3 * 0.05 + case when regexp_matches(q, 'the|und|que') and regexp_matches(c, 'the|und|que') then 0.1 else 0 end
    + case when (contains(q, '4.16') and contains(c, '4.16')) or (contains(q, '4.15') and contains(c, '4.15')) or (contains(q, '4.14') and contains(c, '4.14')) then 0.15 else 0 end + case when ql = cl then 0.1 else 0 end, 6) as ensemble from t""",
)
def rt16(spark, d):
    """Similarity and 0.05 a model, 0.1 if question and text hold words of the domain, 0.15 for a shared version, 0.1 for the right kind of document."""
    docs = table(spark, d, D).select("doc_id", F.lower("text").alias("c"), F.col("lang").alias("cl"))
    hits = RT.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 10).join(docs, "doc_id").join(docs.select(F.col("doc_id").alias("qid"), F.col("c").alias("q"), F.col("cl").alias("ql")), "qid")
    words = "|".join(_ASKS)
    version = reduce(lambda a, b: a | b, (F.contains("q", F.lit(v)) & F.contains("c", F.lit(v)) for v in _VERSIONS))
    bonus = lambda c, w: F.when(c, w).otherwise(0.0)
    score = F.col("score") + 3 * 0.05 + bonus(F.col("q").rlike(words) & F.col("c").rlike(words), 0.1) + bonus(version, 0.15) + bonus(F.col("ql") == F.col("cl"), 0.1)
    return hits.select("qid", "doc_id", F.round(score, 6).alias("ensemble"))


@query(
    "rt17_accuracy_estimate",
    f"""with {_SIM}, t as (select t.qid, t.score, t.rank, lower(b.text) as c, a.lang || '-' || a.source as wanted, a.lang as kind, b.lang || '-' || b.source as name from {_TOP('cos')} t join documents a on a.doc_id = t.qid join documents b on b.doc_id = t.doc_id where rank <= 5),
    m as (select qid, sum(((contains(c, 'the')::int + contains(c, 'und')::int + contains(c, 'que')::int) / 3) * 5) filter (where rank <= 3) as terms, sum(case when contains(name, kind) then 3 when contains(name, 'src1') then 1 else 0 end) filter (where rank <= 3) as kinds,
    case when count(*) >= 3 and min(score) filter (where rank <= 3) > 0 then min(score) filter (where rank <= 3) / max(score) filter (where rank <= 3) * 5 else 0 end as even, avg(score) filter (where score > 0) as sure, max(score) as best,
    count(*) filter (where rank <= 3 and (contains(name, kind) or contains(name, 'src1'))) / 3 as right_kind from t group by 1)
    select qid, round(least(99.0, 80 + 0.8 * 10 + coalesce(terms, 0) + kinds + even), 6) as accuracy, round(least(1, (0.8 + case when best > 0 then least(sure, 1) else 0.5 end + right_kind) / 3), 6) as confidence from m""",
)
def rt17(spark, d):
    """80, ten times the sureness of the question's class, five for terms found and three or one for the document's name in each of the
    first three hits, five for even scores; 99 at most. Confidence: mean of sureness, scores and share of right names."""
    docs = table(spark, d, D).select("doc_id", F.lower("text").alias("c"), F.concat_ws("-", "lang", "source").alias("name"), "lang")
    hits = RT.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 5).join(docs.drop("lang"), "doc_id").join(docs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("kind")), "qid")
    first = F.col("rank") <= 3
    terms = sum(F.contains("c", F.lit(t)).cast("int") for t in ("the", "und", "que")) / 3 * 5
    named, generic = F.contains("name", "kind"), F.contains("name", F.lit("src1"))
    low, high = F.min(F.when(first, F.col("score"))), F.max(F.when(first, F.col("score")))
    m = hits.groupBy("qid").agg(
        F.coalesce(F.sum(F.when(first, terms)), F.lit(0.0)).alias("terms"),
        F.sum(F.when(first, F.when(named, 3).when(generic, 1).otherwise(0))).alias("kinds"),
        F.when((F.count("*") >= 3) & (low > 0), F.try_divide(low, high) * 5).otherwise(0.0).alias("even"),
        F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("sure"),
        F.max("score").alias("best"),
        (F.count_if(first & (named | generic)) / 3).alias("right_kind"),
    )
    sure = F.when(F.col("best") > 0, F.least("sure", F.lit(1.0))).otherwise(0.5)
    accuracy = F.least(F.lit(99.0), 80 + 0.8 * 10 + F.col("terms") + F.col("kinds") + F.col("even"))
    return m.select("qid", F.round(accuracy, 6).alias("accuracy"), F.round(F.least(F.lit(1.0), (0.8 + sure + F.col("right_kind")) / 3), 6).alias("confidence"))


REASONING = {"analysis": ["the", "and"], "synthesis": ["tion", "und"], "comparison": ["versus", "que"]}
_BOOST = " * ".join("case when " + "(" + " or ".join(f"contains(lower(q), '{t}')" for t in ts) + ") and (" + " or ".join(f"contains(lower(a), '{t}')" for t in ts) + ") then 1.2::double else 1 end" for ts in REASONING.values())


@query(
    "rt24_context_score",
    f"""select conv_id, turn, round(0.4 * least(1, overlap * {_BOOST}) + 0.3 * pow(0.5, turn) + 0.3 * least(1, ln(turn + 2) / ln(10)), 6) as score from (select *, case when len(x) = 0 then 0.0 else len(list_intersect(x, y)) / len(x) end as overlap
    from (select a.conv_id, a.turn, a.text as q, b.text as a, list_distinct({WORDS('lower(a.text)')}) as x, list_distinct({WORDS('lower(b.text)')}) as y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'))""",
)
def rt24(spark, d):
    """0.4 overlap, a fifth more for each group of reasoning words that question and text share, 0.3 recency, 0.3 frequency."""
    has = lambda c, terms: reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(t)) for t in terms))
    boost = reduce(lambda a, b: a * b, (F.when(has("q", ts) & has("a", ts), 1.2).otherwise(1.0) for ts in REASONING.values()))
    overlap = T.overlap(T.split_words(F.lower("q")), T.split_words(F.lower("a")))
    score = 0.4 * F.least(F.lit(1.0), overlap * boost) + 0.3 * F.pow(F.lit(0.5), "turn") + 0.3 * T.frequency(F.col("turn") + 1)
    return pairs(spark, d).select("conv_id", "turn", F.round(score, 6).alias("score"))


@query("rt29_chunk_cap", "select doc_id, least(greatest(1, (n_chars - 2000) // 1000), 8)::bigint as cap from documents")
def rt29(spark, d):
    return table(spark, d, D).select("doc_id", F.least(F.greatest(F.lit(1), F.floor((F.col("n_chars") - 2000) / 1000)), F.lit(8)).alias("cap"))


@query("rt32_type_diversity", f"with {_SIM}, t as (select * from {_TOP('cos')} where rank <= 10) select qid, count(distinct label) / 10 as diversity from t join embeddings on vec_id = doc_id group by 1")
def rt32(spark, d):
    hits = RT.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 10).join(vectors(spark, d).select("doc_id", "label"), "doc_id")
    return hits.groupBy("qid").agg((F.countDistinct("label") / 10).alias("diversity"))


@query("ev07_alpha_sweep", f"with {_HYBRID}, f3 as (select alpha, qid, doc_id, row_number() over (partition by alpha, qid order by round(alpha * vs + (1 - alpha) * bs, 6) desc, doc_id) as rank from n, (values (0.0::double), (0.5), (1.0)) a(alpha)) select alpha, round(avg(len(list_intersect(list_distinct({TOK('query')}), list_distinct({TOK('text')}))) / len(list_distinct({TOK('query')}))), 5) as share from f3 join documents using (doc_id) join queries using (qid) where rank <= 5 and len({TOK('query')}) > 0 group by 1")
def ev07(spark, d):
    docs = table(spark, d, D)
    asked_texts = docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    vector, lexical = arms(spark, d)
    fused = reduce(lambda a, b: a.unionByName(b), (RT.fuse(vector, lexical, "qid", "doc_id", x, 5).withColumn("alpha", F.lit(x)) for x in (0.0, 0.5, 1.0)))
    rows = fused.join(docs.select("doc_id", "text"), "doc_id").join(asked_texts, "qid").filter(F.size(T.tokens("query")) > 0)
    return rows.groupBy("alpha").agg(F.round(F.avg(T.overlap(T.tokens("query"), T.tokens("text"))), 5).alias("share"))


@query(
    "ev13_method_summary",
    "with s as (select event_type as method, avg(value) as m, avg((value < 100)::int) as r from events group by 1) select method, round(m, 6) as mean, round(r, 6) as reliability, method = (select method from s order by m, method limit 1) as fastest, method = (select method from s order by r desc, method limit 1) as most_reliable, m < 1.2 * (select m from s where method = 'view') as advised from s",
)
def ev13(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("m"), F.avg((F.col("value") < 100).cast("int")).alias("r"))
    best = s.agg(
        F.min_by("method", F.struct("m", "method")).alias("first"), F.min_by("method", F.struct(-F.col("r"), "method")).alias("sure"), F.max(F.when(F.col("method") == "view", F.col("m"))).alias("base")
    )
    rows = s.crossJoin(F.broadcast(best))
    return rows.select(
        "method", F.round("m", 6).alias("mean"), F.round("r", 6).alias("reliability"), (F.col("method") == F.col("first")).alias("fastest"), (F.col("method") == F.col("sure")).alias("most_reliable"), (F.col("m") < 1.2 * F.col("base")).alias("advised")
    )


@query("ev18_response_quality", "select role, round(avg(case when length(text) between 50 and 500 then 0.4 else 0.1 end + case when contains(text, '.') then 0.3 else 0 end + 0.3 * (not contains(lower(text), 'unknown'))::int), 6) as quality from conversations group by 1")
def ev18(spark, d):
    score = F.when(F.length("text").between(50, 500), 0.4).otherwise(0.1) + F.when(F.contains("text", F.lit(".")), 0.3).otherwise(0.0) + 0.3 * (~F.contains(F.lower("text"), F.lit("unknown"))).cast("int")
    return table(spark, d, C).groupBy("role").agg(F.round(F.avg(score), 6).alias("quality"))


@query(
    "ds03_pairs",
    f"""with t as (select distinct doc_id, term from (select doc_id, unnest({TOK('text')}) as term from documents) where length(term) > 9), n as (select greatest(1, count(distinct term) // 64) as b from t),
    w as (select term, ('0x' || substr(md5(term), 1, 8))::bigint % b as bucket from (select distinct term from t), n),
    s as (select doc_id, slot, ('0x' || substr(md5(doc_id || ':' || slot), 1, 8))::bigint % b as bucket from (select distinct doc_id from t), (values (0), (1), (2)) v(slot), n),
    c as (select doc_id, slot, term from s join w using (bucket) anti join t using (doc_id, term)), g as (select doc_id, slot, arg_min(term, md5(term || ':' || doc_id || ':' || slot)) as term from c group by 1, 2)
    select doc_id, term as positive, 1 as label from t union all select doc_id, term, 0 from g""",
)
def ds03(spark, d):
    terms = table(spark, d, D).select("doc_id", F.explode(T.tokens("text")).alias("term")).filter(F.length("term") > 9).distinct()
    return M.contrastive_pairs(terms, "doc_id", "term", 3).withColumnRenamed("term", "positive")


@query("ds05_glossary", "select conv_id, turn, case when contains(lower(text), 'the') then text || ' article' else text end || case when contains(lower(case when contains(lower(text), 'the') then text || ' article' else text end), 'art') then ' craft' else '' end as expanded from conversations")
def ds05(spark, d):
    glossary = F.array(*(F.struct(F.lit(a).alias("term"), F.lit(b).alias("other")) for a, b in (("the", "article"), ("art", "craft"))))
    grown = F.aggregate(glossary, F.col("text"), lambda acc, g: F.when(F.contains(F.lower(acc), g["term"]), F.concat(acc, F.lit(" "), g["other"])).otherwise(acc))
    return table(spark, d, C).select("conv_id", "turn", grown.alias("expanded"))


@query("ds06_test_questions", "with q(lang, template) as (values ('en', 'What is in document {}?'), ('en', 'Who wrote document {}?'), ('de', 'Was steht in Dokument {}?')) select doc_id, replace(template, '{}', doc_id::varchar) as question from documents join q using (lang)")
def ds06(spark, d):
    templates = F.broadcast(spark.createDataFrame([("en", "What is in document {}?"), ("en", "Who wrote document {}?"), ("de", "Was steht in Dokument {}?")], "lang string, template string"))
    return table(spark, d, D).join(templates, "lang").select("doc_id", F.replace("template", F.lit("{}"), F.col("doc_id").cast("string")).alias("question"))


_WEIGHTS = (("text", 0.6), ("description", 0.4), ("tags", 0.3))


@query(
    "rt31_keyword_match",
    f"""with p as (select page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) as text, regexp_extract(html, '<title>(.*?)</title>', 1) as description, regexp_replace(url, '[^A-Za-z]+', ' ', 'g') as tags from pages),
    w as (select page_id, 0.6::double as weight, unnest(list_distinct({TOK('text')})) as w from p union all select page_id, 0.4, unnest(list_distinct({TOK('description')})) from p union all select page_id, 0.3, unnest(list_distinct({TOK('tags')})) from p),
    q as (select item_id as qid, unnest(list_distinct({TOK('text')})) as w, len(list_distinct({TOK('text')})) as n from benchmark),
    s as (select qid, page_id as doc_id, round(sum(weight) / any_value(n), 6) as score from q join w using (w) group by 1, 2) select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id)::int as rank from s where score > 0.1) where rank <= 20""",
)
def rt31(spark, d):
    """Share of a question's words in a page's heading, title and address, weighted 0.6, 0.4 and 0.3; above 0.1, the best 20."""
    pages, bench = tables(spark, d, "pages", "benchmark")
    found = lambda p: F.regexp_extract("html", p, 1)
    parts = pages.select(F.col("page_id").alias("doc_id"), found("<h1>(.*?)</h1>").alias("text"), found("<title>(.*?)</title>").alias("description"), F.regexp_replace("url", "[^A-Za-z]+", " ").alias("tags"))
    words = reduce(lambda a, b: a.unionByName(b), (parts.select("doc_id", F.lit(w).alias("weight"), F.explode(F.array_distinct(T.tokens(c))).alias("w")) for c, w in _WEIGHTS))
    asked_words = bench.select(F.col("item_id").alias("qid"), F.array_distinct(T.tokens("text")).alias("ws")).select("qid", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    scored = asked_words.join(words, "w").groupBy("qid", "doc_id").agg(F.round(F.sum("weight") / F.max("n"), 6).alias("score"))
    return RT.top(scored.filter("score > 0.1"), "qid", "doc_id", "score", 20)