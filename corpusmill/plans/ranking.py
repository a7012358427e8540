"""Question enhancement, merged result lists, confidence and accuracy scores over tables of questions and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import ranking as K
from corpusmill.operators import retrieval as R
from corpusmill.plans.retrieval import _BENCH, _BM25, _SIM, _TOP, asked, bench_bm25, contexts, told, vectors
from corpusmill.plans.text import TOK, WORDS, pairs
from corpusmill.registry import query
from corpusmill.sources.tables import table, tables

C, D = "conversations", "documents"
_PAIRS = "(select a.conv_id, a.turn, a.text as q, b.text as a from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- lexicons for the invented words of the tables ------------------------------------------------------------------
PATTERNS = {"english": ["(^| )the ", "(^| )of ", "ing"], "romance": ["(^| )de ", "(^| )que ", "ción"], "german": ["(^| )und ", "(^| )der ", "sch"]}
SYNONYMS = {"the": ["article", "determiner"], "und": ["and", "also"], "de": ["of", "from"], "que": ["that"]}
ACRONYMS = {"AM": "amplitude modulation", "EN": "english"}
TRIGGERS = {"er": ["repeat"], "tion": ["action", "state"], "ment": ["state", "means"]}

_CLASS = "case when greatest({0}) = 0 then 'general' {1} end".format(
    ", ".join("(" + " + ".join(f"regexp_matches(lower(text), '{p}')::int" for p in ps) + ")" for ps in PATTERNS.values()),
    " ".join(f"when {' + '.join(f'regexp_matches(lower(text), {chr(39)}{p}{chr(39)})::int' for p in ps)} = greatest({', '.join('(' + ' + '.join(f'regexp_matches(lower(text), {chr(39)}{p}{chr(39)})::int' for p in qs) + ')' for qs in PATTERNS.values())}) then '{c}'" for c, ps in PATTERNS.items()),
)
_TERMS = r"list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}')) || regexp_extract_all(text, '\b\d+\.\d+(?:\.\d+)?\b') || " + f"list_filter({sql_list(SYNONYMS)}, lambda k: contains(lower(text), k))))"
_GROWN = " || ".join(
    [f"case when list_contains(terms, '{k}') then {sql_list(v)} else [] end" for k, v in SYNONYMS.items()]
    + [f"case when list_contains(terms, '{k}') then ['{v}'] else [] end" for k, v in ACRONYMS.items()]
    + [f"case when contains(lower(text), '{k}') then {sql_list(v)} else [] end" for k, v in TRIGGERS.items()]
)
_ENHANCED = f"""with t as (select conv_id, turn, text, {_CLASS} as query_type, {_TERMS} as terms from conversations where role = 'user'),
    x as (select *, list_sort(list_distinct({_GROWN})) as expansions from t),
    e as (select conv_id, turn, query_type, terms, expansions, case when len(expansions) > 0 then text || ' (' || array_to_string(list_transform(expansions[1:5], lambda v: '"' || v || '"'), ' OR ') || ')' else text end as enhanced,
    round(least(0.5::double + least(len(terms) * 0.1, 0.3) + case when query_type <> 'general' then 0.2 else 0 end + case when len({WORDS('text')}) > 3 then 0.1 else 0 end, 1), 6) as confidence from x)"""


def enhanced(spark, d):
    questions = table(spark, d, C).filter("role = 'user'").select("conv_id", "turn", "text")
    return K.enhanced(questions, "text", PATTERNS, SYNONYMS, ACRONYMS, TRIGGERS).drop("text")


@query("tx09_query_enhancement", _ENHANCED + " select * from e")
def tx09(spark, d):
    return enhanced(spark, d)


@query("tx09_enhancement_impact", _ENHANCED + " select query_type, count(*) as n, round(avg(confidence), 6) as confidence, sum(len(terms))::bigint as terms, round(avg(len(expansions)), 6) as expansions from e group by 1")
def tx09_impact(spark, d):
    by = enhanced(spark, d).groupBy("query_type")
    return by.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum(F.size("terms")).alias("terms"), F.round(F.avg(F.size("expansions")), 6).alias("expansions"))


GLOSSARY = {"english": ["the theory", "of course", "thing"], "german": ["und so weiter", "derweil"], "romance": ["que quiere", "de facto"]}
KIND_SYNONYMS = {"english": {"the": ["article", "determiner"], "er": ["doer", "agent"]}, "german": {"und": ["sowie", "auch"]}, "romance": {"de": ["des", "du"], "que": ["qui", "quoi"]}}
EXTRAS = {"4.16": ["4.16.1", "latest"], "Th": ["thorn"]}
_KIND = "case lang when 'en' then 'english' when 'de' then 'german' else 'romance' end"
_ADDED = " || ".join(
    [f"case when contains(text, '{k}') then ['{v}'] else [] end" for k, v in ACRONYMS.items()]
    + ["list_filter(case kind " + " ".join(f"when '{k}' then {sql_list(v)}" for k, v in GLOSSARY.items()) + " end, lambda t: not list_contains(words, t) and len(list_filter(words, lambda w: contains(t, w))) > 0)"]
    + ["(" + " || ".join(f"case when kind = '{k}' and contains(lower(text), '{w}') then {sql_list(v)} else [] end" for k, m in KIND_SYNONYMS.items() for w, v in m.items()) + ")[1:3]"]
    + [f"case when contains(text, '{k}') then {sql_list(v)} else [] end" for k, v in EXTRAS.items()]
)


@query("tx53_enhancement_by_type", f"with k as (select doc_id, text, {_KIND} as kind, {WORDS('lower(text)')} as words from documents), a as (select doc_id, kind, text, {_ADDED} as added from k) select doc_id, kind, added, md5(case when len(added) = 0 then text || ' ' else text || ' ' || array_to_string(added, ' ') end) as enhanced_md5 from a")
def tx53(spark, d):
    docs = table(spark, d, D).select("doc_id", "text", F.when(F.col("lang") == "en", "english").when(F.col("lang") == "de", "german").otherwise("romance").alias("kind"))
    rows = K.glossed(docs, "text", "kind", ACRONYMS, GLOSSARY, KIND_SYNONYMS, EXTRAS)
    return rows.select("doc_id", "kind", "added", F.md5("enhanced").alias("enhanced_md5"))


# --- retrieval ------------------------------------------------------------------------------------------------------
_VARIANTS = f"""words as (select item_id, w, min(i) as i from (select item_id, unnest({TOK('text')}) as w, generate_subscripts({TOK('text')}, 1) as i from benchmark) where length(w) > 6 group by 1, 2),
    queries as (select item_id * 4 as qid, text as query from benchmark union all select item_id * 4 + v, w from (select *, row_number() over (partition by item_id order by i) as v from words) where v <= 3)"""


def variants(spark, d):
    """Benchmark passages as variant 0 of a question, and their first three long words as its expansions."""
    bench = table(spark, d, "benchmark")
    long_words = F.slice(F.filter(F.array_distinct(T.tokens("text")), lambda w: F.length(w) > 6), 1, 3)
    return bench.select("item_id", F.posexplode(F.concat(F.array("text"), long_words)).alias("variant", "query")).select((F.col("item_id") * 4 + F.col("variant")).alias("qid"), "query")


@query(
    "rt09_expansion_retrieval",
    f"""with {_VARIANTS}, {_BM25}, h as (select qid // 4 as item_id, qid % 4 as variant, doc_id, rank from {_TOP('b')} where rank <= case when qid % 4 = 0 then 10 else 5 end),
    f1 as (select item_id, variant, rank, doc_id, row_number() over (partition by item_id, substr(text, 1, 200) order by variant, rank, doc_id) as nth from h join documents using (doc_id)),
    p1 as (select item_id as qid, doc_id, row_number() over (partition by item_id order by variant, rank, doc_id)::int as position from f1 where nth = 1) select * from p1 where position <= 10""",
)
def rt09(spark, d):
    docs = table(spark, d, D)
    scored = R.bm25_top(variants(spark, d), docs, "qid", "doc_id", "text", 10)
    hits = scored.select(F.floor(F.col("qid") / 4).alias("qid"), (F.col("qid") % 4).alias("variant"), "rank", "doc_id")
    vector = R.vector_top_k(table(spark, d, "embeddings").join(table(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("qid"), "embedding"), vectors(spark, d), "qid", "doc_id", 10)
    return K.expansion_retrieval(hits, vector, docs, "qid", "doc_id", "text", 10)


@query("rt33_session_top_k", "select * from (select *, row_number() over (partition by qid order by score desc, doc_id)::int as rank from (select a.vec_id as qid, b.vec_id as doc_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0)) where rank <= 5")
def rt33(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding", "label")
    return R.vector_top_k(rows.filter("qid % 20 = 0"), rows.withColumnRenamed("qid", "doc_id"), "qid", "doc_id", 5, session="label")


@query("rt19_method_selection", _ENHANCED + f" select e.conv_id, e.turn, case when len({WORDS('enhanced')}) > 1.5 * len({WORDS('text')}) or contains(lower(enhanced), 'state') or contains(lower(enhanced), 'article') then 'hybrid' else 'enhanced' end as method from e join conversations c on c.conv_id = e.conv_id and c.turn = e.turn")
def rt19(spark, d):
    rows = K.enhanced(table(spark, d, C).filter("role = 'user'"), "text", PATTERNS, SYNONYMS, ACRONYMS, TRIGGERS)
    grown = F.size(T.split_words("enhanced")) > 1.5 * F.size(T.split_words("text"))
    return rows.select("conv_id", "turn", F.when(grown | F.lower("enhanced").rlike("state|article"), "hybrid").otherwise("enhanced").alias("method"))


_HITS = f"{_BENCH}, {_BM25}, first as (select * from {_TOP('b')} where rank <= 10)"


@query("jn14_rejoin_passages", f"with {_HITS}, r as (select distinct qid, text, len(text)::double as rerank from first join documents using (doc_id)), c as (select qid, doc_id, text, row_number() over (partition by qid, text order by rank) as nth from first join documents using (doc_id)) select r.qid, c.doc_id, r.rerank from r join c using (qid, text) where nth = 1")
def jn14(spark, d):
    hits = bench_bm25(spark, d, 10).join(table(spark, d, D).select("doc_id", "text"), "doc_id")
    reranked = hits.select("qid", "text", F.length("text").cast("double").alias("rerank")).distinct()
    first = hits.groupBy("qid", "text").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    return reranked.join(first, ["qid", "text"]).select("qid", "doc_id", "rerank")


_THREE = f"""with {_HITS}, base as (select qid, doc_id, source || substr(text, 1, 50) as name_start, lang as type, score / 100 as score from first join documents using (doc_id)),
    x as (select a.item_id as qid, v.vec_id as doc_id, round(list_cosine_similarity(e.embedding::double[], v.embedding::double[]), 6) as score from benchmark a join embeddings e on e.vec_id = a.item_id join embeddings v on v.vec_id <> e.vec_id),
    cross_hits as (select qid, doc_id, case when label % 2 = 0 then 'en' else 'image' end as type, score, abs(score) as confidence from (select *, row_number() over (partition by qid order by score desc, doc_id) as i from x) join embeddings on vec_id = doc_id where i <= 50),
    second as (select qid, name_start, max(score) as s_score from (select qid, source || substr(text, 1, 50) as name_start, score / 50 as score from first join documents using (doc_id) where rank <= 5) group by 1, 2),
    j as (select b.qid, b.doc_id, b.type, c.score is not null as in_cross, s_score is not null as in_second, round((0.4 * b.score + 0.3 * coalesce(s_score, b.score) + 0.2 * 0.3 * coalesce(c.score, 0)
        + 0.1 * 0.2 * coalesce(least(confidence * case when b.type <> c.type then 1.1 else 1 end, 1), 0)) * case b.type when 'en' then 1.2 when 'de' then 1.1 else 1 end, 6) as final
        from base b left join cross_hits c on c.qid = b.qid and c.doc_id = b.doc_id left join second s on s.qid = b.qid and s.name_start = b.name_start)"""


def three_way(spark, d):
    docs, embeddings, bench = tables(spark, d, D, "embeddings", "benchmark")
    named = docs.select("doc_id", F.concat("source", F.substring("text", 1, 50)).alias("name_start"), F.col("lang").alias("type"))
    hits = bench_bm25(spark, d, 10).join(named, "doc_id")
    queries = embeddings.join(bench, F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("qid"), "embedding")
    cross = R.vector_top_k(queries, vectors(spark, d), "qid", "doc_id", 50).join(vectors(spark, d).select("doc_id", F.when(F.col("label") % 2 == 0, "en").otherwise("image").alias("type")), "doc_id")
    second = hits.filter("rank <= 5").select("qid", "name_start", (F.col("score") / 50).alias("score"))
    return K.three_way(hits.withColumn("score", F.col("score") / 100), cross.withColumn("confidence", F.abs("score")), second, "qid", {"en": 1.2, "de": 1.1})


@query("jn16_three_way_join", _THREE + " select qid, doc_id, in_cross, in_second from j")
def jn16(spark, d):
    return three_way(spark, d).select("qid", "doc_id", "in_cross", "in_second")


@query("rt36_three_way_score", _THREE + " select qid, doc_id, final from j")
def rt36(spark, d):
    return three_way(spark, d).select("qid", "doc_id", "final")


@query("rt36_diversity", _THREE + " select qid, round((count(distinct type) / 4 + (1 + max(in_cross::int) + max(in_second::int)) / 3) / 2, 6) as diversity from j group by 1")
def rt36_diversity(spark, d):
    return K.three_way_diversity(three_way(spark, d), "qid", 4)


@query("se06_merged_results", f"with {_HITS}, {_SIM}, v as (select * from {_TOP('cos')} where rank <= 5) select kind, qid, doc_id, row_number() over (partition by qid order by score desc, kind, doc_id)::int as position from (select 'text' as kind, qid, doc_id, round(score / 100, 8) as score from first where rank <= 5 union all select 'vector', qid, doc_id, score from v)")
def se06(spark, d):
    text = bench_bm25(spark, d, 5).select(F.lit("text").alias("kind"), "qid", "doc_id", F.round(F.col("score") / 100, 8).alias("score"))
    vector = R.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 5).select(F.lit("vector").alias("kind"), "qid", "doc_id", "score")
    position = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "kind", "doc_id"))
    return text.unionByName(vector).withColumn("position", position).drop("score")


# --- scores ---------------------------------------------------------------------------------------------------------
_KIND_OF = "case when contains(q, '?') then 'factual' when regexp_matches(q, '[0-9]') then 'math' when length(q) > 200 then 'technical' else 'chat' end"


@query(
    "rt22_typed_confidence",
    f"""with c as (select p.*, {_KIND_OF} as kind, coalesce(x.context, '') as context, coalesce(x.chunks, 0) as chunks from {_PAIRS} p left join (select a.conv_id, a.turn, string_agg(b.text, ' ' order by b.turn) as context, count(*) as chunks
        from conversations a join conversations b on a.conv_id = b.conv_id and b.turn < a.turn group by 1, 2) x using (conv_id, turn)),
    w as (select *, list_distinct({WORDS('lower(q)')}) as words from c), m as (select *, len(list_filter(words, lambda x: contains(lower(context), x))) as met from w)
    select conv_id, turn, case when chunks = 0 then 0.0 else round(greatest(0, least(1, least(chunks / 8, case kind when 'math' then 0.8 when 'technical' then 0.6 when 'chat' then 0.6 else 0.5 end::double)
      + 0.05 * ((length(a) > 500)::int + (len(string_split(a, chr(10))) - 1 > 2 or len(string_split(a, '•')) - 1 > 1)::int + regexp_matches(a, '\\b\\d+\\b')::int + regexp_matches(lower(a), 'according to|research shows|studies indicate')::int)
      + 0.4 * met / greatest(len(words), 1) * case kind when 'math' then 0.15 when 'technical' then 0.25 when 'chat' then 0.2 else 0.3 end::double
      + case when contains(lower(context), 'the') or contains(lower(context), 'und') then 0.1 else 0 end + (0.7 - 0.5) * 0.1
      - len(list_filter({sql_list(K.UNCERTAIN)}, lambda u: contains(lower(a), u))) * case kind when 'math' then 0.5 when 'technical' then 0.3 else 0.2 end::double)), 6) end as confidence from m""",
)
def rt22(spark, d):
    rows = pairs(spark, d).join(told(spark, d), ["conv_id", "turn"], "left").fillna({"context": "", "chunks": 0})
    kind = F.when(F.contains("q", F.lit("?")), "factual").when(F.col("q").rlike("[0-9]"), "math").when(F.length("q") > 200, "technical").otherwise("chat")
    score = K.typed_confidence(kind, F.col("q"), F.col("a"), F.col("context"), F.col("chunks"), K.array_of(["the", "und"]), F.lit(0.7))
    return rows.select("conv_id", "turn", F.round(score, 6).alias("confidence"))


@query(
    "ev11_composite_accuracy",
    f"""select conv_id, turn, round(least(1, 0.4::double * (0.5 + (turn % 5) / 10) + 0.2 * case when length(a) > 2000 then greatest(0.8, 2000 / length(a)) else least(1, length(a) / 1000) end + 0.2 * least(1, (turn % 4) / 3)
    + 0.2 * coalesce(len(list_intersect(list_distinct({WORDS('lower(q)')}), {WORDS('lower(a)')})) / nullif(len(list_distinct({WORDS('lower(q)')})), 0), 0)), 6) as accuracy from {_PAIRS}""",
)
def ev11(spark, d):
    score = K.composite_accuracy(0.5 + (F.col("turn") % 5) / 10, F.col("q"), F.col("a"), F.col("turn") % 4)
    return pairs(spark, d).select("conv_id", "turn", F.round(score, 6).alias("accuracy"))


@query(
    "ev12_coverage",
    f"""with {_HITS}, h as (select qid, rank, doc_id, source, {TOK('text')} as w, list_distinct({TOK('query')}) as q from first join documents using (doc_id) join queries using (qid) where rank <= 5),
    a as (select qid, any_value(q) as q, list_distinct(flatten(list(w))) as all5, list_distinct(flatten(list(w) filter (where rank <= 3))) as all3, count(distinct source) / count(*) as spread from h group by 1),
    k as (select *, list_filter(q, lambda x: length(x) > 2 and x not in ('the', 'of', 'and', 'to', 'in', 'is')) as keys from a)
    select qid, round(len(list_intersect(q, all5)) / len(list_distinct(q || all5)), 6) as semantic, case when len(keys) = 0 then 1.0 else round(len(list_intersect(keys, all3)) / len(keys), 6) end as keyword, round(spread, 6) as spread from k""",
)
def ev12(spark, d):
    bench, docs = tables(spark, d, "benchmark", D)
    q = bench.select(F.col("item_id").alias("qid"), F.array_distinct(T.tokens("text")).alias("q"))
    hits = R.looked_up(bench_bm25(spark, d, 5), docs, "doc_id", source=F.col("source"), w=F.array_distinct(T.tokens("text")))
    by = hits.groupBy("qid").agg(
        F.array_distinct(F.flatten(F.collect_list("w"))).alias("all5"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= 3, F.col("w"))))).alias("all3"),
        F.round(F.countDistinct("source") / F.count("*"), 6).alias("spread"),
    )
    keys = F.filter("q", lambda x: (F.length(x) > 2) & ~x.isin("the", "of", "and", "to", "in", "is"))
    semantic = F.round(F.size(F.array_intersect("q", "all5")) / F.size(F.array_union("q", "all5")), 6)
    keyword = F.when(F.size(keys) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(keys, "all3")) / F.size(keys), 6))
    return by.join(q, "qid").select("qid", semantic.alias("semantic"), keyword.alias("keyword"), "spread")


_L2 = "l2 as (select a.vec_id as qid, b.vec_id as doc_id, round(1 - list_distance(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)"


@query(
    "ev14_compared_results",
    f"with {_SIM}, {_L2}, x as (select * from {_TOP('cos')} where rank <= 5), y as (select * from {_TOP('l2')} where rank <= 3), s as (select qid, count(*) as n_a, max(case when rank = 1 then doc_id end) as top_a, max(score) as score_a from x group by 1), t as (select qid, count(*) as n_b, max(case when rank = 1 then doc_id end) as top_b, max(score) as score_b from y group by 1) select *, round(score_a / nullif(score_b, 0), 6) as ratio from s join t using (qid)",
)
def ev14(spark, d):
    def arm(metric, k, name):
        hits = R.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", k, metric=metric)
        return hits.groupBy("qid").agg(F.count("*").alias(f"n_{name}"), F.min_by("doc_id", "rank").alias(f"top_{name}"), F.max("score").alias(f"score_{name}"))

    both = arm("cosine", 5, "a").join(arm("l2", 3, "b"), "qid")
    return both.withColumn("ratio", F.round(F.try_divide("score_a", "score_b"), 6))


@query(
    "ev15_search_accuracy",
    f"""with {_SIM}, t as (select t.qid, t.score, b.lang, b.source, b.text, a.lang as want, a.source as want_source from {_TOP('cos')} t join documents b on b.doc_id = t.doc_id join documents a on a.doc_id = t.qid where rank <= 5),
    m as (select qid, max((lang = want)::int) as types, max((source = want_source)::int) as products, avg(1 - score) as distance, sum(contains(lower(text), 'the')::int + contains(lower(text), 'que')::int) / 10 as keywords from t group by 1),
    s as (select qid, round(0.4 * types + 0.3 * products + 0.2 * (1 - distance) + 0.1 * keywords, 6) as accuracy from m) select *, accuracy >= 0.7 as pass from s""",
)
def ev15(spark, d):
    docs = table(spark, d, D)
    wanted = docs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("want"), F.col("source").alias("want_source"))
    hits = R.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 5).join(docs.select("doc_id", "lang", "source", F.lower("text").alias("low")), "doc_id").join(wanted, "qid")
    keywords = F.contains("low", F.lit("the")).cast("int") + F.contains("low", F.lit("que")).cast("int")
    best = lambda a, b: F.max((F.col(a) == F.col(b)).cast("int"))
    score = 0.4 * best("lang", "want") + 0.3 * best("source", "want_source") + 0.2 * (1 - F.avg(1 - F.col("score"))) + 0.1 * F.sum(keywords) / 10
    return hits.groupBy("qid").agg(F.round(score, 6).alias("accuracy")).withColumn("pass", F.col("accuracy") >= 0.7)


@query(
    "ev20_ab_report",
    """with g as (select event_type as test, count(*) as n, count(*) filter (where value > 60) as a, count(*) filter (where value < 40) as b from events group by 1),
    r as (select test, round(a / n, 6) as a_rate, round(b / n, 6) as b_rate, round((n - a - b) / n, 6) as tie_rate, case when a > b then 'a' else 'b' end as recommended, case when a > b then 'a' when b > a then 'b' end as winner from g)
    select test, a_rate, b_rate, tie_rate, recommended, (select winner from r where winner is not null group by 1 order by count(*) desc, winner limit 1) as overall from r""",
)
def ev20(spark, d):
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("test")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("a"), F.count_if(F.col("value") < 40).alias("b"))
    rate = lambda c, n: F.round(c / F.col("n"), 6).alias(n)
    winner = F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b")
    report = by.select("test", rate(F.col("a"), "a_rate"), rate(F.col("b"), "b_rate"), rate(F.col("n") - F.col("a") - F.col("b"), "tie_rate"), F.when(F.col("a") > F.col("b"), "a").otherwise("b").alias("recommended"), winner.alias("winner"))
    won = report.filter("winner is not null").groupBy("winner").count().orderBy(F.desc("count"), "winner").limit(1).select(F.col("winner").alias("overall"))
    return report.drop("winner").join(F.broadcast(won), how="left")


@query(
    "rt35_model_comparison",
    """with p as (select label, vec_id, embedding::double[] as e, row_number() over (partition by label order by vec_id) as i from embeddings),
    t as (select a.label, round(list_cosine_similarity(a.e, b.e), 6) as s12, round(list_cosine_similarity(a.e, c.e), 6) as s13, round(list_cosine_similarity(b.e, c.e), 6) as s23, len(a.e)::int as dimension
    from p a join p b on a.label = b.label and a.i = 1 and b.i = 2 join p c on a.label = c.label and c.i = 3) select *, row_number() over (order by s23 desc, label)::int as place from t""",
)
def rt35(spark, d):
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    probes = table(spark, d, "embeddings").withColumn("i", nth).filter("i <= 3")
    e = lambda i: F.max_by("embedding", F.when(F.col("i") == i, F.lit(1)))
    by = probes.groupBy("label").agg(e(1).alias("e1"), e(2).alias("e2"), e(3).alias("e3")).filter("e3 is not null")
    s = lambda a, b: F.round(V.cosine(F.col(a), F.col(b)), 6)
    rows = by.select("label", s("e1", "e2").alias("s12"), s("e1", "e3").alias("s13"), s("e2", "e3").alias("s23"), F.size("e1").alias("dimension"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s23"), "label")))


# --- relational rows ------------------------------------------------------------------------------------------------
@query("pf05_optional_filters", "select c_custkey, c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' and c_mktsegment = 'BUILDING'")
def pf05(spark, d):
    c, n, r = tables(spark, d, "customer", "nation", "region")
    view = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    given = {"r_name": "EUROPE", "c_mktsegment": "BUILDING", "n_name": None}
    kept = reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in given.items() if v is not None), view)
    return kept.select("c_custkey", "c_name", "n_name", "r_name")


@query("pf08_term_context", "select p_partkey, p_name, p_size from part where p_name ilike '%' || 'a' || '%' and p_brand in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') order by p_size desc, p_partkey")
def pf08(spark, d):
    brands = F.array(*map(F.lit, ["Brand#11", "Brand#12", "Brand#13", "Brand#21"]))
    return table(spark, d, "part").filter(F.col("p_name").ilike("%a%") & F.array_contains(brands, F.col("p_brand"))).orderBy(F.desc("p_size"), "p_partkey").select("p_partkey", "p_name", "p_size")


@query("ag15_schema_overview", "select r_name, n_name, count(c_custkey) as n_columns from region join nation on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2")
def ag15(spark, d):
    r, n, c = tables(spark, d, "region", "nation", "customer")
    counted = c.groupBy("c_nationkey").agg(F.count("*").alias("n_columns"))
    rows = n.join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey")).join(counted, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("r_name", "n_name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


@query(
    "ag39_source_consensus",
    f"""with s as (select conv_id, role, text, 1.0::double * length(text) / 1000 as confidence, {TOK('text')} as w, turn from conversations where role <> 'system'),
    g as (select conv_id, count(distinct role) as sources, arg_max(text, (confidence, -turn)) as best, avg(confidence) as mean, list_sort(list_distinct(flatten(list(w)))) as terms from s group by 1)
    select conv_id, sources, case when sources < 2 then 'single' else 'consensus' end as kind, md5(best) as best_md5, round(mean, 6) as confidence, len(terms) as n_terms, md5(array_to_string(terms, ' ')) as terms_md5 from g""",
)
def ag39(spark, d):
    s = table(spark, d, C).filter("role <> 'system'").withColumn("confidence", F.length("text") / 1000)
    by = s.groupBy("conv_id")
    g = by.agg(F.countDistinct("role").alias("sources"), F.max_by("text", F.struct("confidence", -F.col("turn"))).alias("best"), F.avg("confidence").alias("mean"))
    words = s.select("conv_id", F.explode(T.tokens("text")).alias("w")).distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("terms"))
    kind = F.when(F.col("sources") < 2, "single").otherwise("consensus")
    rows = g.join(words, "conv_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return rows.select("conv_id", "sources", kind.alias("kind"), F.md5("best").alias("best_md5"), F.round("mean", 6).alias("confidence"), F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


_REFS = " || ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in K.REFERENCES)


@query("tx43_cross_references", f"select item_id as id, {_REFS} as refs from (select item_id, text || ' See section ' || item_id || '.' || (item_id % 3) || ' and [ref' || item_id || '] (see page ' || item_id || ')' as text from benchmark) union all select doc_id + 1000000, {_REFS} from documents")
def tx43(spark, d):
    bench, docs = tables(spark, d, "benchmark", D)
    i = F.col("item_id").cast("string")
    made = F.concat("text", F.lit(" See section "), i, F.lit("."), (F.col("item_id") % 3).cast("string"), F.lit(" and [ref"), i, F.lit("] (see page "), i, F.lit(")"))
    rows = bench.select(F.col("item_id").alias("id"), made.alias("text")).unionByName(docs.select((F.col("doc_id") + 1000000).alias("id"), "text"))
    return rows.select("id", K.cross_references(F.col("text")).alias("refs"))


_STOP = ["the", "of", "and", "to", "in", "is"]
_GRAMS = "list_filter({0}, lambda w: length(w) > 1 and w not in ('the', 'of', 'and', 'to', 'in', 'is'))"


@query(
    "rt08_tfidf",
    f"""with w as (select doc_id, {_GRAMS.format(TOK('text'))} as w from documents), g as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from w),
    c as (select doc_id, term, count(*) as tf from g group by 1, 2), n as (select count(*) as n from documents), s as (select term, count(*) as df, sum(tf) as total from c group by 1),
    v as (select term, ln((1 + n) / (1 + df)) + 1 as idf from s, n where df >= 2 and df <= n * 0.8 order by total desc, term limit 5000),
    x as (select item_id, {_GRAMS.format(TOK('text'))} as w from benchmark), y as (select item_id as qid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from x),
    q as (select qid, term, count(*) * any_value(idf) as q from y join v using (term) group by 1, 2), d as (select doc_id, term, tf * idf as d from c join v using (term)),
    ql as (select qid, sqrt(sum(q * q)) as l from q group by 1), dl as (select doc_id, sqrt(sum(d * d)) as l from d group by 1),
    r as (select qid, doc_id, round(sum(q * d) / (any_value(ql.l) * any_value(dl.l)), 6) as score from q join d using (term) join ql using (qid) join dl using (doc_id) group by 1, 2)
    select * from {_TOP('r')} where rank <= 10""",
)
def rt08(spark, d):
    bench, docs = tables(spark, d, "benchmark", D)
    return R.tfidf_top(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), docs, "qid", "doc_id", "text", _STOP, 10)


@query(
    "rt18_mode_fallback",
    f"""with {_SIM}, t as (select * from {_TOP('cos')} where rank <= 5), m as (select distinct qid, qid // 20 % 3 as m from cos), a as (select * from t where score > 0.55), b as (select * from t where score > 0.45),
    k as (select m.qid, case when m = 0 and a.qid is not null then 'maximum' when m <= 1 and b.qid is not null then 'balanced' else 'speed' end as mode from m left join (select distinct qid from a) a using (qid) left join (select distinct qid from b) b using (qid))
    select qid, doc_id, mode from (select qid, doc_id, 'maximum' as mode from a union all select qid, doc_id, 'balanced' from b union all select qid, doc_id, 'speed' from t) join k using (qid, mode)""",
)
def rt18(spark, d):
    hits = R.vector_top_k(asked(spark, d), vectors(spark, d), "qid", "doc_id", 5)
    m = F.floor(F.col("qid") / 20) % 3
    questions = asked(spark, d).select("qid", F.when(m == 0, "maximum").when(m == 1, "balanced").otherwise("speed").alias("mode"))
    modes = [("maximum", hits.filter("score > 0.55")), ("balanced", hits.filter("score > 0.45")), ("speed", hits)]
    return K.with_fallback(questions, modes, "qid", "mode").select("qid", "doc_id", "mode")


@query(
    "rt23_reranked_parts",
    f"""with p as (select u.conv_id, a.turn, a.text, case when len({TOK('u.text')}) = 0 then 0 else len(list_intersect(list_distinct({TOK('u.text')}), {TOK('a.text')})) / len(list_distinct({TOK('u.text')})) end as relevance, 0.5::double + (a.turn % 5) / 10 as confidence
    from (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' group by 1) u join conversations a on a.conv_id = u.conv_id and a.role = 'assistant'),
    n as (select *, row_number() over (partition by conv_id order by round(0.8 * relevance + 0.2 * confidence, 6) desc, turn) as i from p) select conv_id, md5(string_agg(text, chr(10) || chr(10) order by i)) as answer_md5, round(avg(relevance), 6) as relevance from n where i <= 5 group by 1""",
)
def rt23(spark, d):
    turns = table(spark, d, C)
    questions = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    parts = turns.filter("role = 'assistant'").join(questions, "conv_id")
    parts = parts.withColumn("relevance", T.overlap(T.tokens("question"), T.tokens("text"))).withColumn("confidence", 0.5 + F.col("turn") % 5 / 10)
    return K.reranked_parts(parts, "conv_id", "relevance", "confidence", "text", "turn").select("conv_id", F.md5("answer").alias("answer_md5"), "relevance")


@query("rt37_context_assembly")
def rt37(spark, d):
    reasoning = F.element_at(F.array(*map(F.lit, ["synthesis", "analytical", "plain", "comprehensive"])), (F.col("item_id") % 4 + 1).cast("int"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), reasoning.alias("reasoning"))
    history = table(spark, d, C).select(F.col("conv_id").alias("qid"), "turn", F.size(T.split_words("text")).alias("words"))
    return R.assembled_context(contexts(spark, d), questions, history, "qid", 3000)


@query("rt37_context_usage")
def rt37_usage(spark, d):
    return R.used_context(rt37(spark, d))
