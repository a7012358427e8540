"""Queries over the structure of documents and result lists: hierarchical chunks, clusters, pairs, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import confidence as CF
from corpusmill.operators import sections as H
from corpusmill.operators import similarity as S
from corpusmill.plans.retrieval import _BENCH, _BM25, _TOP, bench_bm25
from corpusmill.plans.text import SENT, STOP, STOPS, TOK, WORDS
from corpusmill.registry import query
from corpusmill.sources.scratch import stored
from corpusmill.sources.tables import table


def headed(docs):
    """Whole documents with headings, lists and references between their lines, as the generated prose holds none."""

    def line(x, i):
        n = i.cast("string")
        before = (
            F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 4) % 3 + 1).cast("int")), F.lit(" Part "), n, F.lit("\n")))
            .when(i % 9 == 5, F.concat((i % 3 + 1).cast("string"), F.lit(".2 Setup of unit "), n, F.lit("\n")))
            .when(i % 11 == 7, F.lit("SAFETY NOTES\n"))
            .when(i % 13 == 9, F.lit("Known limits:\n- first item\n- second item\n"))
            .otherwise(F.lit(""))
        )
        after = F.when(i % 5 == 3, F.concat(F.lit(" See section unit. Refer to [Part "), (i - i % 4).cast("string"), F.lit("]"))).when(i % 7 == 6, F.lit(" Step 2: set VALUE = 4.5")).otherwise(F.lit(""))
        return F.concat(before, x, after)

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("tx06_hierarchical_chunks")
def tx06(spark, d):
    chunks = H.hierarchical_chunks(headed(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    titles = F.array_join("titles", " > ").alias("titles")
    return chunks.select("doc_id", "chunk_no", titles, "chunk_type", F.md5("content").alias("content_md5"), "n_words", "n_sentences", "importance", "readability", "refs", "overlap", "depends")


_SETS = f"""c as (select doc_id, w, count(*) as n from (select doc_id, unnest({TOK('text')}) as w from documents) where length(w) >= 4 group by 1, 2),
    s as (select doc_id, list_sort(list(w)) as tokens from (select doc_id, w, row_number() over (partition by doc_id order by n desc, w) as i from c) where i <= 10 group by 1),
    u as (select tokens, min(doc_id) as rep from s group by 1),
    t as (select rep, len(tokens) as size, unnest(tokens) as w from u),
    e as (select a.rep as a, b.rep as b from t a join t b on a.w = b.w and a.rep < b.rep group by 1, 2 having count(*) >= 0.7 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9),
    ways as (select a as node, b as other from e union select b, a from e union select ways.node, case when x.a = ways.other then x.b else x.a end from ways join e x on x.a = ways.other or x.b = ways.other),
    p as (select doc_id, least(rep, coalesce(other, rep)) as cluster from s join u using (tokens) left join (select node, min(other) as other from ways group by 1) on node = rep),
    k as (select cluster, count(*) as size from p group by 1 having count(*) >= 2)"""


def concepts(spark, d):
    return S.top_tokens(table(spark, d, "documents"), "doc_id", "text", 10)


@query("tx47_clusters", f"with recursive {_SETS} select doc_id, cluster, size, round(least(0.9, 0.5 + 0.1 * size)::double, 6) as confidence from p join k using (cluster)")
def tx47(spark, d):
    return S.clusters(concepts(spark, d), "doc_id", "tokens")


@query(
    "tx47_cluster_concepts",
    f"with recursive {_SETS} select cluster, concept, n from (select *, row_number() over (partition by cluster order by n desc, concept) as i from (select cluster, concept, count(*) as n from (select cluster, unnest(tokens) as concept from p join k using (cluster) join s using (doc_id)) group by 1, 2)) where i <= 10",
)
def tx47_concepts(spark, d):
    sets = stored(concepts(spark, d), "concepts")
    return S.cluster_concepts(S.clusters(sets, "doc_id", "tokens"), sets, "doc_id", "tokens")


@query(
    "jn09_pairs",
    f"""with s as (select list_sort(list_distinct({TOK('text')})) as tokens, min(doc_id) as rep, count(*) as n from documents where len({TOK('text')}) > 0 group by 1),
    t as (select rep, n, len(tokens) as size, unnest(tokens) as w from s)
    select a.rep as a, b.rep as b, any_value(a.n) as a_copies, any_value(b.n) as b_copies, count(*)::int as shared, round(count(*) / (any_value(a.size) + any_value(b.size) - count(*)), 6) as score
    from t a join t b on a.w = b.w and a.rep < b.rep group by 1, 2 having count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9""",
)
def jn09(spark, d):
    """Near copies by their different words, counted on whole texts: a common word alone brings none together."""
    sets = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("tokens"))
    pairs, members = S.similar_sets(sets, "doc_id", "tokens", 0.8)
    copies = stored(members.select("rep", "n").distinct(), "copies")
    pairs = pairs.join(copies.select(F.col("rep").alias("a"), F.col("n").alias("a_copies")), "a").join(copies.select(F.col("rep").alias("b"), F.col("n").alias("b_copies")), "b")
    return pairs.select("a", "b", "a_copies", "b_copies", F.col("common").alias("shared"), F.round("score", 6).alias("score"))


def _counted(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in patterns) + ")"


_CLASS = f"""case when m >= 3 or (m >= 2 and k > 10) then 'expert' when m >= 2 or regexp_matches(query, '\\b(and|or|not|AND|OR|NOT)\\b') or k > 8 then 'complex'
    when m >= 1 or contains(query, '"') or k > 4 then 'moderate' else 'simple' end"""


@query(
    "rt20_result_confidence",
    f"""with {_BENCH}, {_BM25}, h as (select t.qid, t.rank, t.score / 100 as score, text, source, lower(text) as low from {_TOP('b')} t join documents using (doc_id) where rank <= 5),
    c as (select qid, rank, score, source, {_counted('low', CF.DOUBT)} as doubts, greatest(0, least(1, 0.1::double * {_counted('low', CF.CERTAIN)} + least(0.3::double, 0.05 * len({SENT('low')}))
        + case when regexp_matches(low, '[0-9]') then 0.2::double else 0 end - 0.15 * {_counted('low', CF.DOUBT)})) as content, len({WORDS('low')}) as words from h),
    pp as (select qid, count(*) as n, avg(content) filter (where rank <= 3) as content, least(1, 10 * avg(doubts / greatest(1, words)) filter (where rank <= 3)) as penalty,
        count(distinct source) as sources, stddev_pop(score) as deviation from c group by 1),
    ss as (select qid, count(*) filter (where n > 1) / count(*) as shared from (select qid, t, count(*) as n from (select qid, unnest({TOK('text')}) as t from h where rank <= 3) group by 1, 2) group by 1),
    e as (select qid, rank, unnest({TOK('text')}) as t from h union all select qid, 0, unnest({TOK('query')}) from queries where qid in (select qid from h)),
    ff as (select qid, rank, t, count(*) as tf from e where length(t) > 1 and t not in {STOPS} group by 1, 2, 3),
    l as (select qid, count(*) + 1 as n from h group by 1), d as (select qid, t, count(*) as df, sum(tf) as total from ff group by 1, 2),
    k as (select qid, t, ln((1 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (partition by qid order by total desc, t) as i from d) join l using (qid) where i <= 1000),
    w as (select qid, rank, t, tf * idf as w from ff join k using (qid, t)),
    m as (select a.qid, a.rank, sum(a.w * coalesce(b.w, 0)) as dot, sqrt(sum(a.w * a.w)) as len_d from w a left join w b on b.qid = a.qid and b.t = a.t and b.rank = 0 where a.rank > 0 group by 1, 2),
    qq as (select qid, sqrt(sum(w * w)) as len_q from w where rank = 0 group by 1),
    x as (select h.qid, avg(coalesce(dot / (len_d * len_q), 0) / h.rank) as semantic from h left join m on m.qid = h.qid and m.rank = h.rank left join qq on qq.qid = h.qid group by 1),
    y as (select qid, query, {_counted('query', CF.TECHNICAL)} as m, len({TOK('query')}) as k from queries),
    z as (select pp.*, semantic, {_CLASS} as question_class, case when n < 2 then 0.8::double when shared is null then 0.5 else 0.3::double * (1 - sources / n) + 0.4 * greatest(0, 1 - deviation) + 0.3 * shared end as consistency
        from pp left join ss using (qid) join x using (qid) join y using (qid))
    select qid, round(semantic, 6) as semantic, round(content, 6) as content, round(consistency, 6) as consistency, round(penalty, 6) as penalty, question_class,
        round(least(1, greatest(0, (0.4 * semantic + 0.3 * content + 0.2 * consistency + 0.1 * (1 - penalty)) * case question_class when 'simple' then 1.0::double when 'moderate' then 0.95 when 'complex' then 0.9 else 0.85 end)), 6) as confidence from z""",
)
def rt20(spark, d):
    """Confidence in the five best documents for each passage; documents are looked up before they are tokenised."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = stored(bench_bm25(spark, d, 5).join(docs, "doc_id").withColumn("score", F.col("score") / 100), "hits")
    return CF.result_confidence(hits, questions, "qid", STOP)
