"""Queries through plug points, SQL functions and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import plugs as P
from corpusmill.operators import table_functions as TF
from corpusmill.plans.catalog import CATALOG as _CATALOG
from corpusmill.plans.catalog import catalog
from corpusmill.plans.retrieval import _BENCH, _BM25, _TOP, bench_bm25
from corpusmill.plans.text import TOK, WORDS
from corpusmill.registry import query
from corpusmill.sources.tables import table, tables

@query(
    "ud01_table_functions",
    f"""with {_CATALOG}, a as (select distinct upper(substr(p_name, 1, 3)) as acronym, p_name as definition, (p_size / 50)::double as confidence from part)
    select 'search' as f, doc_id::varchar as k, confidence as x from catalog where document_type = 'fr' and privacy_level = 'public'
    union all select 'statistics', document_type || ':' || product_name || ':' || privacy_level, round(avg(confidence), 3) from catalog group by document_type, product_name, privacy_level
    union all select 'acronyms', acronym || ':' || definition, confidence from a where list_contains(string_split_regex(lower(definition), '[^a-z0-9]+'), '1') or contains(lower(acronym), '1')
    union all select 'synonyms', p_brand || ':' || p_name, 0.5::double from part where contains(lower(p_brand), '#1') and p_size > 25
    union all select 'context', p_brand, 0.25::double from part where contains(lower(p_name), '7') and p_size % 2 = 0""",
)
def ud01(spark, d):
    part = table(spark, d, "part")
    catalog(spark, d).createOrReplaceTempView("catalog")
    part.select(F.upper(F.substring("p_name", 1, 3)).alias("acronym"), F.col("p_name").alias("definition"), (F.col("p_size") / 50).alias("confidence")).distinct().createOrReplaceTempView("acronyms")
    kind = F.when(F.col("p_size") > 25, "large").otherwise("small")
    part.select(F.col("p_brand").alias("term"), F.col("p_name").alias("synonym"), kind.alias("term_type"), F.lit(0.5).alias("confidence")).createOrReplaceTempView("synonyms")
    relation = F.when(F.col("p_size") % 2 == 0, "synonym").otherwise("part_of")
    part.select(F.col("p_name").alias("primary_term"), F.col("p_brand").alias("related_term"), relation.alias("relationship_type"), F.lit(0.25).alias("confidence")).createOrReplaceTempView("relations")
    TF.register(spark)
    return spark.sql("""SELECT 'search' AS f, string(doc_id) AS k, confidence AS x FROM search_documents_by_category(search_type => 'fr')
        UNION ALL SELECT 'statistics', concat_ws(':', document_type, product_name, privacy_level), avg_confidence FROM get_categorization_statistics()
        UNION ALL SELECT 'acronyms', concat_ws(':', acronym, definition), confidence FROM get_relevant_acronyms('1')
        UNION ALL SELECT 'synonyms', concat_ws(':', term, synonym), confidence FROM get_relevant_synonyms('#1', 'large')
        UNION ALL SELECT 'context', related_term, confidence FROM get_term_context('7')""")


@query("ud02_derived_columns", f"select doc_id, length(text)::int as content_length, list_sort(list_distinct({TOK('text')})) as lexemes from documents")
def ud02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return TF.derived_columns(docs).select("doc_id", "content_length", "lexemes")


@query(
    "ud03_views",
    f"""with {_CATALOG}, c as (select doc_id, unnest(range(1 + len(text) // 1000)) as chunk_no, v.embedding is not null as e from documents left join embeddings v on vec_id = doc_id)
    select 'summary' as v, doc_id::varchar as k, count(*)::double as x, (count(*) filter (where e))::double as y from catalog join c using (doc_id) group by doc_id
    union all select 'searchable', doc_id::varchar || ':' || chunk_no, confidence, null from c join catalog using (doc_id) where e and status = 'completed'
    union all select 'questions', event_type, count(*)::double, count(distinct user_id)::double from events group by event_type
    union all select 'feedback', event_type, (count(*) filter (where value > 50))::double, round(avg(value), 6) from events group by event_type""",
)
def ud03(spark, d):
    docs, vectors, events = tables(spark, d, "documents", "embeddings", "events")
    catalog(spark, d).createOrReplaceTempView("catalog")
    numbers = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 1000).cast("int")))
    pieces = docs.select("doc_id", "text", numbers.alias("chunk_no")).select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * 1000 + 1, F.lit(1000)).alias("content"))
    pieces.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").createOrReplaceTempView("chunks")
    names = events.select("event_type").distinct()
    names.select(F.col("event_type").alias("pattern_id"), F.md5("event_type").alias("question_hash"), F.col("event_type").alias("question"), F.lit("general").alias("category")).createOrReplaceTempView("patterns")
    feedback = F.when(F.col("value") > 50, "positive").when(F.col("value") < 10, "negative")
    events.select(F.col("event_type").alias("pattern_id"), "user_id", F.col("value").alias("response_ms"), F.col("value").alias("quality"), feedback.alias("feedback"), F.col("ts").alias("created_at")).createOrReplaceTempView("usage")
    TF.create_views(spark)
    return spark.sql("""SELECT 'summary' AS v, string(doc_id) AS k, double(chunk_count) AS x, double(embedded_chunks) AS y FROM document_summary
        UNION ALL SELECT 'searchable', concat(doc_id, ':', chunk_no), confidence, NULL FROM searchable_chunks
        UNION ALL SELECT 'questions', question, double(usage_count), double(unique_users) FROM question_statistics
        UNION ALL SELECT 'feedback', question, double(positive_feedback), round(avg_quality_score, 6) FROM question_statistics""")


@query(
    "ud04_embedding",
    f"""with w as (select doc_id, unnest({WORDS('lower(text)')}[1:100]) as w, generate_subscripts({WORDS('lower(text)')}[1:100], 1) - 1 as p from documents),
    b as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 768 as bucket, sum(1.0::double / (p + 1)) as x from w group by 1, 2),
    n as (select doc_id, sqrt(sum(x * x)) as n from b group by 1) select doc_id, bucket::int as bucket, round((x / n)::float::double, 4) as weight from b join n using (doc_id)""",
)
def ud04(spark, d):
    """The vectors of the default embedder, as their places that are not zero."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(P.embedding("text")).alias("bucket", "x"))
    return rows.filter("x != 0").select("doc_id", "bucket", F.round(F.col("x").cast("double"), 4).alias("weight"))


@query(
    "ud05_pair_scorer",
    f"""with {_BENCH}, {_BM25}, r as (select t.qid, t.doc_id, round(len(list_intersect(list_distinct({TOK('query')}), list_distinct({TOK('text')}))) / len(list_distinct({TOK('query')})), 6) as score
    from {_TOP('b')} t join documents using (doc_id) join queries using (qid) where t.rank <= 20) select * from {_TOP('r')} where rank <= 5""",
)
def ud05(spark, d):
    bench, docs = tables(spark, d, "benchmark", "documents")
    questions, passages = bench.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), docs.select("doc_id", F.col("text").alias("passage"))
    return P.reranked(bench_bm25(spark, d, 20), questions, passages, "qid", "doc_id", 5)


@query(
    "ud06_row_generators",
    """select doc_id, 'spans' as f, sum(length(t))::bigint as x, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as t from documents) group by 1
    union all select doc_id, 'words', sum(length(w))::bigint, count(*) from (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from documents) group by 1""",
)
def ud06(spark, d):
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("whole_texts")
    TF.register(spark)
    return spark.sql("""SELECT doc_id, 'spans' AS f, sum(s.end - s.start) AS x, count(*) AS n FROM whole_texts, LATERAL spans_of(text) s GROUP BY doc_id
        UNION ALL SELECT doc_id, 'words', sum(length(w.word)), count(*) FROM whole_texts, LATERAL words_of(text) w GROUP BY doc_id""")
