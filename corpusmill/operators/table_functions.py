"""Functions and views for SQL: parametrised table functions, row generators, derived columns, reporting views."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table functions over the views ``catalog`` (one row a document), ``acronyms``, ``synonyms`` and ``relations``. ``'all'`` lets
#: every value of a filter pass; a null synonym type likewise. Names of results are those of the catalogue.
TABLE_FUNCTIONS = {
    "search_documents_by_category": """(search_type STRING DEFAULT 'all', search_product STRING DEFAULT 'all', search_privacy STRING DEFAULT 'public')
        RETURNS TABLE (doc_id BIGINT, file_name STRING, document_type STRING, product_name STRING, privacy_level STRING, confidence DOUBLE)
        RETURN SELECT doc_id, file_name, document_type, product_name, privacy_level, confidence FROM catalog
        WHERE (search_type = 'all' OR document_type = search_type) AND (search_product = 'all' OR product_name = search_product) AND (search_privacy = 'all' OR privacy_level = search_privacy)""",
    "get_categorization_statistics": """()
        RETURNS TABLE (document_type STRING, product_name STRING, privacy_level STRING, document_count BIGINT, avg_confidence DOUBLE)
        RETURN SELECT document_type, product_name, privacy_level, count(*), round(avg(confidence), 3) FROM catalog GROUP BY document_type, product_name, privacy_level""",
    "get_relevant_acronyms": """(asked STRING)
        RETURNS TABLE (acronym STRING, definition STRING, confidence DOUBLE)
        RETURN SELECT acronym, definition, confidence FROM acronyms
        WHERE (size(array_remove(split(lower(asked), '[^a-z0-9]+'), '')) > 0 AND size(array_except(array_remove(split(lower(asked), '[^a-z0-9]+'), ''), split(lower(definition), '[^a-z0-9]+'))) = 0) OR contains(lower(acronym), lower(asked))""",
    "get_relevant_synonyms": """(asked STRING, kind STRING DEFAULT NULL)
        RETURNS TABLE (term STRING, synonym STRING, term_type STRING, confidence DOUBLE)
        RETURN SELECT term, synonym, term_type, confidence FROM synonyms
        WHERE (contains(lower(term), lower(asked)) OR contains(lower(synonym), lower(asked))) AND (kind IS NULL OR term_type = kind)""",
    "get_term_context": """(asked STRING, kinds ARRAY<STRING> DEFAULT array('synonym', 'acronym', 'abbreviation'))
        RETURNS TABLE (related_term STRING, relationship_type STRING, confidence DOUBLE)
        RETURN SELECT related_term, relationship_type, confidence FROM relations WHERE contains(lower(primary_term), lower(asked)) AND array_contains(kinds, relationship_type)""",
}


class Words:
    """``position, word`` of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


class Spans:
    """``start, end, token`` of the tokens of a text, in characters."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        import re

        for m in re.finditer(r"\w+", text or ""):
            yield m.start(), m.end(), m[0]


class Pieces:
    """``piece_no, start, content``: words of a text packed into pieces of at most ``size`` characters; a longer word is one."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, str]]:
        import re

        held, begin, n = [], 0, 0
        for m in re.finditer(r"\S+", text or ""):
            if held and sum(map(len, held)) + len(held) + len(m[0]) > size:
                yield n, begin, " ".join(held)
                held, n = [], n + 1
            begin = begin if held else m.start()
            held.append(m[0])
        if held:
            yield n, begin, " ".join(held)


ROW_GENERATORS = {"words_of": (Words, "position int, word string"), "spans_of": (Spans, "start int, end int, token string"), "pieces_of": (Pieces, "piece_no int, start int, content string")}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL. Row generators come after a table, ``FROM documents, LATERAL spans_of(text)``; table
    functions need the views that they read from."""
    for name, (rows, schema) in ROW_GENERATORS.items():
        spark.udtf.register(name, F.udtf(rows, returnType=schema))
    known = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    needs = {"get_relevant_acronyms": "acronyms", "get_relevant_synonyms": "synonyms", "get_term_context": "relations"}
    for name, body in TABLE_FUNCTIONS.items():
        if needs.get(name, "catalog") in known:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def derived_columns(chunks: DataFrame, changed_at: str | None = None) -> DataFrame:
    """What the store's triggers set on every row that is written: ``content_length``, ``lexemes`` (the different lower-cased
    tokens, sorted, for ``content``) and, with a column of the time of the change, ``updated_at``."""
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)))
    out = chunks.withColumn("content_length", F.length("content")).withColumn("lexemes", tokens)
    return out if changed_at is None else out.withColumn("updated_at", F.col(changed_at))


def create_views(spark: SparkSession) -> None:
    """The reporting views over the views ``catalog``, ``chunks``, ``patterns`` and ``usage``."""
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW document_summary AS SELECT d.doc_id, d.file_name, d.document_type, d.product_name, d.privacy_level, d.confidence, coalesce(c.chunk_count, 0) AS chunk_count,
        coalesce(c.embedded_chunks, 0) AS embedded_chunks FROM catalog d LEFT JOIN (SELECT doc_id, count(*) AS chunk_count, count_if(embedding IS NOT NULL) AS embedded_chunks FROM chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id""")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW searchable_chunks AS SELECT c.doc_id, c.chunk_no, d.file_name, d.document_type, d.product_name, c.content, d.privacy_level, d.confidence
        FROM chunks c JOIN catalog d ON d.doc_id = c.doc_id WHERE c.embedding IS NOT NULL AND d.status = 'completed'""")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW question_statistics AS SELECT p.question_hash, p.question, p.category, count(*) AS usage_count, avg(u.response_ms) AS avg_response_time, avg(u.quality) AS avg_quality_score,
        count_if(u.feedback = 'positive') AS positive_feedback, count_if(u.feedback = 'negative') AS negative_feedback, max(u.created_at) AS last_used, count(DISTINCT u.user_id) AS unique_users
        FROM patterns p JOIN usage u ON u.pattern_id = p.pattern_id GROUP BY p.question_hash, p.question, p.category""")
