"""The documents as a store of classified documents has them: kind, product, privacy, confidence, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.sources.tables import table

CATALOG = """catalog as (select doc_id, 'doc-' || doc_id as file_name, lang as document_type, source as product_name, case when doc_id % 3 = 0 then 'private' else 'public' end as privacy_level,
    round((n_chars % 97) / 97.0::double, 4) as confidence, case when doc_id % 5 = 0 then 'pending' else 'completed' end as status from documents)"""


def catalog(spark, d):
    """One row a document, as a store of classified documents has it."""
    privacy = F.when(F.col("doc_id") % 3 == 0, "private").otherwise("public")
    status = F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("completed")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("file_name"), F.col("lang").alias("document_type"), F.col("source").alias("product_name"), privacy.alias("privacy_level"),
        F.round((F.col("n_chars") % 97) / 97.0, 4).alias("confidence"), status.alias("status"),
    )
