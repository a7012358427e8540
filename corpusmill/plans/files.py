"""Source and sink queries over files that are written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.operators import relational as R
from corpusmill.plans.streams import folder
from corpusmill.registry import query
from corpusmill.sources import files
from corpusmill.sources.tables import TABLES, table, tables


def place(spark) -> str:
    return f"{folder(spark)}/files-{uuid.uuid4().hex}"


@query("src01_scan", "select vec_id as doc_id, source, length(text)::int as n from embeddings join documents on doc_id = vec_id where embedding is not null order by 1")
def src01(spark, d):
    vectors, docs = tables(spark, d, "embeddings", "documents")
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("doc_id")).join(docs, "doc_id")
    return rows.select("doc_id", "source", F.length("text").alias("n")).orderBy("doc_id")


@query("src02_csv_lines", "select 'CSV Headers: n_nationkey | n_name | n_regionkey' || chr(10) || string_agg(n_nationkey || ' | ' || n_name || ', \"the\" ' || n_regionkey || ' | ' || n_regionkey, chr(10) order by n_nationkey) as content from nation")
def src02(spark, d):
    """A field that holds commas and quotes is one field."""
    path = place(spark)
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "the" '), "n_regionkey").alias("n_name"), "n_regionkey")
    rows.repartitionByRange(1, "n_nationkey").sortWithinPartitions("n_nationkey").write.option("header", True).option("escape", '"').csv(path)
    return files.csv_lines(spark, path).select("content")


@query("src03_json_text", "select count(*) as n from region")
def src03(spark, d):
    path = place(spark)
    table(spark, d, "region").write.json(path)
    return files.whole_texts(spark, path, "JSON Content:\n").select(F.explode(F.split("content", "\n")).alias("l")).filter("l like '{%'").agg(F.count("*").alias("n"))


@query("src04_xml", "select n_name from nation")
def src04(spark, d):
    path = place(spark)
    table(spark, d, "nation").write.format("xml").option("rootTag", "nations").option("rowTag", "nation").save(path)
    lines = files.xml_lines(spark, path).select(F.explode(F.split("content", "\n")).alias("l")).filter("l like '    n_name: %'")
    return lines.select(F.substring_index("l", ": ", -1).alias("n_name"))


@query("src06_jsonl_append", "select doc_id, lang from documents union all select doc_id, lang from documents where doc_id % 2 = 0")
def src06(spark, d):
    path, docs = place(spark), table(spark, d, "documents").select("doc_id", "lang")
    files.write_jsonl(docs, path)
    files.write_jsonl(docs.filter("doc_id % 2 = 0"), path, append=True)
    return files.read_jsonl(spark, path, "doc_id long, lang string")


@query("src07_tolerant_jsonl", "select event_id, (props->>'$.k')::int as k from events where event_id % 7 <> 0")
def src07(spark, d):
    path, events = place(spark), table(spark, d, "events")
    good = F.to_json(F.struct("event_id", F.expr("cast(get_json_object(props, '$.k') as int)").alias("k")))
    events.select(F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(good).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, k int")


@query(
    "src08_flatten",
    """select doc_id, case when quality = 1 then 0.9 else 0.1 end::double as typeprob_good, case when doc_id % 3 = 0 then toxic::double end as typeprob_toxic,
    case when toxic = 1 then 1.0::double end as domainprob_harm, case when toxic = 0 then 0.5::double end as domainprob_plain, case when quality = 1 then 'q' || (doc_id % 5) end as meta_batch from labels""",
)
def src08(spark, d):
    """Maps with keys that only some rows hold, through JSON Lines to Parquet; the keys come from the data."""
    path, rows = place(spark), table(spark, d, "labels")
    good = F.when(F.col("quality") == 1, 0.9).otherwise(0.1)
    types = F.map_concat(F.create_map(F.lit("good"), good), F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("toxic"), F.col("toxic").cast("double"))).otherwise(F.create_map().cast("map<string,double>")))
    domains = F.when(F.col("toxic") == 1, F.create_map(F.lit("harm"), F.lit(1.0))).when(F.col("toxic") == 0, F.create_map(F.lit("plain"), F.lit(0.5)))
    meta = F.when(F.col("quality") == 1, F.create_map(F.lit("batch"), F.concat(F.lit("q"), F.col("doc_id") % 5)))
    files.write_jsonl(rows.select("doc_id", types.alias("types"), domains.alias("domains"), meta.alias("meta")), path)
    schema = "doc_id long, types map<string,double>, domains map<string,double>, meta map<string,string>"
    return files.jsonl_to_parquet(spark, path, f"{path}-flat", schema, {"types": "typeprob", "domains": "domainprob", "meta": "meta"})


@query("src09_round_trip", "select count(*) as written, count(*) as read, []::varchar[] as missing, true as ok from documents")
def src09(spark, d):
    return files.round_trip(table(spark, d, "documents"), place(spark), ["doc_id", "text"])


_KINDS = "replace(replace(replace(lower(data_type), 'integer', 'int'), 'varchar', 'string'), 'timestamp', 'timestamp_ntz')"


@query(
    "src11_catalog",
    f"select table_name as \"table\", column_name as \"column\", column_index::int as position, case data_type when 'FLOAT[]' then 'array<float>' when 'DOUBLE[]' then 'array<double>' else {_KINDS} end as type, true as nullable, n as rows from duckdb_columns() join ("
    + " union all ".join(f"select '{n}' as t, count(*) as n from {n}" for n in TABLES)
    + ") on t = table_name where not internal",
)
def src11(spark, d):
    return files.catalog_profile({n: table(spark, d, n) for n in TABLES})


@query("src12_constraints", "select r_name as constraint_name, string_agg(n_name, ',' order by n_nationkey) as columns from region join nation on r_regionkey = n_regionkey group by 1")
def src12(spark, d):
    region, nation = tables(spark, d, "region", "nation")
    rows = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return files.constraint_columns(rows.select(F.col("r_name").alias("constraint_name"), F.col("n_name").alias("column_name"), F.col("n_nationkey").alias("ordinal")))


@query("snk06_json_export", "select event_type, count(*) as n from events group by 1")
def snk06(spark, d):
    path = place(spark)
    summary = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    files.write_jsonl(summary.select(F.struct("event_type", "n").alias("summary")), path)
    return spark.read.schema("summary struct<event_type string, n long>").json(path).select("summary.*")


@query(
    "snk07_reshape",
    "select doc_id, coalesce(try_cast(regexp_extract(text, '([0-9]+)', 1) as int), doc_id::int) as page, label from documents join embeddings on vec_id = doc_id where label = (select label from embeddings group by 1 order by count(*) desc, label limit 1)",
)
def snk07(spark, d):
    docs, vectors = tables(spark, d, "documents", "embeddings")
    common = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    rows = vectors.join(F.broadcast(common), "label").join(docs, F.col("vec_id") == F.col("doc_id"))
    page = F.coalesce(F.expr("try_cast(regexp_extract(text, '([0-9]+)', 1) as int)"), F.col("doc_id").cast("int"))
    return rows.select("doc_id", page.alias("page"), "label")


@query("st01_ingest", "select doc_id, md5(text) as hash from (select doc_id, text, row_number() over (partition by text order by doc_id) as i from documents) where i = 1")
def st01(spark, d):
    """New files go through a checkpointed stream; each batch keeps the first document of a hash, as an upsert would."""
    path = place(spark)
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")

    def ingest(batch, epoch):
        new = batch.select("doc_id", F.md5("text").alias("hash"))
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(ingest).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path).select("doc_id", "hash")
    return R.latest(rows, ["hash"], [F.col("doc_id")])
