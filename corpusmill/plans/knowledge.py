"""Knowledge mining over texts that are made from the rows of given tables, as the generated prose holds no such patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import knowledge as K
from corpusmill.registry import query
from corpusmill.sources import files
from corpusmill.sources.tables import table, tables

D = "documents"


def _s(c: str):
    return F.col(c).cast("string")


def parts(spark, d, *text):
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(*(F.lit(t[1:]) if t.startswith("'") else _s(t) for t in text)).alias("text"))


#: Sentences that texts are made of: several forms of each pattern, two hits in one, and lookalikes that are none. ``{n}`` and
#: ``{k}`` are numbers of the row.
BANK = [
    "The Brand Part Name (BPN{n}) is used.", "Advanced Meter Reading (AMR) and Head End System (HES{k}) are here (not one).", "AB{n}: alpha {k}. More text", "AC{k} - gamma ray of {n}", "THE: not one",
    "AAA: all the same letter", "X: too short to be one", "lower Case (abc) is none, nor (ABC) alone", "AB{n}: beta of {k}", "A Meter{n} (also known as endpoint{k}) is here.",
    "The valve{k}, also called tap{n}, and pump (also known as mover).", "Nothing also known as", "meter also called meter", "Step 1: open it Step 2: turn {n}", "- bullet {n}", "* star {k}", "3) third of {n}",
    "Install the part {k}", "Reinstall nothing", "remove it, then install", "", "Étude Générale (EG{k}) fini", "no hit - at all", "AB{n} - delta", "  12: twelve", "-no bullet", "AMR: another reading", "EG{k} - général",
]
_SENTENCES = 6
_LINES = ", ".join(f"([{', '.join(repr(x) for x in BANK)}])[(p_partkey * {3 + 2 * j} + {5 * j}) % {len(BANK)} + 1]" for j in range(_SENTENCES))
_MIXED = f"(select p_partkey as doc_id, replace(replace(array_to_string([{_LINES}], chr(10)), '{{n}}', p_size::varchar), '{{k}}', (p_partkey % 9)::varchar) as text from part)"


def mixed_texts(spark, d):
    bank = F.array(*map(F.lit, BANK))
    lines = F.array(*(F.element_at(bank, ((F.col("p_partkey") * (3 + 2 * j) + 5 * j) % len(BANK) + 1).cast("int")) for j in range(_SENTENCES)))
    text = F.replace(F.replace(F.array_join(lines, "\n"), F.lit("{n}"), _s("p_size")), F.lit("{k}"), (F.col("p_partkey") % 9).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


_FOUND = rf"""with h as (select doc_id, regexp_extract_all(text, '(?:[A-Z]\p{{L}}+ ){{1,6}}\([A-Z0-9]{{2,10}}\)') as h1, regexp_extract_all(text, '(?m)^[A-Z0-9]{{2,10}}: [^\n.]{{3,100}}') as h2,
        regexp_extract_all(text, '(?m)^[A-Z0-9]{{2,10}} - [^\n.]{{3,100}}') as h3 from {_MIXED}),
    e as (select doc_id, 1 as method, unnest(h1) as hit, generate_subscripts(h1, 1) as pos from h union all select doc_id, 2, unnest(h2), generate_subscripts(h2, 1) from h union all select doc_id, 3, unnest(h3), generate_subscripts(h3, 1) from h),
    n as (select *, case when method = 1 then regexp_extract(hit, '\(([A-Z0-9]+)\)', 1) else regexp_extract(hit, '^[A-Z0-9]+') end as acronym,
        trim(case when method = 1 then regexp_extract(hit, '^(.*) \(', 1) else regexp_replace(hit, '^[A-Z0-9]+(: | - )', '') end) as definition from e),
    found as (select doc_id, acronym, arg_max(definition, (method, pos)) as definition, max(method) as method from n
        where acronym not in {K.COMMON_WORDS} and regexp_matches(acronym, '[A-Z]') and (length(acronym) = 1 or replace(acronym, left(acronym, 1), '') <> '') group by 1, 2)"""


@query("tx33_acronyms", _FOUND + " select * from found")
def tx33(spark, d):
    return K.acronyms(mixed_texts(spark, d), "doc_id", "text")


@query("tx34_merged_acronyms", _FOUND + " select acronym, arg_max(definition, (length(definition), -doc_id)) as definition, count(distinct doc_id) as documents from found group by 1")
def tx34(spark, d):
    return K.merged_acronyms(K.acronyms(mixed_texts(spark, d), "doc_id", "text"), "doc_id")


@query("tx35_first_expansions", _FOUND + " select acronym, arg_min(definition, doc_id) as definition from found group by 1")
def tx35(spark, d):
    return K.first_expansions(K.acronyms(mixed_texts(spark, d), "doc_id", "text"), "doc_id")


_ALSO = r"(\p{L}[\p{L}\p{N}_-]*),? \(?also (?:known as|called) (\p{L}[\p{L}\p{N}_-]*)"


@query(
    "tx36_synonyms",
    f"""with h as (select doc_id, unnest(regexp_extract_all(lower(text), '{_ALSO}', 1)) as a, unnest(regexp_extract_all(lower(text), '{_ALSO}', 2)) as b from {_MIXED})
    select term, synonym, count(distinct doc_id) as documents from (select a as term, b as synonym, doc_id from h where a <> b union all select b, a, doc_id from h where a <> b) group by 1, 2""",
)
def tx36(spark, d):
    return K.synonyms(mixed_texts(spark, d), "doc_id", "text")


@query("pf10_acronym_lookup", "select p_partkey as qid, 'AB' || p_size as acronym from part")
def pf10(spark, d):
    queries = parts(spark, d, "'what is ab", "p_size").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    entries = table(spark, d, "part").select(F.concat(F.lit("AB"), _s("p_size")).alias("acronym"), F.lit("alpha").alias("definition"), (F.col("p_size") / 50).alias("confidence"), F.col("p_size").alias("usage_count")).distinct()
    return K.relevant_acronyms(queries, entries, 1).select("qid", "acronym")


@query("pf09_synonym_lookup", "with t as (select distinct 'meter' || (p_size % 5) as term, 'gauge' || p_size as synonym, p_size / 50 as confidence, p_size as usage from part), q as (select p_partkey as qid, 'METER' || (p_partkey % 5) as q from part) select qid, term, synonym, rank from (select qid, term, synonym, row_number() over (partition by qid order by confidence desc, usage desc, term, synonym)::int as rank from q join t on lower(q) = term) where rank <= 3")
def pf09(spark, d):
    part = table(spark, d, "part")
    entries = part.select(F.concat(F.lit("meter"), (F.col("p_size") % 5).cast("string")).alias("term"), F.concat(F.lit("gauge"), _s("p_size")).alias("synonym"), F.lit("x").alias("term_type"), (F.col("p_size") / 50).alias("confidence"), F.col("p_size").alias("usage_count")).distinct()
    queries = part.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("METER"), (F.col("p_partkey") % 5).cast("string")).alias("query"))
    return K.relevant_synonyms(queries, entries, 3, "x").select("qid", "term", "synonym", "rank")


@query(
    "tx39_specifications",
    "select p_partkey as doc_id, 'voltage' as name, p_size::double as value, 'V' as unit from part union all select p_partkey, 'speed', p_size * 10.0, 'rpm' from part union all select p_partkey, 'torque', (10 + p_size) / 2.0, 'Nm' from part union all select p_partkey, 'grade', p_size, 'XY' from part",
)
def tx39(spark, d):
    return K.specifications(parts(spark, d, "'Voltage: ", "p_size", "' volts; speed (rpm): ", "p_size", "'0; torque = 10-", "p_size", "' Nm; Grade: ", "p_size", "'XY"), "doc_id", "text")


@query("fn29_normal_units", "select p_partkey, case p_partkey % 4 when 0 then 'V' when 1 then 'C' when 2 then 'Ω' else p_brand end as unit from part")
def fn29(spark, d):
    i = F.col("p_partkey") % 4
    written = F.when(i == 0, "Volts").when(i == 1, "°C").when(i == 2, " ohm ").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", K.normal_unit(written).alias("unit"))


@query(
    "tx40_steps",
    rf"""with l as (select doc_id, string_split(regexp_replace(text, '(?i)([^\n])(step \d+:)', '\1' || chr(10) || '\2', 'g'), chr(10)) as l from {_MIXED}),
    e as (select doc_id, trim(unnest(l)) as line, generate_subscripts(l, 1) as pos from l),
    i as (select *, trim(coalesce(nullif(regexp_extract(line, '(?i)^(?:step\s+)?\d+[:.)]\s*(.+)$', 1), ''), nullif(regexp_extract(line, '^[-*•]\s+(.+)$', 1), ''), nullif(regexp_extract(line, '(?i)^((?:install|remove)\b.+)$', 1), ''))) as instruction from e),
    n as (select doc_id, row_number() over (partition by doc_id order by pos)::int as step, instruction from i where instruction is not null)
    select *, case when step > 1 then step - 1 end as depends_on from n""",
)
def tx40(spark, d):
    return K.steps(mixed_texts(spark, d), "doc_id", "text", ["install", "remove"])


_PUMP = "'Pump", "p_size", "' is connected to the valve of ", "p_name"


@query("tx38_entity_spans", "select p_partkey as doc_id, 'valve' as entity, 'part' as type, (25 + length(p_size::varchar))::int as start, (30 + length(p_size::varchar))::int as \"end\" from part")
def tx38(spark, d):
    return K.entity_spans(parts(spark, d, *_PUMP), "doc_id", "text", {"part": ["valve", "motor"]}).select("doc_id", "entity", "type", "start", "end")


@query("tx41_relations", "select p_partkey as doc_id, 'Pump' as source, 'connected to' as relation, 'valve' as target from part")
def tx41(spark, d):
    texts = parts(spark, d, "'The Pump of ", "p_size", "' is connected to the valve.")
    entities, verbs = (K.entity_spans(texts, "doc_id", "text", lexicon) for lexicon in ({"part": ["pump", "valve"]}, {"verb": ["connected to"]}))
    return K.relations(entities, verbs, "doc_id")


@query("tx51_index_entries", "select r_regionkey as doc_id, 1 as section, n_name as entry, 'Nation ' || n_nationkey as content from nation join region on n_regionkey = r_regionkey")
def tx51(spark, d):
    nation, region = tables(spark, d, "nation", "region")
    entry = F.concat(F.lit("### "), "n_name", F.lit("\nNation "), _s("n_nationkey"), F.lit("\n"))
    lists = nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("entries"))
    texts = region.join(lists, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("intro\n## "), "r_name", F.lit("\n"), "entries").alias("text"))
    return K.index_entries(texts, "doc_id", "text")


@query("tx19_security_override", "select doc_id, case when contains(source, '1') then 'private' when contains(lang, 'de') then 'internal' when contains(text, 'token') then 'private' when contains(text, 'License') then 'internal' end as security, case when contains(source, '1') or contains(lang, 'de') then 0.95 when contains(text, 'token') or contains(text, 'License') then 0.9 end::double as security_confidence from documents")
def tx19(spark, d):
    docs = table(spark, d, D).select("doc_id", F.concat_ws("-", "source", "lang").alias("name"), "text")
    return K.security_class(docs, "name", "text", [("src[0-9]*1[0-9]*-|token", "private"), ("-de$|License", "internal")]).select("doc_id", "security", "security_confidence")


@query("tx21_merged_classification", "select doc_id, case when doc_id % 3 > 0 then lang when doc_id % 2 = 0 then source else 'unknown' end as kind, greatest(doc_id % 10, doc_id % 7) / 10 as confidence from documents")
def tx21(spark, d):
    docs = table(spark, d, D)
    a = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("Unknown").alias("kind"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    b = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("n/a").alias("kind"), (F.col("doc_id") % 7 / 10).alias("confidence"))
    return K.merged_classes(a, b, "doc_id", ["kind"])


@query("tx20_name_classification", "select doc_id, source as product, '4.' || (doc_id % 17) as version, case when contains(lower(text), 'license') or lang = 'de' then 'reference' when contains(lower(text), 'the') then 'guide' else 'unknown' end as kind, case when contains(lower(text), 'license') or lang = 'de' then 'documentation' else 'general' end as category, list_filter(['que', 'und'], lambda t: contains(lower(text), t)) as topics from documents")
def tx20(spark, d):
    docs = table(spark, d, D).select("doc_id", "text", F.concat("source", F.lit("_"), "lang", F.lit("!_4."), (F.col("doc_id") % 17).cast("string"), F.lit("!.pdf")).alias("name"))
    rows = K.classified_by_name(docs, "name", "text", {"reference": ["license", "_de!"], "guide": ["the"]}, {"reference": "documentation"}, ["que", "und"])
    return rows.select("doc_id", "product", "version", "kind", "category", "topics")


@query("tx02_packed_sentences")
def tx02(spark, d):
    return K.pack_sentences(table(spark, d, D), "doc_id", "text", 1000, 0)


@query("tx04_overlapping_sentences")
def tx04(spark, d):
    return K.pack_sentences(table(spark, d, D), "doc_id", "text", 1000, 200)


@query("tx03_section_chunks")
def tx03(spark, d):
    return K.section_chunks(table(spark, d, D), "doc_id", "text", 512)


@query("src10_data_dictionary", "select case when r_name = 'ASIA' then 'dbo' else r_name end as schema_name, n_name as table_name, c_name as column_name, c_mktsegment as data_type, row_number() over (partition by n_name order by c_custkey)::int as ordinal, c_custkey % 2 = 0 as nullable from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def src10(spark, d):
    c, n, r = tables(spark, d, "customer", "nation", "region")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    schema = F.when(F.col("r_name") == "ASIA", " ").otherwise(F.col("r_name")).alias("schema_name")
    listing = rows.select(schema, F.col("n_name").alias("table_name"), F.col("c_name").alias("column_name"), F.col("c_mktsegment").alias("data_type"), F.when(F.col("c_custkey") % 2 == 0, " YES").otherwise("no").alias("is_nullable"), F.col("c_custkey").alias("position"))
    return files.data_dictionary(listing)


@query(
    "snk05_markdown_index",
    "select 'A' || n_name as acronym, case when row_number() over (order by n_name) = 1 then '## A' || chr(10) || chr(10) else '' end || '### A' || n_name || chr(10) || r_name || case when n_nationkey % 2 = 0 then chr(10) || '*Confidence: 0.5 | Sources: ' || r_name || ', b*' else '' end as line from nation join region on n_regionkey = r_regionkey",
)
def snk05(spark, d):
    n, r = tables(spark, d, "nation", "region")
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.col("n_nationkey") % 2 == 0
    return files.markdown_index(rows.select(F.concat(F.lit("A"), "n_name").alias("acronym"), F.col("r_name").alias("definition"), F.when(even, 0.5).otherwise(0.9).alias("confidence"), (~even).alias("verified"), F.array("r_name", F.lit("b"), F.lit("c")).alias("sources")))


@query("tx42_snapshot", "select p_partkey as doc_id, 2::bigint as entities, 2::bigint as specifications, 2::bigint as steps, 1::bigint as relations from part")
def tx42(spark, d):
    texts = parts(spark, d, "'The Pump of ", "p_size", "' is connected to the valve.\nVoltage: ", "p_size", "' volts; speed (rpm): ", "p_size", "'\nStep 1: open it\n- bullet")
    mined = K.snapshot(texts, "doc_id", "text", {"part": ["pump", "valve"]}, ["connected to"], ["install"])
    return K.snapshot_counts(texts, "doc_id", mined)


@query(
    "tx37_term_context",
    """with s as (select distinct 'meter' || (p_size % 5) as term, 'gauge' || p_size as synonym, p_size / 50 as confidence, p_size as usage from part), r as (select *, row_number() over (partition by term order by confidence desc, usage desc, synonym) as i from s),
    t as (select term, string_agg(term || ' ~ ' || synonym, '; ' order by i) as l from r where i <= 3 group by 1) select p_partkey as qid, 'Acronyms: AB' || p_size || ' = alpha' || chr(10) || 'gauge: ' || l as context from part join t on term = 'meter' || (p_partkey % 5)""",
)
def tx37(spark, d):
    part = table(spark, d, "part")
    i = (F.col("p_partkey") % 5).cast("string")
    queries = part.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("Meter"), i, F.lit(" and ab"), _s("p_size")).alias("query"))
    acronyms = part.select(F.concat(F.lit("AB"), _s("p_size")).alias("acronym"), F.lit("alpha").alias("definition"), (F.col("p_size") / 50).alias("confidence"), F.col("p_size").alias("usage_count")).distinct()
    synonyms = part.select(F.concat(F.lit("meter"), (F.col("p_size") % 5).cast("string")).alias("term"), F.concat(F.lit("gauge"), _s("p_size")).alias("synonym"), F.lit("gauge").alias("term_type"), (F.col("p_size") / 50).alias("confidence"), F.col("p_size").alias("usage_count")).distinct()
    return K.term_context(queries, acronyms, synonyms)
