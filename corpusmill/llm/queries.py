"""One query an operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, merkle, mixing, oracles, output, packing, quality_rules, sharding, simhash, site_quality, spelling, substrings, tokens, vptree
from .common import read, scratch_dir


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return tokens.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), rule="majority")


def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, recall=0.95)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"), shingle=4, bits=4)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.strip_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("section", F.concat_ws("/", "source", "lang"))
    judged = site_quality.site_quality(docs, read(spark, sf_dir, "labels"), host="source", path="section")
    return judged.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/token-orc-{uuid.uuid4().hex}"
    output.write_token_orc(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return output.token_digest(spark, path)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "accepted")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(read(spark, sf_dir, "documents"), tampered=merkle.every_third(F.col("doc_id")))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_vptree,
        op3_packing,
        op4_simhash,
        op5_quality_rules,
        op6_substring_dedup,
        op7_site_quality,
        op8_mixing,
        op9_sharding,
        op10_token_orc,
        op11_language_id,
        op12_spelling,
        op13_merkle,
    )
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    **oracles.ORACLE_SQL,
    "op6_substring_dedup": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        windows as (select doc_id, k, array_to_string(w[k : k + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d)),
        firsts as (select s, min(doc_id) as first from windows group by s),
        gone as (select distinct doc_id, k + j as p from windows join firsts using (s), range(13) r(j) where first < doc_id),
        words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
        kept as (select doc_id, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id),
        n as (select doc_id, count(*) as n from gone group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join kept using (doc_id) left join n using (doc_id)""",
    "op8_mixing": f"""
        with d0 as (select doc_id, source, len({_WORDS})::bigint as size,
            md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) || ':' || coalesce('+' || source, '-')) as mark from documents),
        s as (select *, row_number() over (partition by mark) - 1 as nth from d0),
        p as (select source, sum(size)::bigint as source_size from s group by source),
        w as (select *, ([3, 1, 2])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, source_size * 2::double as most from p),
        l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(most) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
            from w window b as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
        t as (select source, source_size, least(most, weight * coalesce(max(case when level <= most / weight then level end) over (), max(level) over ())) as target from l),
        r as (select s.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole,
            (('0x' || substr(md5(mark || ':' || nth || ':mix'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u from s join t on s.source is not distinct from t.source),
        q as (select *, target - whole * source_size as wanted, round(sqrt(size), 2) as w from r),
        g as (select source, w, any_value(wanted) as wanted, sum(size)::double as words from q where size > 0 and wanted > 0 group by source, w),
        v as (select source, w, (wanted - coalesce(sum(words) over (partition by source order by w desc rows between unbounded preceding and 1 preceding), 0))
            / sum(words * w) over (partition by source order by w rows unbounded preceding) as level from g),
        fit as (select source, max(w) as fit, arg_max(level, w) as level from v where level * w < 1 group by source),
        d as (select q.*, size > 0 and wanted > 0 and w > coalesce(fit, 0) as certain, level * w as p from q left join fit on q.source is not distinct from fit.source),
        k as (select *, wanted - coalesce(sum(case when certain then size end) over (partition by source), 0) as remaining from d),
        o as (select *, (u / (1 - u)) / (p / (1 - p)) as odds from k where size > 0 and wanted > 0 and not certain),
        c as (select *, odds / (1 + odds) as place, sum(size) over (partition by source order by odds / (1 + odds), mark, nth rows unbounded preceding) as upto from o),
        h as (select *, remaining - coalesce(max(case when upto <= remaining then upto end) over (partition by source), 0) as gap from c),
        f as (select *, row_number() over (partition by source, upto > remaining order by abs(gap - size), place, mark, nth) as nearest from h),
        m as (select mark, nth from f where upto <= remaining or (nearest = 1 and abs(gap - size) < gap) union all select mark, nth from d where certain)
        select q.doc_id, q.size, q.source, q.source_size, q.target, (q.whole + (m.mark is not null)::int) * q.size as taken
        from q left join m on q.mark = m.mark and q.nth = m.nth""",
}
