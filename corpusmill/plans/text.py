"""Queries over texts: normal forms, keys, overlaps, chunks, terms, classes and metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import mining as M
from corpusmill.operators import ranking as K
from corpusmill.operators import relational as R
from corpusmill.registry import query
from corpusmill.sources.tables import table, tables

C, D = "conversations", "documents"
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format
WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')".format
SENT = r"list_filter(list_transform(regexp_split_to_array({}, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')".format
COLL = r"trim(regexp_replace({}, '\s+', ' ', 'g'))".format
STOP = ["the", "of", "and", "to", "in", "is", "der", "die", "das", "und", "de", "la", "le", "et", "el", "y"]


def cascade(classes: dict[str, list[str]], column: str, default: str) -> str:
    """SQL of a first-match cascade of substrings."""
    found = (" or ".join(f"contains(lower({column}), '{w}')" for w in words) for words in classes.values())
    return "case " + " ".join(f"when {f} then '{c}'" for f, c in zip(found, classes)) + f" else '{default}' end"


STOPS = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


@query("fn01_normal_query", "select conv_id, turn, " + COLL("regexp_replace(regexp_replace(lower(text), '[?,;:!\"()]', '', 'g'), '[–—]', '-', 'g')") + " as q from conversations")
def fn01(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.normal_query("text").alias("q"))


@query("fn02_normal_question", "select conv_id, turn, regexp_replace(" + COLL("lower(text)") + r", '[^\p{L}\p{N}_\s?!.]', '', 'g') as q from conversations")
def fn02(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.normal_question("text").alias("q"))


@query("fn03_normal_relevance", "select conv_id, turn, " + COLL(r"regexp_replace(lower(text), '[.,;:\-()\[\]]', '', 'g')") + " as q from conversations")
def fn03(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.normal_relevance("text").alias("q"))


@query("fn04_normal_cache", "select conv_id, turn, regexp_replace(" + COLL("lower(text)") + ", '[?,;:!]', '', 'g') as q from conversations")
def fn04(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.normal_cache("text").alias("q"))


@query("fn05_hash_keys", "select doc_id, sha256(text) as full_hash, substr(sha256(text), 1, 16) as short_hash, md5(text) as content_hash from documents")
def fn05(spark, d):
    return table(spark, d, D).select("doc_id", F.sha2("text", 256).alias("full_hash"), T.short_hash("text").alias("short_hash"), F.md5("text").alias("content_hash"))


@query("fn06_hash_id", "select c_custkey, ('0x' || substr(sha256(lower(trim(c_name))), 1, 7))::bigint as user_id from customer")
def fn06(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.hash_id("c_name").alias("user_id"))


@query("fn07_scoped_key", "select conv_id, turn, 'chat:' || substr(sha256(text), 1, 16) || ':' || conv_id as key from conversations")
def fn07(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.scoped_key("chat", T.short_hash("text"), F.col("conv_id").cast("string")).alias("key"))


@query("fn08_tokens", "select doc_id, " + TOK("text") + " as tokens from documents")
def fn08(spark, d):
    return table(spark, d, D).select("doc_id", T.tokens("text").alias("tokens"))


@query("fn09_split_words", "select doc_id, len(" + WORDS("text") + ") as n from documents")
def fn09(spark, d):
    return table(spark, d, D).select("doc_id", F.size(T.split_words("text")).cast("long").alias("n"))


@query("fn10_sentences", "select conv_id, turn, " + SENT("text") + " as sentences from conversations")
def fn10(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.sentences("text").alias("sentences"))


@query(
    "fn11_stop_words",
    f"with w as (select conv_id, turn, {TOK('text')} as w from conversations), k as (select *, list_filter(w, lambda x: x not in {STOPS} or x = 'in') as l from w) select conv_id, turn, case when len(l) = 0 then w else l end as words from k",
)
def fn11(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.without_stop_words(T.tokens("text"), STOP, ["in"]).alias("words"))


@query(
    "fn12_keywords",
    f"select conv_id, turn, list_filter(list_transform({WORDS('lower(text)')}, lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x not in {STOPS} and length(x) > 2) as keywords from conversations",
)
def fn12(spark, d):
    return table(spark, d, C).select("conv_id", "turn", T.keywords(T.split_words(F.lower("text")), STOP).alias("keywords"))


_ENT = [r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}\.\d{1,2}\.\d{4}", r"[vV]?\d+\.\d+(?:\.\d+)*", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"[A-Z]{2,}-\d+"]


@query(
    "fn13_entities",
    "select doc_id, list_sort(list_distinct(" + " || ".join(f"regexp_extract_all(text, '{p}')" for p in _ENT) + ")) as entities from documents",
)
def fn13(spark, d):
    return table(spark, d, D).select("doc_id", F.sort_array(T.entities("text")).alias("entities"))


_PAIR = "select a.conv_id, a.turn, a.text as q, b.text as a from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'"


def pairs(spark, d):
    """Questions and the answers that follow them."""
    c = table(spark, d, C)
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return a.join(b, ["conv_id", "turn"])


@query(
    "fn14_overlap",
    f"with t as (select conv_id, turn, list_distinct({TOK('q')}) as x, list_distinct({TOK('a')}) as y from ({_PAIR})) select conv_id, turn, case when len(x) = 0 then 0.0 else round(len(list_intersect(x, y)) / len(x), 6) end as overlap from t",
)
def fn14(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(T.overlap(T.tokens("q"), T.tokens("a")), 6).alias("overlap"))


@query("fn15_sequence_similarity")
def fn15(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(T.sequence_similarity("q", "a"), 6).alias("similarity"))


@query("fn16_relevance")
def fn16(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(T.relevance(F.col("q"), F.col("a"), T.overlap(T.tokens("q"), T.tokens("a"))), 6).alias("relevance"))


_VP = "select a.vec_id as x, b.vec_id as y, a.embedding::double[] as u, b.embedding::double[] as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


def neighbours(spark, d):
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("x"), F.col("embedding").alias("u"))
    return a.join(e.select((F.col("vec_id") - 1).alias("x"), F.col("vec_id").alias("y"), F.col("embedding").alias("v")), "x")


@query("fn17_cosine", f"select x, y, round(list_cosine_similarity(u, v), 6) as cosine from ({_VP})")
def fn17(spark, d):
    return neighbours(spark, d).select("x", "y", F.round(V.cosine(F.col("u"), F.col("v")), 6).alias("cosine"))


@query(
    "fn18_distances",
    f"select x, y, round(list_distance(u, v), 6) as l2, round(1 - list_distance(u, v), 6) as one_minus, round(1 / (1 + list_distance(u, v)), 6) as inverse, round(list_dot_product(u, v), 6) as dot from ({_VP})",
)
def fn18(spark, d):
    l2, dot = V.l2(F.col("u"), F.col("v")), V.dot(F.col("u"), F.col("v"))
    return neighbours(spark, d).select("x", "y", F.round(l2, 6).alias("l2"), F.round(1 - l2, 6).alias("one_minus"), F.round(1 / (1 + l2), 6).alias("inverse"), F.round(dot, 6).alias("dot"))


@query("fn19_padded", f"select x, round(list_dot_product(u[1:32] || list_transform(range(32), lambda i: 0.0), v), 6) as dot from ({_VP})")
def fn19(spark, d):
    short = V.padded(F.slice("u", 1, 32), 64)
    return neighbours(spark, d).select("x", F.round(V.dot(short, F.col("v")), 6).alias("dot"))


@query(
    "fn20_hashed_bag",
    f"""with w as (select doc_id, unnest({WORDS('lower(text)')}[1:100]) as w, generate_subscripts({WORDS('lower(text)')}[1:100], 1) - 1 as p from documents),
    b as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 768 as bucket, sum(1.0 / (p + 1)) as x from w group by 1, 2),
    n as (select doc_id, sqrt(sum(x * x)) as n from b group by 1) select doc_id, bucket, round(x / n, 6) as weight from b join n using (doc_id)""",
)
def fn20(spark, d):
    rows = table(spark, d, D).select("doc_id", F.posexplode(F.slice(T.split_words(F.lower("text")), 1, 100)).alias("p", "w"))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(768))
    b = rows.groupBy("doc_id", bucket.alias("bucket")).agg(F.sum(1.0 / (F.col("p") + 1)).alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    return b.select("doc_id", "bucket", F.round(F.col("x") / n, 6).alias("weight"))


_AGE = "with t as (select max(ts) as last from events), e as (select event_id, epoch(last) - epoch(ts) as age, value from events, t)"


def aged(spark, d):
    e = table(spark, d, "events")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last")))).withColumn("age", seconds("last") - seconds("ts"))


@query("fn21_recency", _AGE + " select event_id, round(pow(0.5, age / 3600), 6) as recency from e")
def fn21(spark, d):
    return aged(spark, d).select("event_id", F.round(T.recency(F.col("age")), 6).alias("recency"))


@query("fn22_frequency", "select user_id, round(least(1, ln(count(*) + 1) / ln(10)), 6) as frequency from events group by 1")
def fn22(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.round(T.frequency(F.col("n")), 6).alias("frequency"))


@query("fn23_time_factor", _AGE + " select event_id, round(greatest(0.1, 1 - age / 3600) * least(1, value / 100), 6) as weight from e")
def fn23(spark, d):
    return aged(spark, d).select("event_id", F.round(T.time_factor(F.col("age")) * F.least(F.lit(1.0), F.col("value") / 100), 6).alias("weight"))


@query("fn24_token_estimate", f"select doc_id, floor(len({WORDS('text')}) * 1.3)::bigint as tokens from documents")
def fn24(spark, d):
    return table(spark, d, D).select("doc_id", T.token_estimate("text").alias("tokens"))


@query("fn26_unknown", "select doc_id, (lang is null or lower(trim(lang)) in ('', 'unknown', 'n/a')) or source = 'src1' as unknown from documents")
def fn26(spark, d):
    return table(spark, d, D).select("doc_id", (T.is_unknown("lang") | T.is_unknown(F.when(F.col("source") == "src1", "Unknown").otherwise(F.col("source")))).alias("unknown"))


@query("fn27_first_object", r"select event_id, regexp_extract('Answer: ' || props || ' done {x}', '(\{(?:[^{}]|\{[^{}]*\})*\})', 1) as found from events")
def fn27(spark, d):
    return table(spark, d, "events").select("event_id", T.first_object(F.concat(F.lit("Answer: "), "props", F.lit(" done {x}"))).alias("found"))


@query("fn28_safe_casts", "select event_id, try_cast(props as int) as n, try_cast(props->>'$.k' as int) as k, lower(event_type) in ('true', '1', 'yes', 't') as flag from events")
def fn28(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.expr("try_cast(props as int)").alias("n"), F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("k"), T.safe_bool("event_type").alias("flag")
    )


_SE = f"with t as (select conv_id, turn, list_distinct({TOK('q')}) as x, list_distinct({TOK('a')}) as y from ({_PAIR}))"


@query("se04_token_sets", _SE + " select conv_id, turn, len(list_intersect(x, y)) as both, len(list_distinct(x || y)) as either, round(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 6) as iou from t")
def se04(spark, d):
    x, y = T.tokens("q"), T.tokens("a")
    either = F.size(F.array_union(x, y)).cast("long")
    return pairs(spark, d).select("conv_id", "turn", F.size(F.array_intersect(x, y)).cast("long").alias("both"), either.alias("either"), F.round(T.jaccard(x, y), 6).alias("iou"))


@query(
    "tx01_sentence_chunks",
    f"""with p as (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as para from documents),
    s as (select doc_id, para, unnest({SENT('p')}) as s, generate_subscripts({SENT('p')}, 1) as pos from p)
    select doc_id, (row_number() over (partition by doc_id order by para, pos) - 1)::int as chunk_index, concat_ws(' ', lag(s) over (partition by doc_id, para order by pos), s) as content from s""",
)
def tx01(spark, d):
    return M.sentence_chunks(table(spark, d, D), "doc_id", "text")


@query(
    "tx05_word_windows",
    f"""with w as (select doc_id, {WORDS('text')} as w from documents), c as (select doc_id, w, unnest(range(0, greatest(ceil((len(w) - 1000) / 800.0), 0)::bigint + 1))::int as chunk_index from w where len(w) > 0)
    select doc_id, chunk_index, array_to_string(w[chunk_index * 800 + 1 : chunk_index * 800 + 1000], ' ') as content from c""",
)
def tx05(spark, d):
    return M.word_windows(table(spark, d, D), "doc_id", "text")


@query(
    "tx07_chunk_quality",
    f"""with m as (select conv_id, turn, case when turn % 4 = 3 then ' \t' else regexp_replace(text, '[.]+\\s*$', '') || case turn % 5 when 1 then ' with' when 2 then 'is' when 3 then '! ' else '.' end end as text from conversations),
    r as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as b, lead(turn) over (partition by conv_id order by turn) is null as last from m),
    i as (select conv_id, count(*) as chunks, count(*) filter (where b = '') as empty, count(*) filter (where {' or '.join(f"ends_with(b, '{w}')" for w in M.DANGLING)}) as truncated,
    count(*) filter (where b <> '' and not regexp_matches(b, '[.!?]$') and not last) as unfinished, round(avg(length(b)), 4) as mean_length,
    min(length(b)) filter (where b <> '')::int as min_length, max(length(b)) filter (where b <> '')::int as max_length from r group by 1)
    select *, greatest(0, 100 - 10 * (truncated + unfinished)) as score from i""",
)
def tx07(spark, d):
    """Turns as chunks, of which some are made empty, unfinished or to end in a dangling word."""
    end = F.when(F.col("turn") % 5 == 1, " with").when(F.col("turn") % 5 == 2, "is").when(F.col("turn") % 5 == 3, "! ").otherwise(".")
    made = F.when(F.col("turn") % 4 == 3, F.lit(" \t")).otherwise(F.concat(F.regexp_replace("text", r"[.]+\s*$", ""), end))
    return M.chunk_quality(table(spark, d, C).select("conv_id", "turn", made.alias("text")), "conv_id", "turn", "text")


_CLASSES = {"contact": {"@": 1.0, "phone": 2.0}, "legal": {"licen[sc]e": 2.0, "copyright": 1.5}, "secret": {"token = ": 3.0, "key = ": 1.0}}


_BOOSTS = {"contact": ["mail", "Call"], "legal": ["MIT ", "rights"], "secret": ["="]}


def _score_sql(label):
    patterns = " + ".join(f"{w} * len(regexp_extract_all(t, '{p}'))" for p, w in _CLASSES[label].items())
    return patterns + "".join(f" + 0.5 * contains(t, '{b.lower()}')::int" for b in _BOOSTS[label])


@query(
    "tx10_pattern_class",
    "with s as (select doc_id, " + ", ".join(f"{_score_sql(k)} as {k}" for k in _CLASSES) + """ from (select doc_id, lower(text) as t from documents)),
    m as (select *, greatest(contact, legal, secret) as top, contact + legal + secret as total from s)
    select doc_id, case when top = 0 then 'general' when contact = top then 'contact' when legal = top then 'legal' else 'secret' end as label,
    case when top = 0 then 0.5 else round((top / total)::double, 6) end as confidence from m""",
)
def tx10(spark, d):
    return M.classify(table(spark, d, D), "doc_id", "text", _CLASSES, "general", boosts=_BOOSTS).withColumn("confidence", F.round("confidence", 6))


@query("tx14_category", "select conv_id, turn, " + cascade(K.QUESTION_CATEGORIES, "text", "general") + " as category from conversations")
def tx14(spark, d):
    return table(spark, d, C).select("conv_id", "turn", K.first_class(F.col("text"), K.QUESTION_CATEGORIES, "general").alias("category"))


@query(
    "tx18_privacy",
    "select doc_id, case when " + " or ".join(f"contains(lower(text), '{w}')" for w in K.CONFIDENTIAL) + " or " + " or ".join(f"regexp_matches(lower(text), '{p}')" for p in K.CONFIDENTIAL_PATTERNS)
    + " or len(list_filter(string_split(lower(text), chr(10))[1:5] || string_split(lower(text), chr(10))[-5:], lambda x: contains(x, 'confidential') or contains(x, 'private') or contains(x, 'restricted'))) > 0 then 'private' else 'public' end as privacy"
    " from (select doc_id, text || case when doc_id % 7 = 0 then chr(10) || 'Strictly  Confidential' when doc_id % 7 = 1 then ' do  not share' else '' end as text from documents)",
)
def tx18(spark, d):
    """Every seventh text is given a marking of each kind, as invented words hold none."""
    i = F.col("doc_id") % 7
    marked = F.concat("text", F.when(i == 0, "\nStrictly  Confidential").when(i == 1, " do  not share").otherwise(""))
    return table(spark, d, D).select("doc_id", K.confidentiality(marked).alias("privacy"))


@query(
    "tx23_features",
    rf"""select doc_id, len({WORDS('text')}) as words, round(length(regexp_replace(text, '\s+', '', 'g')) / nullif(len({WORDS('text')}), 0), 6) as mean_word,
    round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 6) as digit_ratio, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text), 6) as upper_ratio,
    len(regexp_extract_all(text, '[|*-]')) as bullets from documents where length(text) > 0""",
)
def tx23(spark, d):
    n, words = F.length("text"), F.size(T.split_words("text")).cast("long")
    only = lambda p: F.length(F.regexp_replace("text", p, ""))
    return table(spark, d, D).filter(n > 0).select(
        "doc_id", words.alias("words"), F.round(only(r"\s+") / words, 6).alias("mean_word"), F.round(only("[^0-9]") / n, 6).alias("digit_ratio"),
        F.round(only("[^A-Z]") / n, 6).alias("upper_ratio"), F.regexp_count("text", F.lit("[|*-]")).cast("long").alias("bullets"),
    )


def _chances(words: dict[str, list[str]], kind: str) -> str:
    """SQL rows ``doc_id, kind, label, share, chance, best`` of a lexicon's labels."""
    counts = ", ".join("(" + " + ".join(f"len(regexp_extract_all(t, '{w}'))" for w in ws) + ")" for ws in words.values())
    return f"""select doc_id, '{kind}' as kind, ({list(words)})[i] as label, round(n[i] / greatest(1, list_sum(n)), 6) as share,
        round((n[i] / greatest(1, list_sum(n)) + 0.05) / (case when list_sum(n) > 0 then 1 else 0 end + {len(words)} * 0.05), 6) as chance, i = list_position(n, list_max(n)) as best
        from (select doc_id, [{counts}] as n from (select doc_id, lower(text) as t from documents)), range(1, {len(words) + 1}) r(i)"""


@query("tx24_domain_scores", f"{_chances(M.DOMAINS, 'domain')} union all {_chances(M.KINDS, 'type')}")
def tx24(spark, d):
    docs = table(spark, d, D)
    parts = [M.class_chances(docs, "doc_id", "text", words).withColumn("kind", F.lit(kind)) for kind, words in (("domain", M.DOMAINS), ("type", M.KINDS))]
    return parts[0].unionByName(parts[1])


_NOT_TERMS = ["The", "That", "Und", "Les"]


@query(
    "tx26_term_frequency",
    f"""with t as (select text, lower(text) as low, {TOK('text')} as w from documents),
    e as (select unnest(regexp_extract_all(low, '\\d+\\.\\d+(?:\\.\\d+)?') || list_filter(w, lambda x: x in {tuple(M.TERM_WORDS)}) || list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{2,6}}$'))
        || regexp_extract_all(low, '/[^\\s]+') || regexp_extract_all(low, '(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}') || list_filter(w, lambda x: regexp_matches(x, '^[0-9]{{2,5}}$'))
        || list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*'), lambda x: length(x) > 3 and x not in {tuple(_NOT_TERMS)})) as term from t)
    select term, count(*) as n from e where length(term) > 1 group by 1 order by n desc, term limit 100""",
)
def tx26(spark, d):
    return M.technical_terms(table(spark, d, D), "text", stop=_NOT_TERMS)


@query(
    "tx27_pattern_examples",
    r"""with m as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+tion')) as value, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+tion'), 1) as pos from documents),
    f as (select value, min((doc_id, pos)) as first from m group by 1) select value from f order by first limit 20""",
)
def tx27(spark, d):
    m = table(spark, d, D).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+tion)"), 1)).alias("pos", "value"))
    return m.groupBy("value").agg(F.min(F.struct("doc_id", "pos")).alias("first")).orderBy("first").limit(20).select("value")


@query(
    "tx28_phrases",
    rf"""with s as (select list_filter(regexp_extract_all(lower(s), '\p{{L}}+'), lambda x: x not in {STOPS}) as w from (select unnest({SENT('text')}) as s from documents)),
    g as (select unnest(list_filter(list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' ')), lambda p: length(p) >= 5)
    || list_filter(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')), lambda p: length(p) >= 8)) as phrase from s)
    select phrase, count(*) as n from g group by 1 order by n desc, phrase limit 50""",
)
def tx28(spark, d):
    return M.phrases(table(spark, d, D), "text", STOP, 50)


@query(
    "tx29_headers",
    """with l as (select unnest(string_split(text, chr(10))) as l from documents) select case when regexp_matches(l, '^[0-9]+[.]') then 'numbered' when regexp_matches(l, '^[A-Z !.,]+$') then 'capitals'
    when regexp_matches(l, ':$') then 'colon' when regexp_matches(l, '[|]') then 'table' end as kind, count(*) as n from l where length(l) between 4 and 99 group by 1 having kind is not null""",
)
def tx29(spark, d):
    line = F.col("l")
    kind = F.when(line.rlike("^[0-9]+[.]"), "numbered").when(line.rlike("^[A-Z !.,]+$"), "capitals").when(line.rlike(":$"), "colon").when(line.rlike("[|]"), "table")
    lines = table(spark, d, D).select(F.explode(F.split("text", "\n")).alias("l")).filter(F.length("l").between(4, 99))
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).filter("kind is not null")


@query(
    "tx30_vocabulary_stats",
    f"with c as (select lang, t, count(*) as n from (select lang, unnest({TOK('text')}) as t from documents) group by 1, 2) select lang, sum(n)::bigint as tokens, count(*) as unique, round(count(*) / sum(n), 6) as richness, max(n) as most from c group by 1",
)
def tx30(spark, d):
    return M.vocabulary_stats(table(spark, d, D), "lang", "text")


@query("tx31_vocabulary", f"select t as word, count(*) as n from (select unnest({TOK('text')}) as t from documents) where length(t) > 2 group by 1 order by n desc, word limit 10000")
def tx31(spark, d):
    words = table(spark, d, D).select(F.explode(T.tokens("text")).alias("word")).filter(F.length("word") > 2)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10000)


@query("tx32_document_types", "select case when contains(lower(text), 'license') then 'legal' when contains(text, '|') then 'table' when regexp_matches(text, '[0-9]') then 'numeric' else 'other' end as kind, count(*) as n from documents group by 1")
def tx32(spark, d):
    rules = [("legal", F.contains(F.lower("text"), F.lit("license"))), ("table", F.contains("text", F.lit("|"))), ("numeric", F.col("text").rlike("[0-9]"))]
    return table(spark, d, D).groupBy(M.first_match(rules, "other").alias("kind")).agg(F.count("*").alias("n"))


_TECH = r"list_distinct(regexp_extract_all(text, '[A-Z]{2,}[0-9]*|[0-9]+[.][0-9]+'))"


@query(
    "tx44_importance",
    f"""with t as (select conv_id, turn, text, {_TECH} as terms, len({WORDS('text')}) as n, len({SENT('text')}) as s from conversations)
    select conv_id, turn, round(least(1, case when n between 50 and 200 then 0.2::double when n between 20 and 400 then 0.1 else 0 end + least(0.3, 5 * len(terms) / greatest(n, 1)) + case when (upper(text) = text and lower(text) <> text) or regexp_matches(text, '^#+\\s+') then 0.2 else 0 end
    + case when regexp_matches(lower(text), '\\b(?:step|procedure|method|instruction|how to)\\b') then 0.2 else 0 end + least(0.1, 0.02 * len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b')))), 6) as importance,
    case when n = 0 or s = 0 then 0.5 else round((case when n / s between 10 and 20 then 1.0::double when n / s between 5 and 30 then 0.7 else 0.4 end + greatest(0.2, 1 - 3 * len(terms) / n)) / 2, 6) end as readability from t""",
)
def tx44(spark, d):
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z]{2,}[0-9]*|[0-9]+[.][0-9]+)"), 1))
    readability = K.readability(F.size(T.split_words("text")), F.size(T.sentences("text")), terms)
    return table(spark, d, C).select("conv_id", "turn", F.round(K.importance(F.col("text"), terms), 6).alias("importance"), F.round(readability, 6).alias("readability"))


@query("tx45_row_text", "select p_partkey, 'p_name: ' || p_name || ', p_brand: ' || p_brand || ', p_size: ' || p_size as row_text from part")
def tx45(spark, d):
    cols = ["p_name", "p_brand", "p_size"]
    return table(spark, d, "part").select("p_partkey", F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in cols)).alias("row_text"))


@query(
    "tx46_table_profile",
    "select name, case when numeric > 0.8 then 'numeric' when numeric > 0.3 then 'mixed' else 'text' end as kind from (select unnest([{'name': 'p_name', 'numeric': avg((try_cast(p_name as double) is not null)::int)}, {'name': 'p_brand', 'numeric': avg((try_cast(replace(p_brand, 'Brand#', '') as double) is not null)::int)}, {'name': 'p_size', 'numeric': avg((try_cast(p_size::varchar as double) is not null)::int)}], recursive := true) from part)",
)
def tx46(spark, d):
    shown = {"p_name": F.col("p_name"), "p_brand": F.regexp_replace("p_brand", "Brand#", ""), "p_size": F.col("p_size").cast("string")}
    share = table(spark, d, "part").agg(*(F.avg(c.try_cast("double").isNotNull().cast("int")).alias(n) for n, c in shown.items()))
    rows = share.unpivot([], list(shown), "name", "numeric")
    return rows.select("name", F.when(F.col("numeric") > 0.8, "numeric").when(F.col("numeric") > 0.3, "mixed").otherwise("text").alias("kind"))


@query(
    "tx48_topics",
    f"""with c as (select conv_id, w, count(*) as n from (select conv_id, unnest({TOK('text')}) as w from conversations) where length(w) > 4 group by 1, 2 having count(*) > 1)
    select conv_id, w as word, n from (select *, row_number() over (partition by conv_id order by n desc, w) as i from c) where i <= 5""",
)
def tx48(spark, d):
    words = table(spark, d, C).select("conv_id", F.explode(T.tokens("text")).alias("word")).filter(F.length("word") > 4)
    counts = words.groupBy("conv_id", "word").agg(F.count("*").alias("n")).filter("n > 1")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("i", nth).filter("i <= 5").drop("i")


@query(
    "tx50_chunk_dedupe",
    "select source, count(*) as total, count(*) filter (where i > 1) as skipped, count(*) filter (where i = 1) as inserted from (select source, row_number() over (partition by source, md5(text) order by doc_id) as i from documents) group by 1",
)
def tx50(spark, d):
    rows = M.dedupe_chunks(table(spark, d, D), ["source"], "text", "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if("duplicate").alias("skipped"), F.count_if(~F.col("duplicate")).alias("inserted"))


@query("ag37_corpus_statistics", f"select count(*) as n, round(avg(len({WORDS('text')})), 4) as mean_words, max(len({WORDS('text')})) as most_words, min(len({WORDS('text')})) as least_words from documents")
def ag37(spark, d):
    n = F.size(T.split_words("text")).cast("long")
    return table(spark, d, D).agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_words"), F.max(n).alias("most_words"), F.min(n).alias("least_words"))


@query("ag29_chunk_statistics", f"select lang, round(avg(n), 4) as mean, median(n) as median, min(n) as least, max(n) as most, count(*) filter (where refs) as with_refs from (select lang, len({WORDS('text')}) as n, contains(text, 'License') as refs from documents) group by 1")
def ag29(spark, d):
    n = F.size(T.split_words("text")).cast("long")
    rows = table(spark, d, D).select("lang", n.alias("n"), F.contains("text", F.lit("License")).alias("refs"))
    sums = rows.groupBy("lang").agg(F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if("refs").alias("with_refs"))
    return sums.join(R.percentiles(rows, ["lang"], "n", {"median": 0.5}), "lang", "left")


@query(
    "ds01_instruction_rows",
    "select doc_id, case when lang = 'en' then 'Summarise this text.' else 'Summarise this foreign text.' end as instruction, concat_ws(chr(10), 'Source: ' || source, substr(text, 1, 1000)) as input from documents where length(text) >= 200",
)
def ds01(spark, d):
    instruction = F.when(F.col("lang") == "en", "Summarise this text.").otherwise("Summarise this foreign text.")
    body = F.concat_ws("\n", F.concat(F.lit("Source: "), "source"), F.substring("text", 1, 1000))
    return table(spark, d, D).filter(F.length("text") >= 200).select("doc_id", instruction.alias("instruction"), body.alias("input"))


@query(
    "ds02_question_rows",
    f"with s as (select doc_id, unnest(list_filter({SENT('text')}, lambda x: length(x) >= 50)[1:2]) as s from documents) select doc_id, 'What does the text say about ' || string_split(s, ' ')[1] || '?' as question, s as answer from s",
)
def ds02(spark, d):
    kept = F.slice(F.filter(T.sentences("text"), lambda s: F.length(s) >= 50), 1, 2)
    rows = table(spark, d, D).select("doc_id", F.explode(kept).alias("answer"))
    question = F.concat(F.lit("What does the text say about "), F.split_part("answer", F.lit(" "), F.lit(1)), F.lit("?"))
    return rows.select("doc_id", question.alias("question"), "answer")


@query(
    "ds04_split",
    """with r as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id || ':split')) as i, count(*) over (partition by quality) as n from labels)
    select doc_id, quality, case when i <= floor(n * 0.8::double) then 'train' when i <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'validation' else 'test' end as part from r""",
)
def ds04(spark, d):
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":split")))
    return M.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "quality", order, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])