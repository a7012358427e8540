"""Queries over questions and documents: types with search parameters, intents over a collection, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import metadata as M
from corpusmill.operators import questions as Q
from corpusmill.operators.ranking import QUESTION_TYPES
from corpusmill.plans.text import TOK, WORDS, cascade
from corpusmill.registry import query
from corpusmill.sources.tables import table

#: Openings of questions that turns of conversations are given, with every class, several hits in one, and none.
OPENINGS = [
    "", "How to set it,", "How do I  change", "please LIST all documents", "show report documents", "find documents about", "List documents for Pump 12 manuals", "search for files containing",
    "how many documents are there in", "knowledge base summary of", "the newest documents with private", "recently added documents, top 7 public", "total number of documents first 99", "document count",
    "what is the best way", "is it broken or a problem", "compare the server with", "a python function", "what changed this year", "in 2031 or 2030", "pros  and cons of", "a tutorial on", "step  by step",
    "show me the pdf files", "what documents do you have on Valve product", "browse the database top", "undocumented", "errors and fixes", "which is better,", "the latest", "class of", "debug",
]
_MADE = f"(select conv_id, turn, ([{', '.join(repr(x) for x in OPENINGS)}])[(conv_id * 5 + turn * 3) % {len(OPENINGS)} + 1] || ' ' || array_to_string({WORDS('text')}[1:4], ' ') as text from conversations)"


def made(spark, d):
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(OPENINGS) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(opening, F.lit(" "), F.array_join(F.slice(T.split_words("text"), 1, 4), " ")).alias("text"))


def _any(patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches(low, '{p}')" for p in patterns) + ")"


def _has(words: list[str]) -> str:
    return f"list_has_any(w, {words})"


_RULES = {
    "technical_docs": _has(Q.TECHNICAL_WORDS + ["pump"]),
    "current_events": f"({_has(Q.CURRENT_WORDS)} or " + " or ".join(f"contains(low, '{x}')" for x in ["2029", "2030", "2031", *Q.RECENT]) + ")",
    "code_examples": _has(Q.CODE_WORDS), "how_to": _any(Q.HOW_TO), "comparison": _any(Q.COMPARISON), "troubleshooting": _any(Q.TROUBLE),
}


@query(
    "tx12_query_type",
    f"""with q as (select conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as low from {_MADE}), w as (select *, {TOK('low')} as w from q),
    t as (select conv_id, turn, case {' '.join(f"when {rule} then '{name}'" for name, rule in _RULES.items())} else 'general_knowledge' end as kind from w),
    p(kind, confidence, suggested, prefer_web, chunks, strategy) as (values {', '.join(str((k, *v)) for k, v in Q.TYPES.items())})
    select conv_id, turn, kind, confidence::double as confidence, (case kind when 'current_events' then 0.7 when 'technical_docs' then 0.2 else suggested end)::double as threshold, prefer_web, chunks::int as chunks, strategy from t join p using (kind)""",
)
def tx12(spark, d):
    return Q.search_params(made(spark, d), ["conv_id", "turn"], "text", year=2030, technical=["pump"])


def _cases(value) -> str:
    return "case " + " ".join(f"when regexp_matches(q, '(?i){p}') then {value(name, p)}" for name, patterns in Q.INTENTS.items() for p in patterns) + " end"


def _argument(name: str, pattern: str) -> str:
    if name not in ("list_by_type", "list_by_product", "search_documents"):
        return "null"
    found = f"trim(regexp_extract(q, '(?i){pattern}', 1))"
    return f"regexp_replace({found}, '(?i)\\s+(documentation|docs?|manual|guide)s?$', '')" if name == "list_by_product" else found


@query(
    "tx17_intent",
    f"""with m as (select conv_id, turn, trim(text) as q, lower(trim(text)) as low from {_MADE}),
    i as (select *, {_cases(lambda name, p: repr(name))} as intent, {_cases(_argument)} as argument from m)
    select conv_id, turn, intent, argument, case when intent is null then null when contains(low, 'private') then 'private' when contains(low, 'public') then 'public' end as privacy,
        case when intent is not null and (contains(low, 'first') or contains(low, 'top')) then least(20, coalesce(try_cast(nullif(regexp_extract(low, '(?:first|top)\\s+(\\d+)', 1), '') as int), case when regexp_matches(low, '(?:first|top)\\s+\\d') then 20 else 10 end)) end as most,
        case when intent is not null then contains(low, 'recent') or contains(low, 'latest') or contains(low, 'newest') or contains(low, 'new') end as recent from i""",
)
def tx17(spark, d):
    return Q.document_intent(made(spark, d), ["conv_id", "turn"], "text")


#: Lines that documents are given, with each pattern, several in one, and lookalikes that are none.
_MARKS = [
    "", "Page 1 of 12\nVersion 4.16.2 of the Pump user guide, 4.17", "© 2021 the makers\nv1.2 Installation of 3.4 reference", "Copyright 1999\nRelease 7.1 for developers", "ABC-10003-01 and AB-1-1\n4.5  user guide",
    "GA date: March 3, 2024\nversion 5", "General availability:  may 14 2023\nElectric power and WATER", "abc-10003-01 ga date soon\nGasoline support", "The Valve interface, version four", "x\n\n  \nshort\nXYZ-9999-1",
]
_PRODUCTS, _PUBLISHERS = {"Pumps": ["pump"], "Valves": ["valve", "tap "]}, {"Makers": ["the makers"], "Others": ["licen"]}
_MARKED = f"(select doc_id, ([{', '.join('E' + repr(x) for x in _MARKS)}])[doc_id % {len(_MARKS)} + 1] || chr(10) || text as text from documents)"


def _first(text: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in patterns) + ")"


def _named(lexicon: dict[str, list[str]]) -> str:
    flags = ", ".join("case when " + " or ".join(f"contains(low, '{w}')" for w in words) + f" then '{name}' end" for name, words in lexicon.items())
    return f"list_filter([{flags}], lambda x: x is not null)"


@query(
    "tx22_metadata",
    f"""with m as (select doc_id, text, lower(text) as low, list_transform(string_split(text, chr(10))[1:10], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as lines from {_MARKED})
    select doc_id, list_filter(lines, lambda x: length(x) > 10 and not regexp_matches(lower(x), '^(page|copyright|©)'))[1] as title, {_first('low', M.VERSIONS)} as version, {_first('text', [M.NUMBER])} as doc_number,
        {_first('low', M.RELEASES)} as ga_date, {_first('low', [M.YEAR])}::int as copyright_year, {_named(_PUBLISHERS)}[1] as publisher, {_named(_PRODUCTS)} as products, {_named(M.SERVICES)} as services, {_named(M.AUDIENCES)} as audiences from m""",
)
def tx22(spark, d):
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % len(_MARKS) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(mark, F.lit("\n"), "text").alias("text"))
    return M.document_metadata(rows, "doc_id", "text", _PRODUCTS, _PUBLISHERS)


def _count(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::int" for w in words) + ")"


def _adds(i: int) -> str:
    return " + ".join("case " + c + " " + " ".join(f"when '{k}' then {v[i]}::double" for k, v in table.items()) + " end" for c, table in (("complexity", Q.LEVELS), ("kind", Q.KINDS)))


@query(
    "tx15_complexity",
    f"""with q as (select conv_id, turn, text, lower(text) as low, {TOK('text')} as w, {WORDS('text')} as s from (select conv_id, turn, text from {_MADE} union all select conv_id, turn + 1000, text from conversations)),
    c as (select *, 2.0::double * len(list_filter(w, lambda x: x in {tuple(Q.JOINING)})) + 1.5 * len(list_filter(w, lambda x: x in {tuple(Q.ASKING)})) + 0.5 * len(list_filter(s, lambda x: length(x) > 8))
        + least(len(s) / 20.0, 2.0)::double + 1.5 * len(regexp_extract_all(text, '[(\\[]')) as score, {cascade(QUESTION_TYPES, 'text', 'factual')} as kind from q),
    l as (select *, case when {_count(Q.MAKING)} > 0 then 'creative' when score >= 4 then 'complex' when score >= 2 then 'moderate' else 'simple' end as complexity, {_count(Q.TIMELY)} > 0 as timely from c)
    select conv_id, turn, round(score, 6) as score, complexity, kind, round(greatest(0.1::double, least(1.0, 0.6::double + 0.2 * {_count(Q.EXACT)} - 0.1 * {_count(Q.LOOSE)})), 6) as certainty,
        round(greatest(0.1::double, least(0.9::double, 0.5::double + {_adds(0)} - case when timely then 0.2::double else 0 end)), 6) as threshold, round(greatest(0.0::double, least(1.0::double, 0.5::double + {_adds(1)})), 6) as priority,
        case when timely then 'web_preferred' when complexity = 'complex' then 'fusion' when {_count(Q.COVERED)} > 0 then 'rag_only' else 'hybrid_balanced' end as strategy from l""",
)
def tx15(spark, d):
    """Made questions, and whole turns beside them."""
    whole = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1000).alias("turn"), "text")
    return Q.question_analysis(made(spark, d).select("conv_id", "turn", "text").unionByName(whole), ["conv_id", "turn"], "text")
