"""Enhancing questions, merging ranked lists, and scoring answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

#: Phrases that tell an unsure answer; fixed values.
UNCERTAIN = [
    "i don't know", "not sure", "cannot", "unable", "no information", "unclear", "apologize", "does not contain", "not available", "insufficient",
    "limited information", "may not be accurate",
]

#: Factors of a question's type: base, bonus for relevant context, penalty an unsure phrase; fixed values.
TYPE_FACTORS = {
    "code": (0.7, 0.2, 0.4), "technical": (0.6, 0.25, 0.3), "math": (0.8, 0.15, 0.5), "factual": (0.5, 0.3, 0.2), "creative": (0.4, 0.1, 0.1), "chat": (0.6, 0.2, 0.2),
}


def array_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def best_class(text: Column, patterns: dict[str, list[str]], default: str) -> Column:
    """The class with most of its patterns in the lower-cased text, the first of equals; ``default`` if none has any."""
    scores = F.array(*(F.struct(sum((F.lower(text).rlike(p).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, ps) in enumerate(patterns.items())))
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["c"]).otherwise(F.lit(default))


def enhanced(df: DataFrame, text: str, patterns: dict[str, list[str]], synonyms: dict[str, list[str]], acronyms: dict[str, str], triggers: dict[str, list[str]], most: int = 5) -> DataFrame:
    """``df`` with ``query_type, terms, expansions, enhanced, confidence``.

    Terms are runs of capitals, version numbers and known words of the text. Expansions are the synonyms of its terms, the
    meaning of its acronyms and what its trigger words bring along, each once and in order; the first ``most`` are added as
    alternatives. Confidence is 0.5, a tenth for each term up to 0.3, 0.2 for a known type, 0.1 for over three words.
    """
    low = F.lower(text)
    known = F.filter(array_of(list(synonyms)), lambda k: F.contains(low, F.lower(k)))
    terms = F.array_distinct(F.concat(F.filter(F.regexp_extract_all(text, F.lit(f"({T.WORD})"), 1), lambda w: w.rlike("^[A-Z]{2,}$")), F.regexp_extract_all(text, F.lit(T.ascii_bounds(r"\b(\d+\.\d+(?:\.\d+)?)\b")), 1), known))
    df = df.withColumn("query_type", best_class(F.col(text), patterns, "general")).withColumn("terms", F.sort_array(terms))
    meant = [F.when(F.array_contains("terms", k), array_of(v)) for k, v in synonyms.items()]
    meant += [F.when(F.array_contains("terms", k), array_of([v])) for k, v in acronyms.items()]
    meant += [F.when(F.contains(low, F.lit(k)), array_of(v)) for k, v in triggers.items()]
    all_of = F.concat(*(F.coalesce(m, F.array().cast("array<string>")) for m in meant))
    df = df.withColumn("expansions", F.sort_array(F.array_distinct(all_of)))
    quoted = F.array_join(F.transform(F.slice("expansions", 1, most), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")
    sure = 0.5 + F.least(F.size("terms") * 0.1, F.lit(0.3)) + F.when(F.col("query_type") != "general", 0.2).otherwise(0.0) + F.when(F.size(T.split_words(text)) > 3, 0.1).otherwise(0.0)
    return df.withColumn("enhanced", F.when(F.size("expansions") > 0, F.concat(F.col(text), F.lit(" ("), quoted, F.lit(")"))).otherwise(F.col(text))).withColumn("confidence", F.round(F.least(sure, F.lit(1.0)), 6))


def glossed(df: DataFrame, text: str, kind: str, acronyms: dict[str, str], glossary: dict[str, list[str]], synonyms: dict[str, dict[str, list[str]]], extras: dict[str, list[str]]) -> DataFrame:
    """``df`` with ``added``, the words a question of its ``kind`` is enhanced by, in order, and ``enhanced``.

    Meanings of acronyms that the text holds in this case; glossary terms of the kind that are no word of the text but
    hold one; the first three synonyms of the kind's words; extras of strings that the text holds.
    """
    low, words = F.lower(text), T.split_words(F.lower(text))
    none = F.array().cast("array<string>")
    parts = [F.when(F.contains(text, F.lit(k)), array_of([v])).otherwise(none) for k, v in acronyms.items()]
    terms = F.coalesce(*(F.when(F.col(kind) == k, array_of(v)) for k, v in glossary.items()), none)
    parts.append(F.filter(terms, lambda t: ~F.array_contains(words, F.lower(t)) & F.exists(words, lambda w: F.contains(F.lower(t), w))))
    found = [F.when((F.col(kind) == k) & F.contains(low, F.lit(w)), array_of(v)).otherwise(none) for k, m in synonyms.items() for w, v in m.items()]
    parts.append(F.slice(F.concat(*found), 1, 3))
    parts += [F.when(F.contains(text, F.lit(k)), array_of(v)).otherwise(none) for k, v in extras.items()]
    return df.withColumn("added", F.concat(*parts)).withColumn("enhanced", F.concat_ws(" ", F.col(text), F.array_join("added", " ")))


def expansion_retrieval(hits: DataFrame, fallback: DataFrame, content: DataFrame, qid: str, key: str, text: str, k: int, variants: int = 3) -> DataFrame:
    """``qid, key, position`` from hits ``(qid, variant, rank, key)``: variant 0 is the question, others its expansions.

    The question gives ``k`` hits, each of the first ``variants`` expansions half as many. Of hits that begin with the same
    200 characters the first stays. A question without any hit takes those of ``fallback (qid, rank, key)``.
    """
    kept = hits.filter((F.col("variant") <= variants) & (F.col("rank") <= F.when(F.col("variant") == 0, k).otherwise(k // 2)))
    missing = fallback.join(kept.select(qid).distinct(), qid, "left_anti").filter(F.col("rank") <= k).select(qid, F.lit(0).alias("variant"), "rank", key)
    begun = kept.select(qid, "variant", "rank", key).join(content.select(key, F.xxhash64(F.substring(text, 1, 200)).alias("start")), key)
    order = ["variant", "rank", key]
    first = begun.withColumn("nth", F.row_number().over(Window.partitionBy(qid, "start").orderBy(*order))).filter("nth = 1").select(qid, *order)
    position = F.row_number().over(Window.partitionBy(qid).orderBy(*order))
    return first.unionByName(missing).withColumn("position", position).filter(F.col("position") <= k).select(qid, key, "position")


def three_way(base: DataFrame, cross: DataFrame, second: DataFrame, qid: str, boosts: dict[str, float], embedding_weight: float = 0.3, cross_weight: float = 0.2) -> DataFrame:
    """``base`` hits with ``final``: two more ranked lists are looked up by their own keys, a missing score is 0 or the base's.

    ``base (qid, doc_id, name_start, type, score)``, ``cross (qid, doc_id, type, score, confidence)``, ``second (qid,
    name_start, score)``, the first row of a key counts. Other content types in ``cross`` raise its relevance by a tenth.
    """
    c = cross.select(qid, "doc_id", F.col("type").alias("c_type"), F.col("score").alias("c_score"), F.col("confidence"))
    s = second.groupBy(qid, "name_start").agg(F.max("score").alias("s_score"))
    rows = base.join(c, [qid, "doc_id"], "left").join(s, [qid, "name_start"], "left")
    relevance = F.coalesce(F.least(F.col("confidence") * F.when(F.col("type") != F.col("c_type"), 1.1).otherwise(1.0), F.lit(1.0)), F.lit(0.0))
    boost = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in boosts.items()), F.lit(1.0))
    mixed = 0.4 * F.col("score") + 0.3 * F.coalesce("s_score", "score") + 0.2 * embedding_weight * F.coalesce("c_score", F.lit(0.0)) + 0.1 * cross_weight * relevance
    return rows.select(qid, "doc_id", "type", F.col("c_score").isNotNull().alias("in_cross"), F.col("s_score").isNotNull().alias("in_second"), F.round(mixed * boost, 6).alias("final"))


def three_way_diversity(scored: DataFrame, qid: str, types: int) -> DataFrame:
    """Mean of the share of content types and of the share of the three methods that contributed."""
    methods = 1 + F.max(F.col("in_cross").cast("int")) + F.max(F.col("in_second").cast("int"))
    return scored.groupBy(qid).agg(F.round((F.countDistinct("type") / types + methods / 3) / 2, 6).alias("diversity"))


def composite_accuracy(confidence: Column, question: Column, answer: Column, sources: Column) -> Column:
    """0.4 confidence, 0.2 length (best from 1,000 to 2,000 characters), 0.2 sources (three or more), 0.2 share of the
    question's words in the answer."""
    n = F.length(answer)
    length = F.when(n > 2000, F.greatest(F.lit(0.8), 2000 / n)).otherwise(F.least(F.lit(1.0), n / 1000))
    q, a = F.array_distinct(T.split_words(F.lower(question))), T.split_words(F.lower(answer))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(q, a)), F.size(q)), F.lit(0.0))
    return F.least(F.lit(1.0), confidence * 0.4 + length * 0.2 + F.least(F.lit(1.0), sources / 3) * 0.2 + share * 0.2)


def typed_confidence(kind: Column, question: Column, answer: Column, context: Column, chunks: Column, keywords: Column, certainty: Column) -> Column:
    """Confidence by question type: chunks, the answer's form, question words found in the context, keywords found there
    too, how much certainty is asked for, less a penalty for each unsure phrase; 0 without context."""
    factor = lambda i: F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in TYPE_FACTORS.items()), F.lit(TYPE_FACTORS["factual"][i]))
    low, around = F.lower(answer), F.lower(context)
    flag = lambda c: F.when(c, 0.05).otherwise(0.0)
    form = (
        flag(F.length(answer) > 500)
        + flag((F.regexp_count(answer, F.lit("\n")) > 2) | (F.regexp_count(answer, F.lit("•")) > 1))
        + flag(answer.rlike(T.ascii_bounds(r"\b\d+\b")))
        + flag(low.rlike("according to|research shows|studies indicate"))
    )
    unsure = sum((F.contains(low, F.lit(p)).cast("int") for p in UNCERTAIN), F.lit(0))
    words = F.array_distinct(T.split_words(F.lower(question)))
    met = F.size(F.filter(words, lambda w: F.contains(around, w)))
    # a word has no white space, so it is part of some word of the context whenever the context holds it
    relevance = (met * 0.3 + met * 0.1) / F.greatest(F.size(words), F.lit(1)) * factor(1)
    domain = F.when(F.exists(keywords, lambda w: F.contains(around, w)), 0.1).otherwise(0.0)
    score = F.least(chunks / 8.0, factor(0)) + form + relevance + domain + (certainty - 0.5) * 0.1 - unsure * factor(2)
    return F.when(chunks == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def holds(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in signs))


def importance(text: Column, terms: Column) -> Column:
    """Importance of a chunk: moderate length, density of technical ``terms``, a heading or capitals, a procedure, numbers."""
    words = F.size(T.split_words(text))
    length = F.when(words.between(50, 200), 0.2).when(words.between(20, 400), 0.1).otherwise(0.0)
    heading = ((F.upper(text) == text) & (F.lower(text) != text)) | text.rlike(r"^#+\s+")
    names = ["step", "procedure", "method", "instruction", "how to"]
    procedure = holds(F.lower(text), names) & F.lower(text).rlike(T.ascii_bounds(rf"\b(?:{'|'.join(names)})\b"))
    numbers = F.when(~text.rlike("[0-9]"), F.lit(0)).otherwise(F.regexp_count(text, F.lit(T.ascii_bounds(r"\b\d+(?:\.\d+)?\b"))))
    flag = lambda c: F.when(c, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), length + F.least(F.lit(0.3), 5 * F.size(terms) / F.greatest(words, F.lit(1))) + flag(heading) + flag(procedure) + F.least(F.lit(0.1), numbers * 0.02))


def readability(words: Column, sentences: Column, terms: Column) -> Column:
    """Mean of a score for the length of sentences (10 to 20 words are best) and of one for few technical terms."""
    mean = words / sentences
    length = F.when(mean.between(10, 20), 1.0).when(mean.between(5, 30), 0.7).otherwise(0.4)
    score = (length + F.greatest(F.lit(0.2), 1 - 3 * F.size(terms) / words)) / 2
    return F.when((words == 0) | (sentences == 0), F.lit(0.5)).otherwise(score)


#: Weights of document types for processing; fixed values.
TYPE_WEIGHTS = {"specification": 1.0, "schematic": 0.95, "procedure": 0.9, "manual": 0.85, "report": 0.75, "drawing": 0.7, "unknown": 0.5}


def priority(kind: Column, sections: Column, bullets: Column, domain_sum: Column, length: Column) -> Column:
    """0.4 type weight, 0.25 structure, 0.2 mean of six domain densities, 0.15 logarithmic length; at most 1, to four places."""
    base = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in TYPE_WEIGHTS.items()), F.lit(0.6))
    structure = F.least(F.lit(1.0), (sections + bullets / 2) / 20)
    return F.round(F.least(F.lit(1.0), 0.4 * base + 0.25 * structure + 0.2 * domain_sum / 6 + 0.15 * F.least(F.lit(1.0), F.log1p(length.cast("double")) / 8)), 4)


def quality(sections: Column, bullets: Column, length: Column, uppercase: Column, digits: Column) -> Column:
    """0.35 structure, 0.3 logarithmic length, 0.2 few capitals, 0.15 numbers; at most 1, to four places."""
    structure = F.least(F.lit(1.0), (sections + bullets / 2) / 25)
    score = 0.35 * structure + 0.3 * F.least(F.lit(1.0), F.log1p(length.cast("double")) / 8) + 0.2 * (1 - F.abs(uppercase - 0.1)) + 0.15 * F.least(F.lit(1.0), digits * 5)
    return F.round(F.least(F.lit(1.0), score), 4)


#: Substrings and patterns of confidential texts; fixed values.
CONFIDENTIAL = [
    "confidential", "private", "restricted", "classified", "proprietary", "internal", "sensitive", "privileged", "attorney-client", "attorney client", "work product",
    "trade secret", "proprietary information", "do not distribute", "internal use only", "not for distribution", "for internal use", "company confidential",
    "personally identifiable", "pii", "personal information", "social security number", "ssn", "credit card", "top secret", "secret", "eyes only", "need to know",
]
CONFIDENTIAL_PATTERNS = [
    r"\bconfidential\b.*\bdocument\b",
    r"\bdo\s+not\s+(share|distribute|disclose)\b",
    r"\bfor\s+internal\s+use\s+only\b",
    r"\bnot\s+for\s+(public|external)\b",
    r"\b(strictly|highly)\s+confidential\b",
    r"\bclassification\s*:\s*(private|confidential|restricted)\b",
]


def confidentiality(text: Column, words: list[str] = CONFIDENTIAL, patterns: list[str] = CONFIDENTIAL_PATTERNS, marks: tuple[str, ...] = ("confidential", "private", "restricted")) -> Column:
    """``private`` if the lower-cased text holds a word or pattern, or one of its first or last five lines a mark."""
    low = F.lower(text)
    lines = F.split(low, "\n")
    edges = F.concat(F.slice(lines, 1, 5), F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5)))
    private = F.lit(False)
    for w in words:
        private = private | F.contains(low, F.lit(w))
    for p in patterns:
        private = private | low.rlike(T.ascii_bounds(p))
    marked = F.exists(edges, lambda x: sum((F.contains(x, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0)
    return F.when(F.coalesce(private | marked, F.lit(False)), "private").otherwise("public")


#: Cross references in texts; fixed values.
REFERENCES = [
    r"\bsee\s+(?:section|chapter|page|figure|table)\s+([^\s.,]+)",
    r"\brefer\s+to\s+([^\s.,]+)",
    r"\bas\s+(?:described|shown|outlined)\s+in\s+([^\s.,]+)",
    r"\b(?:section|chapter|page|figure|table)\s+(\d+(?:\.\d+)*)",
    r"\[([^\]]+)\]",
    r"\(see\s+([^)]+)\)",
]


#: One of these is in every text, in lower case, where a pattern of ``REFERENCES`` finds anything; looking for them first costs less.
REFERENCE_SIGNS = [["see"], ["refer"], ["described", "shown", "outlined"], ["section", "chapter", "page", "figure", "table"], ["["], ["(see"]]


def cross_references(text: Column) -> Column:
    """What the six patterns find, pattern by pattern, whatever its case."""
    low, none = F.lower(text), F.array().cast("array<string>")
    found = lambda p, signs: F.when(~holds(low, signs), none).otherwise(F.regexp_extract_all(text, F.lit("(?i)" + T.ascii_bounds(p)), 1))
    return F.concat(*map(found, REFERENCES, REFERENCE_SIGNS))


#: Categories of questions, first match wins; fixed values.
QUESTION_CATEGORIES = {
    "technical_setup": ["how to", "how do", "setup", "install", "configure"],
    "explanatory": ["what is", "explain", "definition", "meaning"],
    "troubleshooting": ["error", "problem", "issue", "fail", "broken"],
    "user_management": ["user", "role", "permission", "admin", "access"],
    "reporting": ["report", "dashboard", "analytics", "statistics"],
}

#: Types of questions, first match wins; fixed values.
QUESTION_TYPES = {
    "technical": ["install", "config", "setup", "active directory", "server", "network", "deployment"],
    "code": ["code", "function", "algorithm", "programming", "python", "javascript"],
    "math": ["calculate", "solve", "derivative", "integral", "equation", "math"],
    "creative": ["write", "create", "design", "story", "poem"],
    "chat": ["hello", "hi", "how are you", "good morning"],
}

#: Phrases that tell a response's doubt; fixed values.
DOUBTS = ["i'm not sure", "uncertain", "maybe", "possibly", "i think", "perhaps"]


def first_class(text: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The first class of which a word or phrase is in the lower-cased text."""
    low, out = F.lower(text), F.lit(default)
    for name, words in reversed(classes.items()):
        out = F.when(F.exists(array_of(words), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def response_confidence(question: Column, response: Column, context: Column, chunks: Column, adjust: Column) -> Column:
    """0.5, up to 0.2 for chunks of context and 0.1 each for words of question and response in it, less 0.2 without any;
    ``adjust`` for the model; less 0.1 below 10 words, plus 0.05 above 50; less 0.15 for doubt; between 0 and 1."""
    around, said = T.split_words(F.lower(context)), T.split_words(F.lower(response))
    shared = lambda x: F.when(F.size(F.array_intersect(x, around)) > 0, 0.1).otherwise(0.0)
    with_context = F.least(F.lit(0.2), chunks * 0.05) + shared(T.split_words(F.lower(question))) + shared(said)
    n = F.size(T.split_words(response))
    length = F.when(n < 10, -0.1).when(n > 50, 0.05).otherwise(0.0)
    doubt = F.when(F.exists(array_of(DOUBTS), lambda d: F.contains(F.lower(response), d)), 0.15).otherwise(0.0)
    score = 0.5 + F.when(chunks > 0, with_context).otherwise(-0.2) + adjust + length - doubt
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def with_fallback(asked: DataFrame, results: list[tuple[str, DataFrame]], qid: str, mode: str) -> DataFrame:
    """Results of each question's mode, or, where it gives none, of the next mode in the list: ``results`` with ``mode``."""
    out, waiting = None, None
    for name, rows in results:
        here = asked.filter(F.col(mode) == name).select(qid)
        here = here if waiting is None else here.unionByName(waiting)
        found = rows.join(here, qid, "left_semi").withColumn(mode, F.lit(name))
        waiting = here.join(rows.select(qid).distinct(), qid, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def reranked_parts(parts: DataFrame, qid: str, relevance: str, confidence: str, text: str, order: str, k: int = 5) -> DataFrame:
    """``qid, answer, relevance``: the ``k`` parts of an answer best by 0.8 relevance and 0.2 confidence, joined by blank lines,
    and their mean relevance."""
    score = F.round(0.8 * F.col(relevance) + 0.2 * F.col(confidence), 6)
    nth = F.row_number().over(Window.partitionBy(qid).orderBy(score.desc(), order))
    best = parts.withColumn("_n", nth).filter(F.col("_n") <= k)
    rows = best.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("_n", text))).alias("p"), F.round(F.avg(relevance), 6).alias("relevance"))
    return rows.select(qid, F.array_join(F.col(f"p.{text}"), "\n\n").alias("answer"), "relevance")
