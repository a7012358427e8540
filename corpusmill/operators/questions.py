"""Questions taken apart: complexity by tiers of words, parts by sentence or connective, neighbours merged to a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.ranking import QUESTION_TYPES, first_class

#: Words of simple, moderate and complex questions. Fixed values.
TIERS = {
    "simple": ["what is", "how do", "explain", "tell me", "describe", "define", "list", "where is", "who is", "when is"],
    "moderate": ["compare", "analyze", "summarize", "discuss", "contrast", "evaluate", "assess", "examine", "review"],
    "complex": ["design", "implement", "troubleshoot", "optimize", "recommend", "suggest", "predict", "forecast", "architect", "evaluate tradeoffs"],
}
#: Words of conditions. Fixed values.
CONDITIONS = ["if ", "when ", "given ", "assuming ", "in case "]
#: Parts of a question at most, and words of one that is taken apart. Fixed values.
MOST_PARTS, LEAST_WORDS = 5, 15
CONNECTIVE = r"(?i)\s+(?:and|or)\s+"


def _held(text: Column, words: list[str]) -> Column:
    """How many of the words the text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def complexity(text: Column, tiers: dict[str, list[str]] = TIERS) -> Column:
    """``simple``, ``moderate`` (score 2) or ``complex`` (4): 1, 2 and 3 for a word of each tier, 1 for each question mark
    but trailing ones, and 1 for each condition. The number of words has no effect."""
    plain = F.lower(F.regexp_replace(T.collapse(text), r"[?!.]+$", ""))
    score = sum((F.when(_held(plain, words) > 0, i + 1).otherwise(0) for i, words in enumerate(tiers.values())), F.lit(0))
    score = score + F.regexp_count(plain, F.lit(r"\?")) + _held(plain, CONDITIONS)
    return F.when(score >= 4, "complex").when(score >= 2, "moderate").otherwise("simple")


def merged_place(i: Column, n: Column, most: int = MOST_PARTS) -> Column:
    """Where part ``i`` of ``n`` goes so that neighbours are merged in pairs until ``most`` are left, from 0.

    While there are more than twice as many, all neighbours pair up; then the first pairs do, as many as are too many.
    """
    # pairing up n parts r times leaves ceil(n / 2 ** r) of them
    rounds = F.greatest(F.lit(0), F.ceil(F.log2(n / (2.0 * most)) - 1e-9)).cast("int")
    step = F.pow(F.lit(2.0), rounds)
    left, at = F.ceil(n / step), F.floor(i / step)
    over = F.greatest(F.lit(0), left - most)
    return F.when(at < 2 * over, F.floor(at / 2)).otherwise(at - over).cast("int")


def decompose(questions: DataFrame, keys: list[str], text: str, tiers: dict[str, list[str]] = TIERS, most: int = MOST_PARTS) -> DataFrame:
    """``keys, complexity, n_parts, confidence, i, part, part_complexity, topic``: a row for each part of each question.

    A question of ``LEAST_WORDS`` words or more that is not simple is split into sentences, or one sentence at ``and`` and
    ``or``. Parts beyond ``most`` are merged with their neighbours: joined by ``and``, topics by ``+``, complexity the
    greatest **name** of the two. No part is lost. Confidence is 0.8 for sentences and 0.7 for connectives, times 0.9 below 20
    words and 0.85 above 100, and at least 0.5. A question that stays whole is one row without part, with confidence 1.
    """
    whole = F.col(text)
    n_words = F.size(T.split_words(whole))
    sentences = T.sentences(whole)
    trimmed = F.transform(F.split(whole, CONNECTIVE), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    clauses = F.filter(trimmed, lambda x: x != "")
    rows = questions.select(*keys, complexity(whole, tiers).alias("complexity"), n_words.alias("_words"), sentences.alias("_s"), clauses.alias("_c"))
    apart = (F.col("_words") >= LEAST_WORDS) & (F.col("complexity") != "simple")
    parts = F.when(apart & (F.size("_s") > 1), F.col("_s")).when(apart & (F.size("_c") > 1), F.col("_c"))
    base = F.when(F.size("_s") > 1, 0.8).otherwise(0.7) * F.when(F.col("_words") < 20, 0.9).when(F.col("_words") > 100, 0.85).otherwise(1.0)
    rows = rows.select(*keys, "complexity", parts.alias("_parts"), F.greatest(F.lit(0.5), base).alias("_confidence")).withColumn("_n", F.coalesce(F.size("_parts"), F.lit(0)))
    exploded = rows.filter("_parts is not null").select(*keys, "complexity", "_n", "_confidence", F.posexplode("_parts").alias("_i", "_part"))
    topic = F.array_join(F.slice(T.split_words("_part"), 1, 3), " ")
    exploded = exploded.withColumn("i", merged_place(F.col("_i"), F.col("_n"), most) + 1).withColumn("_topic", topic).withColumn("_level", complexity(F.col("_part"), tiers))
    in_order = lambda c, gap: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", c))), lambda x: x[c]), gap)
    joined = exploded.groupBy(*keys, "complexity", "_n", "_confidence", "i").agg(
        in_order("_part", " and ").alias("part"), F.max("_level").alias("part_complexity"), in_order("_topic", " + ").alias("topic")
    )
    joined = joined.select(*keys, "complexity", F.least("_n", F.lit(most)).alias("n_parts"), F.round("_confidence", 6).alias("confidence"), "i", "part", "part_complexity", "topic")
    none = F.lit(None).cast("string")
    alone = rows.filter("_parts is null").select(
        *keys, "complexity", F.lit(0).alias("n_parts"), F.lit(1.0).alias("confidence"), F.lit(None).cast("int").alias("i"), none.alias("part"), none.alias("part_complexity"), none.alias("topic")
    )
    return joined.unionByName(alone)


#: Words of technical, current and programming questions, and patterns of three more types. Fixed values.
TECHNICAL_WORDS = ["installation", "setup", "configure", "requirements", "install", "system", "server", "database", "network", "security", "authentication", "sql", "windows", "prerequisites", "configuration", "documentation", "manual", "guide"]
CURRENT_WORDS = ["latest", "recent", "new", "updated", "current", "2024", "2025", "released", "announced", "breaking", "trending", "now"]
CODE_WORDS = ["code", "programming", "function", "class", "method", "api", "python", "javascript", "java", "framework", "library", "example", "snippet", "syntax", "algorithm", "implementation"]
RECENT = ["today", "yesterday", "this week", "this month", "this year"]
HOW_TO = [r"^how\s+to\s+", r"^how\s+do\s+i\s+", r"^how\s+can\s+i\s+", r"step\s+by\s+step", "tutorial", "walkthrough"]
COMPARISON = [r"\b(best|top|compare|vs|versus|difference|better)\b", r"\b(pros\s+and\s+cons|advantages|disadvantages)\b", r"\b(which\s+is\s+better|what.*best)\b"]
TROUBLE = [r"\b(error|problem|issue|fix|solve|troubleshoot)\b", r"\b(not\s+working|broken|failed|failing)\b", r"\b(debug|diagnose|resolve)\b"]
#: Of each type: confidence, threshold, whether the web is preferred, chunks of context, strategy. Fixed values.
TYPES = {
    "technical_docs": (0.8, 0.2, False, 8, "rag_first"),
    "current_events": (0.9, 0.8, True, 3, "web_first"),
    "code_examples": (0.7, 0.4, False, 5, "adaptive_hybrid"),
    "how_to": (0.8, 0.3, False, 8, "adaptive_hybrid"),
    "comparison": (0.7, 0.5, True, 5, "balanced_hybrid"),
    "troubleshooting": (0.6, 0.3, False, 5, "adaptive_hybrid"),
    "general_knowledge": (0.5, 0.4, True, 5, "adaptive_hybrid"),
}


def query_type(text: Column, year: int, technical: list[str] | None = None) -> Column:
    """The first type whose words, or else patterns, a question holds; ``year`` is the current one, never the clock's.

    ``technical`` words may be added to, as names of own products.
    """
    low = F.lower(T.collapse(text))
    words = F.regexp_extract_all(low, F.lit(f"({T.WORD})"), 1)
    holds = lambda lexicon: F.arrays_overlap(words, F.array(*map(F.lit, lexicon)))
    within = lambda parts: F.coalesce(low.rlike("|".join(f"(?:{T.ascii_bounds(p)})" for p in parts)), F.lit(False))
    recent = [str(y) for y in range(year - 1, year + 2)] + RECENT
    return (
        F.when(holds(TECHNICAL_WORDS + (technical or [])), "technical_docs")
        .when(holds(CURRENT_WORDS) | (_held(low, recent) > 0), "current_events")
        .when(holds(CODE_WORDS), "code_examples")
        .when(within(HOW_TO), "how_to")
        .when(within(COMPARISON), "comparison")
        .when(within(TROUBLE), "troubleshooting")
        .otherwise("general_knowledge")
    )


def search_params(questions: DataFrame, keys: list[str], text: str, year: int, base_threshold: float = 0.3, technical: list[str] | None = None) -> DataFrame:
    """``keys, kind, confidence, threshold, prefer_web, chunks, strategy``: how a question should be searched.

    The threshold is the type's own, but for current events 0.7 and for technical documents 0.2 bound ``base_threshold``.
    A null question is one of general knowledge.
    """
    names = ("confidence", "suggested", "prefer_web", "chunks", "strategy")
    rows = questions.select(*keys, query_type(F.coalesce(F.col(text), F.lit("")), year, technical).alias("kind"))
    of = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[i])) for k, v in TYPES.items()))
    rows = rows.withColumns({n: of(i) for i, n in enumerate(names)})
    threshold = F.when(F.col("kind") == "current_events", F.lit(max(base_threshold, 0.7))).when(F.col("kind") == "technical_docs", F.lit(min(base_threshold, 0.2))).otherwise(F.col("suggested"))
    return rows.select(*keys, "kind", "confidence", threshold.alias("threshold"), "prefer_web", "chunks", "strategy")


#: What is asked of a collection of documents: patterns of each intent, the first that is found. Fixed values.
INTENTS = {
    "list_all": [
        r"(?:list|show|display)\s+(?:all\s+)?documents?",
        r"what\s+documents?\s+(?:do\s+you\s+have|are\s+available)",
        r"show\s+me\s+(?:the\s+)?(?:available\s+)?documents?",
        r"what\s+(?:files?|pdfs?)\s+are\s+in\s+(?:the\s+)?(?:knowledge\s+)?(?:base|database)",
        r"browse\s+(?:the\s+)?(?:knowledge\s+)?(?:base|database)",
    ],
    "list_by_type": [
        r"(?:list|show|find)\s+(?:all\s+)?(\w+)\s+(?:type\s+)?documents?",
        r"what\s+(\w+)\s+documents?\s+(?:do\s+you\s+have|are\s+available)",
        r"show\s+me\s+(?:all\s+)?(?:the\s+)?(\w+)\s+(?:files?|pdfs?|documents?)",
    ],
    "list_by_product": [
        r"(?:list|show|find)\s+documents?\s+(?:for|about|on)\s+(.+?)(?:\s+product|\s*$)",
        r"what\s+documents?\s+(?:do\s+you\s+have\s+)?(?:for|about|on)\s+(.+?)(?:\s+product|\s*$)",
        r"show\s+me\s+(?:all\s+)?(?:documents?\s+)?(?:for|about|on)\s+(.+?)(?:\s+product|\s*$)",
    ],
    "search_documents": [
        r"(?:find|search\s+for|look\s+for)\s+documents?\s+(?:with|containing|about)\s+(.+)",
        r"(?:find|search\s+for|look\s+for)\s+(?:files?|pdfs?)\s+(?:with|containing|about)\s+(.+)",
        r"documents?\s+(?:with|containing|about)\s+(.+)",
        r"(?:any\s+)?documents?\s+(?:on|about)\s+(.+)",
    ],
    "get_stats": [
        r"(?:how\s+many|count)\s+documents?",
        r"(?:knowledge\s+base|database)\s+(?:statistics|stats|summary)",
        r"what\s+(?:types?\s+of\s+)?documents?\s+(?:do\s+you\s+have|are\s+available)",
        r"(?:give\s+me\s+)?(?:an?\s+)?(?:overview|summary)\s+of\s+(?:the\s+)?documents?",
    ],
    "find_recent": [
        r"(?:latest|most\s+recent|newest)\s+documents?",
        r"recently\s+(?:added|uploaded|processed)\s+documents?",
        r"what\s+(?:new\s+)?documents?\s+(?:have\s+been\s+)?(?:added|uploaded)\s+recently",
    ],
    "count_documents": [r"how\s+many\s+documents?\s+(?:do\s+you\s+have|are\s+there)", r"total\s+(?:number\s+of\s+)?documents?", r"document\s+count"],
}
#: Most documents that a question may ask for, and how many are meant without a number. Fixed values.
MOST_ASKED, USUALLY_ASKED = 20, 10


def document_intent(questions: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, intent, argument, privacy, most, recent``: what a question asks of a collection of documents.

    The argument is the kind, product (without a last word like ``manual``) or words asked for; ``privacy`` a word of it in the
    question; ``most`` what ``first`` or ``top`` ask for; ``recent`` whether the newest come first. Questions of no intent have nulls.
    """
    q = F.trim(F.coalesce(F.col(text), F.lit("")))
    low, argued = F.lower(q), ("list_by_type", "list_by_product", "search_documents")
    intent, argument = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, patterns in reversed(INTENTS.items()):
        for p in reversed(patterns):
            found = q.rlike("(?i)" + p)
            value = F.trim(F.regexp_extract(q, "(?i)" + p, 1)) if name in argued else F.lit(None)
            if name == "list_by_product":
                value = F.regexp_replace(value, r"(?i)\s+(documentation|docs?|manual|guide)s?$", "")
            intent, argument = F.when(found, F.lit(name)).otherwise(intent), F.when(found, value).otherwise(argument)
    known = F.col("intent").isNotNull()
    number = F.regexp_extract(low, r"(?:first|top)\s+(\d+)", 1)
    most = F.when(number != "", F.least(F.coalesce(number.try_cast("int"), F.lit(MOST_ASKED)), F.lit(MOST_ASKED))).otherwise(USUALLY_ASKED)
    rows = questions.select(
        *keys, intent.alias("intent"), argument.alias("argument"), F.when(F.contains(low, F.lit("private")), "private").when(F.contains(low, F.lit("public")), "public").alias("_p"),
        F.when(_held(low, ["first", "top"]) > 0, most).alias("_m"), (_held(low, ["recent", "latest", "newest", "new"]) > 0).alias("_r"),
    )
    return rows.select(*keys, "intent", "argument", F.when(known, F.col("_p")).alias("privacy"), F.when(known, F.col("_m")).alias("most"), F.when(known, F.col("_r")).alias("recent"))


#: Words that raise a question's complexity, that ask for something made, and that ask for what is current. Fixed values.
JOINING, ASKING = ["and", "or", "but"], ["who", "what", "when", "where", "why", "how"]
MAKING = ["write", "create", "design", "imagine", "brainstorm"]
TIMELY = ["latest", "recent", "current", "now", "today", "this year", "2025", "newest", "updated", "breaking", "trending", "just released"]
EXACT, LOOSE = ["exactly", "precisely", "accurate", "correct", "definitive"], ["approximately", "roughly", "about", "maybe", "suggest"]
#: Words of domains that documents are likely to cover. Fixed values.
COVERED = ["configure", "setup", "install", "deploy", "network", "server", "system", "code", "function", "algorithm", "programming", "debug", "syntax"]
#: What complexity and type of question add to the threshold and to the priority of reranking. Fixed values.
LEVELS = {"simple": (-0.1, -0.1), "moderate": (0.0, 0.0), "complex": (0.15, 0.2), "creative": (-0.05, 0.1)}
KINDS = {"code": (0.1, 0.3), "technical": (0.05, 0.2), "math": (0.15, 0.25), "factual": (0.0, 0.1), "creative": (-0.1, 0.0), "chat": (-0.05, -0.1)}


def linguistic_score(text: Column) -> Column:
    """2 a joining word, 1.5 an asking one, 0.5 a word of more than eight characters, a twentieth a word up to 2, 1.5 a bracket."""
    tokens, words = T.tokens(text), T.split_words(text)
    among = lambda lexicon: F.size(F.filter(tokens, lambda w: w.isin(*lexicon)))
    long_words = F.size(F.filter(words, lambda w: F.length(w) > 8))
    return 2.0 * among(JOINING) + 1.5 * among(ASKING) + 0.5 * long_words + F.least(F.size(words) / 20.0, F.lit(2.0)) + 1.5 * F.regexp_count(text, F.lit(r"[(\[]"))


def question_analysis(questions: DataFrame, keys: list[str], text: str, base_threshold: float = 0.5) -> DataFrame:
    """``keys, score, complexity, kind, certainty, threshold, priority, strategy`` of each question.

    Words that ask for something made are told within words and override the score (complex from 4, moderate from 2). The
    threshold is the base with what complexity and kind add, less 0.2 where something current is asked for, between 0.1 and
    0.9; priority is 0.5 with what they add, between 0 and 1. A null question is empty.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(q)
    score = linguistic_score(q)
    rows = questions.select(
        *keys, F.round(score, 6).alias("score"), F.when(_held(low, MAKING) > 0, "creative").when(score >= 4, "complex").when(score >= 2, "moderate").otherwise("simple").alias("complexity"),
        first_class(q, QUESTION_TYPES, "factual").alias("kind"), (_held(low, TIMELY) > 0).alias("_timely"), (_held(low, COVERED) > 0).alias("_covered"),
        F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.6 + 0.2 * _held(low, EXACT) - 0.1 * _held(low, LOOSE))), 6).alias("certainty"),
    )
    adds = lambda i: sum((F.coalesce(*(F.when(F.col(c) == k, F.lit(v[i])) for k, v in table.items())) for c, table in (("complexity", LEVELS), ("kind", KINDS))), F.lit(0.0))
    threshold = F.greatest(F.lit(0.1), F.least(F.lit(0.9), base_threshold + adds(0) - F.when(F.col("_timely"), 0.2).otherwise(0.0)))
    strategy = F.when(F.col("_timely"), "web_preferred").when(F.col("complexity") == "complex", "fusion").when(F.col("_covered"), "rag_only").otherwise("hybrid_balanced")
    return rows.select(
        *keys, "score", "complexity", "kind", "certainty", F.round(threshold, 6).alias("threshold"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + adds(1))), 6).alias("priority"), strategy.alias("strategy")
    )
