"""Knowledge mining: acronyms, synonyms, entities, specifications, steps, relations, sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.sources.scratch import stored

#: Short words in capitals that are no acronyms, for texts in English; pass a list of the corpus's own.
COMMON_WORDS = ("THE", "AND", "FOR", "NOT", "ALL", "ARE", "BUT", "CAN", "HAS", "YOU", "WAS", "WHO", "NO", "OR", "IF", "IT", "IS", "IN", "ON", "AT", "TO")


# --- acronyms and synonyms ----------------------------------------------------------------------------------------
def acronyms(docs: DataFrame, key: str, text: str, words: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """``key, acronym, definition, method``: ``Name (ABC)``, ``ABC: name`` and ``ABC - name``; later methods win.

    Acronyms have 2 to 10 capitals or digits, not all one letter, and are none of ``words``.
    """
    methods = [(1, r"((?:[A-Z][\p{L}]+ ){1,6}\([A-Z0-9]{2,10}\))"), (2, r"(?m)(^[A-Z0-9]{2,10}: [^\n.]{3,100})"), (3, r"(?m)(^[A-Z0-9]{2,10} - [^\n.]{3,100})")]

    def hits(method: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(F.lit(method).alias("method"), x.alias("hit")))

    found = F.concat(*(hits(m, p) for m, p in methods))
    rows = docs.select(key, F.posexplode(found).alias("pos", "f")).select(key, "pos", "f.method", "f.hit")
    named = F.col("method") == 1
    acronym = F.when(named, F.regexp_extract("hit", r"\(([A-Z0-9]+)\)", 1)).otherwise(F.regexp_extract("hit", "^([A-Z0-9]+)", 1))
    definition = F.when(named, F.regexp_extract("hit", r"^(.*) \(", 1)).otherwise(F.regexp_replace("hit", "^[A-Z0-9]+(: | - )", ""))
    rows = rows.select(key, "pos", "method", acronym.alias("acronym"), F.trim(definition).alias("definition"))
    valid = ~F.col("acronym").isin(*words) & F.col("acronym").rlike("[A-Z]") & ~F.col("acronym").rlike(r"^(.)\1+$")
    return rows.filter(valid).groupBy(key, "acronym").agg(F.max_by("definition", F.struct("method", "pos")).alias("definition"), F.max("method").alias("method"))


def merged_acronyms(found: DataFrame, key: str) -> DataFrame:
    """One definition an acronym, the longest, the earliest document's on a tie; with its number of documents."""
    order = F.struct(F.length("definition"), -F.col(key))
    return found.groupBy("acronym").agg(F.max_by("definition", order).alias("definition"), F.countDistinct(key).alias("documents"))


def first_expansions(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy("acronym").agg(F.min_by("definition", key).alias("definition"))


def synonyms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term, synonym, documents`` in both directions from ``a (also known as b)`` and ``a, also called b,``."""
    pattern = r"(\p{L}[\p{L}\p{N}_-]*),? \(?also (?:known as|called) (\p{L}[\p{L}\p{N}_-]*)"
    low = F.lower(text)
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(low, F.lit(pattern), 2).alias("b"))
    rows = docs.select(key, F.explode(pairs).alias("p")).select(key, "p.a", "p.b").filter("a <> b")
    both = rows.unionByName(rows.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("term"), F.col("b").alias("synonym")).agg(F.countDistinct(key).alias("documents"))


#: Entries of acronyms and best synonyms of words that are sent to every task, so that questions with a common word do not meet in one; more are joined by key.
MOST_SENT = 500_000


def relevant_acronyms(queries: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """For each query the ``n`` best entries whose acronym it names or whose definition holds one of its words."""
    q = queries.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("w"))
    words = F.array_distinct(F.concat(F.array(F.lower("acronym")), F.regexp_extract_all(F.lower("definition"), F.lit(r"([\p{L}\p{N}_]+)"), 1)))
    entries = stored(table.withColumn("w", F.explode(words)), "entries")
    hits = q.join(F.broadcast(entries) if entries.count() <= MOST_SENT else entries, "w").drop("w").dropDuplicates(["qid", "acronym", "definition"])
    order = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.desc("usage_count"), "acronym", "definition")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def relevant_synonyms(queries: DataFrame, table: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """For each term the ``n`` best rows in which it is the term or the synonym, whatever its case.

    The rows are ranked once a word, not once a question; a ``qid`` names one question.
    """
    rows = table if kind is None else table.filter(F.col("term_type") == kind)
    sides = rows.withColumn("w", F.explode(F.array_distinct(F.array(F.lower("term"), F.lower("synonym")))))
    order = Window.partitionBy("w").orderBy(F.desc("confidence"), F.desc("usage_count"), "term", "synonym")
    best = stored(sides.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n), "synonyms")
    return queries.withColumn("w", F.lower("query")).join(F.broadcast(best) if best.count() <= MOST_SENT else best, "w").drop("w")


# --- spans --------------------------------------------------------------------------------------------------------
def entity_spans(docs: DataFrame, key: str, text: str, lexicon: dict[str, list[str]], context: int = 40) -> DataFrame:
    """``key, entity, type, start, end, context`` of whole-word lexicon terms, whatever their case."""
    import re

    terms = {t.lower(): kind for kind, ts in lexicon.items() for t in ts}
    pattern = r"(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?!\w)"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(pattern, re.IGNORECASE)
        for pdf in batches:
            rows = [
                (k, m[0], terms.get(m[0].lower()), m.start(), m.end(), t[max(0, m.start() - context) : m.end() + context])
                for k, t in zip(pdf[key], pdf[text].fillna(""))
                for m in find.finditer(t)
            ]
            yield pd.DataFrame(rows, columns=[key, "entity", "type", "start", "end", "context"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, entity string, type string, start int, end int, context string")


#: Unit spellings and what they are counted as; fixed values.
UNITS = {"volts": "V", "volt": "V", "amps": "A", "amp": "A", "c": "C", "°c": "C", "ohms": "Ω", "ohm": "Ω", "nm": "Nm", "rpm": "rpm", "hz": "Hz", "w": "W"}


def normal_unit(unit: Column) -> Column:
    """The unit that a spelling counts as, any other one as it is written; null for none."""
    known = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(unit))), F.nullif(F.trim(unit), F.lit("")))


def specifications(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, value, unit`` of ``name: 5V``, ``name (rpm): 1500``, ``name is 3`` and ``name = 10-20 Nm``.

    Ranges, with a hyphen or an en dash, give their mean. What follows the number is no unit if it runs on as a word, or
    if another specification follows and it is longer than two letters and not known. A value without a unit takes that
    in brackets at the end of its name.
    """
    name = r"[A-Za-z][A-Za-z0-9_ \-/()]{2,40}"
    pattern = rf"(?i)({name}?)\s*(?:[:=]|\bis\b)\s*(\d+(?:\.\d+)?(?:\s*[–-]\s*\d+(?:\.\d+)?)?)(?=([\s\S]{{0,30}}))\s*([A-Za-z%Ωμ/°]{{0,5}})(?=([A-Za-z]?))"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), i)
    zipped = F.arrays_zip(*(part(i).alias(n) for i, n in enumerate(("name", "raw", "ahead", "unit", "on"), 1)))
    rows = docs.select(key, F.explode(zipped).alias("s")).select(key, "s.*").withColumn("name", F.trim("name"))
    long_one = (F.length("unit") > 2) & ~F.lower("unit").isin(*UNITS)
    dropped = (F.col("on") != "") | (F.col("ahead").rlike(rf"(?i)\s+{name}:") & long_one)
    bracket = F.regexp_extract("name", r"^.+?\(([A-Za-z%Ωμ/°]{1,6})\)$", 1)
    inside = F.when(F.length(normal_unit(bracket)) <= 5, normal_unit(bracket))
    unit = F.when(~dropped, normal_unit(F.col("unit")))
    base = F.when(unit.isNull() & inside.isNotNull(), F.trim(F.regexp_extract("name", r"^(.+?)\([^()]*\)$", 1))).otherwise(F.col("name"))
    numbers = F.transform(F.split(F.regexp_replace("raw", r"\s", ""), "[–-]"), lambda x: x.cast("double"))
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)
    return rows.select(key, F.lower(base).alias("name"), mean.alias("value"), F.coalesce(unit, inside).alias("unit"))


def classified_by_name(docs: DataFrame, name: str, text: str, kinds: dict[str, list[str]], categories: dict[str, str], topics: list[str]) -> DataFrame:
    """``docs`` with ``product, version, kind, category, topics`` by rules: product and version from the file name, the
    first kind of which a word is in name or text, its category, and the topics that the text holds."""
    plain = F.lower(F.concat_ws(" ", name, text))
    kind = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(plain, w)), F.lit(k)) for k, words in kinds.items()), F.lit("unknown"))
    version = F.nullif(F.regexp_extract(name, r"[vV_ -](\d+(?:\.\d+)+)", 1), F.lit(""))
    product = F.nullif(F.regexp_extract(name, r"^([A-Za-z0-9]+)", 1), F.lit(""))
    rows = docs.withColumn("product", product).withColumn("version", version).withColumn("kind", kind)
    category = F.coalesce(*(F.when(F.col("kind") == k, F.lit(c)) for k, c in categories.items()), F.lit("general"))
    return rows.withColumn("category", category).withColumn("topics", F.filter(F.array(*map(F.lit, topics)), lambda t: F.contains(F.lower(text), t)))


def steps(docs: DataFrame, key: str, text: str, verbs: list[str]) -> DataFrame:
    """``key, step, instruction, depends_on`` of numbered, bulleted and verb-initial lines, renumbered in their order."""
    marked = F.regexp_replace(F.col(text), r"(?i)(?<!^)(?<!\n)(step \d+:)", "\n$1")
    lines = docs.select(key, F.posexplode(F.split(marked, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    numbered = F.regexp_extract("line", r"(?i)^(?:step\s+)?\d+[:.)]\s*(.+)$", 1)
    bullet = F.regexp_extract("line", r"^[-*•]\s+(.+)$", 1)
    verb = F.regexp_extract("line", r"(?i)^((?:" + "|".join(verbs) + T.ascii_bounds(r")\b.+)$"), 1)
    text_of = F.coalesce(F.nullif(numbered, F.lit("")), F.nullif(bullet, F.lit("")), F.nullif(verb, F.lit("")))
    rows = lines.withColumn("instruction", F.trim(text_of)).filter("instruction is not null")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.select(key, nth.alias("step"), "instruction", F.when(nth > 1, nth - 1).alias("depends_on"))


def relations(entities: DataFrame, verb_spans: DataFrame, key: str, reach: int = 80) -> DataFrame:
    """``key, source, relation, target``: the first two entities within ``reach`` characters of a connecting verb."""
    verbs = verb_spans.select(key, F.col("entity").alias("relation"), F.col("start").alias("v_start"), F.col("end").alias("v_end"))
    near = entities.select(key, "entity", "start", "end").join(verbs, key).filter((F.col("end") >= F.col("v_start") - reach) & (F.col("start") <= F.col("v_end") + reach))
    nth = F.row_number().over(Window.partitionBy(key, "v_start").orderBy("start"))
    two = near.withColumn("nth", nth).filter("nth <= 2")
    out = two.groupBy(key, "v_start", "relation").agg(F.max(F.when(F.col("nth") == 1, F.col("entity"))).alias("source"), F.max(F.when(F.col("nth") == 2, F.col("entity"))).alias("target"))
    return out.filter("target is not null").select(key, "source", "relation", "target")


# --- sections and chunks ------------------------------------------------------------------------------------------
HEADING = r"^(#{1,6} .+|\d+(\.\d+)*\.? [A-Z].*|[A-Z][A-Z0-9 ]{3,}|([A-Z][a-z]+ ){1,6}[A-Z][a-z]+|.{3,60}:)$"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section, title, body``: lines grouped under the heading before them; 0 is what comes before any."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    heading = F.col("line").rlike(HEADING) & (F.length("line") < 100)
    rows = lines.withColumn("h", heading.cast("int")).withColumn("section", F.sum("h").over(Window.partitionBy(key).orderBy("pos")))
    body = F.sort_array(F.collect_list(F.when(F.col("h") == 0, F.struct("pos", "line"))))
    return rows.groupBy(key, "section").agg(
        F.max(F.when(F.col("h") == 1, F.regexp_replace("line", "^#+ ", ""))).alias("title"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body")
    )


#: Characters of texts whose chunks a worker holds before it passes them on.
MOST_CHARACTERS = 4 << 20


def pack_sentences(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 0) -> DataFrame:
    """``key, chunk_index, content, hash``: sentences packed into chunks of at most ``size`` characters.

    The hash is that of the chunk's own sentences. With ``overlap`` a chunk starts with the sentences that end the
    chunk before it, as many as fit into that number of characters. A longer sentence is a chunk of its own.
    """
    import hashlib
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "chunk_index", "content", "hash"]
        for pdf in batches:
            rows, held = [], 0
            for k, t in zip(pdf[key], pdf[text].fillna("")):
                held += len(t)
                if held > MOST_CHARACTERS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], len(t)
                own: list[str] = []
                tail: list[str] = []
                n = 0

                def close() -> None:
                    nonlocal own, tail, n
                    if own:
                        rows.append((k, n, " ".join(tail + own), hashlib.md5(" ".join(own).encode()).hexdigest()))
                        n += 1
                        tail = []
                        for s in reversed(own):
                            if len(" ".join([s, *tail])) > overlap:
                                break
                            tail.insert(0, s)
                        own = []

                for s in (x.strip() for x in re.findall(r"[^.!?]+[.!?]*", t)):
                    if s and own and len(" ".join([*tail, *own, s])) > size:
                        close()
                    if s:
                        own.append(s)
                close()
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(key, text).mapInPandas(run, f"{key} long, chunk_index int, content string, hash string")


def section_chunks(docs: DataFrame, key: str, text: str, size: int = 512) -> DataFrame:
    """Chunks that do not cross headings: short sections whole, longer ones by sentences, each under its title."""
    parts = sections(docs, key, text)
    titled = parts.withColumn("sid", F.xxhash64(key, "section"))
    packed = pack_sentences(titled.select(F.col("sid"), F.col("body")), "sid", "body", size, min(50, size // 2))
    rows = packed.join(titled.select("sid", key, "section", "title"), "sid")
    content = F.when(F.col("title").isNotNull(), F.concat(F.lit("Section: "), "title", F.lit("\n"), "content")).otherwise(F.col("content"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("section", "chunk_index")) - 1
    return rows.select(key, nth.alias("chunk_index"), "section", content.alias("content"))


def index_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown index to entries: ``key, section, entry, content`` by ``## `` sections and ``### `` entries."""
    parts = docs.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), text), "\n## ")).alias("section", "s")).filter("section > 0")
    rows = parts.select(key, "section", F.posexplode(F.split("s", "\n### ")).alias("nth", "e")).filter("nth > 0")
    return rows.select(key, "section", F.split_part("e", F.lit("\n"), F.lit(1)).alias("entry"), F.regexp_replace(F.regexp_replace("e", "^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("content"))


def security_class(docs: DataFrame, name: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The first rule whose pattern is in the file name (0.95), else in the text (0.90); else null."""
    label, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for column, sure in ((text, 0.90), (name, 0.95)):
        for pattern, kind in reversed(rules):
            hit = F.col(column).rlike(pattern)
            label, confidence = F.when(hit, F.lit(kind)).otherwise(label), F.when(hit, F.lit(sure)).otherwise(confidence)
    return docs.withColumn("security", label).withColumn("security_confidence", confidence)


def merged_classes(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two classifications of each row: known values first, the greater confidence."""
    known = lambda c: F.when(~F.lower(F.trim(c)).isin("", "unknown", "n/a"), F.col(c))
    other = b.select(key, F.col("confidence").alias("_confidence"), *(F.col(f).alias(f"_{f}") for f in fields))
    rows = a.join(other, key)
    return rows.select(key, *(F.coalesce(known(f), known(f"_{f}"), F.lit("unknown")).alias(f) for f in fields), F.greatest("confidence", "_confidence").alias("confidence"))


def snapshot(docs: DataFrame, key: str, text: str, lexicon: dict[str, list[str]], connecting: list[str], verbs: list[str]) -> dict[str, DataFrame]:
    """All that is mined of each document: ``entities``, ``specifications``, ``steps`` and ``relations``, one table each."""
    entities = entity_spans(docs, key, text, lexicon)
    links = entity_spans(docs, key, text, {"verb": connecting})
    return {"entities": entities, "specifications": specifications(docs, key, text), "steps": steps(docs, key, text, verbs), "relations": relations(entities, links, key)}


def snapshot_counts(docs: DataFrame, key: str, mined: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table for each document, zeros included."""
    out = docs.select(key).distinct()
    for name, rows in mined.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(mined))


def term_context(queries: DataFrame, acronym_table: DataFrame, synonym_table: DataFrame, most: int = 3, terms: int = 3) -> DataFrame:
    """``qid, context``: a text of the acronyms that a question names, ``most`` at most, and of the synonyms of its first
    ``terms`` words, ``most`` a word, by their type; null where there is nothing to tell."""
    named = relevant_acronyms(queries, acronym_table, most)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" = ", "acronym", "definition").alias("t")))), lambda x: x["t"]), "; ")
    named = named.groupBy("qid").agg(F.concat(F.lit("Acronyms: "), listed).alias("acronyms"))
    words = F.slice(F.regexp_extract_all("query", F.lit(r"([\p{L}\p{N}_]+)"), 1), 1, terms)
    each = queries.select("qid", F.posexplode(words).alias("nth", "query")).select(F.struct("qid", "nth").alias("qid"), "query")
    found = relevant_synonyms(each, synonym_table, most).select("qid.qid", "qid.nth", "rank", "term_type", F.concat_ws(" ~ ", "term", "synonym").alias("t"))
    by_type = found.groupBy("qid", "term_type").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("nth", "rank", "t"))), lambda x: x["t"])), "; ").alias("s"))
    lines = by_type.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list(F.concat("term_type", F.lit(": "), "s"))), "\n").alias("synonyms"))
    both = queries.select("qid").distinct().join(named, "qid", "left").join(lines, "qid", "left")
    return both.select("qid", F.nullif(F.concat_ws("\n", "acronyms", "synonyms"), F.lit("")).alias("context"))
