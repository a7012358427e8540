"""Text mining over tables of texts: chunks, terms, phrases, classes, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    (label, rule), *rest = rules
    return reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rest, F.when(rule, F.lit(label))).otherwise(F.lit(otherwise))


def sentence_chunks(docs: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """One chunk a sentence, after the sentence before it in its paragraph: ``key, chunk_index, content``."""
    paragraphs = docs.select(key, F.posexplode(F.split(text, separator)).alias("para", "p"))
    rows = paragraphs.select(key, "para", F.posexplode(T.sentences("p")).alias("pos", "sentence"))
    before = F.lag("sentence").over(Window.partitionBy(key, "para").orderBy("pos"))
    rows = rows.withColumn("content", F.concat_ws(" ", before, "sentence"))
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("para", "pos")) - 1).alias("chunk_index"), "content")


def word_windows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of words with overlap; the last one reaches the end."""
    words = docs.select(key, T.split_words(text).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / F.lit(size - overlap)), F.lit(0)).cast("int")
    rows = words.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select(key, "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * (size - overlap) + 1, F.lit(size)), " ").alias("content"))


#: Endings that tell a chunk cut off. Fixed values.
DANGLING = [
    "is", "are", "was", "were", "has", "have", "can", "will", "would", "should", "could", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
]


def chunk_quality(chunks: DataFrame, key: str, order: str, content: str, dangling: list[str] = DANGLING) -> DataFrame:
    """Of each document: chunks, empty ones, ones that end as a dangling word does, ones unfinished though not last; shortest,
    longest and mean length without white space around; and a score, 100 less 10 for each chunk cut off or unfinished.

    An ending is compared as it stands, letters before it or not, so ``this`` ends as ``is`` does. Empty chunks have no other
    issue and no part in the shortest and longest; without others both are null.
    """
    w = Window.partitionBy(key).orderBy(order)
    body = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"^\s+|\s+$", "")
    rows = chunks.select(key, body.alias("_body"), F.lead(order).over(w).isNull().alias("_last"))
    full = F.col("_body") != ""
    truncated = full & F.exists(F.array(*map(F.lit, dangling)), lambda x: F.endswith(F.col("_body"), x))
    unfinished = full & ~F.col("_body").rlike(r"[.!?]\z") & ~F.col("_last")
    length = F.length("_body")
    out = rows.groupBy(key).agg(
        F.count("*").alias("chunks"), F.count_if(~full).alias("empty"), F.count_if(truncated).alias("truncated"), F.count_if(unfinished).alias("unfinished"),
        F.round(F.avg(length), 4).alias("mean_length"), F.min(F.when(full, length)).alias("min_length"), F.max(F.when(full, length)).alias("max_length"),
    )
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 10 * (F.col("truncated") + F.col("unfinished"))))


def pattern_scores(docs: DataFrame, key: str, text: str, patterns: dict[str, dict[str, float]], boosts: dict[str, list[str]] | None = None) -> DataFrame:
    """``key, label, score``: matches of each pattern times its weight, and 0.5 for each of a label's boost terms that the text
    holds, summed by label; only labels that score."""
    low = F.lower(text)
    scored = []
    for label, ps in patterns.items():
        parts = [F.regexp_count(low, F.lit(p)) * F.lit(w) for p, w in ps.items()]
        parts += [F.when(F.contains(low, F.lit(t.lower())), 0.5).otherwise(0.0) for t in (boosts or {}).get(label, [])]
        scored.append(F.struct(F.lit(label).alias("label"), reduce(Column.__add__, parts).alias("score")))
    rows = docs.select(key, F.explode(F.array(*scored)).alias("s")).select(key, "s.label", "s.score")
    return rows.filter("score > 0")


def classify(
    docs: DataFrame, key: str, text: str, patterns: dict[str, dict[str, float]], default: str, default_confidence: float = 0.5, boosts: dict[str, list[str]] | None = None
) -> DataFrame:
    """``key, label, confidence``: the label of the highest score, ties to the first by name, and its share of all."""
    scores = pattern_scores(docs, key, text, patterns, boosts)
    best = scores.groupBy(key).agg(F.max("score").alias("top"), F.sum("score").alias("total"))
    named = scores.join(best, key).filter("score = top").groupBy(key).agg(F.min("label").alias("label"), F.first(F.col("top") / F.col("total")).alias("confidence"))
    return docs.select(key).join(named, key, "left").select(
        key, F.coalesce("label", F.lit(default)).alias("label"), F.coalesce("confidence", F.lit(default_confidence)).alias("confidence")
    )


#: Words of domains and of document types, counted within words too. Fixed values.
DOMAINS = {
    "electrical": ["ohm", "resistor", "capacitor", "voltage", "current", "circuit", "amplifier"],
    "network": ["router", "switch", "tcp/ip", "protocol", "firewall", "vlan", "latency"],
    "mechanical": ["bearing", "shaft", "gear", "torque", "load", "tolerance"],
    "software": ["api", "database", "microservice", "endpoint", "json", "deployment"],
    "chemical": ["ph", "compound", "reaction", "solvent", "catalyst", "concentration"],
}
KINDS = {
    "manual": ["guide", "instructions", "overview", "introduction"],
    "specification": ["specification", "spec", "requirements", "parameters", "compliance"],
    "schematic": ["schematic", "diagram", "wiring", "layout"],
    "report": ["analysis", "results", "observations", "summary"],
    "drawing": ["drawing", "figure", "scale", "dimension"],
    "procedure": ["step", "procedure", "process", "sequence"],
}


def class_chances(docs: DataFrame, key: str, text: str, words: dict[str, list[str]], smoothing: float = 0.05) -> DataFrame:
    """``key, label, share, chance, best``: each label's share of all words counted, the shares with ``smoothing`` added and made to
    add up to one again, and whether it is the greatest, ties to the first listed. A text without any has equal chances."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = [reduce(Column.__add__, (F.regexp_count(low, F.lit(w)) for w in ws)).alias(f"_{i}") for i, ws in enumerate(words.values())]
    columns = [F.col(f"_{i}") for i in range(len(words))]
    rows = docs.select(key, *counts).withColumn("_total", F.greatest(F.lit(1), reduce(Column.__add__, columns))).withColumn("_most", F.greatest(*columns))
    first = F.array_position(F.array(*columns), F.col("_most"))
    labels = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(name).alias("label"), c.alias("n")) for i, (name, c) in enumerate(zip(words, columns))))
    rows = rows.select(key, "_total", F.when(F.col("_most") > 0, 1.0).otherwise(0.0).alias("_found"), first.alias("_first"), F.explode(labels).alias("l"))
    share = F.col("l.n") / F.col("_total")
    every = F.col("_found") + smoothing * len(words)  # shares add up to one, or to zero where nothing was found
    return rows.select(key, "l.label", F.round(share, 6).alias("share"), F.round((share + smoothing) / every, 6).alias("chance"), (F.col("l.i") == F.col("_first")).alias("best"))


def term_counts(docs: DataFrame, text: str, patterns: list[str], top: int) -> DataFrame:
    """Most frequent matches of any pattern in the lower-cased text, ties by term."""
    found = F.concat(*(F.regexp_extract_all(F.lower(text), F.lit(f"({p})"), 1) for p in patterns))
    terms = docs.select(F.explode(found).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


#: Words of families of technical terms. Fixed values.
TERM_WORDS = [
    "install", "installation", "setup", "configure", "configuration", "security", "authentication", "authorization", "certificate", "encryption", "integration", "connector", "interface", "api", "ldap",
    "troubleshoot", "error", "issue", "problem", "fix", "resolve",
]


def technical_terms(docs: DataFrame, text: str, top: int = 100, words: list[str] = TERM_WORDS, stop: list[str] = ()) -> DataFrame:
    """``term, n``: the most frequent technical terms of whole texts, ties by term.

    Of the lower-cased text: versions, ``words`` of families, words of two to six ASCII letters (what counts as an acronym where
    case is ignored), paths, IPv4 addresses and numbers of two to five digits, as ports; and, as written, runs of capitalised
    ASCII words of more than three characters that are not in ``stop``. A word in two families counts in each.
    """
    low = docs.select(F.lower(text).alias("low"), F.col(text).alias("text"), T.tokens(text).alias("w"))
    found = lambda c, p: F.regexp_extract_all(c, F.lit(f"({p})"), 1)
    terms = F.concat(
        found("low", r"\d+\.\d+(?:\.\d+)?"), F.filter("w", lambda x: x.isin(*words)), F.filter("w", lambda x: x.rlike("^[a-z]{2,6}$")), found("low", r"/[^\s]+"),
        found("low", r"(?:\d{1,3}\.){3}\d{1,3}"), F.filter("w", lambda x: x.rlike("^[0-9]{2,5}$")),
        F.filter(found("text", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), lambda x: (F.length(x) > 3) & ~x.isin(*stop)),
    )
    rows = low.select(F.explode_outer(terms).alias("term")).filter(F.length("term") > 1)
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def phrases(docs: DataFrame, text: str, stop: list[str], top: int) -> DataFrame:
    """Two- and three-word phrases within sentences over words of letters that are no stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col("s")), F.lit(r"(\p{L}+)"), 1), lambda w: ~w.isin(stop))
    rows = docs.select(F.explode(T.sentences(text)).alias("s")).select(words.alias("w")).filter(F.size("w") > 1)
    w = F.col("w")  # a column of its own, so that the functions below look words up and do not find them anew

    def grams(n: int) -> Column:
        after = F.slice(w, F.lit(n), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(after, lambda x, i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(n - 1)), x))

    both = F.concat(F.filter(grams(2), lambda p: F.length(p) >= 5), F.filter(grams(3), lambda p: F.length(p) >= 8))
    # an outer explode, as a plain one has the optimizer add a filter that makes the phrases a second time
    found = rows.select(F.explode_outer(both).alias("phrase")).filter("phrase is not null")
    return found.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(top)


def vocabulary_stats(docs: DataFrame, by: str, text: str) -> DataFrame:
    """Tokens, different tokens, richness and the greatest frequency by group."""
    counts = docs.select(by, F.explode(T.tokens(text)).alias("t")).groupBy(by, "t").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("unique"), F.round(F.count("*") / F.sum("n"), 6).alias("richness"), F.max("n").alias("most")
    )


def dedupe_chunks(chunks: DataFrame, by: list[str], content: str, order: str) -> DataFrame:
    """Chunks with their hash and whether they repeat an earlier one of their group."""
    hashed = chunks.withColumn("hash", F.md5(content))
    nth = F.row_number().over(Window.partitionBy(*by, "hash").orderBy(order))
    return hashed.withColumn("duplicate", nth > 1)


def _hash_mod(text: Column, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def contrastive_pairs(terms: DataFrame, key: str, term: str, negatives: int, per_bucket: int = 64) -> DataFrame:
    """``key, term, label``: the rows of ``terms (key, term)``, and for each key ``negatives`` terms of other keys.

    Terms are dealt to buckets of about ``per_bucket`` by hash. A key draws a bucket for each of its negatives and takes
    the term of it that a hash of term, key and draw puts first, among those that are not its own. So draws are random,
    repeatable, and cost a bucket, not the vocabulary. A draw whose bucket holds own terms only gives none.
    """
    distinct = terms.select(term).distinct()
    buckets = F.broadcast(distinct.agg(F.greatest(F.floor(F.count("*") / per_bucket), F.lit(1)).alias("n")))
    dealt = distinct.crossJoin(buckets).withColumn("bucket", _hash_mod(F.col(term), F.col("n"))).drop("n")
    slots = terms.select(key).distinct().withColumn("slot", F.explode(F.array(*map(F.lit, range(negatives))))).crossJoin(buckets)
    name = F.concat_ws(":", F.col(key).cast("string"), F.col("slot").cast("string"))
    drawn = slots.withColumn("bucket", _hash_mod(name, F.col("n"))).drop("n").join(dealt, "bucket").join(terms, [key, term], "left_anti")
    order = F.md5(F.concat_ws(":", F.col(term), name))
    negative = drawn.groupBy(key, "slot").agg(F.min_by(term, order).alias(term))
    return terms.select(key, term, F.lit(1).alias("label")).unionByName(negative.select(key, term, F.lit(0).alias("label")))


def stratified_split(df: DataFrame, stratum: str, order: Column, shares: list[tuple[str, float]]) -> DataFrame:
    """``df`` with ``part``: of each stratum the first rows in ``order`` (a hex string that tells rows apart) go to the
    first part, as many as its share of the stratum rounded down, and so on; the rest goes to the last part.

    Ranks are counted in two steps, by the order's first three digits and then among equal ones, so a stratum with most
    rows is ranked by many tasks.
    """
    rows = df.withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, 3))
    counts = rows.groupBy(stratum, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(stratum))).drop("_n")
    counts = counts.withColumnRenamed(stratum, "_stratum").withColumnRenamed("_slice", "_s")
    within = F.row_number().over(Window.partitionBy(stratum, "_slice").orderBy("_order"))
    ranked = rows.withColumn("_rank", within).join(counts, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_slice") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_base"))
    part, upto = F.lit(shares[-1][0]), F.lit(0.0)
    bounds = []
    for name, share in shares[:-1]:
        upto = upto + F.floor(F.col("_total") * share)
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        part = F.when(F.col("_rank") <= bound, name).otherwise(part)
    return ranked.select(*df.columns, part.alias("part"))
