"""Metadata of documents by ordered patterns and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Versions, dates of release, document numbers, years: the first pattern that is found. Looked for in lower-cased text, but for
#: numbers. Fixed values.
VERSIONS = [r"version\s+(\d+\.\d+(?:\.\d+)?)", r"v(\d+\.\d+(?:\.\d+)?)", r"(\d+\.\d+)\s+(?:user|installation|reference)", r"release\s+(\d+\.\d+(?:\.\d+)?)"]
RELEASES = [r"ga\s+date[:\s]+(\w+\s+\d{1,2},?\s+\d{4})", r"general\s+availability[:\s]+(\w+\s+\d{1,2},?\s+\d{4})"]
NUMBER = r"([A-Z]{2,4}-\d{4,6}-\d{1,3})"
YEAR = r"(\d{4})"
#: Words that tell services and readers. Fixed values.
SERVICES = {"Electric": ["electric", "electricity", "power", "meter reading"], "Gas": ["gas", "natural gas"], "Water": ["water", "h2o"], "Common": ["communication", "protocol", "interface"]}
AUDIENCES = {
    "Utility operations": ["utility", "operations", "operator"],
    "Technical support": ["support", "troubleshooting", "maintenance"],
    "Developers": ["developer", "api", "integration", "programming"],
    "End users": ["user guide", "end user", "customer"],
}
#: A title stands in the first lines, is longer than this, and does not begin as a footer does. Fixed values.
TITLE_LINES, SHORT_TITLE, FOOTERS = 10, 10, ("page", "copyright", "©")


def first_found(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that is found captures; null if none is."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def named(low: Column, lexicon: dict[str, list[str]]) -> Column:
    """Names of the lexicon of which a word is within the lower-cased text, in its order."""
    flags = (F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in lexicon.items())
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def document_metadata(
    docs: DataFrame, key: str, text: str, products: dict[str, list[str]], publishers: dict[str, list[str]], services: dict[str, list[str]] = SERVICES, audiences: dict[str, list[str]] = AUDIENCES
) -> DataFrame:
    """``key, title, version, doc_number, ga_date, copyright_year, publisher, products, services, audiences`` of whole texts.

    The title is the first of ten lines that is long enough and no footer; the year the first four digits anywhere, as they
    stand. A null text has no values and empty lists.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    lines = F.transform(F.slice(F.split(whole, "\n"), 1, TITLE_LINES), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    footer = lambda x: F.exists(F.array(*map(F.lit, FOOTERS)), lambda f: F.startswith(F.lower(x), f))
    title = F.get(F.filter(lines, lambda x: (F.length(x) > SHORT_TITLE) & ~footer(x)), 0)
    return docs.select(
        key, title.alias("title"), first_found(low, VERSIONS).alias("version"), first_found(whole, [NUMBER]).alias("doc_number"), first_found(low, RELEASES).alias("ga_date"),
        first_found(low, [YEAR]).cast("int").alias("copyright_year"), F.get(named(low, publishers), 0).alias("publisher"),
        named(low, products).alias("products"), named(low, services).alias("services"), named(low, audiences).alias("audiences"),
    )
