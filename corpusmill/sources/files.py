"""File sources and sinks: CSV, JSON, XML and text as lines, JSON Lines, Parquet round trips, catalog listings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_lines(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """``file, content`` of CSV files: the header row, then rows up to ``most`` in file order, and a mark if more follow.

    Files are read whole, as a quoted field may hold line feeds; quotes within a field are doubled.
    """

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io
        from itertools import islice

        for pdf in batches:
            out = []
            for text in pdf["content"]:
                rows = list(islice(csv.reader(io.StringIO(text, newline="")), most + 1))
                lines = [" | ".join(r) for r in rows[:most]] + (["... (truncated)"] if len(rows) > most else [])
                out.append("\n".join(["CSV Headers: " + lines[0], *lines[1:]]) if lines else "")
            yield pd.DataFrame({"file": pdf["file"], "content": out})

    return whole_texts(spark, path).mapInPandas(render, "file string, content string")


def whole_texts(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``file, content`` of whole files; JSON files are told by the prefix ``JSON Content:``."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.concat(F.lit(prefix), "value").alias("content"))


def xml_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of XML files: ``tag: text`` lines in document order, indented by depth."""

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        def lines(e, depth: int) -> Iterator[str]:
            text = (e.text or "").strip()
            yield "  " * depth + (f"{e.tag}: {text}" if text else e.tag)
            for child in e:
                yield from lines(child, depth + 1)

        for pdf in batches:
            yield pd.DataFrame({"file": pdf["file"], "content": ["\n".join(lines(ElementTree.fromstring(x), 0)) for x in pdf["content"]]})

    return whole_texts(spark, path).mapInPandas(render, "file string, content string")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON Lines; lines that are not objects of the schema are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if limit is None else rows.limit(limit)


def map_keys(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The different keys of a map column, sorted; more than ``most`` are an error, as each becomes a column."""
    found = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} keys")
    return sorted(r["k"] for r in found)


def flatten_maps(df: DataFrame, maps: dict[str, tuple[str, list[str] | None]]) -> DataFrame:
    """Map columns as one column a key: ``{column: (prefix, keys)}``. Without ``keys`` they are those that rows hold, found in a
    first pass, so that columns are the same on every run over the same rows; a row without a key has null."""
    kept = [c for c in df.columns if c not in maps]
    keys = {c: map_keys(df, c) if k is None else k for c, (_, k) in maps.items()}
    return df.select(*kept, *(F.col(c)[k].alias(f"{prefix}_{k}") for c, (prefix, _) in maps.items() for k in keys[c]))


def jsonl_to_parquet(spark: SparkSession, source: str, target: str, schema: str, maps: dict[str, str]) -> DataFrame:
    """JSON Lines to Parquet with each map column as columns of its prefix, one a key of the data; reads the result back."""
    rows = read_jsonl(spark, source, schema)
    flatten_maps(rows, {c: (prefix, None) for c, prefix in maps.items()}).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def round_trip(df: DataFrame, path: str, required: list[str]) -> DataFrame:
    """One row: whether Parquet gives back the required columns and the number of rows."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    missing = sorted(set(required) - set(back.columns))
    counts = df.agg(F.count("*").alias("written")).crossJoin(back.agg(F.count("*").alias("read")))
    return counts.withColumn("missing", F.array(*map(F.lit, missing)).cast("array<string>")).withColumn("ok", (F.col("written") == F.col("read")) & F.lit(not missing))


def data_dictionary(listing: DataFrame) -> DataFrame:
    """Column listing to a dictionary: default schema, position in its table, safe types."""
    schema = F.coalesce(F.nullif(F.trim("schema_name"), F.lit("")), F.lit("dbo"))
    rows = listing.withColumn("schema_name", schema)
    position = F.row_number().over(Window.partitionBy("schema_name", "table_name").orderBy("position"))
    return rows.select(
        "schema_name", "table_name", "column_name", "data_type", position.alias("ordinal"), F.lower(F.trim("is_nullable")).isin("true", "1", "yes", "t").alias("nullable")
    )


def catalog_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, position, type, nullable, rows`` of the given tables."""
    out = None
    for name, df in tables.items():
        listed = [(name, f.name, i, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
        columns = df.sparkSession.createDataFrame(listed, "table string, column string, position int, type string, nullable boolean")
        one = columns.crossJoin(df.agg(F.count("*").alias("rows")))
        out = one if out is None else out.unionByName(one)
    return out


def constraint_columns(constraints: DataFrame) -> DataFrame:
    """Columns of each constraint in their order, as one string."""
    return constraints.groupBy("constraint_name").agg(F.expr("listagg(column_name, ',') within group (order by ordinal)").alias("columns"))


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A partitioned scan of a database table."""
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts)


def markdown_index(acronyms: DataFrame) -> DataFrame:
    """Lines of an acronym index: letter headings, entries, and notes on doubtful ones with two sources at most."""
    letter = F.upper(F.substring("acronym", 1, 1))
    doubtful = (F.col("confidence") < 0.8) | ~F.col("verified")
    note = F.when(doubtful, F.concat(F.lit("*Confidence: "), F.col("confidence").cast("string"), F.lit(" | Sources: "), F.array_join(F.slice("sources", 1, 2), ", "), F.lit("*")))
    entry = F.concat_ws("\n", F.concat(F.lit("### "), "acronym"), "definition", note)
    first = F.row_number().over(Window.partitionBy(letter).orderBy("acronym")) == 1
    heading = F.when(first, F.concat(F.lit("## "), letter))
    return acronyms.select("acronym", F.concat_ws("\n\n", heading, entry).alias("line")).orderBy("acronym")
