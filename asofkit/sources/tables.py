"""Readers: CSV as text, copies of one table, JSON lines, pages, literals, samples."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.functions.text import html_body_udf
from asofkit.operators.dedup import first_of


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, without a byte order mark."""
    first = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    return [(c or "").lstrip("\ufeff") for c in first[0]] if first else []


def read_csv(spark: SparkSession, path: str, null_value: str | None = None) -> DataFrame:
    """A CSV file with every column as text: quotes doubled, line ends in cells allowed, empty cells "" (or null with null_value=""), words such as NA kept.

    A file without rows gives none; one whose quotes don't close gives an error when it is read.
    """
    names = csv_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    reader = reader.option("nullValue", "\u0000" if null_value is None else null_value).option("emptyValue", "")
    out = reader.csv(path)
    return out.fillna("") if null_value is None else out


def read_copies(spark: SparkSession, active: str, archives: list[str]) -> DataFrame:
    """The active copy and then the archived ones by path, with copy_no and copy_path; all must have the same set of columns."""
    parts = []
    for n, p in enumerate([active, *sorted(archives)]):
        part = read_csv(spark, p)
        if parts and set(part.columns) != set(parts[0].columns) - {"copy_no", "copy_path"}:
            raise ValueError(f"{p}: columns differ from those of the active copy")
        parts.append(part.withColumn("copy_no", F.lit(n)).withColumn("copy_path", F.lit(p)))
    return reduce(DataFrame.unionByName, parts)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no from 1, value: the lines of the text files, blank ones too, in the order of file names and of the splits of each file."""
    text = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    # Within a split ids grow line by line; a line's number is its place in its split, plus the lines of all splits before: one row per split.
    counts = text.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return text.join(bases, ["_file", "_at"]).select((F.col("_base") + F.col("_i") - F.col("_least") + 1).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line_no, record, bad_line: each line as a struct; a line that is no such JSON is kept in bad_line, a blank one too."""
    lines = read_lines(spark, path)
    parsed = lines.withColumn("record", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.when(F.trim("value") == "", F.col("value")).otherwise(F.col("record._bad"))
    return parsed.select("line_no", F.when(bad.isNull(), F.col("record").dropFields("_bad")).alias("record"), bad.alias("bad_line"))


def page_bodies(pages: DataFrame, key: str, page: str) -> DataFrame:
    """`key` and `body`, the visible text of each page; null for null, empty for a page without text."""
    return pages.select(key, html_body_udf(F.col(page)).alias("body"))


def sample_rows(df: DataFrame, keys: list[str], usable: Column, order: str, n: int) -> DataFrame:
    """The first `n` usable rows in order, of each key its first row: the feature is the sample, so there is a limit."""
    return first_of(df, keys, [F.col(order)]).filter(usable).orderBy(order).limit(n)


def one_text(spark: SparkSession, text: str, source: str = "direct_text") -> DataFrame:
    return spark.createDataFrame([(source, text)], "source_type string, text string")


def fetched(spark: SparkSession, urls: DataFrame, cache: DataFrame, fetch) -> DataFrame:
    """url, body, error: cached results and those of `fetch(url) -> (body, error)` for addresses without one. The library itself fetches nothing."""
    def run(frames):
        for frame in frames:
            got = [fetch(u) for u in frame["url"]]
            yield pd.DataFrame({"url": frame["url"], "body": [b for b, _ in got], "error": [e for _, e in got]})

    asked = urls.select("url").filter("url IS NOT NULL").distinct()
    new = asked.join(cache.select("url"), "url", "left_anti").mapInPandas(run, "url string, body string, error string")
    return cache.select("url", "body", "error").join(asked, "url", "left_semi").unionByName(new)
