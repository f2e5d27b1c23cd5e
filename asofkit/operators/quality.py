"""Profiles, duplicate counts, flags and assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.times import strict_date, week_start

PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_none(df: DataFrame, **bad: Column) -> DataFrame:
    """df, if no row meets any of the named conditions; else an error with their counts. One pass."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in bad.items())).first().asDict()
    if wrong := {n: v for n, v in counts.items() if v}:
        raise ValueError("; ".join(f"{n}: {v} rows" for n, v in wrong.items()))
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    doubled = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if doubled:
        raise ValueError(f"not unique: {', '.join(keys)}")
    return df


def blank(c: Column) -> Column:
    """Null, empty, or white space alone."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) == ""


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: column_name, rows_total, empty_cells (null or ""), empty_ratio, blank_cells, blank_ratio; ratios are null without rows. One pass."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    counted = df.agg(F.count("*").alias("n"), *(F.count_if(empty(c)).alias(f"e_{i}") for i, c in enumerate(columns)), *(F.count_if(blank(F.col(c).cast("string"))).alias(f"b_{i}") for i, c in enumerate(columns)))
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"e_{i}").alias("empty_cells"), F.col(f"b_{i}").alias("blank_cells")) for i, c in enumerate(columns)))
    rows = counted.select("n", F.explode(parts).alias("x")).select("x.*", F.col("n").alias("rows_total"))
    ratio = lambda c: F.when(F.col("rows_total") > 0, F.col(c) / F.col("rows_total"))
    return rows.select("column_name", "rows_total", "empty_cells", ratio("empty_cells").alias("empty_ratio"), "blank_cells", ratio("blank_cells").alias("blank_ratio"))


def analysis_text(title: Column, content: Column, summary: Column, source: Column) -> Column:
    """title and body on two lines; the body of news is the content, else the summary. Nulls are empty."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    body = F.when((source == "news") & (clean(content) == ""), clean(summary)).otherwise(clean(content))
    return F.regexp_replace(F.concat(clean(title), F.lit("\n"), body), r"^\s+|\s+$", "")


def length_profile(df: DataFrame, length: Column, by: list[str]) -> DataFrame:
    """Exact minimum, median, p90, p95, p99, maximum (linear interpolation), mean and counts over 4,000 and 8,000 of a length."""
    held = df.withColumn("_n", length)
    p = F.percentile("_n", F.array(*map(F.lit, PERCENTILES)))
    return held.groupBy(*by).agg(
        F.count("*").alias("rows_total"), F.min("_n").alias("minimum"), p.alias("_p"), F.max("_n").alias("maximum"), F.avg("_n").alias("mean"),
        F.count_if(F.col("_n") > 4000).alias("over_4000"), F.count_if(F.col("_n") > 8000).alias("over_8000"), F.count_if(F.col("_n") == 0).alias("blank_rows"),
    ).select(*by, "rows_total", "minimum", *(F.col("_p")[i].alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))), "maximum", "mean", "over_4000", "over_8000", "blank_rows")


def observed_volumes(df: DataFrame, day: Column) -> DataFrame:
    """Per observed day and per observed Monday week: unit, period_start, rows_seen; no zeros are filled in, unreadable days aren't counted."""
    days = df.select(day.alias("d")).filter("d IS NOT NULL")
    daily = days.groupBy("d").agg(F.count("*").alias("rows_seen"))
    weekly = daily.groupBy(week_start(F.col("d")).alias("d")).agg(F.sum("rows_seen").alias("rows_seen"))
    named = lambda x, unit: x.select(F.lit(unit).alias("unit"), F.col("d").alias("period_start"), "rows_seen")
    return named(daily, "day").unionByName(named(weekly, "week"))


def date_coverage(df: DataFrame, text: str) -> DataFrame:
    """parsed, unparsed, success ratio, earliest and latest of a column of `YYYY-MM-DD` dates, failures counted."""
    day = strict_date(F.col(text))
    return df.agg(F.count(day).alias("parsed"), F.count_if(day.isNull()).alias("unparsed"), (F.count(day) / F.count("*")).alias("parse_ratio"), F.min(day).alias("earliest"), F.max(day).alias("latest"))


def item_mentions(df: DataFrame, content: str, section: str, items: tuple[str, ...] = ("1", "1A", "7", "7A")) -> DataFrame:
    """Rows that mention a 10-K item in their content, in their section label, or in either."""
    parts = []
    for item in items:
        pattern = rf"(?i)\bItem\s+{item}(?![A-Za-z0-9])"
        told = F.coalesce(F.col(content).rlike(pattern), F.lit(False))
        labelled = F.coalesce(F.col(section).rlike(pattern) | (F.upper(F.trim(section)) == item), F.lit(False))
        parts.append((item, told, labelled))
    counted = df.agg(*(F.count_if(c).alias(f"{kind}_{i}") for i, (_, told, labelled) in enumerate(parts) for kind, c in (("t", told), ("l", labelled), ("e", told | labelled))))
    rows = F.array(*(F.struct(F.lit(f"Item {item}").alias("item"), F.col(f"t_{i}").alias("content_rows"), F.col(f"l_{i}").alias("label_rows"), F.col(f"e_{i}").alias("either_rows")) for i, (item, *_) in enumerate(parts)))
    return counted.select(F.explode(rows).alias("x")).select("x.*")


def extra_rows(df: DataFrame, keys: list[str]) -> Column | int:
    """Rows beyond the first of each key; nulls are equal to each other."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("extra_rows"))


def duplicate_counts(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """key_name, extra_rows for each named key; null where df lacks a column of it."""
    spark = df.sparkSession
    parts = []
    for name, columns in keys.items():
        if set(columns) <= set(df.columns):
            parts.append(extra_rows(df, columns).select(F.lit(name).alias("key_name"), F.col("extra_rows").cast("long").alias("extra_rows")))
        else:
            parts.append(spark.createDataFrame([(name, None)], "key_name string, extra_rows long"))
    return reduce(DataFrame.unionByName, parts)


def spread_keys(df: DataFrame, key: Column, over: Column) -> DataFrame:
    """groups and extra_rows of keys that occur with more than one value of `over`; null keys and values don't count."""
    held = df.select(key.alias("k"), over.alias("o")).filter("k IS NOT NULL AND o IS NOT NULL")
    per = held.groupBy("k").agg(F.count_distinct("o").alias("values"), F.count("*").alias("n"))
    return per.filter("values > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"))


def flags(**conditions: Column) -> Column:
    """The names of the conditions that hold, in order, joined by `;`."""
    return F.concat_ws(";", *(F.when(c, F.lit(n)) for n, c in conditions.items()))


def inventory(tables: dict[str, DataFrame], body: str = "content") -> DataFrame:
    """Per table: its rows, columns, and rows without body (null where it has no such column)."""
    parts = []
    for name, df in tables.items():
        missing = F.count_if(blank(F.col(body).cast("string"))) if body in df.columns else F.lit(None).cast("long")
        parts.append(df.agg(F.count("*").alias("rows_total"), missing.alias("missing_body")).select(F.lit(name).alias("table_name"), "rows_total", F.lit(len(df.columns)).alias("columns_total"), "missing_body"))
    return reduce(DataFrame.unionByName, parts)


def with_group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    """df with the size of each row's group, by a count and a join, so that a large group isn't sorted in one task; null keys are a group."""
    counts = df.groupBy(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys))).agg(F.count("*").alias(name))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(keys)])
    return df.join(counts, on).select(*df.columns, name)


def first_seen(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """df with `first_position`, the least position of the row's key, and whether the row repeats it."""
    w = Window.partitionBy(*keys)
    return df.withColumn("first_position", F.min(position).over(w)).withColumn("repeats", F.col(position) > F.col("first_position"))
