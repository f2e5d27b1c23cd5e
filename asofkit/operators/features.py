"""Point-in-time feature tables from scored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.text import LABELS
from asofkit.functions.times import next_month, week_ending_sunday, week_start

SOURCES = ("news", "earnings_call", "ten_k")


def valid_label(label: str = "label", error: str = "error", score: str | None = None) -> Column:
    """A known label without error, and with a score where one is named."""
    ok = F.col(label).isin(*LABELS) & (F.trim(F.coalesce(error, F.lit(""))) == "")
    return F.coalesce(ok & F.col(score).isNotNull() if score else ok, F.lit(False))


def period_grid(start: str, end: str, weekly: bool, spark) -> DataFrame:
    """The Sundays, or all days, from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return days.filter(F.weekday("date") == 6) if weekly else days


def source_features(scored: DataFrame, start: str, end: str, weekly: bool = True, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """One row per Sunday (or day) with, per source, document_count, error_count, missing, sentiment_mean and count and ratio of each label.

    `scored` has available_date, source_type, label, score, error. One aggregate per (source, period) is spread over fixed
    columns and joined to the grid of all periods; empty periods have 0 and missing 1. Documents after the last whole week
    are in no period.
    """
    day = F.col("available_date")
    inside = scored.filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).withColumn("date", week_ending_sunday(day) if weekly else day)
    ok = valid_label()
    measures = []
    for s in sources:
        own = F.coalesce(F.col("source_type") == s, F.lit(False))
        valid = own & ok
        n = F.count_if(valid)
        measures += [
            F.count_if(own).alias(f"{s}_document_count"), F.count_if(own & ~ok).alias(f"{s}_error_count"), F.when(n > 0, 0).otherwise(1).alias(f"{s}_missing"),
            F.coalesce(F.avg(F.when(valid, F.col("score"))), F.lit(0.0)).alias(f"{s}_sentiment_mean"),
        ]
        for label in LABELS:
            k = F.count_if(valid & (F.col("label") == label))
            measures += [k.alias(f"{s}_{label}_count"), F.when(n > 0, k / n).otherwise(0.0).alias(f"{s}_{label}_ratio")]
    found = inside.groupBy("date").agg(*measures)
    grid = period_grid(start, end, weekly, scored.sparkSession)
    names = [c for c in found.columns if c != "date"]
    return grid.join(found, "date", "left").select("date", *(F.coalesce(c, F.lit(1 if c.endswith("_missing") else 0)).cast(dict(found.dtypes)[c]).alias(c) for c in names))


def known_months(trends: DataFrame) -> DataFrame:
    """(keyword, known_from, value) of monthly values of (date, keyword, value, is_partial): partial months are left out after keys are checked, a month is known from the next one on."""
    wrong = trends.agg(F.count_if(F.dayofmonth("date") != 1), F.count("*"), F.count_distinct("date", "keyword")).first()
    if wrong[0] or wrong[1] != wrong[2]:
        raise ValueError("monthly values need the first day of a month, and each keyword once a month")
    partial = F.lower(F.coalesce(F.col("is_partial").cast("string"), F.lit(""))).isin("true", "1")
    return trends.filter(~partial).select("keyword", next_month(F.col("date")).alias("known_from"), "value")


def daily_sentiment(rows: DataFrame) -> DataFrame:
    """Per effective_trading_date: counts, failures and has_data; mean, sum, population deviation and ratios are null where no row is valid.

    Rows have effective_trading_date, label, score, error; a valid row has a known label (in any case), no error and a score.
    """
    held = rows.withColumn("label", F.lower(F.trim("label")))
    ok = valid_label(score="score")
    n, score = F.count_if(ok), F.when(ok, F.col("score"))
    out = [F.count("*").alias("item_count"), n.alias("valid_count"), (F.count("*") - n).alias("failure_count"), F.when(n > 0, 1).otherwise(0).alias("has_data"), F.avg(score).alias("sentiment_mean"), F.sum(score).alias("sentiment_sum"), F.stddev_pop(score).alias("sentiment_std")]
    for label in LABELS:
        k = F.count_if(ok & (F.col("label") == label))
        out += [k.alias(f"{label}_count"), F.when(n > 0, k / n).alias(f"{label}_ratio")]
    return held.groupBy("effective_trading_date").agg(*out)


def daily_dissemination(rows: DataFrame) -> DataFrame:
    """Per effective_trading_date (null is a group): sum of sizes, largest number of domains and span."""
    return rows.groupBy("effective_trading_date").agg(F.sum("size_asof").alias("cluster_size_sum"), F.max("domains_asof").alias("domains_max"), F.max("span_hours_asof").alias("span_hours_max"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join whose right side has each key once, which is checked; null keys are equal."""
    doubled = right.groupBy(key).count().filter("count > 1").limit(1).count()
    if doubled:
        raise ValueError(f"the right side has {key} more than once")
    r = right.withColumnRenamed(key, "_k")
    return left.join(r, left[key].eqNullSafe(r["_k"]), "left").drop("_k")


def snapshots(rows: DataFrame) -> DataFrame:
    """Per (cluster, trading date) of rows with cluster, trading_date, row_ix, ts, domain, title: size, domains (blank is one), span, the first row's attributes, the last time."""
    first = lambda c: F.min_by(c, F.struct("ts", "row_ix"))
    return rows.groupBy("cluster", "trading_date").agg(
        F.count("*").alias("cluster_size"), F.count_distinct(F.trim(F.coalesce("domain", F.lit("")))).alias("domain_count"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("span_hours"), first("row_ix").alias("first_row"), first("domain").alias("first_domain"),
        first("title").alias("first_title"), F.max("ts").alias("published_at"),
    )


def weekly_text(rows: DataFrame) -> DataFrame:
    """Per Monday week of rows with date, label, score, confidence: item and label counts, score sum, mean confidence, to four half-even decimals."""
    start = week_start(F.col("date"))
    per = rows.filter("date IS NOT NULL").groupBy(start.alias("week_start")).agg(
        F.count("label").alias("item_count"), *(F.count_if(F.col("label") == x).alias(f"{x}_count") for x in LABELS), F.bround(F.sum("score"), 4).alias("score_sum"), F.bround(F.avg("confidence"), 4).alias("confidence_mean")
    )
    return per.withColumn("week_end", F.date_add("week_start", 6))


def daily_text(rows: DataFrame) -> DataFrame:
    """As weekly_text by day; scores are read as numbers, 0 where they aren't."""
    score = F.coalesce(F.expr("try_cast(score AS double)"), F.lit(0.0))
    return rows.filter("date IS NOT NULL").groupBy("date").agg(
        F.count("label").alias("item_count"), *(F.count_if(F.col("label") == x).alias(f"{x}_count") for x in LABELS), F.bround(F.sum(score), 4).alias("score_sum"), F.bround(F.avg(score), 4).alias("score_mean")
    )


def document_scores(chunks: DataFrame) -> DataFrame:
    """Of (document_id, chunk_ix, score, error): the mean score and its sign's label where no chunk failed, else null; chunk counts and errors."""
    failed = F.count_if(F.coalesce("error", F.lit("")) != "")
    mean = F.when(failed == 0, F.avg("score"))
    return chunks.groupBy("document_id").agg(mean.alias("score"), F.count("*").alias("chunk_count"), failed.alias("failed_chunks")).withColumn(
        "label", F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").when(F.col("score") == 0, "neutral")
    )


def lookback_windows(series: DataFrame, order: str, values: list[str], length: int) -> DataFrame:
    """series with `window`: the last `length` rows' values in order, for rows that have so many. The series is one row a period."""
    w = Window.orderBy(order).rowsBetween(-(length - 1), 0)
    return series.withColumn("window", F.collect_list(F.struct(order, *values)).over(w)).filter(F.size("window") == length)


def temporal_split(labelled: DataFrame, order: str, end: str, shares: tuple[float, float] = (0.7, 0.85), least: tuple[int, int, int] = (4, 2, 2)) -> DataFrame:
    """labelled with `part`: train, validation, test by position, rows whose target reaches into the next part left out.

    Cuts are at the whole parts of the shares of n. Too few rows in a part is an error. The series is one row a period.
    """
    n = labelled.count()
    a, b = int(n * shares[0]), int(n * shares[1])
    placed = labelled.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    part = F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "validation").otherwise("test")
    placed = placed.withColumn("part", part)
    firsts = placed.agg(F.min(F.when(F.col("part") == "validation", F.col(order))).alias("_v"), F.min(F.when(F.col("part") == "test", F.col(order))).alias("_t"))
    held = placed.crossJoin(F.broadcast(firsts))
    reaches = ((F.col("part") == "train") & (F.col(end) >= F.col("_v"))) | ((F.col("part") == "validation") & (F.col(end) >= F.col("_t")))
    kept = held.filter(~F.coalesce(reaches, F.lit(False))).drop("_i", "_v", "_t")
    counts = {r["part"]: r["count"] for r in kept.groupBy("part").count().collect()}
    if any(counts.get(p, 0) < m for p, m in zip(("train", "validation", "test"), least)):
        raise ValueError(f"too few rows in a part: {counts}")
    return kept


def scaling(train: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, mean, deviation (population, 1 where under 1e-8) of the training rows alone."""
    stats = train.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m_{i}").alias("mean"), F.when(F.col(f"s_{i}") < 1e-8, 1.0).otherwise(F.col(f"s_{i}")).alias("deviation")) for i, c in enumerate(columns)))
    return stats.select(F.explode(rows).alias("x")).select("x.*")


def guard_columns(columns: list[str]) -> list[str]:
    """The columns, if none of them tells the future."""
    told = [c for c in columns if c.startswith("target_") or c in ("label", "future_return", "date")]
    if told:
        raise ValueError(f"not features: {', '.join(told)}")
    return columns
