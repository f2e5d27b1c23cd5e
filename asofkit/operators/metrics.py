"""Metrics of classifications and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole > 0, part / whole)


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """rows_total, accuracy, balanced_accuracy over the classes present, macro_f1, majority_accuracy; rows without label are left out, without prediction are wrong."""
    by = by or []
    held = rows.filter(F.col(label).isNotNull()).select(*by, F.col(label).alias("y"), F.col(predicted).alias("p"))
    hit = F.coalesce(F.col("y") == F.col("p"), F.lit(False))
    true = held.groupBy(*by, F.col("y").alias("c")).agg(F.count("*").alias("n"), F.count_if(hit).alias("tp"))
    told = held.filter("p IS NOT NULL").groupBy(*by, F.col("p").alias("c")).agg(F.count("*").alias("m"))
    joined = true.join(told, [*by, "c"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    f1 = F.col("tp") * 2 / (F.col("n") + F.col("m"))
    return joined.groupBy(*by).agg(
        F.sum("n").alias("rows_total"), (F.sum("tp") / F.sum("n")).alias("accuracy"), F.avg(F.col("tp") / F.col("n")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), (F.max("n") / F.sum("n")).alias("majority_accuracy")
    )


def run_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of rows with label, error, raw_output, seconds: success (no error, some output), failures, unparsed, label shares of the classified, mean of finite seconds from 0."""
    ok = (F.trim(F.coalesce("error", F.lit(""))) == "") & (F.trim(F.coalesce("raw_output", F.lit(""))) != "")
    done = ok & F.col("label").isin("negative", "neutral", "positive")
    n = F.count_if(done)
    seconds = F.when((F.col("seconds") >= 0) & ~F.isnan("seconds") & (F.col("seconds") < float("inf")), F.col("seconds"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows_total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.count_if(ok & ~F.coalesce(done, F.lit(False))).alias("unparsed"),
        *(rate(F.count_if(done & (F.col("label") == x)) * 100.0, n).alias(f"{x}_percent") for x in ("negative", "neutral", "positive")), F.avg(seconds).alias("mean_seconds"),
    )


def label_shares(rows: DataFrame, dimension: str, label: str, categories: list[tuple[str, str]] | None = None, least: int = 10, under: float = 0.1) -> DataFrame:
    """Per dimension and label: n, share, collapsed (the dimension has one label alone), imbalanced (a share under `under` among at least `least` rows). Named categories come with 0."""
    held = rows.filter(F.col(dimension).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(dimension).alias("dimension"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if categories:
        named = rows.sparkSession.createDataFrame(categories, "dimension string, label string")
        held = named.join(held, ["dimension", "label"], "full").select("dimension", "label", F.coalesce("n", F.lit(0)).alias("n"))
    sums = held.groupBy("dimension").agg(F.sum("n").alias("_all"), F.count_if(F.col("n") > 0).alias("_kinds"))
    share = rate(F.col("n"), F.col("_all"))
    return held.join(sums, "dimension").select("dimension", "label", "n", share.alias("share"), (F.col("_kinds") == 1).alias("collapsed"), F.coalesce((F.col("_all") >= least) & (share < under), F.lit(False)).alias("imbalanced"))


def repeat_consistency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key with several runs: runs, and whether all gave the same value; null is a value."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("\u0001"))
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), (F.min(v) == F.max(v)).alias("consistent")).filter("runs > 1")


def probe_summary(rows: DataFrame, dimension: str, expected: str, actual: str, margin: str | None = None) -> DataFrame:
    """Per dimension of probe rows: rows, valid answers, accuracy over rows with an expectation, distinct answers, collapse, mean margin."""
    known = F.col(expected).isNotNull()
    valid = F.col(actual).isNotNull()
    hit = F.coalesce(F.col(expected) == F.col(actual), F.lit(False))
    out = [
        F.count("*").alias("rows_total"), F.count_if(valid).alias("valid"), rate(F.count_if(valid), F.count("*")).alias("validity"), rate(F.count_if(known & hit), F.count_if(known)).alias("accuracy"),
        F.count_distinct(actual).alias("answers"), (F.count_distinct(actual) == 1).alias("collapsed"),
    ]
    if margin:
        out.append(F.avg(margin).alias("mean_margin"))
    return rows.groupBy(F.col(dimension).alias("dimension")).agg(*out)


def softmax(scores: Column) -> Column:
    """The softmax of an array of log-likelihoods, shifted by the largest; null for null or empty."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(scores) > 0, F.transform(exps, lambda x: x / total))


def top_margin(probabilities: Column) -> Column:
    """The largest less the second; null with fewer than two."""
    ordered = F.array_sort(probabilities)
    n = F.size(ordered)
    return F.when(n >= 2, F.element_at(ordered, -1) - F.try_element_at(ordered, F.when(n >= 2, F.lit(-2)).otherwise(F.lit(-1))))


def latest_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
