"""Problem 5: the three written times of the project's tables as UTC instants."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.operators.timestamps import host_of, normalize_timestamps
from asofkit.plans.timesql import FOUND_SQL, headline_times
from asofkit.session import table


def stacked_times(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the three fields with the outlet and its zone; outlets are those of `outlet_zones`, in any case."""
    titles, pages = table(spark, folder, "cluster_news_titles"), table(spark, folder, "pipeline_documents")
    news = titles.select(
        "row_ix", F.lower(F.trim("domain")).alias("outlet"),
        F.explode(F.array(*(F.struct(F.lit(f"cluster_news_titles|{c}").alias("stream"), F.col(c).alias("value")) for c in ("seendate", "published_at")))).alias("x"),
    ).select("row_ix", "outlet", "x.stream", "x.value")
    docs = pages.select("row_ix", host_of(F.col("url")).alias("outlet"), F.lit("pipeline_documents|date").alias("stream"), F.col("date").alias("value"))
    zones = table(spark, folder, "outlet_zones").groupBy(F.lower(F.trim("domain")).alias("outlet")).agg(F.min("zone_name").alias("zone"))
    return news.unionByName(docs).join(zones, "outlet", "left")


def read_times(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """row_ix and ts of each headline: the instant its written time names by the rules of problem 5, null where it names none.

    Without a table `outlet_zones` no outlet's zone is known.
    """
    titles = table(spark, folder, "cluster_news_titles").select("row_ix", F.lower(F.trim("domain")).alias("outlet"), F.col(field).alias("value"))
    try:
        zones = table(spark, folder, "outlet_zones").groupBy(F.lower(F.trim("domain")).alias("outlet")).agg(F.min("zone_name").alias("zone"))
        rows = titles.join(zones, "outlet", "left")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = titles.withColumn("zone", F.lit(None).cast("string"))
    out = normalize_timestamps(rows, F.col("value"), F.col("outlet"), F.col("row_ix"), F.col("zone"), F.lit(f"cluster_news_titles|{field}"))
    return out.select("row_ix", F.expr("try_cast(utc_at AS timestamp)").alias("ts"))


def unread_times(spark: SparkSession, folder: str) -> DataFrame:
    """By field of the headlines: rows, those without a time, those read, and those whose written time stays unreadable."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    parts = []
    for field in ("seendate", "published_at"):
        rows = table(spark, folder, "cluster_news_titles").select("row_ix", F.col(field).alias("value")).join(read_times(spark, folder, field), "row_ix")
        counts = F.count("*").alias("rows_total"), F.count_if(blank(F.col("value"))).alias("blank"), F.count("ts").alias("read"), F.count_if(~blank(F.col("value")) & F.col("ts").isNull()).alias("unread")
        parts.append(rows.agg(*counts).select(F.lit(field).alias("field_name"), "*"))
    return parts[0].unionAll(parts[1])


def _normalized(spark: SparkSession, folder: str, only_changed: bool) -> DataFrame:
    out = normalize_timestamps(
        stacked_times(spark, folder), F.col("value"), F.col("outlet"), F.col("row_ix"), F.col("zone"), F.col("stream"),
        dates_done=F.col("stream") == "pipeline_documents|date", only_changed=only_changed,
    )
    named = [F.split("stream", r"\|")[0].alias("source_table"), "row_ix", F.split("stream", r"\|")[1].alias("field_name")]
    return out.select(*named, "utc_at") if only_changed else out.select(*named, "value", "utc_at", "notation", "readings")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _normalized(spark, folder, True)


def p5_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the three fields with its instant, notation and number of valid readings."""
    return _normalized(spark, folder, False)


def p5_open_slashes(spark: SparkSession, folder: str) -> DataFrame:
    """How the Viterbi pass reads slashed dates when nobody says what comes first, by field: values with two readings, and those read with the month first, as they are written."""
    rows = stacked_times(spark, folder)
    out = normalize_timestamps(rows, F.col("value"), F.col("outlet"), F.col("row_ix"), F.col("zone"), F.col("stream"), slashes="both").filter("readings > 1")
    return out.groupBy(F.split("stream", r"\|")[1].alias("field_name")).agg(F.count("*").alias("open_values"), F.count_if(F.col("notation") == "mdy_slash").alias("month_first"))


QUERIES = {"p5_found": p5_found, "p5_normalized": p5_normalized, "p5_open_slashes": p5_open_slashes, "unread_times": unread_times}
ORACLES = {
    "p5_found": FOUND_SQL,
    "unread_times": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {headline_times(c)} SELECT '{c}' AS field_name, count(*) AS rows_total, count(*) FILTER (trim(coalesce(v, '')) = '') AS blank, count(ts) AS read,
            count(*) FILTER (trim(coalesce(v, '')) <> '' AND ts IS NULL) AS unread FROM {c}_times)"""
        for c in ("seendate", "published_at")
    ),
}
