"""Views of the project's tables that several queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.text import plain_title_form_udf, title_form_udf, tokens
from asofkit.functions.times import strict_date
from asofkit.plans.times import read_times
from asofkit.plans.timesql import headline_times
from asofkit.session import table

#: The sources as the feature tables name them.
START, END = "2020-01-01", "2026-12-31"


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """row_ix, document_id, available_date, source_type, label, score, error of each scored document; NaN scores are null."""
    return table(spark, folder, "pipeline_sentiment").select(
        "row_ix", "document_id", strict_date(F.col("available_date")).alias("available_date"), "source_type", F.col("sentiment_label").alias("label"),
        F.when(~F.isnan("sentiment_score"), F.col("sentiment_score")).alias("score"), F.col("fingpt_error").alias("error"), "text",
    )


def news(spark: SparkSession, folder: str, form: str = "lower", times: bool = True) -> DataFrame:
    """row_ix, ts, day, title, form, words, domain, url, cluster of each headline, with times of every notation; `row_ix` is the key of the table.

    Without `times` ts and day are left out. `form` is the title in lower case ("lower"), without its outlet and typographic differences ("title"), or with the outlet ("plain").
    """
    rows = table(spark, folder, "cluster_news_titles")
    if times:
        rows = rows.join(read_times(spark, folder, "published_at"), "row_ix", "left")
    source = F.col("source") if "source" in rows.columns else F.lit("")
    forms = {"lower": F.lower(F.trim("title")), "title": title_form_udf("title", "domain", source), "plain": plain_title_form_udf("title")}
    return rows.select(
        "row_ix", *(["ts", F.to_date("ts").alias("day")] if times else []), "title", forms[form].alias("form"), tokens(F.col("title")).alias("words"), "domain", F.coalesce("url", F.lit("")).alias("url"),
        F.lower(F.trim("preliminary_cluster_id")).alias("cluster"),
    )


def text_time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


DATE_SQL = "CASE WHEN regexp_full_match(trim({0}), '\\d{{4}}-\\d\\d-\\d\\d') THEN CAST(try_strptime(trim({0}), '%Y-%m-%d') AS DATE) END"
SCORED_SQL = f"""scored AS (SELECT row_ix, document_id, {DATE_SQL.format("available_date")} AS available_date, source_type, sentiment_label AS label,
    CASE WHEN NOT isnan(sentiment_score) THEN sentiment_score END AS score, fingpt_error AS error, text FROM pipeline_sentiment)"""
NEWS_SQL = f"""{headline_times("published_at")}, news AS MATERIALIZED (SELECT n.row_ix, t.ts, title, lower(trim(title)) AS form, domain, coalesce(url, '') AS url,
    lower(trim(preliminary_cluster_id)) AS cluster FROM cluster_news_titles n JOIN published_at_times t USING (row_ix))"""
