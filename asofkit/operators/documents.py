"""Preparation of raw records as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.functions.ids import json_list_id
from asofkit.functions.times import strict_date

COLUMNS = ("document_id", "source_type", "date", "available_date", "date_status", "title", "url", "text", "text_origin", "quality_flags", "preparation_error")


def prepared(raw: DataFrame, ticker: str, start: str, end: str, overrides: DataFrame | None = None, *, title_only: bool = True, allow_incomplete: bool = False, allow_unverified: bool = False) -> DataFrame:
    """Documents from records of (source_type, date, title, url, content): range filter, distinct rows, id, date status, flags and errors.

    `overrides` has document_id (once each), available_date and evidence, which must not be blank. Nulls count as empty.
    Flags are joined by `;`, errors by `; `; no row is dropped for an error.
    """
    filled = raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("source_type", "date", "title", "url", "content")))
    rows = filled.filter(strict_date(F.col("date")).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).distinct()
    rows = rows.withColumn("document_id", json_list_id(F.lit(ticker), F.col("source_type"), F.col("date"), F.col("url"), F.col("title"), F.col("content")))
    if overrides is None:
        rows = rows.withColumn("_day", F.lit(None).cast("string")).withColumn("_why", F.lit(None).cast("string"))
    else:
        if overrides.groupBy("document_id").count().filter("count > 1").limit(1).count():
            raise ValueError("overrides name a document twice")
        o = overrides.select("document_id", F.col("available_date").alias("_day"), F.coalesce("evidence", F.lit("")).alias("_why"))
        rows = rows.join(o, "document_id", "left")
    body = F.trim("content")
    news = F.col("source_type") == "news"
    unverified = (F.col("source_type") == "earnings_call") & F.col("title").contains("CFO Commentary")
    baseless = F.raise_error(F.lit("an override needs evidence")).cast("string")
    status = F.when(F.col("_day").isNotNull(), F.when(F.trim("_why") == "", baseless).otherwise("reviewed_override")).when(unverified, "unverified").otherwise("source_date")
    only_title = (body == "") & news & F.lit(title_only)
    bodiless = (body == "") & ~only_title
    unsound = (body != "") & ~news & ((F.length(body) == 20000) | body.contains("us-gaap:") | body.contains("xbrli:"))
    flags = F.concat_ws(";", F.when(unverified, "cfo_commentary_publication_date_unverified"), F.when(only_title, "title_only"), F.when(unsound, "possibly_truncated_or_xbrl_contaminated"))
    errors = F.concat_ws(
        "; ",
        F.when((status == "unverified") & F.lit(not allow_unverified), "Publication date needs review."),
        F.when(bodiless, "No body."),
        F.when(unsound & F.lit(not allow_incomplete), "Supplied body needs replacement."),
    )
    return rows.select(
        "document_id", "source_type", "date", F.coalesce("_day", "date").alias("available_date"), status.alias("date_status"), "title", "url", F.when(only_title, F.col("title")).otherwise(body).alias("text"),
        F.when(only_title, "title_only").otherwise("supplied_body").alias("text_origin"), flags.alias("quality_flags"), errors.alias("preparation_error"),
    )


def preparation_summary(documents: DataFrame) -> DataFrame:
    """Per source_type: rows, ready, failed."""
    ready = F.coalesce("preparation_error", F.lit("")) == ""
    return documents.groupBy("source_type").agg(F.count("*").alias("rows_total"), F.count_if(ready).alias("ready"), F.count_if(~ready).alias("failed"))
