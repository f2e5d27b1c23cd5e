"""Queries on data quality: profiles, duplicates, conflicts, ids, validation and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.ids import with_stable_ids
from asofkit.functions.text import answered_label, one_label_only
from asofkit.operators import dedup, metrics, quality
from asofkit.operators.documents import preparation_summary, prepared
from asofkit.plans.common import NEWS_SQL, SCORED_SQL, news, scored_documents
from asofkit.plans.times import read_times
from asofkit.plans.timesql import headline_times
from asofkit.session import table

_COLUMNS = ["date", "title", "content", "summary", "url", "source", "speaker", "section", "quarter", "fiscal_year", "filing_date", "chunk_id"]


def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.column_profile(table(spark, folder, "inspect_text_datasets"), _COLUMNS)
    return out.select("column_name", "rows_total", "empty_cells", F.round("empty_ratio", 6).alias("empty_ratio"), "blank_cells", F.round("blank_ratio", 6).alias("blank_ratio"))


def profile_lengths(spark: SparkSession, folder: str) -> DataFrame:
    text = quality.analysis_text(F.col("title"), F.col("content"), F.col("summary"), F.col("source"))
    out = quality.length_profile(table(spark, folder, "inspect_text_datasets").withColumn("source", F.coalesce("source", F.lit(""))), F.length(text), ["source"])
    return out.select("source", "rows_total", "minimum", *(F.round(c, 6).alias(c) for c in ("median", "p90", "p95", "p99", "mean")), "maximum", "over_4000", "over_8000", "blank_rows")


def profile_dates(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.date_coverage(table(spark, folder, "inspect_text_datasets"), "date")
    return out.select("parsed", "unparsed", F.round("parse_ratio", 6).alias("parse_ratio"), F.col("earliest").cast("string").alias("earliest"), F.col("latest").cast("string").alias("latest"))


def observed_volumes(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.observed_volumes(read_times(spark, folder, "seendate"), F.to_date("ts"))
    return out.select("unit", F.col("period_start").cast("string").alias("period_start"), "rows_seen")


def ten_k_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "inspect_text_datasets").filter("source = 'ten_k'")
    return quality.item_mentions(rows, "content", "section")


def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "inspect_text_datasets").select(*_COLUMNS)
    return quality.duplicate_counts(rows, {"all_columns": _COLUMNS, "date+title+url": ["date", "title", "url"], "date+title": ["date", "title"]})


def titles_across_days(spark: SparkSession, folder: str) -> DataFrame:
    return quality.spread_keys(news(spark, folder), F.col("form"), F.col("day"))


def union_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in, rows out and months covered of overlapping copies of one table."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    parts = [orders.filter(F.col("o_orderstatus").isin("O", "F")), orders.filter(F.col("o_orderstatus").isin("F", "P"))]
    out = dedup.union_distinct(parts).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows_out"))
    before = parts[0].unionAll(parts[1]).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows_in"))
    return before.join(out, "month").select("month", "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("removed"))


def key_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that are shipped in different rows on one day."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_quantity").distinct()
    return dedup.conflicts(rows, ["l_orderkey", "l_shipdate"]).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


def stable_row_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pipeline_sentiment").select("row_ix", "document_id", "source_type", "available_date", "sentiment_label")
    return with_stable_ids(rows, ["document_id", "source_type", "available_date", "sentiment_label"], "row_ix").select("row_ix", "occurrence", "stable_id")


def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = news(spark, folder, times=False).select("row_ix", "cluster")
    return quality.with_group_size(rows, ["cluster"], "cluster_size")


def cluster_status(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by whether they are exact duplicates, alone, or of a cluster."""
    rows = quality.with_group_size(table(spark, folder, "cluster_news_titles").select("row_ix", "exact_duplicate", "preliminary_cluster_id"), ["preliminary_cluster_id"])
    status = F.when(F.col("exact_duplicate"), "exact_duplicate").when(F.col("group_size") == 1, "canonical_singleton").otherwise("canonical_clustered")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def duplicate_components(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_components(news(spark, folder, "title").drop("title", "domain", "cluster"))


def sequential_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.sequential_duplicates(news(spark, folder, "plain").drop("title", "domain", "cluster"))


def retained_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Which headlines are in row set B, why the others aren't, and which they repeat."""
    rows = table(spark, folder, "cluster_news_titles").select("row_ix", "original_row_id", "exact_duplicate", "duplicate_of_row_id")
    return dedup.with_retained(rows).select("row_ix", "retained_in_b", "duplicate_reason", "canonical_row_id")


def prepared_documents(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "inspect_text_datasets").withColumnRenamed("source", "source_type")
    return prepared(raw, "NVDA", "2021-01-01", "2025-12-31").select("source_type", "date", "title", "url", "available_date", "date_status", "text_origin", "quality_flags", "preparation_error", F.length("text").alias("characters"))


def preparation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return preparation_summary(table(spark, folder, "pipeline_documents"))


def quality_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged documents by flag; the flags are taken apart again."""
    rows = table(spark, folder, "pipeline_documents").select(F.explode(F.split(F.coalesce("quality_flags", F.lit("")), ";")).alias("flag"))
    return rows.filter("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def consolidation_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with problems: blank title, blank body, no address, unread date."""
    d = table(spark, folder, "pipeline_documents")
    flags = quality.flags(
        blank_title=quality.blank(F.col("title")), blank_text=quality.blank(F.col("text")), no_url=quality.blank(F.col("url")), unread_date=quality.strict_date(F.col("available_date")).isNull()
    )
    return d.select("row_ix", flags.alias("flags")).filter("flags <> ''")


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pipeline_sentiment").select("source_type", F.col("sentiment_label").alias("label"), F.col("fingpt_error").alias("error"), F.col("sentiment_label").alias("raw_output"), F.col("chunk_count").cast("double").alias("seconds"))
    out = metrics.run_summary(rows, ["source_type"])
    return out.select("source_type", "rows_total", "success", "failed", "unparsed", *(F.round(c, 6).alias(c) for c in ("negative_percent", "neutral_percent", "positive_percent", "mean_seconds")))


def label_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_documents(spark, folder).filter("label <> ''")
    out = metrics.label_shares(rows, "source_type", "label")
    return out.select("dimension", "label", "n", F.round("share", 6).alias("share"), "collapsed", "imbalanced")


def _told(spark: SparkSession, folder: str) -> DataFrame:
    """Labels against the sign of the score, a prediction of a kind."""
    sign = F.when(F.col("score") > 0.3, "positive").when(F.col("score") < -0.3, "negative").when(F.col("score").isNotNull(), "neutral")
    return scored_documents(spark, folder).filter("label IN ('negative', 'neutral', 'positive')").withColumn("predicted", sign)


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_told(spark, folder), "label", "predicted")


def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.class_metrics(_told(spark, folder), "label", "predicted", ["source_type"])
    return out.select("source_type", "rows_total", *(F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "majority_accuracy")))


def probe_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _told(spark, folder).withColumn("margin", F.abs("score"))
    out = metrics.probe_summary(rows, "source_type", "label", "predicted", "margin")
    return out.select("dimension", "rows_total", "valid", F.round("validity", 6).alias("validity"), F.round("accuracy", 6).alias("accuracy"), "answers", "collapsed", F.round("mean_margin", 6).alias("mean_margin"))


def repeat_consistency(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pipeline_sentiment").filter("document_id IS NOT NULL")
    return metrics.repeat_consistency(rows, ["document_id"], "sentiment_label")


def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read from answers in words."""
    rows = table(spark, folder, "pipeline_sentiment").withColumn("answer", F.concat(F.lit("The tone is mixed. ANSWER: "), F.upper(F.coalesce("sentiment_label", F.lit("")))))
    label = answered_label(F.col("answer"))
    return rows.select("row_ix", label.alias("parsed"), one_label_only(F.col("answer"), label).alias("unique_label"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    names = ("inspect_text_datasets", "pipeline_documents", "pipeline_sentiment", "cluster_news_titles", "select_news_pilot")
    out = quality.inventory({n: table(spark, folder, n) for n in names}, "text")
    return out.select("table_name", "rows_total", "columns_total", F.coalesce("missing_body", F.lit(0)).alias("missing_body"))


def first_seen_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pipeline_documents").filter("document_id IS NOT NULL").select("row_ix", "document_id")
    return quality.first_seen(rows, ["document_id"], "row_ix").filter("repeats").select("row_ix", "document_id", "first_position")


QUERIES = {
    f.__name__: f
    for f in (
        profile_columns, profile_lengths, profile_dates, observed_volumes, ten_k_items, duplicate_counts, titles_across_days, union_dedup, key_conflicts, stable_row_ids, group_sizes, cluster_status,
        duplicate_components, sequential_duplicates, retained_rows, prepared_documents, preparation_counts, quality_flag_counts, consolidation_flags, run_summary, label_shares, confusion, class_metrics, probe_summary,
        repeat_consistency, parsed_answers, first_seen_documents, inventory,
    )
}

_BLANK = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')) = ''"
_ITEM = """SELECT 'Item {0}' AS item, count(*) FILTER (t) AS content_rows, count(*) FILTER (l) AS label_rows, count(*) FILTER (t OR l) AS either_rows FROM (
    SELECT coalesce(regexp_matches(content, '(?i)\\bItem\\s+{0}([^A-Za-z0-9]|$)'), false) AS t,
           coalesce(regexp_matches(section, '(?i)\\bItem\\s+{0}([^A-Za-z0-9]|$)') OR upper(trim(section)) = '{0}', false) AS l FROM inspect_text_datasets WHERE source = 'ten_k')"""
_TOLD = f"""WITH {SCORED_SQL}, told AS (SELECT *, CASE WHEN score > 0.3 THEN 'positive' WHEN score < -0.3 THEN 'negative' WHEN score IS NOT NULL THEN 'neutral' END AS predicted
    FROM scored WHERE label IN ('negative', 'neutral', 'positive'))"""
_ALL = ", ".join(_COLUMNS)

ORACLES = {
    "profile_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS rows_total, count(*) FILTER (coalesce({c}, '') = '') AS empty_cells, round(count(*) FILTER (coalesce({c}, '') = '') / count(*), 6) AS empty_ratio,
            count(*) FILTER ({_BLANK.format(c)}) AS blank_cells, round(count(*) FILTER ({_BLANK.format(c)}) / count(*), 6) AS blank_ratio FROM inspect_text_datasets"""
        for c in _COLUMNS
    ),
    "profile_lengths": r"""WITH t AS (SELECT coalesce(source, '') AS source, trim(coalesce(title, ''), ' ') AS ti, trim(coalesce(content, ''), ' ') AS co, trim(coalesce(summary, ''), ' ') AS su FROM inspect_text_datasets),
        n AS (SELECT source, length(regexp_replace(ti || chr(10) || CASE WHEN source = 'news' AND co = '' THEN su ELSE co END, '^\s+|\s+$', '', 'g')) AS n FROM t)
        SELECT source, count(*) AS rows_total, min(n) AS minimum, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95,
            round(quantile_cont(n, 0.99), 6) AS p99, round(avg(n), 6) AS mean, max(n) AS maximum, count(*) FILTER (n > 4000) AS over_4000, count(*) FILTER (n > 8000) AS over_8000,
            count(*) FILTER (n = 0) AS blank_rows FROM n GROUP BY source""",
    "profile_dates": """WITH d AS (SELECT CASE WHEN regexp_full_match(trim(date), '\\d{4}-\\d\\d-\\d\\d') THEN CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE) END AS d FROM inspect_text_datasets)
        SELECT count(d) AS parsed, count(*) - count(d) AS unparsed, round(count(d) / count(*), 6) AS parse_ratio, CAST(min(d) AS VARCHAR) AS earliest, CAST(max(d) AS VARCHAR) AS latest FROM d""",
    "observed_volumes": f"""WITH {headline_times("seendate")}, d AS (SELECT CAST(ts AS DATE) AS d FROM seendate_times)
        SELECT 'day' AS unit, CAST(d AS VARCHAR) AS period_start, count(*) AS rows_seen FROM d WHERE d IS NOT NULL GROUP BY d
        UNION ALL SELECT 'week', CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR), count(*) FROM d WHERE d IS NOT NULL GROUP BY date_trunc('week', d)""",
    "ten_k_items": " UNION ALL ".join(_ITEM.format(i) for i in ("1", "1A", "7", "7A")),
    "duplicate_counts": f"""SELECT 'all_columns' AS key_name, (SELECT count(*) FROM inspect_text_datasets) - (SELECT count(*) FROM (SELECT DISTINCT {_ALL} FROM inspect_text_datasets)) AS extra_rows
        UNION ALL SELECT 'date+title+url', (SELECT count(*) FROM inspect_text_datasets) - (SELECT count(*) FROM (SELECT DISTINCT date, title, url FROM inspect_text_datasets))
        UNION ALL SELECT 'date+title', (SELECT count(*) FROM inspect_text_datasets) - (SELECT count(*) FROM (SELECT DISTINCT date, title FROM inspect_text_datasets))""",
    "titles_across_days": f"""WITH {NEWS_SQL}, g AS (SELECT form, count(DISTINCT CAST(ts AS DATE)) AS d, count(*) AS n FROM news WHERE ts IS NOT NULL AND form IS NOT NULL GROUP BY form)
        SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups FROM g WHERE d > 1""",
    "union_dedup": """WITH i AS (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') UNION ALL SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')),
        a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows_in FROM i GROUP BY 1),
        b AS (SELECT month, count(*) AS rows_out FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate FROM i) GROUP BY 1)
        SELECT a.month, rows_in, rows_out, rows_in - rows_out AS removed FROM a JOIN b ON a.month = b.month""",
    "key_conflicts": """SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, count(*) AS rows_of_key FROM (SELECT DISTINCT l_orderkey, l_shipdate, l_partkey, l_quantity FROM lineitem)
        GROUP BY l_orderkey, l_shipdate HAVING count(*) > 1""",
    "stable_row_ids": """WITH p AS (SELECT row_ix, '{"available_date":"' || coalesce(available_date, '') || '","document_id":"' || coalesce(document_id, '') || '","sentiment_label":"' || coalesce(sentiment_label, '')
            || '","source_type":"' || coalesce(source_type, '') || '"}' AS payload FROM pipeline_sentiment),
        o AS (SELECT row_ix, payload, row_number() OVER (PARTITION BY payload ORDER BY row_ix) AS occurrence FROM p)
        SELECT row_ix, occurrence, 'news_' || substr(sha256(payload || '#occurrence=' || occurrence), 1, 20) AS stable_id FROM o""",
    "group_sizes": f"WITH {NEWS_SQL} SELECT row_ix, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM news",
    "cluster_status": """SELECT status, count(*) AS n FROM (SELECT CASE WHEN exact_duplicate THEN 'exact_duplicate' WHEN count(*) OVER (PARTITION BY preliminary_cluster_id) = 1 THEN 'canonical_singleton'
        ELSE 'canonical_clustered' END AS status FROM cluster_news_titles) GROUP BY status""",
    "retained_rows": """SELECT row_ix, NOT coalesce(exact_duplicate, false) AS retained_in_b, CASE WHEN exact_duplicate THEN 'same-day-title-or-exact-repeat' ELSE '' END AS duplicate_reason,
        CASE WHEN exact_duplicate THEN coalesce(duplicate_of_row_id, '') ELSE original_row_id END AS canonical_row_id FROM cluster_news_titles""",
    "prepared_documents": """WITH f AS (SELECT DISTINCT coalesce(source, '') AS source_type, coalesce(date, '') AS date, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(content, '') AS content FROM inspect_text_datasets),
        r AS (SELECT *, trim(content, ' ') AS body FROM f WHERE regexp_full_match(trim(date), '\\d{4}-\\d\\d-\\d\\d') AND CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE) BETWEEN DATE '2021-01-01' AND DATE '2025-12-31'),
        c AS (SELECT *, source_type = 'earnings_call' AND contains(title, 'CFO Commentary') AS u, body = '' AND source_type = 'news' AS t, body = '' AND source_type <> 'news' AS b,
            body <> '' AND source_type <> 'news' AND (length(body) = 20000 OR contains(body, 'us-gaap:') OR contains(body, 'xbrli:')) AS x FROM r)
        SELECT source_type, date, title, url, date AS available_date, CASE WHEN u THEN 'unverified' ELSE 'source_date' END AS date_status, CASE WHEN t THEN 'title_only' ELSE 'supplied_body' END AS text_origin,
            concat_ws(';', CASE WHEN u THEN 'cfo_commentary_publication_date_unverified' END, CASE WHEN t THEN 'title_only' END, CASE WHEN x THEN 'possibly_truncated_or_xbrl_contaminated' END) AS quality_flags,
            concat_ws('; ', CASE WHEN u THEN 'Publication date needs review.' END, CASE WHEN b THEN 'No body.' END, CASE WHEN x THEN 'Supplied body needs replacement.' END) AS preparation_error,
            length(CASE WHEN t THEN title ELSE body END) AS characters FROM c""",
    "preparation_counts": """SELECT source_type, count(*) AS rows_total, count(*) FILTER (coalesce(preparation_error, '') = '') AS ready, count(*) FILTER (coalesce(preparation_error, '') <> '') AS failed
        FROM pipeline_documents GROUP BY source_type""",
    "quality_flag_counts": "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(coalesce(quality_flags, ''), ';')) AS flag FROM pipeline_documents) WHERE flag <> '' GROUP BY flag",
    "consolidation_flags": f"""SELECT * FROM (SELECT row_ix, concat_ws(';', CASE WHEN {_BLANK.format("title")} THEN 'blank_title' END, CASE WHEN {_BLANK.format("text")} THEN 'blank_text' END,
        CASE WHEN {_BLANK.format("url")} THEN 'no_url' END, CASE WHEN (CASE WHEN regexp_full_match(trim(available_date), '\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime(trim(available_date), '%Y-%m-%d') END) IS NULL
        THEN 'unread_date' END) AS flags FROM pipeline_documents) WHERE flags <> ''""",
    "run_summary": """WITH r AS (SELECT source_type, sentiment_label AS label, chunk_count, trim(coalesce(fingpt_error, '')) = '' AND trim(coalesce(sentiment_label, '')) <> '' AS ok FROM pipeline_sentiment),
        d AS (SELECT *, ok AND coalesce(label IN ('negative', 'neutral', 'positive'), false) AS done FROM r)
        SELECT source_type, count(*) AS rows_total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND NOT done) AS unparsed,
            round(100.0 * count(*) FILTER (done AND label = 'negative') / nullif(count(*) FILTER (done), 0), 6) AS negative_percent,
            round(100.0 * count(*) FILTER (done AND label = 'neutral') / nullif(count(*) FILTER (done), 0), 6) AS neutral_percent,
            round(100.0 * count(*) FILTER (done AND label = 'positive') / nullif(count(*) FILTER (done), 0), 6) AS positive_percent,
            round(avg(chunk_count) FILTER (chunk_count >= 0), 6) AS mean_seconds FROM d GROUP BY source_type""",
    "label_shares": f"""WITH {SCORED_SQL}, c AS (SELECT source_type AS dimension, label, count(*) AS n FROM scored WHERE label <> '' AND source_type IS NOT NULL GROUP BY ALL)
        SELECT dimension, label, n, round(n / sum(n) OVER w, 6) AS share, count(*) OVER w = 1 AS collapsed, sum(n) OVER w >= 10 AND n / sum(n) OVER w < 0.1 AS imbalanced FROM c WINDOW w AS (PARTITION BY dimension)""",
    "confusion": f"{_TOLD} SELECT label, predicted, count(*) AS n FROM told GROUP BY ALL",
    "class_metrics": f"""{_TOLD}, t AS (SELECT source_type, label AS c, count(*) AS n, count(*) FILTER (label = predicted) AS tp FROM told GROUP BY ALL),
        p AS (SELECT source_type, predicted AS c, count(*) AS m FROM told WHERE predicted IS NOT NULL GROUP BY ALL),
        j AS (SELECT t.*, coalesce(m, 0) AS m FROM t LEFT JOIN p ON t.source_type = p.source_type AND t.c = p.c)
        SELECT source_type, CAST(sum(n) AS BIGINT) AS rows_total, round(sum(tp) / sum(n), 6) AS accuracy, round(avg(tp / n), 6) AS balanced_accuracy, round(avg(2.0 * tp / (n + m)), 6) AS macro_f1,
            round(max(n) / sum(n), 6) AS majority_accuracy FROM j GROUP BY source_type""",
    "probe_summary": f"""{_TOLD} SELECT source_type AS dimension, count(*) AS rows_total, count(predicted) AS valid, round(count(predicted) / count(*), 6) AS validity,
        round(count(*) FILTER (label = predicted) / count(label), 6) AS accuracy, count(DISTINCT predicted) AS answers, count(DISTINCT predicted) = 1 AS collapsed, round(avg(abs(score)), 6) AS mean_margin
        FROM told GROUP BY source_type""",
    "repeat_consistency": """SELECT document_id, count(*) AS runs, min(coalesce(sentiment_label, chr(1))) = max(coalesce(sentiment_label, chr(1))) AS consistent FROM pipeline_sentiment WHERE document_id IS NOT NULL
        GROUP BY document_id HAVING count(*) > 1""",
    "parsed_answers": """WITH l AS (SELECT row_ix, lower(coalesce(sentiment_label, '')) AS l FROM pipeline_sentiment)
        SELECT row_ix, CASE WHEN l IN ('negative', 'neutral', 'positive') THEN l END AS parsed, l IN ('negative', 'neutral', 'positive') AS unique_label FROM l""",
    "first_seen_documents": """SELECT row_ix, document_id, first_position FROM (SELECT row_ix, document_id, min(row_ix) OVER (PARTITION BY document_id) AS first_position FROM pipeline_documents
        WHERE document_id IS NOT NULL) WHERE row_ix > first_position""",
    "inventory": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows_total, {k} AS columns_total, {f'count(*) FILTER ({_BLANK.format("text")})' if body else 'CAST(0 AS BIGINT)'} AS missing_body FROM {n}"
        for n, k, body in (("inspect_text_datasets", 13, False), ("pipeline_documents", 12, True), ("pipeline_sentiment", 10, True), ("cluster_news_titles", 14, False), ("select_news_pilot", 14, False))
    ),
}
