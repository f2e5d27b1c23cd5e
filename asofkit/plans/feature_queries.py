"""Queries on features: weekly and daily tables, as-of joins, calendars, labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.text import split_of_year
from asofkit.functions.times import as_of_latest, checked_calendar, checked_prices, forward_returns, market_day, next_calendar_day, week_ending_sunday, weekday_calendar
from asofkit.operators import clusters, dedup, features
from asofkit.plans.common import END, NEWS_SQL, SCORED_SQL, START, news, scored_documents, text_time
from asofkit.session import table

#: The star tables' dates are moved by so many months to overlap the documents'.
SHIFT_MONTHS = 336


def _texts(df: DataFrame) -> DataFrame:
    """Dates as text, doubles to six decimals, so that engines agree on them."""
    return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _trends(spark: SparkSession, folder: str) -> DataFrame:
    month = F.trunc(F.add_months(F.to_date("o_orderdate"), SHIFT_MONTHS), "MM")
    found = table(spark, folder, "orders").groupBy(month.alias("date"), F.col("o_orderpriority").alias("keyword")).agg(F.count("*").cast("double").alias("value"))
    last = found.groupBy("keyword").agg(F.max("date").alias("last"))  # each keyword's last month isn't over
    return found.join(last, "keyword").withColumn("is_partial", F.when(F.col("date") == F.col("last"), "True").otherwise("False")).drop("last")


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    day = F.add_months(F.to_date("l_shipdate"), SHIFT_MONTHS)
    # In whole cents, so that every engine agrees.
    sums = table(spark, folder, "lineitem").groupBy(day.alias("date")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    return sums.select("date", (F.expr("cents div n") / 100).alias("close")).filter("date IS NOT NULL AND close > 0")


def weekly_features(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(features.source_features(scored_documents(spark, folder), START, END))


def daily_features(spark: SparkSession, folder: str) -> DataFrame:
    """The daily table of all sources over the whole time, as weekly_features."""
    return _texts(features.source_features(scored_documents(spark, folder), START, END, weekly=False))


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    weeks = features.period_grid(START, END, True, spark)
    return weeks.crossJoin(F.broadcast(spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-NOT SPECIFIED",), ("5-LOW",)], "keyword string")))


def trend_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The last known monthly value of each keyword at each Sunday, 0 and missing 1 where none is known."""
    known = features.known_months(_trends(spark, folder))
    out = as_of_latest(_keywords(spark, folder), "date", known, "known_from", ["keyword"], ["value"])
    return _texts(out.select("date", "keyword", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNull().cast("int").alias("missing")))


def future_label(spark: SparkSession, folder: str) -> DataFrame:
    weeks = features.period_grid(START, END, True, spark)
    return _texts(forward_returns(weeks, "date", checked_prices(_prices(spark, folder))))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly features of scored documents, with the monthly trend known at each week and the label of the five price days after it."""
    weekly = features.source_features(scored_documents(spark, folder), START, END)
    known = features.known_months(_trends(spark, folder)).filter("keyword = '1-URGENT'").drop("keyword")
    with_trend = as_of_latest(weekly.withColumn("k", F.lit(1)), "date", known.withColumn("k", F.lit(1)), "known_from", ["k"], ["value"]).drop("k")
    with_trend = with_trend.withColumn("trend_missing", F.col("value").isNull().cast("int")).withColumn("trend", F.coalesce("value", F.lit(0.0))).drop("value")
    return _texts(forward_returns(with_trend, "date", _prices(spark, folder)))


def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    labelled = forward_returns(features.period_grid(START, END, True, spark), "date", _prices(spark, folder)).filter("label IS NOT NULL")
    return features.temporal_split(labelled, "date", "target_end").select(F.col("date").cast("string").alias("date"), "label", "part")


def scaling(spark: SparkSession, folder: str) -> DataFrame:
    weekly = features.source_features(scored_documents(spark, folder), START, END)
    labelled = forward_returns(weekly, "date", _prices(spark, folder)).filter("label IS NOT NULL")
    train = features.temporal_split(labelled, "date", "target_end").filter("part = 'train'")
    return _texts(features.scaling(train, features.guard_columns(["news_document_count", "news_sentiment_mean", "ten_k_document_count", "earnings_call_positive_ratio"])))


def lookback_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The last eight weeks' news counts of each week, as one number each."""
    weekly = features.source_features(scored_documents(spark, folder), START, END)
    out = features.lookback_windows(weekly, "date", ["news_document_count"], 8)
    total = F.aggregate(F.transform("window", lambda x: x["news_document_count"]), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.select(F.col("date").cast("string").alias("date"), total.alias("documents_8_weeks"), F.col("window")[0]["news_document_count"].alias("first_week"))


def trading_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Headlines by trading date: New York's day, from 16:00 on the next, then the next weekday."""
    rows = news(spark, folder).filter("ts IS NOT NULL").withColumn("day", market_day(F.col("ts")))
    out = next_calendar_day(rows, "day", checked_calendar(weekday_calendar(spark)), "trading_date")
    return out.select("row_ix", F.col("trading_date").cast("string").alias("trading_date"))


def asof_dissemination(spark: SparkSession, folder: str) -> DataFrame:
    out = clusters.as_of_counts(news(spark, folder), "cluster", "ts", "domain", until="2025-12-31")
    return _texts(out.select("row_ix", "size_asof", "domains_asof", "span_hours_asof"))


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    rows = clusters.as_of_counts(news(spark, folder), "cluster", "ts", "domain").filter("ts IS NOT NULL").withColumn("day", market_day(F.col("ts")))
    return next_calendar_day(rows, "day", weekday_calendar(spark), "effective_trading_date")


def daily_dissemination(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(features.daily_dissemination(_aligned(spark, folder)))


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_documents(spark, folder).withColumnRenamed("available_date", "effective_trading_date")
    return _texts(features.daily_sentiment(rows))


def sentiment_with_dissemination(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sentiment joined one to one with the day's dissemination."""
    rows = scored_documents(spark, folder).withColumnRenamed("available_date", "effective_trading_date")
    days = features.daily_sentiment(rows).select("effective_trading_date", "item_count", "has_data")
    return _texts(features.one_to_one(days, features.daily_dissemination(_aligned(spark, folder)), "effective_trading_date"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = _aligned(spark, folder).withColumnRenamed("effective_trading_date", "trading_date").filter("cluster IS NOT NULL")
    out = features.snapshots(rows)
    return _texts(out.select("cluster", "trading_date", "cluster_size", "domain_count", "span_hours", "first_row", text_time("published_at").alias("published_at")))


def snapshot_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, clusters and snapshots, and the means and largest of the snapshots."""
    rows = _aligned(spark, folder).withColumnRenamed("effective_trading_date", "trading_date").filter("cluster IS NOT NULL")
    d = features.snapshots(rows)
    return d.agg(
        F.sum("cluster_size").alias("rows_total"), F.count_distinct("cluster").alias("clusters"), F.count("*").alias("snapshots"), F.round(F.avg("cluster_size"), 6).alias("mean_size"), F.max("cluster_size").alias("largest"), F.max("domain_count").alias("most_domains")
    )


def row_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The four row sets: all headlines (A), those retained (B), their clusters (C), and the snapshots of clusters by trading date (D), with D's means and largest."""
    marks = dedup.with_retained(table(spark, folder, "cluster_news_titles").select("row_ix", "exact_duplicate", "duplicate_of_row_id", "original_row_id"))
    kept = marks.filter("retained_in_b").select("row_ix")
    counts = marks.agg(F.count("*").alias("rows_a"), F.count_if("retained_in_b").alias("rows_b"))
    clusters_ = news(spark, folder, times=False).join(kept.hint("merge"), "row_ix", "left_semi").agg(F.count_distinct("cluster").alias("rows_c"))
    aligned = _aligned(spark, folder).withColumnRenamed("effective_trading_date", "trading_date").filter("cluster IS NOT NULL AND trading_date IS NOT NULL")
    d = features.snapshots(aligned.join(kept.hint("merge"), "row_ix", "left_semi"))
    named = (("cluster_size", "cluster_size"), ("domain_count", "domain_count"), ("span_hours", "dissemination_span"))
    told = d.agg(F.count("*").alias("rows_d"), *(f(c).alias(f"{n}_{k}") for c, n in named for f, k in ((F.avg, "mean"), (F.max, "max"))))
    one = counts.crossJoin(clusters_).crossJoin(told)  # one row each
    return one.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes))


def weekly_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_documents(spark, folder).select(F.col("available_date").alias("date"), "label", F.col("score").cast("decimal(18,6)").alias("score"), F.abs("score").cast("decimal(18,6)").alias("confidence"))
    out = features.weekly_text(rows)
    return out.select(F.col("week_start").cast("string").alias("week_start"), F.col("week_end").cast("string").alias("week_end"), "item_count", "negative_count", "neutral_count", "positive_count", F.round(F.col("score_sum").cast("double"), 4).alias("score_sum"))


def daily_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_documents(spark, folder).select(F.col("available_date").alias("date"), "label", F.col("score").cast("string").alias("score"))
    return features.daily_text(rows).select(F.col("date").cast("string").alias("date"), "item_count", "negative_count", "neutral_count", "positive_count", F.round("score_sum", 3).alias("score_sum"))


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Headlines by the split of their year, and by the Sunday their week ends on in the last of these splits."""
    rows = news(spark, folder).filter("ts IS NOT NULL")
    return rows.groupBy(split_of_year(F.year("ts")).alias("split"), F.year(week_ending_sunday(F.to_date("ts"))).alias("week_year")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, weekly_features, daily_features, trend_asof, future_label, temporal_split, scaling, lookback_windows, trading_dates, asof_dissemination, daily_dissemination, daily_sentiment,
        sentiment_with_dissemination, snapshots, snapshot_summary, row_sets, weekly_text, daily_text, split_counts,
    )
}

_VALID = "label IN ('negative', 'neutral', 'positive') AND trim(coalesce(error, '')) = ''"


def _weekly_sql(bucket: str, start: str, end: str, sources: tuple[str, ...], weekly: bool) -> str:
    out = []
    for s in sources:
        own, ok = f"coalesce(source_type = '{s}', false)", f"coalesce(source_type = '{s}' AND {_VALID}, false)"
        out += [f"count(*) FILTER ({own}) AS {s}_document_count", f"count(*) FILTER ({own} AND NOT {ok}) AS {s}_error_count", f"CASE WHEN count(*) FILTER ({ok}) > 0 THEN 0 ELSE 1 END AS {s}_missing", f"round(coalesce(avg(score) FILTER ({ok}), 0), 6) AS {s}_sentiment_mean"]
        for x in ("negative", "neutral", "positive"):
            k = f"count(*) FILTER ({ok} AND label = '{x}')"
            out += [f"{k} AS {s}_{x}_count", f"round(coalesce({k} / nullif(count(*) FILTER ({ok}), 0), 0), 6) AS {s}_{x}_ratio"]
    names = [x.rpartition(" AS ")[2] for x in out]
    grid = f"SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) t(d)" + (" WHERE dayofweek(d) = 0" if weekly else "")
    return f"""{SCORED_SQL}, found AS (SELECT {bucket} AS date, {", ".join(out)} FROM scored WHERE available_date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY 1),
        grid AS ({grid}), weekly AS (SELECT grid.date, {", ".join(f"coalesce({n}, {1 if n.endswith('_missing') else 0}) AS {n}" for n in names)} FROM grid LEFT JOIN found ON grid.date = found.date)"""


_SUNDAY = "available_date + CAST((7 - isodow(available_date)) AS INTEGER)"
_WEEKLY = _weekly_sql(_SUNDAY, START, END, features.SOURCES, True)
_SHIFTED = "CAST(CAST({0} AS DATE) + INTERVAL 28 YEAR AS DATE)"
_TRENDS = f"""all_months AS (SELECT CAST(date_trunc('month', {_SHIFTED.format("o_orderdate")}) AS DATE) AS date, o_orderpriority AS keyword, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL),
    months AS (SELECT * FROM all_months a WHERE date < (SELECT max(date) FROM all_months b WHERE b.keyword = a.keyword)),
    known AS (SELECT keyword, CAST(date + INTERVAL 1 MONTH AS DATE) AS known_from, value, lead(CAST(date + INTERVAL 1 MONTH AS DATE)) OVER (PARTITION BY keyword ORDER BY date) AS until FROM months)"""
_PRICES = f"""prices AS (SELECT {_SHIFTED.format("l_shipdate")} AS date, (CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) // count(*)) / 100 AS close FROM lineitem GROUP BY 1),
    spans AS (SELECT lag(date) OVER o AS before, date AS entry, close AS entry_close, lead(date, 5) OVER o AS exit, lead(close, 5) OVER o AS exit_close FROM prices WHERE close > 0 WINDOW o AS (ORDER BY date))"""
_SUNDAYS = f"sundays AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) = 0)"
_LABEL = """CASE WHEN u THEN CAST(entry AS VARCHAR) END AS target_start, CASE WHEN u THEN CAST(exit AS VARCHAR) END AS target_end, CASE WHEN u THEN round(entry_close, 6) END AS target_start_close,
    CASE WHEN u THEN round(exit_close, 6) END AS target_end_close, CASE WHEN u THEN round(exit_close / entry_close - 1, 6) END AS future_return, CASE WHEN u THEN CAST(exit_close > entry_close AS INTEGER) END AS label"""
_FORWARD = """SELECT w.*, s.*, coalesce(s.exit IS NOT NULL AND s.entry - w.date <= 7, false) AS u FROM {0} w LEFT JOIN spans s ON w.date < s.entry AND (w.date >= s.before OR (s.before IS NULL AND w.date >= s.entry - 7))"""
_LABELLED = f"""WITH {_PRICES}, {_SUNDAYS}, f AS ({_FORWARD.format("sundays")}), l AS (SELECT date, exit, CAST(exit_close > entry_close AS INTEGER) AS label, row_number() OVER (ORDER BY date) - 1 AS i,
    count(*) OVER () AS n FROM f WHERE u), p AS (SELECT *, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS part FROM l),
    c AS (SELECT min(date) FILTER (part = 'validation') AS v, min(date) FILTER (part = 'test') AS t FROM p),
    k AS (SELECT p.* FROM p, c WHERE NOT ((part = 'train' AND exit >= v) OR (part = 'validation' AND exit >= t)))"""
_MARKET = """local AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM news WHERE ts IS NOT NULL),
    day AS (SELECT *, CAST(l AS DATE) + CASE WHEN hour(l) >= 16 THEN 1 ELSE 0 END AS d FROM local),
    aligned AS (SELECT *, CASE WHEN greatest(d, DATE '2020-01-01') > DATE '2035-12-31' THEN NULL ELSE greatest(d, DATE '2020-01-01') + CASE isodow(greatest(d, DATE '2020-01-01')) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END END AS trading_date FROM day)"""
_ASOF = """seen AS (SELECT row_ix, (SELECT count(*) FROM known k WHERE k.cluster IS NOT DISTINCT FROM a.cluster AND k.ts <= a.ts) AS size_asof,
    (SELECT count(DISTINCT nullif(trim(k.domain), '')) FROM known k WHERE k.cluster IS NOT DISTINCT FROM a.cluster AND k.ts <= a.ts) AS domains_asof,
    (SELECT (epoch(a.ts) - epoch(min(k.ts))) / 3600 FROM known k WHERE k.cluster IS NOT DISTINCT FROM a.cluster AND k.ts <= a.ts) AS span_hours_asof FROM known a)"""
_DISSEMINATION = f"""{NEWS_SQL}, {_MARKET}, known AS (SELECT * FROM news WHERE ts IS NOT NULL), {_ASOF},
    dissemination AS (SELECT trading_date AS effective_trading_date, CAST(sum(size_asof) AS BIGINT) AS cluster_size_sum, max(domains_asof) AS domains_max, round(max(span_hours_asof), 6) AS span_hours_max
        FROM aligned JOIN seen USING (row_ix) GROUP BY 1)"""
_DAILY = """SELECT CAST(available_date AS VARCHAR) AS effective_trading_date, count(*) AS item_count, count(*) FILTER (ok) AS valid_count, count(*) FILTER (NOT ok) AS failure_count,
    CASE WHEN count(*) FILTER (ok) > 0 THEN 1 ELSE 0 END AS has_data, round(avg(score) FILTER (ok), 6) AS sentiment_mean, round(sum(score) FILTER (ok), 6) AS sentiment_sum, round(stddev_pop(score) FILTER (ok), 6) AS sentiment_std,
    count(*) FILTER (ok AND l = 'negative') AS negative_count, round(count(*) FILTER (ok AND l = 'negative') / nullif(count(*) FILTER (ok), 0), 6) AS negative_ratio,
    count(*) FILTER (ok AND l = 'neutral') AS neutral_count, round(count(*) FILTER (ok AND l = 'neutral') / nullif(count(*) FILTER (ok), 0), 6) AS neutral_ratio,
    count(*) FILTER (ok AND l = 'positive') AS positive_count, round(count(*) FILTER (ok AND l = 'positive') / nullif(count(*) FILTER (ok), 0), 6) AS positive_ratio FROM s GROUP BY available_date"""
_S = f"{SCORED_SQL}, s AS (SELECT *, lower(trim(label)) AS l, coalesce(lower(trim(label)) IN ('negative', 'neutral', 'positive') AND trim(coalesce(error, '')) = '' AND score IS NOT NULL, false) AS ok FROM scored)"

ORACLES = {
    "weekly_features": f"WITH {_WEEKLY} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM weekly",
    "daily_features": f"WITH {_weekly_sql('available_date', START, END, features.SOURCES, False)} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM weekly",
    "trend_asof": f"""WITH {_TRENDS}, {_SUNDAYS}, words AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS keyword)
        SELECT CAST(s.date AS VARCHAR) AS date, w.keyword, coalesce(value, 0) AS value, CAST(value IS NULL AS INTEGER) AS missing FROM sundays s CROSS JOIN words w
        LEFT JOIN known k ON k.keyword = w.keyword AND s.date >= known_from AND (until IS NULL OR s.date < until)""",
    "future_label": f"WITH {_PRICES}, {_SUNDAYS}, f AS ({_FORWARD.format('sundays')}) SELECT CAST(date AS VARCHAR) AS date, {_LABEL} FROM f",
    "flagship": f"""WITH {_WEEKLY}, {_TRENDS}, {_PRICES}, t AS (SELECT w.*, CAST(value IS NULL AS INTEGER) AS trend_missing, coalesce(value, 0) AS trend FROM weekly w
        LEFT JOIN known k ON k.keyword = '1-URGENT' AND w.date >= known_from AND (until IS NULL OR w.date < until)), f AS ({_FORWARD.format("t")})
        SELECT * EXCLUDE (before, entry, entry_close, exit, exit_close, u) REPLACE (CAST(date AS VARCHAR) AS date), {_LABEL} FROM f""",
    "temporal_split": f"{_LABELLED} SELECT CAST(date AS VARCHAR) AS date, label, part FROM k",
    "scaling": f"""{_LABELLED.replace("WITH ", f"WITH {_WEEKLY}, ", 1)}, tr AS (SELECT w.* FROM k JOIN weekly w ON k.date = w.date WHERE part = 'train')"""
    + " UNION ALL ".join(
        f" SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-8 THEN 1 ELSE stddev_pop({c}) END, 6) AS deviation FROM tr"
        for c in ("news_document_count", "news_sentiment_mean", "ten_k_document_count", "earnings_call_positive_ratio")
    ),
    "lookback_windows": f"""WITH {_WEEKLY}, w AS (SELECT date, sum(news_document_count) OVER o AS s, first_value(news_document_count) OVER o AS f, count(*) OVER o AS n FROM weekly
        WINDOW o AS (ORDER BY date ROWS 7 PRECEDING)) SELECT CAST(date AS VARCHAR) AS date, CAST(s AS BIGINT) AS documents_8_weeks, f AS first_week FROM w WHERE n = 8""",
    "trading_dates": f"WITH {NEWS_SQL}, {_MARKET} SELECT row_ix, CAST(trading_date AS VARCHAR) AS trading_date FROM aligned",
    "asof_dissemination": f"""WITH {NEWS_SQL}, known AS (SELECT * FROM news WHERE ts < TIMESTAMP '2026-01-01'), {_ASOF}
        SELECT n.row_ix, coalesce(size_asof, 0) AS size_asof, coalesce(domains_asof, 0) AS domains_asof, round(coalesce(span_hours_asof, 0), 6) AS span_hours_asof FROM news n LEFT JOIN seen USING (row_ix)""",
    "daily_dissemination": f"WITH {_DISSEMINATION} SELECT * REPLACE (CAST(effective_trading_date AS VARCHAR) AS effective_trading_date) FROM dissemination",
    "daily_sentiment": f"WITH {_S} {_DAILY}",
    "sentiment_with_dissemination": f"""WITH {_DISSEMINATION}, {_S}, days AS ({_DAILY}) SELECT d.effective_trading_date, d.item_count, d.has_data, x.cluster_size_sum, x.domains_max, x.span_hours_max
        FROM days d LEFT JOIN dissemination x ON d.effective_trading_date IS NOT DISTINCT FROM CAST(x.effective_trading_date AS VARCHAR)""",
    "snapshots": f"""WITH {NEWS_SQL}, {_MARKET} SELECT cluster, CAST(trading_date AS VARCHAR) AS trading_date, count(*) AS cluster_size, count(DISTINCT trim(coalesce(domain, ''))) AS domain_count,
        round((epoch(max(ts)) - epoch(min(ts))) / 3600, 6) AS span_hours, arg_min(row_ix, (ts, row_ix)) AS first_row, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS published_at
        FROM aligned WHERE cluster IS NOT NULL GROUP BY cluster, trading_date""",
    "snapshot_summary": f"""WITH {NEWS_SQL}, {_MARKET}, d AS (SELECT cluster, count(*) AS n, count(DISTINCT trim(coalesce(domain, ''))) AS k FROM aligned WHERE cluster IS NOT NULL GROUP BY cluster, trading_date)
        SELECT CAST(sum(n) AS BIGINT) AS rows_total, count(DISTINCT cluster) AS clusters, count(*) AS snapshots, round(avg(n), 6) AS mean_size, max(n) AS largest, max(k) AS most_domains FROM d""",
    "row_sets": f"""WITH {NEWS_SQL}, {_MARKET}, kept AS (SELECT row_ix FROM cluster_news_titles WHERE NOT coalesce(exact_duplicate, false)),
        d AS (SELECT count(*) AS n, count(DISTINCT trim(coalesce(domain, ''))) AS k, (epoch(max(ts)) - epoch(min(ts))) / 3600 AS h FROM aligned JOIN kept USING (row_ix) WHERE cluster IS NOT NULL AND trading_date IS NOT NULL
            GROUP BY cluster, trading_date)
        SELECT (SELECT count(*) FROM news) AS rows_a, (SELECT count(*) FROM kept) AS rows_b, (SELECT count(DISTINCT cluster) FROM news JOIN kept USING (row_ix)) AS rows_c, count(*) AS rows_d,
            round(avg(n), 6) AS cluster_size_mean, max(n) AS cluster_size_max, round(avg(k), 6) AS domain_count_mean, max(k) AS domain_count_max, round(avg(h), 6) AS dissemination_span_mean, round(max(h), 6) AS dissemination_span_max FROM d""",
    "weekly_text": f"""WITH {SCORED_SQL} SELECT CAST(CAST(date_trunc('week', available_date) AS DATE) AS VARCHAR) AS week_start, CAST(CAST(date_trunc('week', available_date) AS DATE) + 6 AS VARCHAR) AS week_end,
        count(label) AS item_count, count(*) FILTER (label = 'negative') AS negative_count, count(*) FILTER (label = 'neutral') AS neutral_count, count(*) FILTER (label = 'positive') AS positive_count,
        round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE), 4) AS score_sum FROM scored WHERE available_date IS NOT NULL GROUP BY date_trunc('week', available_date)""",
    "daily_text": f"""WITH {SCORED_SQL} SELECT CAST(available_date AS VARCHAR) AS date, count(label) AS item_count, count(*) FILTER (label = 'negative') AS negative_count,
        count(*) FILTER (label = 'neutral') AS neutral_count, count(*) FILTER (label = 'positive') AS positive_count, round(sum(coalesce(score, 0)), 3) AS score_sum FROM scored
        WHERE available_date IS NOT NULL GROUP BY available_date""",
    "split_counts": f"""WITH {NEWS_SQL} SELECT CASE WHEN year(ts) BETWEEN 2020 AND 2023 THEN 'train' WHEN year(ts) = 2024 THEN 'validation' WHEN year(ts) BETWEEN 2025 AND 2026 THEN 'test' END AS split,
        year(CAST(ts AS DATE) + CAST(7 - isodow(ts) AS INTEGER)) AS week_year, count(*) AS n FROM news WHERE ts IS NOT NULL GROUP BY ALL""",
}
