"""Weeks, months, calendars, and the three as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a calendar, price or trend table is broadcast; beyond it the same join runs on day keys without broadcast.
SMALL_ROWS = 200_000


def week_ending_sunday(day: Column) -> Column:
    return F.date_add(day, 6 - F.weekday(day))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def next_month(day: Column) -> Column:
    """When a month's value is known: the first of the next month."""
    return F.to_date(F.add_months(F.trunc(day, "MM"), 1))


def strict_date(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))


def weekday_calendar(spark: SparkSession, start: str = "2020-01-01", end: str = "2035-12-31") -> DataFrame:
    """Monday to Friday."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return days.filter(F.weekday("date") < 5)


def checked_calendar(calendar: DataFrame) -> DataFrame:
    """The calendar, if it isn't empty, has each date once and no weekend; else an error."""
    n, distinct, weekend = calendar.agg(F.count("date"), F.count_distinct("date"), F.count_if(F.weekday("date") >= 5)).first()
    if not n or n != distinct or weekend:
        raise ValueError(f"a calendar needs dates, each once and none on a weekend: {n} dates, {distinct} distinct, {weekend} on weekends")
    return calendar


def checked_prices(prices: DataFrame) -> DataFrame:
    """The prices of (date, close), if there are any, each date is there once, and each close is finite and above 0; else an error."""
    bad = F.col("close").isNull() | F.isnan("close") | (F.col("close") <= 0) | (F.col("close") == float("inf")) | F.col("date").isNull()
    n, distinct, wrong = prices.agg(F.count("*"), F.count_distinct("date"), F.count_if(bad)).first()
    if not n or n != distinct or wrong:
        raise ValueError(f"prices need dates, each once, and closes above 0: {n} rows, {distinct} dates, {wrong} bad")
    return prices


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast only where the size is checked."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def as_of_latest(left: DataFrame, day: str, right: DataFrame, known: str, by: list[str], values: list[str]) -> DataFrame:
    """Backward as-of join: to each left row the right row of the same `by` last known at its day; nulls where none is.

    Right rows become intervals up to the next one, so the join is on days, not on all pairs: intervals of a right side
    within SMALL_ROWS are broadcast, a larger one is spelled out by month and joined on the key and month.
    """
    spans = right.select(*by, F.col(known).alias("_from"), *values)
    spans = spans.withColumn("_to", F.lead("_from").over(Window.partitionBy(*by).orderBy("_from")))
    small = spans.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    inside = (F.col(day) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(day) < F.col("_to")))
    if small:
        b = F.broadcast(spans.select(*(F.col(c).alias(f"_r_{c}") for c in by), "_from", "_to", *values))
        on = inside
        for c in by:
            on = on & (F.col(c) == F.col(f"_r_{c}"))
        return left.join(b, on, "left").drop("_from", "_to", *(f"_r_{c}" for c in by))
    last = left.agg(F.max(day)).first()[0]
    months = spans.withColumn("_month", F.explode(F.sequence(F.trunc("_from", "MM"), F.trunc(F.greatest(F.coalesce("_to", F.lit(last)), F.col("_from")), "MM"), F.expr("interval 1 month"))))
    b = months.select(*(F.col(c).alias(f"_r_{c}") for c in by), "_month", "_from", "_to", *values)
    on = (F.trunc(day, "MM") == F.col("_month")) & inside
    for c in by:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(b, on, "left").drop("_from", "_to", "_month", *(f"_r_{c}" for c in by))


def next_calendar_day(left: DataFrame, day: str, calendar: DataFrame, name: str) -> DataFrame:
    """Forward-inclusive as-of join: the first calendar date at or after `day`; before the first date it is the first, after the last null.

    The calendar is expanded to a table of every day, so that the join is an equality.
    """
    order = Window.orderBy("date")  # a calendar of one row a day
    steps = calendar.select("date", F.lag("date").over(order).alias("_before"))
    days = steps.filter("_before IS NOT NULL").select(F.explode(F.sequence(F.date_add("_before", 1), F.col("date"))).alias("_day"), F.col("date").alias(name))
    first = calendar.agg(F.min("date").alias("_first"))
    days = days.unionByName(first.select(F.col("_first").alias("_day"), F.col("_first").alias(name)))
    out = left.join(_sized(days), F.col(day) == F.col("_day"), "left").crossJoin(F.broadcast(first))
    return out.withColumn(name, F.when(F.col(day) < F.col("_first"), F.col("_first")).otherwise(F.col(name))).drop("_day", "_first")


def market_day(time: Column, zone: str = "America/New_York", close_hour: int = 16) -> Column:
    """The local date of an instant, or the next from the market's close on."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(time, F.current_timezone()), zone)
    return F.date_add(F.to_date(local), F.when(F.hour(local) >= close_hour, 1).otherwise(0))


def forward_returns(left: DataFrame, day: str, prices: DataFrame, horizon: int = 5, most_gap: int = 7) -> DataFrame:
    """Forward-exclusive as-of join with a row offset: entry on the first price day after `day`, exit `horizon` price days later.

    Adds target_start, target_end, target_start_close, target_end_close, future_return and label (1 if the exit is higher);
    all null where there is no exit, or the entry is more than `most_gap` days away. Prices are date and close, one row a day.
    """
    order = Window.orderBy("date")
    spans = prices.select(
        F.lag("date").over(order).alias("_before"), F.col("date").alias("_entry"), F.col("close").alias("_entry_close"),
        F.lead("date", horizon).over(order).alias("_exit"), F.lead("close", horizon).over(order).alias("_exit_close"),
    )
    days = spans.withColumn("_day", F.explode(F.sequence(F.coalesce("_before", F.date_sub("_entry", most_gap)), F.date_sub("_entry", 1))))
    held = left.join(_sized(days), F.col(day) == F.col("_day"), "left")
    usable = F.col("_exit").isNotNull() & (F.datediff("_entry", F.col(day)) <= most_gap)
    pick = lambda c: F.when(usable, F.col(c))
    out = held.select(
        *left.columns, pick("_entry").alias("target_start"), pick("_exit").alias("target_end"), pick("_entry_close").alias("target_start_close"), pick("_exit_close").alias("target_end_close")
    )
    return out.withColumn("future_return", F.col("target_end_close") / F.col("target_start_close") - 1).withColumn(
        "label", F.when(F.col("target_end_close").isNotNull(), (F.col("target_end_close") > F.col("target_start_close")).cast("int"))
    )
