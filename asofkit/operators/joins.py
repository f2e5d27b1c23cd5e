"""Lookups that stay spread when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, held: DataFrame, key: str, most_hot: int = 1000, least_hot: int = 100_000, weight: str | None = None) -> DataFrame:
    """Left join of rows with a table that has each key once.

    A key of more than a `most_hot`th of the rows, and of `least_hot` rows, is hot; there are fewer than `most_hot` such keys, so their part of the
    table is broadcast, and the rest is joined by sorted shuffle, whatever the planner thinks of its size. Null keys find
    nothing; unmatched rows keep nulls. `weight` names a column of held with the number of rows of each key, where that is known.
    """
    total = rows.count()
    bound = max(total // most_hot, least_hot)
    names = [c for c in held.columns if c not in (key, weight)]
    if total > bound:
        if weight:
            hot = held.filter(F.col(weight) > bound).select(key)
        else:
            hot = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound).select(key)
        hot_keys = [r[0] for r in hot.collect()]  # fewer than most_hot
    else:
        hot_keys = []
    cold = held.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_cold_{c}") for c in names))
    if not hot_keys:
        asking = rows.filter(F.col(key).isNotNull())
        found = asking.join(cold.hint("merge"), F.col(key) == F.col("_key"), "left").select(*rows.columns, *(F.col(f"_cold_{c}").alias(c) for c in names))
        none = [F.lit(None).cast(t).alias(c) for c, t in held.dtypes if c in names]
        return found.unionAll(rows.filter(F.col(key).isNull()).select(*rows.columns, *none))
    spark = rows.sparkSession
    hot = spark.createDataFrame([(k,) for k in hot_keys], f"`{key}` {dict(held.dtypes)[key]}")
    hot_part = held.join(F.broadcast(hot), key, "left_semi").select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in names))
    marked = rows.join(F.broadcast(hot), key, "left_semi")
    answered = marked.join(F.broadcast(hot_part), F.col(key) == F.col("_hot"), "left").select(*rows.columns, *(F.col(f"_hot_{c}").alias(c) for c in names))
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    asking = rest.filter(F.col(key).isNotNull()).join(cold.hint("merge"), F.col(key) == F.col("_key"), "left").select(*rows.columns, *(F.col(f"_cold_{c}").alias(c) for c in names))
    none = [F.lit(None).cast(t).alias(c) for c, t in held.dtypes if c in names]
    return answered.unionAll(asking).unionAll(rest.filter(F.col(key).isNull()).select(*rows.columns, *none))
