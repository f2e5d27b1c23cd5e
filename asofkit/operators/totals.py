"""Running totals over groups of any size, in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], order: Column, amount: Column, buckets: int = 1024, name: str = "before") -> DataFrame:
    """df with `name`: the sum of `amount` over the group's rows earlier in `order` (a non-null long, a hash; ties by all columns).

    A group is divided by the value of `order` into `buckets` ranges, whose sums are totalled first, so that no task needs
    a whole group. Null amounts count 0.
    """
    width = 2.0**64 / buckets
    held = df.withColumn("_order", order).withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0)))
    held = held.withColumn("_bucket", F.least(F.floor((F.col("_order").cast("double") + 2.0**63) / width), F.lit(buckets - 1)).cast("int"))
    sums = held.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_bucket").orderBy("_order", *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(bases, [*group, "_bucket"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return out.select(*df.columns, name)
