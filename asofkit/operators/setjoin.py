"""Exact set-similarity self-joins by prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.session import cut


def similar_sets(df: DataFrame, key: str, items: str, threshold: float, near: Column | None = None, time: str | None = None, hours: float = 72) -> DataFrame:
    """Pairs key_a < key_b of rows whose item arrays have a Jaccard similarity of at least `threshold`, with `similarity`.

    Items are put in one order from rare to frequent; two sets that similar share one of their first n - ceil(t n) + 1
    items, so only those are joined, and each pair is verified on the whole sets. With `time`, only pairs within `hours` of
    it, inclusive, count, and windows of that width are part of the join's key. `near` is one more condition on columns
    `a` and `b`, structs of df's other columns, asked of pairs that are similar. Null keys, null and empty sets, and with
    `time` rows without it, are in no pair; equal sets must be one row.
    """
    rows = df.filter(F.col(key).isNotNull() & (F.size(items) > 0)).select(F.col(key).alias("k"), F.array_distinct(items).alias("s"), F.struct(*[c for c in df.columns if c not in (items,)]).alias("x"))
    if time:
        rows = rows.filter(F.col(f"x.{time}").isNotNull())
    rows = cut(rows)
    single = rows.select("k", F.size("s").alias("n"), F.explode("s").alias("i"))
    counts = single.groupBy("i").agg(F.count("*").alias("c"))
    placed = single.join(counts.hint("merge"), "i").withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("c", "i")))
    head = placed.filter((F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("c") > 1)).select("k", F.xxhash64("i").alias("i"))
    width = int(hours * 3600)
    at = F.unix_micros(F.col(f"x.{time}")) if time else F.lit(0).cast("long")
    full = head.join(rows.select("k", "s", at.alias("at")).hint("merge"), "k").withColumn("w", F.floor(F.col("at") / (width * 1_000_000)))
    a, b = (full.select("i", "w", F.col("k").alias(f"k_{s}"), F.col("s").alias(f"s_{s}"), F.col("at").alias(f"at_{s}")) for s in "ab")
    if time:
        a = a.withColumn("w", F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    pairs = a.join(b.hint("merge"), ["i", "w"]).filter("k_a < k_b").filter(F.least(F.size("s_a"), F.size("s_b")) >= F.greatest(F.size("s_a"), F.size("s_b")) * threshold - 1e-9)
    if time:
        pairs = pairs.filter(F.abs(F.col("at_a") - F.col("at_b")) <= width * 1_000_000)
    sim = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("s_a") + F.size("s_b") - F.col("shared")))
    found = sim.filter(F.col("similarity") >= threshold - 1e-9).select(F.col("k_a").alias("key_a"), F.col("k_b").alias("key_b"), "similarity").distinct()
    if near is not None:
        xa, xb = (rows.select(F.col("k").alias(f"key_{s}"), F.col("x").alias(s)).hint("merge") for s in "ab")
        found = found.join(xa, "key_a").join(xb, "key_b").filter(near).select("key_a", "key_b", "similarity")
    return found
