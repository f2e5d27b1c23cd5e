"""Unions, exact duplicates, conflicts, duplicate components and first-match deduplication."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.text import jaccard
from asofkit.operators.components import connected_components
from asofkit.session import cut

HOURS = 72


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """All different rows of tables with the same set of columns, in the first one's order."""
    first = parts[0].columns
    for p in parts[1:]:
        if set(p.columns) != set(first):
            raise ValueError(f"columns differ: {sorted(set(p.columns) ^ set(first))}")
    return reduce(DataFrame.unionAll, [p.select(*first) for p in parts]).distinct()


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that different rows share, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows_of_key")).filter("rows_of_key > 1")


def same_frame(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ties by all columns."""
    value = F.struct(*order, F.struct(*df.columns).alias("_row"))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(value).alias("_v")).select("_v._row.*")


def with_retained(rows: DataFrame, exact: str = "exact_duplicate", of: str = "duplicate_of_row_id", row_id: str = "original_row_id") -> DataFrame:
    """rows with retained_in_b, duplicate_reason and canonical_row_id: a row marked as an exact duplicate is left out of set B and stands for the row it repeats; a null mark is none."""
    marked = F.lower(F.coalesce(F.col(exact).cast("string"), F.lit(""))) == "true"
    # Fixed value: the reason as the manifests name it.
    reason = F.when(marked, "same-day-title-or-exact-repeat").otherwise("")
    return rows.select("*", (~marked).alias("retained_in_b"), reason.alias("duplicate_reason"), F.when(marked, F.coalesce(of, F.lit(""))).otherwise(F.col(row_id)).alias("canonical_row_id"))


def duplicate_edges(rows: DataFrame, threshold: float = 0.85, hours: float = HOURS) -> DataFrame:
    """Edges between records of (row_ix, url, form, words, ts, day) that are one article: the same non-blank url with the same
    form, or with a word similarity of `threshold` within `hours`; or the same form on the same UTC day.

    Equal forms are linked to the least record of their group instead of to each other, so copies give no square of edges.
    """
    stars = []
    for keys in (["url", "form"], ["day", "form"]):
        held = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]))
        least = held.groupBy(*keys).agg(F.min("row_ix").alias("a"), F.count("*").alias("n")).filter("n > 1")
        stars.append(held.join(least, keys).filter("row_ix > a").select("a", F.col("row_ix").alias("b")))
    # Different forms of one url: one record of each (url, form, time).
    forms = rows.filter("url <> '' AND form <> '' AND ts IS NOT NULL").groupBy("url", "form", "ts").agg(F.min("row_ix").alias("row_ix"), F.first("words").alias("words"))
    many = forms.groupBy("url").agg(F.count_distinct("form").alias("f")).filter("f > 1").select("url")
    held = forms.join(many, "url", "left_semi").withColumn("bucket", F.floor(F.unix_timestamp("ts") / int(hours * 3600)))
    x = held.select("url", *(F.col(c).alias(f"{c}_a") for c in ("row_ix", "form", "words", "ts")), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    y = held.select("url", "bucket", *(F.col(c).alias(f"{c}_b") for c in ("row_ix", "form", "words", "ts")))
    gap = F.abs(F.unix_timestamp("ts_a") - F.unix_timestamp("ts_b"))
    near = x.join(y, ["url", "bucket"]).filter((F.col("form_a") != F.col("form_b")) & (gap <= hours * 3600)).filter(jaccard(F.col("words_a"), F.col("words_b")) >= threshold)
    return reduce(DataFrame.unionAll, [*stars, near.select(F.least("row_ix_a", "row_ix_b").alias("a"), F.greatest("row_ix_a", "row_ix_b").alias("b"))]).distinct()


def duplicate_components(rows: DataFrame) -> DataFrame:
    """row_ix, component, canonical_row (the first by time, then row), is_duplicate; null times come last, rows without edge are their own."""
    rows = cut(rows)
    found = connected_components(duplicate_edges(rows), "a", "b").withColumnRenamed("node", "row_ix")
    held = rows.select("row_ix", "ts").join(found, "row_ix", "left").withColumn("component", F.coalesce("component", "row_ix"))
    order = F.struct(F.col("ts").isNull(), F.col("ts"), F.col("row_ix"))
    first = held.groupBy("component").agg(F.min_by("row_ix", order).alias("canonical_row"))
    return held.join(first, "component").select("row_ix", "component", "canonical_row", (F.col("row_ix") != F.col("canonical_row")).alias("is_duplicate"))


def sequential_duplicates(rows: DataFrame, hours: float = HOURS) -> DataFrame:
    """row_ix, matched_row: the first earlier retained record it repeats, null if it is retained itself.

    Records of (row_ix, url, form, words, ts, day) are taken in the order of row_ix; a record repeats a retained one within
    `hours` with the same form on the same UTC day, or with the same url and the same form or a word similarity of 0.85.
    Only retained records count, so the order matters; but records that repeat each other lie in one component of the
    undirected matches, and only a component's own records are gone through in one task.
    """
    rows = cut(rows.filter("ts IS NOT NULL"))
    edges = cut(duplicate_edges(rows, hours=hours))
    part = connected_components(edges, "a", "b").withColumnRenamed("node", "row_ix")
    held = rows.join(part, "row_ix")

    def run(frames):
        limit = pd.Timedelta(hours=hours)
        here, by_url, by_day = None, {}, {}
        for frame in frames:
            out = []
            for component, row, url, form, words, ts, day in frame[["component", "row_ix", "url", "form", "words", "ts", "day"]].itertuples(index=False):
                if component != here:
                    here, by_url, by_day = component, {}, {}
                mine = set(words)
                candidates = [x for x in by_day.get((day, form), ()) if form and abs(ts - x[1]) <= limit]
                for x in by_url.get(url, ()) if url else ():
                    if abs(ts - x[1]) <= limit and (x[2] == form or mine and len(mine & x[3]) >= 0.85 * len(mine | x[3])):
                        candidates.append(x)
                match = min((x[0] for x in candidates), default=None)
                if match is None:
                    kept = (row, ts, form, mine)
                    by_day.setdefault((day, form), []).append(kept)
                    by_url.setdefault(url, []).append(kept)
                out.append((row, match))
            yield pd.DataFrame(out, columns=["row_ix", "matched_row"]).astype({"matched_row": "Int64"})

    # Sorted by component, so that a task goes through many in one pass and holds one at a time.
    ordered = held.repartition("component").sortWithinPartitions("component", "row_ix")
    inside = ordered.mapInPandas(run, "row_ix long, matched_row long")
    alone = rows.join(part, "row_ix", "left_anti").select("row_ix", F.lit(None).cast("long").alias("matched_row"))
    return inside.unionByName(alone)


def ordinal_names(df: DataFrame, order: list[str], prefix: str = "cluster_", name: str = "cluster_name") -> DataFrame:
    """Names numbered in order from 0; the order is found by range partitions and their counts, without one global task."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = cut(parts)
    bases = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    bases = bases.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.join(F.broadcast(bases), "_p").withColumn("_number", F.col("_base") + F.col("_i") - F.col("_least"))
    return numbered.select(*df.columns, F.format_string(f"{prefix}%05d", "_number").alias(name))
