"""Causal clusters: each title links to the most similar earlier one within a time window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.text import OPPOSITES, opposed
from asofkit.session import cut

HOURS = 72


def unit(vector: Column) -> Column:
    """A vector of length 1, as doubles; an error for a vector of length 0."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.raise_error(F.lit("a vector of length 0 has no direction")).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _near(frame: pd.DataFrame, threshold: float, width: int) -> pd.DataFrame:
    """The pairs of two blocks whose vectors' product reaches the threshold, the later item first."""
    sides = [frame[frame["side"] == k] for k in (0, 1)]
    sides = [sides[0], sides[1] if len(sides[1]) else sides[0]] if frame["same"].iloc[0] else sides
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"item_id": [], "up": [], "up_at": [], "similarity": []})
    a, b = (np.stack(s["vector"].to_numpy()) for s in sides)
    ids, times = [s["item_id"].to_numpy() for s in sides], [s["at"].to_numpy() for s in sides]
    close = np.round(a @ b.T, 9)
    i, j = np.nonzero(close >= threshold)
    gap = times[0][i] - times[1][j]
    ahead = (gap > 0) | (gap == 0) & (ids[0][i] > ids[1][j])
    keep = (np.abs(gap) <= width * 1_000_000) & (ids[0][i] != ids[1][j])
    if frame["same"].iloc[0]:
        keep &= ahead
    i, j, ahead = i[keep], j[keep], ahead[keep]
    late, early = np.where(ahead, ids[0][i], ids[1][j]), np.where(ahead, ids[1][j], ids[0][i])
    return pd.DataFrame({"item_id": late, "up": early, "up_at": np.where(ahead, times[1][j], times[0][i]), "similarity": close[i, j]})


def causal_pairs(items: DataFrame, threshold: float, hours: float = HOURS, veto: Column | None = None, block: int = 1024) -> DataFrame:
    """item_id, up, up_ts, similarity: each item of (item_id, ts, vector, ...) with the earlier ones it may link to.

    Candidates are earlier items (by ts, then item_id) within `hours`, inclusive: those of the own window of that width and
    the one before. A window's items are divided into blocks, whose number is counted first, and each pair of blocks is one
    product of matrices in a task of its own, so a dense window spreads over many tasks, and only pairs that reach the
    threshold leave it. `veto` is on columns `a` (the item) and `b` (the earlier one), structs of all columns but the
    vector. Items without time are in no pair; item_id must be unique.
    """
    width = int(hours * 3600)
    held = items.filter("ts IS NOT NULL").select("item_id", F.unix_micros("ts").alias("at"), "vector", F.floor(F.unix_timestamp("ts") / width).alias("w"))
    # One row per window: their number is bounded by time.
    counts = held.groupBy("w").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    near = [F.broadcast(counts.select((F.col("w") + d).alias("w"), F.col("k").alias(name))) for d, name in ((0, "k"), (1, "before"), (-1, "after"))]
    placed = held.join(near[0], "w").join(near[1], "w", "left").join(near[2], "w", "left").withColumn("own", F.pmod(F.xxhash64("item_id"), F.col("k")).cast("int"))
    to = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    none = F.lit(0)
    cell = lambda w, i, j, step, side: F.struct(w.alias("w"), i.alias("i"), j.alias("j"), F.lit(step).alias("step"), F.lit(side).alias("side"))
    own = F.col("own")
    cells = F.concat(
        F.transform(to(own, F.col("k") - 1), lambda j: cell(F.col("w"), own, j, 0, 0)), F.transform(to(none, own - 1), lambda i: cell(F.col("w"), i, own, 0, 1)),
        F.transform(to(none, F.coalesce("before", none) - 1), lambda j: cell(F.col("w"), own, j, 1, 0)), F.transform(to(none, F.coalesce("after", none) - 1), lambda i: cell(F.col("w") + 1, i, own, 1, 1)),
    )
    sent = placed.withColumn("c", F.explode(cells)).select("c.*", "item_id", "at", "vector", ((F.col("c.step") == 0) & (F.col("c.i") == F.col("c.j"))).alias("same"))
    types = dict(items.dtypes)["item_id"]
    found = sent.groupBy("w", "i", "j", "step").applyInPandas(lambda frame: _near(frame, threshold, width), f"item_id {types}, up {types}, up_at long, similarity double")
    pairs = found.select("item_id", "up", F.timestamp_micros("up_at").alias("up_ts"), "similarity")
    if veto is None:
        return pairs
    rest = F.struct(*[c for c in items.columns if c != "vector"])
    a, b = items.select("item_id", rest.alias("a")), items.select(F.col("item_id").alias("up"), rest.alias("b"))
    return pairs.join(a.hint("merge"), "item_id").join(b.hint("merge"), "up").filter(~veto).select("item_id", "up", "up_ts", "similarity")


def examined_pairs(items: DataFrame, hours: float = HOURS) -> DataFrame:
    """items, all_pairs and window_pairs: how many pairs there are, and how many of them lie in one or two neighbouring windows, which are all that are compared."""
    width = int(hours * 3600)
    counts = items.filter("ts IS NOT NULL").groupBy(F.floor(F.unix_timestamp("ts") / width).alias("w")).agg(F.count("*").alias("n"))
    before = counts.select((F.col("w") + 1).alias("w"), F.col("n").alias("m"))
    n = F.col("n")
    return counts.join(before, "w", "left").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("items"), (F.sum(n) * (F.sum(n) - 1) / 2).cast("long").alias("all_pairs"), F.sum(n * (n - 1) / 2 + n * F.coalesce("m", F.lit(0))).cast("long").alias("window_pairs")
    )


def best_links(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """item_id, parent_id, link_similarity of every item: the most similar of its pairs, the earliest on ties, null where it has none."""
    best = pairs.groupBy("item_id").agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.unix_micros("up_ts")).alias("t"), (-F.col("up")).alias("i"))).alias("m"))
    return items.select("item_id").join(best.select("item_id", (-F.col("m.i")).alias("parent_id"), F.col("m.s").alias("link_similarity")), "item_id", "left")


def causal_links(items: DataFrame, threshold: float, hours: float = HOURS, veto: Column | None = None) -> DataFrame:
    """item_id, parent_id, link_similarity: the link of each item, null parent where none.

    The choice depends only on times, vectors and titles, never on earlier choices, so all are made at once.
    """
    return best_links(items, causal_pairs(items, threshold, hours, veto))


def title_veto(a: str = "a.title", b: str = "b.title") -> Column:
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return opposed(words(a), words(b))


def roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """item_id, root_id, link_similarity (1 for roots) by pointer doubling: each round halves the way to the root."""
    now = cut(links.select("item_id", F.coalesce("parent_id", "item_id").alias("up"), F.coalesce("link_similarity", F.lit(1.0)).alias("link_similarity")))
    for _ in range(most_rounds):
        above = now.select(F.col("item_id").alias("up"), F.col("up").alias("next"))
        moved = cut(now.join(above, "up").select("item_id", F.col("next").alias("up"), "link_similarity", (F.col("next") != F.col("up")).alias("moved")))
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return now.select("item_id", F.col("up").alias("root_id"), "link_similarity")


def representatives(members: DataFrame) -> DataFrame:
    """cluster_id, representative_id: of each cluster of (cluster_id, item_id, ts, vector) the member nearest the centroid, the earliest on ties.

    Centroids are sums by coordinate, combined before the shuffle; no task holds a cluster.
    """
    parts = members.select("cluster_id", F.posexplode("vector").alias("i", "v")).groupBy("cluster_id", "i").agg(F.sum("v").alias("v"))
    centre = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("cluster_id", F.transform("c", lambda x: x["v"]).alias("c"))
    centre = centre.withColumn("c", unit(F.col("c")))
    scored = members.join(centre, "cluster_id").withColumn("score", F.round(dot(F.col("vector"), F.col("c")), 9))
    return scored.groupBy("cluster_id").agg(F.min_by("item_id", F.struct(-F.col("score"), F.col("ts"), F.col("item_id"))).alias("representative_id"))


def as_of_counts(rows: DataFrame, group: str, ts: str, domain: str | None = None, until: str | None = None) -> DataFrame:
    """rows with size_asof, span_hours_asof and, with `domain`, domains_asof: over the group's rows up to the own time, ties included.

    Rows without time, or after the end of the UTC day `until`, count 0 and are seen by none. Null groups are one group.
    Sizes and spans are running counts over distinct times, domains are counted where they are first seen, so a group of
    any size is first reduced to its distinct times and domains.
    """
    known = F.col(ts).isNotNull() if until is None else F.col(ts).isNotNull() & (F.col(ts) < F.date_add(F.to_date(F.lit(until)), 1))
    held = rows.withColumn("_known", known)
    seen = held.filter("_known").groupBy(F.col(group).alias("_g"), F.col(ts).alias("_t")).agg(F.count("*").alias("_n"))
    first = F.lit(0).alias("_d")
    if domain:
        new = held.filter("_known").filter(F.trim(F.coalesce(domain, F.lit(""))) != "").groupBy(F.col(group).alias("_g"), F.trim(domain).alias("_dom")).agg(F.min(ts).alias("_t"))
        new = new.groupBy("_g", "_t").agg(F.count("*").alias("_d"))
        seen = seen.alias("l").join(new.alias("r"), F.col("l._g").eqNullSafe(F.col("r._g")) & (F.col("l._t") == F.col("r._t")), "left").select("l._g", "l._t", "l._n", F.coalesce("r._d", F.lit(0)).alias("_d"))
    else:
        seen = seen.select("_g", "_t", "_n", first)
    before = Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    span = (F.unix_micros("_t") - F.unix_micros(F.min("_t").over(before))) / 3.6e9
    table = seen.select("_g", "_t", F.sum("_n").over(before).alias("size_asof"), span.alias("span_hours_asof"), F.sum("_d").over(before).alias("domains_asof"))
    on = F.col(group).eqNullSafe(F.col("_g")) & (F.col(ts) == F.col("_t")) & F.col("_known")
    names = ["size_asof", "span_hours_asof", *(["domains_asof"] if domain else [])]
    return held.join(table, on, "left").select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def fetch_ranks(rows: DataFrame, most: int = 3) -> DataFrame:
    """item_id, fetch_rank: per cluster of (cluster_id, item_id, is_rep, similarity, ts, url, domain) up to three addresses to fetch.

    In order of representative, similarity (down), time and id: a blank or used address is skipped, and a used domain (in
    lower case; blank is one too). Each rank is one minimum per cluster, so no task goes through a cluster.
    """
    held = rows.withColumn("url", F.trim(F.coalesce("url", F.lit("")))).filter("url <> ''").withColumn("domain", F.lower(F.trim(F.coalesce("domain", F.lit("")))))
    order = F.struct((~F.col("is_rep")).alias("r"), (-F.col("similarity")).alias("s"), F.col("ts").isNull().alias("z"), F.col("ts").alias("t"), F.col("item_id").alias("i"))
    left, out = held.select("cluster_id", order.alias("o"), "url", "domain"), None
    for rank in range(1, most + 1):
        best = left.groupBy("cluster_id").agg(F.min(F.struct("o", "url", "domain")).alias("m"))
        ranked = best.select("cluster_id", F.col("m.o.i").alias("item_id"), F.lit(rank).alias("fetch_rank"))
        out = ranked if out is None else out.unionByName(ranked)
        left = left.join(best, "cluster_id").filter((F.col("url") != F.col("m.url")) & (F.col("domain") != F.col("m.domain"))).drop("m")
    return out


def roots_by_threshold(items: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, item_id, cluster_id: the clusters at each threshold, from pairs at the lowest, all trees followed at once."""
    n, links = len(thresholds), None
    for k, t in enumerate(thresholds):
        own = best_links(items, pairs.filter(F.col("similarity") >= t))
        own = own.select((F.col("item_id") * n + k).alias("item_id"), (F.col("parent_id") * n + k).alias("parent_id"), "link_similarity")
        links = own if links is None else links.unionByName(own)
    named = F.element_at(F.array(*map(F.lit, thresholds)), (F.col("item_id") % n + 1).cast("int"))
    return roots(links).select(named.alias("threshold"), F.floor(F.col("item_id") / n).alias("item_id"), F.floor(F.col("root_id") / n).alias("cluster_id"))


def sensitivity(members: DataFrame, by: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """Per group of clusters of (cluster_id, item_id): counts of items, clusters, singletons, size bands, largest and mean size; with `candidates` (by the same columns) their number and the reduction."""
    sizes = members.groupBy(*by, "cluster_id").agg(F.count("*").alias("n"))
    out = sizes.groupBy(*by).agg(
        F.sum("n").alias("items"), F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n").between(2, 3)).alias("clusters_2_3"),
        F.count_if(F.col("n") >= 4).alias("clusters_4_plus"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"),
    )
    out = out.withColumn("singleton_ratio", F.col("singletons") / F.col("clusters")).withColumn("near_duplicates", F.col("items") - F.col("clusters"))
    if candidates is not None:
        out = out.join(candidates.groupBy(*by).agg(F.count("*").alias("fetch_candidates")), by, "left").withColumn("reduction", F.col("items") - F.coalesce("fetch_candidates", F.lit(0)))
    return out


def at_threshold(rows: DataFrame, threshold: float, column: str = "threshold", most: float = 1e-9) -> DataFrame:
    """The rows of one threshold, which may differ in its last digits; an error if there is none or more than one."""
    found = rows.filter(F.abs(F.col(column) - threshold) < most)
    held = [r[0] for r in found.select(column).distinct().limit(2).collect()]
    if len(held) != 1:
        raise ValueError(f"{len(held) or 'no'} thresholds at {threshold}")
    return found


def opposed_clusters(rows: DataFrame, cluster: str, row: str, title: str) -> DataFrame:
    """Clusters in which two different rows have titles with the two sides of a pair of opposite words.

    Decided from counts of the rows with each side, without pairs of rows.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    held = rows.withColumn("_w", words)
    counts = []
    for i, (x, y) in enumerate(OPPOSITES):
        a, b = F.array_contains("_w", x), F.array_contains("_w", y)
        counts += [F.count_if(a).alias(f"a{i}"), F.count_if(b).alias(f"b{i}"), F.count_if(a & b).alias(f"c{i}")]
    summed = held.groupBy(cluster).agg(*counts)
    # Two different rows exist unless one row alone has both sides.
    hit = F.lit(False)
    for i in range(len(OPPOSITES)):
        hit = hit | ((F.col(f"a{i}") > 0) & (F.col(f"b{i}") > 0) & ~((F.col(f"a{i}") == 1) & (F.col(f"b{i}") == 1) & (F.col(f"c{i}") == 1)))
    return summed.filter(hit).select(cluster)


def review_sample(members: DataFrame, links: DataFrame, opposed_in: DataFrame, threshold: float, seed: int = 42) -> DataFrame:
    """cluster_id, review_reason, item_id, position: the first 10 members of the 10 largest clusters, the 20 nearest the threshold, 20 at random by hash, and all with opposed titles.

    members: cluster_id, item_id, ts; links: cluster_id, link_similarity.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1")
    largest = sizes.orderBy(F.desc("n"), "cluster_id").limit(10).select("cluster_id", F.lit("largest").alias("reason"))
    drawn = sizes.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cluster_id").cast("string")), 256)).limit(20).select("cluster_id", F.lit("random_multi_news").alias("reason"))
    near = links.filter("link_similarity < 1").groupBy("cluster_id").agg(F.min(F.abs(F.col("link_similarity") - threshold)).alias("d"))
    near = near.orderBy(F.round("d", 9), "cluster_id").limit(20).select("cluster_id", F.lit("near_threshold").alias("reason"))
    against = opposed_in.join(sizes, "cluster_id", "left_semi").select("cluster_id", F.lit("direction_conflict").alias("reason"))
    reasons = largest.unionByName(drawn).unionByName(near).unionByName(against).groupBy("cluster_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("reason"))).alias("review_reason"))
    position = F.row_number().over(Window.partitionBy("cluster_id").orderBy("ts", "item_id"))
    return members.join(reasons, "cluster_id").withColumn("position", position).filter("position <= 10").select("cluster_id", "review_reason", "item_id", "position")
