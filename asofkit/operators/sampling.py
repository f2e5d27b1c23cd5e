"""Cluster representatives, address candidates, and quota samples by year and stratum."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.ids import seeded_id
from asofkit.functions.text import jaccard, letters_and_digits, sequence_ratio, split_of_year, stratum, tokens, trust_tier
from asofkit.operators.totals import running_total
from asofkit.session import cut


def representative_order() -> Column:
    """Earliest, most trusted, fullest title, least id."""
    return F.struct(F.col("ts").isNull().alias("n"), F.col("ts").alias("t"), trust_tier(F.col("domain")).alias("d"), (-letters_and_digits(F.col("title"))).alias("q"), F.col("row_ix").alias("i"))


def cluster_table(rows: DataFrame) -> DataFrame:
    """Per cluster of (cluster, row_ix, ts, title, form, domain, url): size, first and last time, span, domains, representative, year, split, crosses_splits."""
    domain = F.lower(F.trim(F.coalesce("domain", F.lit(""))))
    best = F.min_by(F.struct("row_ix", "title", "form", "domain", "url", "ts"), representative_order())
    out = rows.groupBy("cluster").agg(
        F.count("*").alias("cluster_size"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_distinct(F.when(domain != "", domain)).alias("domain_count"), best.alias("r")
    )
    zone = lambda c: F.to_utc_timestamp(c, F.current_timezone())
    first, last = split_of_year(F.year(zone(F.col("first_at")))), split_of_year(F.year(zone(F.col("last_at"))))
    return out.select(
        "cluster", "cluster_size", "first_at", "last_at", ((F.unix_micros("last_at") - F.unix_micros("first_at")) / 3.6e9).alias("span_hours"), "domain_count",
        F.col("r.row_ix").alias("representative_row"), F.col("r.title").alias("title"), F.col("r.form").alias("form"), F.col("r.domain").alias("domain"), F.col("r.url").alias("url"),
        F.year(zone(F.col("first_at"))).alias("year"), first.alias("split"), F.coalesce(first != last, F.lit(False)).alias("crosses_splits"),
    )


def address_slots(rows: DataFrame, clusters: DataFrame, most: int = 3) -> DataFrame:
    """cluster, slot, row_ix, url: the representative's address first (slot 1 stays free without one), then addresses of new domains, then any, none twice.

    Each slot is one minimum per cluster over what is left: by new domain first, then trust, time, title, row.
    """
    domain = F.lower(F.trim(F.coalesce("domain", F.lit(""))))
    held = rows.withColumn("url", F.trim(F.coalesce("url", F.lit("")))).filter("url <> ''").withColumn("domain", domain)
    order = F.struct(trust_tier(F.col("domain")).alias("d"), F.col("ts").isNull().alias("n"), F.col("ts").alias("t"), (-letters_and_digits(F.col("title"))).alias("q"), F.col("row_ix").alias("i"))
    held = held.select("cluster", order.alias("o"), "url", "domain")
    first = clusters.filter(F.trim(F.coalesce("url", F.lit(""))) != "").select("cluster", F.lit(1).alias("slot"), F.col("representative_row").alias("row_ix"), F.trim("url").alias("url"), F.lower(F.trim(F.coalesce("domain", F.lit("")))).alias("domain"))
    picked = first
    for slot in range(2, most + 1):
        used = picked.groupBy("cluster").agg(F.collect_set("url").alias("urls"), F.collect_set("domain").alias("domains"))  # at most `most` of each
        left = held.join(used, "cluster", "left").filter(~F.coalesce(F.array_contains("urls", F.col("url")), F.lit(False)))
        again = F.coalesce(F.array_contains("domains", F.col("domain")), F.lit(False))
        best = left.groupBy("cluster").agg(F.min(F.struct(again.alias("again"), "o", "url", "domain")).alias("m"))
        picked = picked.unionByName(best.select("cluster", F.lit(slot).alias("slot"), F.col("m.o.i").alias("row_ix"), F.col("m.url").alias("url"), F.col("m.domain").alias("domain")))
    return picked.select("cluster", "slot", "row_ix", "url")


def address_statistics(rows: DataFrame, clusters: DataFrame, by: str = "split") -> DataFrame:
    """Per `by`: clusters, those with any address, with one of the representative, with a second, and with one of another domain than the representative's."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    best = clusters.select("cluster", by, "representative_row", plain(F.col("domain")).alias("_own"))
    held = rows.select("cluster", "row_ix", F.trim(F.coalesce("url", F.lit(""))).alias("_url"), plain(F.col("domain")).alias("_domain")).join(best.hint("merge"), "cluster")
    there = F.col("_url") != ""
    each = held.groupBy("cluster", by).agg(
        F.count_distinct(F.when(there, F.col("_url"))).alias("urls"), F.max(there & (F.col("row_ix") == F.col("representative_row"))).alias("own"), F.max(there & (F.col("_domain") != F.col("_own"))).alias("other")
    )
    return each.groupBy(by).agg(F.count("*").alias("clusters"), F.count_if(F.col("urls") > 0).alias("with_address"), F.count_if("own").alias("with_own"), F.count_if(F.col("urls") > 1).alias("with_second"), F.count_if("other").alias("with_other_domain"))


def round_robin(clusters: DataFrame, seed: int = 42) -> DataFrame:
    """clusters with stratum and `turn`, their place in their year: the strata of a year take turns in order, each drawing by hash.

    A cluster's rank in its stratum is a running count over ranges of the hash, and its turn follows from the rank and the
    sizes of the year's strata (a table of fixed width): all rounds before, in which each stratum takes part as long as it
    lasts, and those before it in its own. So no task holds a year or a stratum. Clusters without a year are left out.
    """
    held = clusters.withColumn("stratum", stratum(F.col("cluster_size"), F.col("form"), F.col("title"))).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cluster").cast("string")), 256))
    held = cut(held.select("_h", "cluster", *(c for c in held.columns if c not in ("_h", "cluster"))))
    # The first 60 bits of the hash, spread over all longs; ties by the whole hash, then the cluster.
    order = (F.conv(F.substring("_h", 1, 15), 16, 10).cast("decimal(20,0)") * 16 - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
    ranked = running_total(held, ["year", "stratum"], order, F.lit(1), name="_before").withColumn("_rank", F.col("_before") + 1)
    sizes = held.groupBy("year", "stratum").agg(F.count("*").alias("n")).groupBy("year").agg(F.collect_list(F.struct("stratum", "n")).alias("_strata"))
    told = ranked.join(F.broadcast(sizes), "year")  # years by strata
    rounds = F.aggregate("_strata", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], F.col("_rank") - 1))
    this = F.aggregate("_strata", F.lit(0).cast("long"), lambda s, x: s + F.when((x["n"] >= F.col("_rank")) & (x["stratum"] <= F.col("stratum")), 1).otherwise(0))
    return told.select(*clusters.columns, "stratum", (rounds + this).cast("int").alias("turn"))


def _lcs(where: dict[str, int], size: int, other: str) -> int:
    """The length of the longest common subsequence of two texts, one given by the places of its characters as bits."""
    full = (1 << size) - 1
    s = full
    for c in other:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def _counts(codes: list[np.ndarray], buckets: int) -> np.ndarray:
    out = np.zeros((len(codes), buckets), "int32")
    for i, c in enumerate(codes):
        out[i] = np.bincount(c % buckets, minlength=buckets)
    return out.astype("int16") if out.max(initial=0) < 16_000 else out


def _close_forms(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of the forms of two blocks that can have a ratio of `threshold`.

    A ratio r of lengths m and n leaves (1 - r)(m + n) characters unmatched, in any order. The counts of characters differ
    by no more than that, those of pairs of neighbours by three times that, and the longest common subsequence lacks no
    more; none of these bounds loses a pair, whatever the buckets of the counts.
    """
    i, j = frame["i"].iloc[0], frame["j"].iloc[0]
    sides = [frame[frame["block"] == n] for n in (i, j)]
    texts = [s["fm"].to_numpy() for s in sides]
    codes = [[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype("int64") for x in side] for side in texts]
    sizes = [np.array([len(c) for c in side]) for side in codes]
    single = [_counts(side, 48) for side in codes]
    double = [_counts([c[:-1] * 31 + c[1:] for c in side], 192) for side in codes]
    # A form of several splits has pairs with all others.
    only = [pd.array(s["only"], dtype="string").fillna("").to_numpy(dtype=object) for s in sides]
    out = []
    for k, text in enumerate(texts[0]):
        start = k + 1 if i == j else 0
        most = (1 - threshold) * (sizes[0][k] + sizes[1][start:]) + 1e-6
        near = np.flatnonzero(np.abs(single[1][start:] - single[0][k]).sum(axis=1, dtype="int32") <= most)
        if only[0][k]:
            near = near[only[1][start + near] != only[0][k]]
        near = near[np.abs(double[1][start + near] - double[0][k]).sum(axis=1, dtype="int32") <= 3 * most[near]]
        if len(near):
            where: dict[str, int] = {}
            for n, c in enumerate(text):
                where[c] = where.get(c, 0) | 1 << n
            out += [(text, texts[1][start + n]) for n in near if len(text) + len(texts[1][start + n]) - 2 * _lcs(where, len(text), texts[1][start + n]) <= most[n]]
    return pd.DataFrame(out, columns=["fm", "other"])


def cross_split_pairs(rows: DataFrame, key: str, split: str, form: str, threshold: float = 0.92, block_rows: int = 4_000) -> DataFrame:
    """All pairs of rows of different splits with equal titles or a sequence ratio of at least `threshold`: key_a, key_b, word_similarity, ratio.

    Equal forms are joined. Other distinct forms are compared in pairs of blocks by bounds that the ratio implies, and those
    that pass by the ratio itself, from the row of the lesser key; the comparison of counts is quadratic in distinct forms.
    Rows without key, split or form, or with an empty one, are in no pair. word_similarity is that of the [a-z0-9]+ words, 0 where a title has none.
    """
    held = cut(rows.filter(F.col(key).isNotNull() & F.col(split).isNotNull() & (F.col(form) != "")).select(F.col(key).alias("k"), F.col(split).alias("sp"), F.col(form).alias("fm")))
    forms = held.groupBy("fm").agg(F.count_distinct("sp").alias("n"), F.min("sp").cast("string").alias("sp"))
    blocks = max(1, -(-forms.count() // block_rows))
    placed = forms.select("fm", F.when(F.col("n") == 1, F.col("sp")).alias("only"), F.pmod(F.xxhash64("fm"), F.lit(blocks)).cast("int").alias("block"))
    sent = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("fm", "only", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    close = sent.groupBy("i", "j").applyInPandas(lambda frame: _close_forms(frame, threshold), "fm string, other string")
    one, two = (held.select(F.col("k").alias(f"k{s}"), F.col("sp").alias(f"sp{s}"), F.col("fm").alias(f)) for s, f in ((1, "fm"), (2, "other")))
    similar = close.join(one, "fm").join(two, "other").filter("sp1 <> sp2")
    ordered = similar.select(*(F.when(F.col("k1") < F.col("k2"), F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("k1", "k2", "key_a"), ("k2", "k1", "key_b"), ("fm", "other", "form_a"), ("other", "fm", "form_b"))))
    scored = ordered.withColumn("ratio", sequence_ratio(F.col("form_a"), F.col("form_b"))).filter(F.col("ratio") >= threshold)
    equal = one.join(two, F.col("fm") == F.col("other")).filter("sp1 <> sp2 AND k1 < k2").select(F.col("k1").alias("key_a"), F.col("k2").alias("key_b"), F.col("fm").alias("form_a"), F.col("other").alias("form_b"), F.lit(1.0).alias("ratio"))
    similarity = F.when(F.col("form_a") == F.col("form_b"), 1.0).otherwise(jaccard(tokens(F.col("form_a")), tokens(F.col("form_b"))))
    return equal.unionByName(scored).select("key_a", "key_b", similarity.alias("word_similarity"), "ratio")


def quota_sample(clusters: DataFrame, quotas: dict[int, int], seed: int = 42, threshold: float = 0.92, margin: int = 4) -> DataFrame:
    """sample_id, cluster, year, split, stratum, title of the clusters drawn for each year's quota.

    The years go up; within one, clusters come in round-robin order, and one whose title equals or nearly repeats one
    already drawn for another split is passed over. That guard is sequential, so it runs in one task over the first
    `margin` times each year's quota of candidates, a number fixed by the quotas; should a year run out of them, more are taken.
    """
    drawn = cut(round_robin(clusters.filter(F.col("year").isin(*quotas) & F.col("split").isNotNull()), seed))
    wanted = dict(quotas)

    def guard(frames):
        frame = pd.concat(list(frames), ignore_index=True)
        chosen: list[tuple] = []
        for year in sorted(wanted):
            taken = 0
            for row in frame[frame["year"] == year].sort_values("turn").itertuples(index=False):
                if taken == wanted[year]:
                    break
                if any(s != row.split and (f == row.form or difflib.SequenceMatcher(None, row.form, f).ratio() >= threshold) for s, f in chosen):
                    continue
                chosen.append((row.split, row.form))
                taken += 1
                yield pd.DataFrame([row])

    while True:
        first = F.lit(False)
        for year, n in wanted.items():
            first = first | ((F.col("year") == year) & (F.col("turn") <= n * margin))
        offered = drawn.filter(first).select("cluster", "year", "split", "stratum", "title", F.coalesce("form", F.lit("")).alias("form"), "turn")
        out = cut(offered.coalesce(1).mapInPandas(guard, offered.schema))
        got = {r["year"]: r["count"] for r in out.groupBy("year").count().collect()}
        there = {r["year"]: r["count"] for r in drawn.groupBy("year").count().collect()}
        if all(got.get(y, 0) >= n or there.get(y, 0) <= n * margin for y, n in wanted.items()):
            break
        margin *= 4
    return out.select(seeded_id("news_pilot_", seed, F.col("cluster").cast("string")).alias("sample_id"), "cluster", "year", "split", "stratum", "title")


def size_distribution(sizes: DataFrame, size: str) -> DataFrame:
    """One row: counts by size band, largest, mean, exact median."""
    n = F.col(size)
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(n == 1).alias("singletons"), F.count_if(n.between(2, 3)).alias("size_2_3"), F.count_if(n >= 4).alias("size_4_plus"), F.max(n).alias("largest"), F.avg(n).alias("mean_size"), F.percentile(n, 0.5).alias("median_size"))


def counts_with_zeros(df: DataFrame, column: str, categories: list) -> DataFrame:
    """The count of each category, 0 where it doesn't occur."""
    spark = df.sparkSession
    named = spark.createDataFrame([(c,) for c in categories], f"{column} {dict(df.dtypes)[column]}")
    return named.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
