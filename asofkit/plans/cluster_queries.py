"""Queries on causal clusters, representatives, samples, and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.ids import json_list_id
from asofkit.functions.text import OPPOSITES, display_text, html_body_udf, label_score, letters_and_digits, plain_title_form_udf, stratum, title_form_udf, trust_tier
from asofkit.operators import clusters, features, metrics, sampling, scoring, setjoin, validate
from asofkit.plans.common import NEWS_SQL, SCORED_SQL, news, scored_documents, text_time
from asofkit.session import cut, table
from asofkit.sources.tables import sample_rows
from asofkit.streaming.online import daily_counts, run_once

#: The vectors of the test tables are spread, so a lower threshold than that for titles gives clusters.
THRESHOLD, THRESHOLDS = 0.3, (0.2, 0.25, 0.3, 0.35)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as items an hour apart."""
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 3600)
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), ts.alias("ts"), clusters.unit(F.col("embedding")).alias("vector"))


def _links(spark: SparkSession, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    return clusters.roots(clusters.causal_links(_items(spark, folder), threshold))


def causal_links(spark: SparkSession, folder: str) -> DataFrame:
    out = clusters.causal_links(_items(spark, folder), THRESHOLD)
    return out.select("item_id", "parent_id", F.round("link_similarity", 6).alias("link_similarity"))


def causal_examined(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs of items the causal links compare, of all there are."""
    return clusters.examined_pairs(_items(spark, folder))


def causal_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("item_id", F.concat(F.lit("cluster_"), F.col("root_id").cast("string")).alias("cluster_id"))


def _members(spark: SparkSession, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    return _links(spark, folder, threshold).withColumnRenamed("root_id", "cluster_id").join(_items(spark, folder), "item_id")


def cluster_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.representatives(cut(_members(spark, folder).select("cluster_id", "item_id", "ts", "vector")))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Items with their cluster, representative, similarity to it, and an address and domain of a document."""
    members = cut(_members(spark, folder))
    reps = clusters.representatives(members)
    centre = members.select(F.col("item_id").alias("representative_id"), F.col("vector").alias("centre"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "source", "ticker")
    held = members.join(reps, "cluster_id").join(centre, "representative_id").join(docs, "item_id", "left")
    return held.select(
        "cluster_id", "item_id", "ts", "link_similarity", (F.col("item_id") == F.col("representative_id")).alias("is_rep"), F.round(clusters.dot(F.col("vector"), F.col("centre")), 6).alias("similarity"),
        F.when(F.col("ticker").isNotNull(), F.concat(F.lit("https://"), F.coalesce("source", F.lit("x")), F.lit("/"), F.col("ticker"))).alias("url"), F.col("source").alias("domain"),
    )


def fetch_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.fetch_ranks(cut(_manifest(spark, folder)))


def cluster_sizes_asof(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_members(spark, folder).select("cluster_id", "item_id", "ts"))
    return clusters.as_of_counts(rows, "cluster_id", "ts").select("item_id", "size_asof")


def threshold_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """All thresholds from one table of scored candidates at the lowest of them."""
    items = cut(_items(spark, folder))
    pairs = cut(clusters.causal_pairs(items, min(THRESHOLDS)))
    out = clusters.sensitivity(clusters.roots_by_threshold(items, pairs, THRESHOLDS), ["threshold"])
    return out.select("threshold", "items", "clusters", "singletons", F.round("singleton_ratio", 6).alias("singleton_ratio"), "clusters_2_3", "clusters_4_plus", "largest", F.round("mean_size", 6).alias("mean_size"), "near_duplicates")


def review_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_manifest(spark, folder))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text")
    against = clusters.opposed_clusters(rows.select("cluster_id", "item_id").join(texts, "item_id"), "cluster_id", "item_id", "text")
    return clusters.review_sample(rows.select("cluster_id", "item_id", "ts"), rows.select("cluster_id", "link_similarity"), against, THRESHOLD)


def event_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Headlines linked to the most similar earlier one within 72 hours by words, without opposite directions."""
    rows = news(spark, folder, "plain").filter("ts IS NOT NULL").select("row_ix", "ts", "title", "form", F.array_distinct(F.split("form", r"\s+")).alias("words"))
    items = cut(rows)
    # Equal word sets are held once per time, as a set join needs distinct sets.
    keyed = cut(items.groupBy(F.array_sort("words").alias("words"), "ts").agg(F.min("row_ix").alias("key"), F.min("title").alias("title")))
    pairs = setjoin.similar_sets(keyed, "key", "words", 0.9, near=~clusters.title_veto(), time="ts", hours=clusters.HOURS)
    times = keyed.select(F.col("key"), F.col("ts")).hint("merge")
    a, b = (times.select(F.col("key").alias(f"key_{s}"), F.col("ts").alias(f"ts_{s}")) for s in "ab")
    timed = pairs.join(a, "key_a").join(b, "key_b")
    later = F.struct("ts_a", "key_a") > F.struct("ts_b", "key_b")
    links = timed.select(
        F.when(later, F.col("key_a")).otherwise(F.col("key_b")).alias("item_id"), F.when(later, F.col("key_b")).otherwise(F.col("key_a")).alias("up"), F.when(later, F.col("ts_b")).otherwise(F.col("ts_a")).alias("up_ts"), "similarity"
    )
    best = links.groupBy("item_id").agg(F.min_by("up", F.struct((-F.round("similarity", 9)).alias("s"), F.col("up_ts").alias("t"), F.col("up").alias("u"))).alias("parent_id"), F.max("similarity").alias("link_similarity"))
    tree = clusters.roots(keyed.select(F.col("key").alias("item_id")).join(best, "item_id", "left"))
    held = items.select("row_ix", "ts", F.array_sort("words").alias("words")).join(keyed.select("words", "ts", "key"), ["words", "ts"])
    return held.join(tree.withColumnRenamed("item_id", "key"), "key").select("row_ix", "root_id")


def opposed_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Domains, in any case, with headlines of opposite directions."""
    rows = table(spark, folder, "cluster_news_titles").select("row_ix", "title", F.lower(F.trim("domain")).alias("cluster")).filter("cluster IS NOT NULL")
    return clusters.opposed_clusters(rows, "cluster", "row_ix", "title")


def _cluster_table(spark: SparkSession, folder: str, form: str = "lower") -> DataFrame:
    return sampling.cluster_table(news(spark, folder, form).filter("cluster IS NOT NULL AND ts IS NOT NULL"))


def cluster_table(spark: SparkSession, folder: str) -> DataFrame:
    out = _cluster_table(spark, folder)
    return out.select("cluster", "cluster_size", text_time("first_at").alias("first_at"), text_time("last_at").alias("last_at"), F.round("span_hours", 6).alias("span_hours"), "domain_count", "representative_row", "year", "split", "crosses_splits")


def split_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return _cluster_table(spark, folder).groupBy("split").agg(F.count("*").alias("clusters"), F.count_if("crosses_splits").alias("crossing"))


def address_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(news(spark, folder).filter("cluster IS NOT NULL AND ts IS NOT NULL"))
    return sampling.address_slots(rows, sampling.cluster_table(rows))


def size_distribution(spark: SparkSession, folder: str) -> DataFrame:
    out = sampling.size_distribution(_cluster_table(spark, folder), "cluster_size")
    return out.select("clusters", "singletons", "size_2_3", "size_4_plus", "largest", F.round("mean_size", 6).alias("mean_size"), F.round("median_size", 6).alias("median_size"))


def strata(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters by year and stratum."""
    return _cluster_table(spark, folder).groupBy("year", stratum(F.col("cluster_size"), F.col("form"), F.col("title")).alias("stratum")).agg(F.count("*").alias("n"))


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """The turn of every cluster in its year."""
    drawn = sampling.round_robin(_cluster_table(spark, folder).filter("split IS NOT NULL"))
    return drawn.select("year", "turn", "stratum", "cluster")


def quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    # The pilot's quotas by year.
    quotas = {2020: 37, 2021: 34, 2022: 34, 2023: 38, 2024: 46, 2025: 48, 2026: 23}
    return sampling.quota_sample(_cluster_table(spark, folder, "title"), quotas).select("sample_id", "cluster", "year", "split", "stratum")


def counts_by_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "select_news_pilot").select(F.lower(F.trim("split")).alias("split"))
    return sampling.counts_with_zeros(rows, "split", ["train", "validation", "test", "holdout"])


def cross_split_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "select_news_pilot").select("row_ix", F.lower(F.trim("split")).alias("split"), F.lower(F.trim("title")).alias("form"))
    first = rows.groupBy("split", "form").agg(F.min("row_ix").alias("row_ix"))
    return sampling.cross_split_pairs(first, "row_ix", "split", "form")


def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different headlines that share three quarters of their words."""
    rows = news(spark, folder, times=False).select("row_ix", F.array_sort("words").alias("words")).filter(F.size("words") > 0)
    sets = cut(rows.groupBy("words").agg(F.min("row_ix").alias("row_ix")))
    out = setjoin.similar_sets(sets, "row_ix", "words", 0.75)
    return out.select("key_a", "key_b", F.round("similarity", 6).alias("similarity"))


def trust_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return news(spark, folder, times=False).groupBy(trust_tier(F.col("domain")).alias("tier")).agg(F.count("*").alias("n"), F.sum(letters_and_digits(F.col("title"))).alias("letters"))


def title_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Both forms of each headline."""
    rows = table(spark, folder, "cluster_news_titles")
    return rows.select("row_ix", title_form_udf("title", "domain", "source").alias("title_form"), plain_title_form_udf("title").alias("plain_form"))


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of documents from their contents."""
    d = table(spark, folder, "pipeline_sentiment")
    return d.select("row_ix", json_list_id(F.lit("NVDA"), F.col("source_type"), F.col("available_date"), F.col("document_id")).alias("made_id"))


def html_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made of documents, and their bodies read again."""
    d = table(spark, folder, "pipeline_documents").filter("text IS NOT NULL")
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = lambda x: F.concat(F.lit("<table><tr><td>"), F.replace(x, F.lit("  "), F.lit("</td><td>")), F.lit("</td></tr></table>"))
    lines = F.concat_ws("", F.transform(F.split(safe, "\n"), lambda x: F.when(F.contains(x, F.lit("  ")), row(x)).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav>Menu Home</nav><script>x = 1</script><div>"), lines, F.lit("</div><footer>Footer</footer></body></html>"))
    return d.select("row_ix", html_body_udf(page).alias("body"))


def chunk_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the documents from those of their pieces, by a scorer without model."""
    docs = table(spark, folder, "pipeline_sentiment").select("row_ix", "text")
    return features.document_scores(scoring.chunk_scores(docs, "row_ix", "text")).withColumn("score", F.round("score", 6))


def unscored(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a usable cached score."""
    wanted = table(spark, folder, "pipeline_documents").select("document_id").filter("document_id IS NOT NULL").distinct()
    cache = table(spark, folder, "pipeline_sentiment").select("document_id", F.col("fingpt_error").alias("error"))
    return scoring.to_score(wanted, cache, "document_id", retry_errors=True)


def source_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten usable documents of each source: a sample, hence the limit."""
    d = table(spark, folder, "pipeline_sentiment").select("row_ix", "source_type", "document_id", "text")
    usable = F.trim(F.coalesce("text", F.lit(""))) != ""
    parts = [sample_rows(d.filter(F.col("source_type") == s), ["document_id"], usable, "row_ix", 10) for s in features.SOURCES]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("row_ix", "source_type", "document_id")


def extraction_check(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers made of scored documents, read as strict extraction records."""
    d = scored_documents(spark, folder).filter("text IS NOT NULL")
    fields = {k: F.lit(0) for k in validate.RANGES} | {
        "sentiment": label_score(F.col("label")) * 2, "event_type": F.when(F.col("row_ix") % 7 == 0, "rumour").otherwise("other"), "positive_factors": F.array().cast("array<string>"),
        "potential_concerns": F.array().cast("array<string>"), "summary": F.lit("One. Two."), "evidence": F.array(F.trim(F.substring("text", 1, 20))),
    }
    answer = F.concat(F.lit("Sure: ```json "), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))), F.lit(" ``` done {"))
    out = validate.extractions(d.withColumn("answer", answer), "row_ix", "answer", "text")
    return out.select("row_ix", "sentiment", "event_type", "error")


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers with every dimension and event, made of scored documents; one in eleven has an unknown event."""
    d = scored_documents(spark, folder).filter("text IS NOT NULL")
    level = lambda low, high, k: ((F.col("row_ix") * k) % (high - low + 1) + low).cast("int")
    fields = {name: level(low, high, k) for k, (name, (low, high)) in enumerate(validate.RANGES.items(), 1)} | {
        "event_type": F.when(F.col("row_ix") % 11 == 0, "rumour").otherwise(F.element_at(F.array(*map(F.lit, validate.EVENTS)), (F.col("row_ix") % len(validate.EVENTS) + 1).cast("int"))),
        "positive_factors": F.array().cast("array<string>"), "potential_concerns": F.array().cast("array<string>"), "summary": F.lit("One. Two."), "evidence": F.array(F.trim(F.substring("text", 1, 20))),
    }
    answers = d.withColumn("answer", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))))
    return validate.extractions(answers, "row_ix", "answer", "text")


def multidimensional_means(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of every dimension and the count of every event type, over valid records alone."""
    ok = F.col("error") == ""
    means = [F.round(F.avg(F.when(ok, F.col(k))), 6).alias(f"mean_{k}") for k in validate.RANGES]
    events = [F.count_if(ok & (F.col("event_type") == e)).alias(f"events_{e}") for e in validate.EVENTS]
    return _extracted(spark, folder).agg(F.count("*").alias("records"), F.count_if(ok).alias("valid"), *means, *events)


def threshold_select(spark: SparkSession, folder: str) -> DataFrame:
    """The row of threshold_sensitivity for a threshold that arithmetic made."""
    return clusters.at_threshold(threshold_sensitivity(spark, folder), 0.1 + 0.2)


def address_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with an address, with a representative one, with a second, and with one of another domain to fall back on, by split."""
    rows = cut(news(spark, folder).filter("cluster IS NOT NULL AND ts IS NOT NULL"))
    return sampling.address_statistics(rows, sampling.cluster_table(rows))


def annotation_check(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations made of scored documents, in JSON, validated line by line."""
    d = scored_documents(spark, folder).filter("text IS NOT NULL AND available_date IS NOT NULL")
    quote = F.substring("text", 1, 12)
    directional = F.when(F.col("label").isin("negative", "neutral", "positive"), F.col("label")).otherwise("insufficient_information")
    labels = F.map_from_arrays(F.array(*map(F.lit, (*validate.DIRECTIONAL, *validate.YES_NO))), F.array(*[directional] * len(validate.DIRECTIONAL), *[F.lit("no")] * len(validate.YES_NO)))
    span = F.array(F.struct(quote.alias("quote"), F.lit(6).alias("start"), (F.lit(6) + F.length(quote)).alias("end")))
    none = F.array().cast("array<struct<quote:string,start:int,end:int>>")
    evidence = F.map_from_arrays(F.array(*map(F.lit, validate.DIRECTIONAL)), F.array(*[F.when(directional == "insufficient_information", none).otherwise(span)] * len(validate.DIRECTIONAL)))
    record = F.struct(
        F.coalesce("document_id", F.lit("x")).alias("sample_id"), F.lit("NVDA").alias("ticker"), "source_type", F.concat(F.col("available_date").cast("string"), F.lit("T10:00:00Z")).alias("published_at"),
        F.col("available_date").cast("string").alias("as_of_date"), F.lit("Title").alias("title"), "text", labels.alias("labels"), evidence.alias("evidence"), F.lit("a").alias("annotator"), F.lit("v1").alias("annotation_version"),
        F.lit("train").alias("split"),
    )
    lines = d.select(F.col("row_ix").alias("line_no"), F.to_json(record).alias("value"))
    return validate.annotations(lines).select("line_no", "sample_id", F.size("errors").alias("errors"), F.array_join("errors", "; ").alias("told"))


def candidate_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities and margins from candidate scores."""
    scores = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    p = metrics.softmax(scores)
    out = table(spark, folder, "embeddings").select("vec_id", p.alias("p"))
    return out.select("vec_id", F.round(F.col("p")[0], 6).alias("p_first"), F.round(metrics.top_margin(F.col("p")), 6).alias("margin"))


def previews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "inspect_text_datasets").select("row_ix", display_text(F.col("content")).alias("preview"))


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, counted as a stream over what is there."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = run_once(spark, daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "complete")
    return out.select(F.col("day").cast("string").alias("day"), "kind", "n")


QUERIES = {
    f.__name__: f
    for f in (
        causal_links, causal_examined, causal_clusters, cluster_representatives, fetch_ranks, cluster_sizes_asof, threshold_sensitivity, review_sample, event_clusters, opposed_clusters, cluster_table, split_crossings,
        address_slots, size_distribution, strata, round_robin, quota_sample, counts_by_split, cross_split_pairs, similar_titles, trust_tiers, title_forms, document_ids, html_bodies, chunk_scores, unscored,
        source_sample, extraction_check, multidimensional_means, threshold_select, address_statistics, annotation_check, candidate_softmax, previews, stream_daily_counts,
    )
}

_LINKS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 9) AS sim FROM u a JOIN u b ON b.vec_id < a.vec_id AND a.vec_id - b.vec_id <= 72),
    l{n} AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= {t}) WHERE r = 1)"""
_TREE = """t{n} AS (SELECT vec_id AS item_id, vec_id AS here, b AS up FROM embeddings LEFT JOIN l{n} ON vec_id = a UNION ALL SELECT t.item_id, t.up, l.b FROM t{n} t LEFT JOIN l{n} l ON t.up = l.a WHERE t.up IS NOT NULL),
    c{n} AS (SELECT item_id, min(here) AS root_id FROM t{n} GROUP BY item_id)"""
_CLUSTERS = f"WITH RECURSIVE {_LINKS.format(n='', t=THRESHOLD)}, {_TREE.format(n='')}"
_TABLE = f"""{NEWS_SQL}, held AS (SELECT *, length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS q, CASE WHEN trim(coalesce(domain, '')) = '' THEN 4 ELSE 3 END AS tier FROM news WHERE cluster IS NOT NULL AND ts IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ts, tier, q DESC, row_ix) AS r FROM held),
    grouped AS (SELECT cluster, count(*) AS cluster_size, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT nullif(lower(trim(domain)), '')) AS domain_count FROM held GROUP BY cluster),
    part AS (SELECT g.*, r.row_ix AS representative_row, r.title, r.form, r.q, year(first_at) AS year,
        CASE WHEN year(first_at) BETWEEN 2020 AND 2023 THEN 'train' WHEN year(first_at) = 2024 THEN 'validation' WHEN year(first_at) BETWEEN 2025 AND 2026 THEN 'test' END AS split,
        CASE WHEN year(last_at) BETWEEN 2020 AND 2023 THEN 'train' WHEN year(last_at) = 2024 THEN 'validation' WHEN year(last_at) BETWEEN 2025 AND 2026 THEN 'test' END AS last_split
        FROM grouped g JOIN ranked r ON g.cluster = r.cluster AND r.r = 1)"""
_STRATA = f"""{_TABLE}, themed AS (SELECT *, regexp_matches(form, '\\b(raise[sd]?|beat[s]?|growth|gain[s]?|surge[sd]?|up|approval|approved)\\b') AS good,
    regexp_matches(form, '\\b(cut[s]?|miss(?:es)?|decline[s]?|drop[s]?|down|rejection|rejected|risk)\\b') AS bad,
    regexp_matches(form, '\\b(stock|share|price|target|rally|momentum|support|resistance)\\b') AS price FROM part),
    strata AS (SELECT *, concat_ws(':', CASE WHEN cluster_size = 1 THEN 'singleton' WHEN cluster_size <= 3 THEN 'size_2_3' ELSE 'size_4_plus' END,
        CASE WHEN good AND bad THEN 'mixed' WHEN good THEN 'positive' WHEN bad THEN 'negative_risk' WHEN price THEN 'price' ELSE 'other' END,
        CASE WHEN q < 50 THEN 'short' WHEN q >= 120 THEN 'long' ELSE 'medium' END) AS stratum FROM themed)"""

_EXTRACTED = rf"""WITH {SCORED_SQL}, x AS (SELECT row_ix, CASE lower(label) WHEN 'positive' THEN 2 WHEN 'negative' THEN -2 ELSE 0 END AS sentiment,
    concat_ws('; ', CASE WHEN row_ix % 7 = 0 THEN 'event_type' END, CASE WHEN regexp_full_match(substr(text, 1, 20), '\s*') THEN 'evidence' END) AS error FROM scored WHERE text IS NOT NULL)"""

_SENSITIVITY = (
    "WITH RECURSIVE "
    + _LINKS.format(n=0, t=THRESHOLDS[0])
    + "".join(f", l{n} AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= {t}) WHERE r = 1)" for n, t in enumerate(THRESHOLDS) if n)
    + "".join(f", {_TREE.format(n=n)}, z{n} AS (SELECT root_id, count(*) AS n FROM c{n} GROUP BY root_id)" for n in range(len(THRESHOLDS)))
    + " UNION ALL ".join(
        f""" SELECT CAST({t} AS DOUBLE) AS threshold, CAST(sum(n) AS BIGINT) AS items, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_ratio,
            count(*) FILTER (n BETWEEN 2 AND 3) AS clusters_2_3, count(*) FILTER (n >= 4) AS clusters_4_plus, max(n) AS largest, round(avg(n), 6) AS mean_size, CAST(sum(n) AS BIGINT) - count(*) AS near_duplicates FROM z{n}"""
        for n, t in enumerate(THRESHOLDS)
    )
)

ORACLES = {
    "causal_links": f"WITH {_LINKS.format(n='', t=THRESHOLD)} SELECT vec_id AS item_id, b AS parent_id, round(sim, 6) AS link_similarity FROM embeddings LEFT JOIN l ON vec_id = a",
    "causal_examined": """WITH i AS (SELECT vec_id, (1704067200 + vec_id * 3600) // 259200 AS w FROM embeddings)
        SELECT (SELECT count(*) FROM i) AS items, (SELECT CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) FROM i) AS all_pairs,
            (SELECT count(*) FROM i a JOIN i b ON b.vec_id < a.vec_id AND a.w - b.w BETWEEN 0 AND 1) AS window_pairs""",
    "causal_clusters": f"{_CLUSTERS} SELECT item_id, 'cluster_' || root_id AS cluster_id FROM c",
    "cluster_representatives": f"""{_CLUSTERS}, m AS (SELECT root_id AS cluster_id, item_id, e FROM c JOIN u ON c.item_id = u.vec_id),
        x AS (SELECT cluster_id, i, sum(e[i]) AS s FROM m, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), z AS (SELECT cluster_id, list(s ORDER BY i) AS z FROM x GROUP BY cluster_id),
        y AS (SELECT m.cluster_id, item_id, round(list_dot_product(e, z) / sqrt(list_dot_product(z, z)), 9) AS score FROM m JOIN z USING (cluster_id))
        SELECT cluster_id, item_id AS representative_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, item_id) AS r FROM y) WHERE r = 1""",
    "cluster_sizes_asof": f"{_CLUSTERS} SELECT item_id, count(*) OVER (PARTITION BY root_id ORDER BY item_id) AS size_asof FROM c",
    "threshold_sensitivity": _SENSITIVITY,
    "threshold_select": "SELECT * FROM (" + _SENSITIVITY + f") WHERE abs(threshold - {0.1 + 0.2!r}) < 1e-9",
    "cluster_table": f"""WITH {_TABLE} SELECT cluster, cluster_size, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at,
        round((epoch(last_at) - epoch(first_at)) / 3600, 6) AS span_hours, domain_count, representative_row, year, split, coalesce(split <> last_split, false) AS crosses_splits FROM part""",
    "split_crossings": f"WITH {_TABLE} SELECT split, count(*) AS clusters, count(*) FILTER (coalesce(split <> last_split, false)) AS crossing FROM part GROUP BY split",
    "size_distribution": f"""WITH {_TABLE} SELECT count(*) AS clusters, count(*) FILTER (cluster_size = 1) AS singletons, count(*) FILTER (cluster_size BETWEEN 2 AND 3) AS size_2_3,
        count(*) FILTER (cluster_size >= 4) AS size_4_plus, max(cluster_size) AS largest, round(avg(cluster_size), 6) AS mean_size, round(quantile_cont(cluster_size, 0.5), 6) AS median_size FROM part""",
    "strata": f"WITH {_STRATA} SELECT year, stratum, count(*) AS n FROM strata GROUP BY ALL",
    "round_robin": f"""WITH {_STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY year, stratum ORDER BY sha256('42:' || cluster), cluster) AS k FROM strata WHERE split IS NOT NULL)
        SELECT year, row_number() OVER (PARTITION BY year ORDER BY k, stratum) AS turn, stratum, cluster FROM r""",
    "counts_by_split": """WITH c AS (SELECT lower(trim(split)) AS split, count(*) AS n FROM select_news_pilot GROUP BY 1)
        SELECT k.split, coalesce(n, 0) AS n FROM (SELECT unnest(['train', 'validation', 'test', 'holdout']) AS split) k LEFT JOIN c ON k.split = c.split""",
    "similar_titles": """WITH w AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'))) AS w, min(row_ix) AS k FROM cluster_news_titles GROUP BY 1),
        h AS (SELECT * FROM w WHERE len(w) > 0), x AS (SELECT k, len(w) AS n, unnest(w) AS t FROM h), s AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.k < b.k GROUP BY ALL)
        SELECT a AS key_a, b AS key_b, round(c / (na + nb - c), 6) AS similarity FROM s WHERE c / (na + nb - c) >= 0.75 - 1e-9""",
    "document_ids": """SELECT row_ix, substr(sha256('["NVDA", "' || coalesce(source_type, '') || '", "' || coalesce(available_date, '') || '", "' || coalesce(document_id, '') || '"]'), 1, 24) AS made_id FROM pipeline_sentiment""",
    "unscored": """SELECT DISTINCT document_id FROM pipeline_documents WHERE document_id IS NOT NULL AND document_id NOT IN
        (SELECT document_id FROM pipeline_sentiment WHERE document_id IS NOT NULL AND trim(coalesce(fingpt_error, '')) = '')""",
    "source_sample": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY source_type, document_id ORDER BY row_ix) AS k FROM pipeline_sentiment WHERE source_type IN ('news', 'earnings_call', 'ten_k')),
        g AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY row_ix) AS r FROM f WHERE k = 1 AND trim(coalesce(text, '')) <> '') SELECT row_ix, source_type, document_id FROM g WHERE r <= 10""",
    "candidate_softmax": """WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding[1:3]) AS DOUBLE))) AS e FROM embeddings),
        p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT vec_id, round(p[1], 6) AS p_first, round(list_sort(p)[3] - list_sort(p)[2], 6) AS margin FROM p""",
    "stream_daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "trust_tiers": """SELECT CASE WHEN trim(coalesce(domain, '')) = '' THEN 4 ELSE 3 END AS tier, count(*) AS n, CAST(sum(length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g'))) AS BIGINT) AS letters
        FROM cluster_news_titles GROUP BY 1""",
    "opposed_clusters": "WITH h AS (SELECT lower(trim(domain)) AS cluster, regexp_extract_all(lower(coalesce(title, '')), '[a-z]+') AS w FROM cluster_news_titles WHERE domain IS NOT NULL),"
    " g AS (SELECT cluster, "
    + ", ".join(f"count(*) FILTER (list_contains(w, '{x}')) AS a{i}, count(*) FILTER (list_contains(w, '{y}')) AS b{i}, count(*) FILTER (list_contains(w, '{x}') AND list_contains(w, '{y}')) AS c{i}" for i, (x, y) in enumerate(OPPOSITES))
    + " FROM h GROUP BY cluster) SELECT cluster FROM g WHERE "
    + " OR ".join(f"(a{i} > 0 AND b{i} > 0 AND NOT (a{i} = 1 AND b{i} = 1 AND c{i} = 1))" for i in range(len(OPPOSITES))),
    "previews": r"""WITH e AS (SELECT row_ix, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) AS e FROM inspect_text_datasets)
        SELECT row_ix, CASE WHEN length(e) > 240 THEN substr(e, 1, 240) || '…' ELSE e END AS preview FROM e""",
    "html_bodies": r"""SELECT row_ix, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body
        FROM pipeline_documents WHERE text IS NOT NULL""",
    "extraction_check": f"{_EXTRACTED} SELECT row_ix, CASE WHEN error = '' THEN sentiment END AS sentiment, CASE WHEN error = '' THEN 'other' END AS event_type, error FROM x",
    "multidimensional_means": f"""WITH {SCORED_SQL}, x AS (SELECT row_ix, NOT regexp_full_match(substr(text, 1, 20), '\\s*') AND row_ix % 11 <> 0 AS ok FROM scored WHERE text IS NOT NULL)
        SELECT count(*) AS records, count(*) FILTER (ok) AS valid, """
    + ", ".join(f"round(avg((row_ix * {k}) % {high - low + 1} + {low}) FILTER (ok), 6) AS mean_{name}" for k, (name, (low, high)) in enumerate(validate.RANGES.items(), 1))
    + ", "
    + ", ".join(f"count(*) FILTER (ok AND row_ix % {len(validate.EVENTS)} = {i}) AS events_{e}" for i, e in enumerate(validate.EVENTS))
    + " FROM x",
    "address_statistics": f"""WITH {_TABLE}, a AS (SELECT p.cluster, p.split, count(DISTINCT nullif(trim(h.url), '')) AS urls, bool_or(h.row_ix = p.representative_row AND trim(h.url) <> '') AS own,
        bool_or(trim(h.url) <> '' AND coalesce(lower(trim(h.domain)), '') <> coalesce((SELECT lower(trim(d.domain)) FROM cluster_news_titles d WHERE d.row_ix = p.representative_row), '')) AS other
        FROM part p JOIN held h ON h.cluster = p.cluster GROUP BY p.cluster, p.split, p.representative_row)
        SELECT split, count(*) AS clusters, count(*) FILTER (urls > 0) AS with_address, count(*) FILTER (own) AS with_own, count(*) FILTER (urls > 1) AS with_second, count(*) FILTER (other) AS with_other_domain FROM a GROUP BY split""",
    "address_slots": f"""WITH {_TABLE}, h AS (SELECT cluster, row_ix, trim(url) AS url, lower(trim(coalesce(domain, ''))) AS domain, row_number() OVER (PARTITION BY cluster ORDER BY tier, ts, q DESC, row_ix) AS o FROM held WHERE trim(url) <> ''),
        one AS (SELECT h.* FROM part p JOIN h ON h.cluster = p.cluster AND h.row_ix = p.representative_row),
        two AS (SELECT h.* FROM h LEFT JOIN one ON h.cluster = one.cluster WHERE h.url IS DISTINCT FROM one.url
            QUALIFY row_number() OVER (PARTITION BY h.cluster ORDER BY h.domain IS NOT DISTINCT FROM one.domain, h.o) = 1),
        three AS (SELECT h.* FROM h JOIN two USING (cluster) LEFT JOIN one ON h.cluster = one.cluster WHERE h.url <> two.url AND h.url IS DISTINCT FROM one.url
            QUALIFY row_number() OVER (PARTITION BY h.cluster ORDER BY h.domain = two.domain OR h.domain IS NOT DISTINCT FROM one.domain, h.o) = 1)
        SELECT cluster, 1 AS slot, row_ix, url FROM one UNION ALL SELECT cluster, 2, row_ix, url FROM two UNION ALL SELECT cluster, 3, row_ix, url FROM three""",
    "fetch_ranks": f"""{_CLUSTERS}, m AS (SELECT c.root_id AS cluster_id, c.item_id, u.e FROM c JOIN u ON c.item_id = u.vec_id),
        x AS (SELECT cluster_id, i, sum(e[i]) AS s FROM m, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), z AS (SELECT cluster_id, list(s ORDER BY i) AS z FROM x GROUP BY cluster_id),
        y AS (SELECT m.cluster_id, item_id, e, round(list_dot_product(e, z) / sqrt(list_dot_product(z, z)), 9) AS score FROM m JOIN z USING (cluster_id)),
        rep AS (SELECT cluster_id, item_id AS rid, e AS re FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, item_id) AS r FROM y) WHERE r = 1),
        h AS (SELECT y.cluster_id, item_id, 'https://' || coalesce(d.source, 'x') || '/' || d.ticker AS url, lower(trim(coalesce(d.source, ''))) AS domain,
            row_number() OVER (PARTITION BY y.cluster_id ORDER BY item_id <> rid, round(list_dot_product(e, re), 6) DESC, item_id) AS o
            FROM y JOIN rep USING (cluster_id) LEFT JOIN documents d ON d.doc_id = item_id WHERE d.ticker IS NOT NULL),
        one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY o) = 1),
        two AS (SELECT h.* FROM h JOIN one USING (cluster_id) WHERE h.url <> one.url AND h.domain <> one.domain QUALIFY row_number() OVER (PARTITION BY h.cluster_id ORDER BY h.o) = 1),
        three AS (SELECT h.* FROM h JOIN one USING (cluster_id) JOIN two USING (cluster_id) WHERE h.url NOT IN (one.url, two.url) AND h.domain NOT IN (one.domain, two.domain)
            QUALIFY row_number() OVER (PARTITION BY h.cluster_id ORDER BY h.o) = 1)
        SELECT cluster_id, item_id, 1 AS fetch_rank FROM one UNION ALL SELECT cluster_id, item_id, 2 FROM two UNION ALL SELECT cluster_id, item_id, 3 FROM three""",
}
