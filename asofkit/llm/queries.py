"""Queries on the training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import abuse, lookalikes, mainbody, mixing, near_duplicates, pieces, quotas, splits, tokens
from asofkit.session import cut, table


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "pipeline_documents"), table(spark, folder, "outlet_zones")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.judged(*_pages(spark, folder)).filter("NOT main").select("row_ix", "line_no")


def p1_main(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.main_text(*_pages(spark, folder))


def p1_votes(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each class the vote on paths decides."""
    return mainbody.vote_counts(*_pages(spark, folder))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.host_paths(mainbody.read_pages(*_pages(spark, folder), wordings=True))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, folder, "cluster_news_titles"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, folder, "cluster_news_titles"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.same_reading_pairs(table(spark, folder, "cluster_news_titles"))


def p7_normalized(spark: SparkSession, folder: str) -> DataFrame:
    forms = {"title": "title_form", "normalized_title": "normalized_title_form"}
    return lookalikes.with_forms(table(spark, folder, "cluster_news_titles"), forms, ["row_ix"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"), ["doc_id"], "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def _pilot(spark: SparkSession, folder: str, targets: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "select_news_pilot"), table(spark, folder, targets)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.unfilled(*_pilot(spark, folder, "pilot_targets"))


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.sample(*_pilot(spark, folder, "pilot_targets"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.report(*_pilot(spark, folder, "pilot_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leaking(table(spark, folder, "select_news_pilot"))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assigned(*_pilot(spark, folder, "split_targets"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.report(*_pilot(spark, folder, "split_targets"))


def _oversized_tables(spark: SparkSession, folder: str) -> DataFrame:
    named = (("pipeline_sentiment", "text"), ("inspect_text_datasets", "content"))
    a, b = (table(spark, folder, t).select(F.lit(t).alias("source_table"), "row_ix", F.col(c).alias("text")) for t, c in named)
    return a.unionByName(b)


def _limits() -> Column:
    return F.when(F.col("source_table") == "pipeline_sentiment", 1800).otherwise(4000)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.oversized(_oversized_tables(spark, folder), ["source_table", "row_ix"], _limits()).select("source_table", "row_ix")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_items(_oversized_tables(spark, folder), ["source_table", "row_ix"], _limits())


def _model(spark: SparkSession, folder: str) -> abuse.Model:
    return abuse.fit(abuse.labelled_documents(table(spark, folder, "documents"), table(spark, folder, "abuse_labels")))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scored(table(spark, folder, "documents"), _model(spark, folder))


def p10_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 by language on labelled documents, by fits that left them out."""
    return abuse.held_out_figures(_model(spark, folder), spark)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter("abusive").select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(_scored(spark, folder))


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sample is as large as is wanted or there is, has each sample_id once, and takes from no cell more than is there, nor, if all floors fit in the sample, less than its floor where there is as much."""
    sample, cells = p2_sample(spark, folder), p2_report(spark, folder)
    taken = cells.join(sample.groupBy(*quotas.CELL).agg(F.count("*").alias("taken")), quotas.CELL, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    wrong, short, floor = (F.col("taken") > F.col("available")) | (F.col("taken") != F.col("quota")), F.col("taken") < F.least("min_rows", "available"), F.least("min_rows", "available")
    counts = taken.agg(F.count_if(wrong).alias("wrong"), F.count_if(short).alias("short"), F.sum(floor).alias("floors"))
    drawn = sample.agg(F.count("*").alias("rows_drawn"), F.count_distinct("sample_id").alias("ids_drawn")).crossJoin(counts)  # one row each
    return drawn.select("rows_drawn", "ids_drawn", (F.col("wrong") + F.when(F.col("floors") <= F.col("rows_drawn"), F.col("short")).otherwise(0)).alias("wrong_cells"))


def p4_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of each item the length its pieces cover, overlaps aside, and whether all pieces are within the limit and overlap by 200 characters."""
    found = p4_pieces(spark, folder).withColumn("_limit", _limits())
    each = found.groupBy("source_table", "row_ix").agg(
        (F.sum(F.length("piece")) - 200 * (F.count("*") - 1)).alias("covered"), F.max(F.length("piece") > F.col("_limit")).alias("over"),
        F.max(F.length("piece") != F.col("end") - F.col("start")).alias("off"), (F.max("end") - F.sum(F.col("end") - F.col("start")) + 200 * (F.count("*") - 1) != 0).alias("gap"),
    )
    return each.select("source_table", "row_ix", "covered", (~F.col("over") & ~F.col("off") & ~F.col("gap")).alias("as_asked"))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Records that got a split, stories and addresses in more than one split, and splits further than a hundredth of all records from their share."""
    got = p6_splits(spark, folder).select("row_ix", "new_split")
    rows = table(spark, folder, "select_news_pilot").select("row_ix", F.nullif(F.lower(F.trim("preliminary_cluster_id")), F.lit("")).alias("story"), F.nullif(F.trim("representative_url"), F.lit("")).alias("address"))
    held = cut(rows.join(got.hint("merge"), "row_ix"))
    torn = [held.filter(F.col(c).isNotNull()).groupBy(c).agg((F.min("new_split") < F.max("new_split")).alias("torn")).agg(F.count_if("torn").alias(n)) for c, n in (("story", "torn_stories"), ("address", "torn_addresses"))]
    sizes = table(spark, folder, "split_targets").join(held.groupBy(F.col("new_split").alias("split")).agg(F.count("*").alias("n")), "split", "left").crossJoin(held.agg(F.count("*").alias("total")))
    off = sizes.agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("total")) > 0.01 * F.col("total")).alias("splits_off"))
    return held.agg(F.count("new_split").alias("records")).crossJoin(torn[0]).crossJoin(torn[1]).crossJoin(off)


QUERIES = {f.__name__: f for f in (p1_found, p1_main, p1_votes, p1_paths, p2_found, p2_sample, p2_report, p2_check, p3_found, p3_groups, p4_found, p4_pieces, p4_check, p6_found, p6_splits, p6_report, p6_check, p7_found, p7_normalized, p8_ids, p9_found, p9_mix, p9_shares, p10_found, p10_scores, p10_rates, p10_held_out)}
_CATEGORY = "nullif(lower(trim({0})), '')"

ORACLES: dict[str, str] = {
    "p2_found": f"""
        WITH pool AS (
            SELECT {_CATEGORY.format("split")} AS split, year(try_cast(nullif(trim(published_at), '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC') AS pub_year,
                   {_CATEGORY.format("selection_reason")} AS selection_reason, sample_id FROM select_news_pilot),
        counts AS (SELECT split, pub_year, selection_reason, count(DISTINCT sample_id) AS n FROM pool GROUP BY ALL)
        SELECT t.split, t.pub_year, t.selection_reason FROM pilot_targets t
        LEFT JOIN counts c ON {_CATEGORY.format("t.split")} = c.split AND t.pub_year = c.pub_year AND {_CATEGORY.format("t.selection_reason")} = c.selection_reason
        WHERE coalesce(c.n, 0) < greatest(CAST(t.min_rows AS DOUBLE), t.target_share * t.sample_rows)""",
    "p4_found": """
        SELECT 'pipeline_sentiment' AS source_table, row_ix FROM pipeline_sentiment
        WHERE length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) > 1800
        UNION ALL
        SELECT 'inspect_text_datasets', row_ix FROM inspect_text_datasets
        WHERE length(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))) > 4000""",
    "p2_check": f"""
        WITH pool AS (SELECT {_CATEGORY.format("split")} AS split, year(try_cast(nullif(trim(published_at), '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC') AS pub_year, {_CATEGORY.format("selection_reason")} AS selection_reason, sample_id FROM select_news_pilot),
        there AS (SELECT count(DISTINCT sample_id) AS n FROM pool JOIN pilot_targets t ON pool.split = {_CATEGORY.format("t.split")} AND pool.pub_year = t.pub_year AND pool.selection_reason = {_CATEGORY.format("t.selection_reason")}),
        wanted AS (SELECT least(n, (SELECT max(sample_rows) FROM pilot_targets)) AS n FROM there) SELECT CAST(n AS BIGINT) AS rows_drawn, CAST(n AS BIGINT) AS ids_drawn, CAST(0 AS BIGINT) AS wrong_cells FROM wanted""",
    "p4_check": """
        WITH c AS (SELECT 'pipeline_sentiment' AS source_table, row_ix, length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS covered FROM pipeline_sentiment
            UNION ALL SELECT 'inspect_text_datasets', row_ix, length(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))) FROM inspect_text_datasets)
        SELECT source_table, row_ix, covered, true AS as_asked FROM c WHERE covered > 0""",
    "p6_check": "SELECT count(*) AS records, CAST(0 AS BIGINT) AS torn_stories, CAST(0 AS BIGINT) AS torn_addresses, CAST(0 AS BIGINT) AS splits_off FROM select_news_pilot",
    "p6_found": """
        WITH RECURSIVE r AS (SELECT row_ix, nullif(lower(trim(split)), '') AS s, nullif(lower(trim(preliminary_cluster_id)), '') AS c, nullif(trim(representative_url), '') AS u FROM select_news_pilot),
        n AS (SELECT row_ix, 'c' || c AS node FROM r WHERE c IS NOT NULL UNION ALL SELECT row_ix, 'u' || u FROM r WHERE u IS NOT NULL),
        e AS (SELECT DISTINCT 'c' || c AS a, 'u' || u AS b FROM r WHERE c IS NOT NULL AND u IS NOT NULL), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT DISTINCT node AS start, node FROM n UNION SELECT reach.start, both_ways.b FROM reach JOIN both_ways ON reach.node = both_ways.a),
        part AS (SELECT start AS node, min(node) AS part FROM reach GROUP BY start), held AS (SELECT DISTINCT n.row_ix, p.part FROM n JOIN part p ON n.node = p.node),
        torn AS (SELECT part FROM held JOIN r USING (row_ix) GROUP BY part HAVING count(DISTINCT s) > 1)
        SELECT DISTINCT row_ix FROM held WHERE part IN (SELECT part FROM torn)""",
}
