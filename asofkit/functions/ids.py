"""Identifiers from contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A string as JSON text; null as empty."""
    one = F.to_json(F.array(F.coalesce(value.cast("string"), F.lit(""))))
    return one.substr(F.lit(2), F.length(one) - 2)


def json_list_id(*values: Column, size: int = 24) -> Column:
    """The first hex digits of SHA-256 of a JSON list of strings."""
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *map(json_text, values)), F.lit("]")), 256), 1, size)


def row_payload(df: DataFrame, columns: list[str]) -> Column:
    """A row as compact JSON with its keys in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), json_text(F.col(c))) for c in sorted(columns))), F.lit("}"))


def with_stable_ids(df: DataFrame, columns: list[str], order: str, prefix: str = "news_", name: str = "stable_id") -> DataFrame:
    """df with an id of each row's content and of its number among rows of the same content, in `order`.

    Rows are grouped by the digest of their content; a group is as large as the copies of one row. Copies may be reordered
    without changing the set of ids.
    """
    digest = F.sha2(row_payload(df, columns), 256)
    held = df.withColumn("_payload", row_payload(df, columns)).withColumn("_digest", digest)
    number = F.row_number().over(Window.partitionBy("_digest").orderBy(order))
    named = held.withColumn("occurrence", number)
    made = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat("_payload", F.lit("#occurrence="), F.col("occurrence").cast("string")), 256), 1, 20))
    return named.withColumn(name, made).drop("_payload", "_digest")


def seeded_id(prefix: str, seed: int, key: Column, size: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, size))
