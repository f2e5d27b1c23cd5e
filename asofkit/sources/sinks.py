"""Writers: verified replacement, single files, nested values as JSON, keyed results, manifests and reports."""

from __future__ import annotations

import hashlib
import html
import json
import math
import os
import tempfile
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.operators.dedup import same_frame
from asofkit.operators.metrics import latest_of
from asofkit.session import cut


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """Writes to a staging folder beside `path`, reads it again, compares all rows both ways, and only then takes its place; the last version stays as `.backup`."""
    df, staging = cut(df), f"{path}.staging-{uuid.uuid4().hex}"  # made once, as what is not deterministic would differ
    df.write.parquet(staging)
    spark = df.sparkSession
    if not same_frame(spark.read.parquet(staging), df):
        raise ValueError("what was written isn't what was meant")
    jvm = spark.sparkContext._jvm
    place, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, f"{path}.backup"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        fs.delete(old, True)
        fs.rename(place, old)
    fs.rename(new, place)
    return spark.read.parquet(path)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for files without nested values."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, doubled quotes, nested values as JSON."""
    nested_as_json(df).write.option("header", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed results: a new row's values that aren't null replace the old ones."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns))


def latest_results(results: DataFrame, key: str, order: str) -> DataFrame:
    return latest_of(results, [key], order)


def _clean(value):
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number that isn't finite has no JSON")
    if isinstance(value, dict):
        return {str(k): _clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_clean(v) for v in value]
    return value


def save_json(path: str | Path, value) -> None:
    """Whole or not at all; NaN is an error."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        json.dump(_clean(value), f, ensure_ascii=False, indent=2, allow_nan=False, default=str)
    os.replace(f.name, path)


def file_hash(path: str | Path) -> str:
    """SHA-256 of a file, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def files_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the data files of a folder, each hashed where it lies."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.sha2("content", 256).alias("h")).orderBy("h").collect()
    return hashlib.sha256("".join(r["h"] for r in parts).encode()).hexdigest()


def run_folder(root: str | Path) -> Path:
    """A new folder named by time and chance; an error if it exists."""
    made = Path(root) / f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    made.mkdir(parents=True, exist_ok=False)
    return made


def apart(output: str | Path, inputs: list[str | Path]) -> None:
    """An error if the output lies in, on or around an input, links followed."""
    out = Path(output).resolve()
    for i in inputs:
        p = Path(i).resolve()
        if out == p or out in p.parents or p in out.parents:
            raise ValueError(f"{out} overlaps {p}")


_HIDDEN = ("daily_counts", "weekly_counts", "content_lengths_by_row")


def visible(report: dict) -> dict:
    """A report without per-row and per-day values."""
    return {k: visible(v) if isinstance(v, dict) else v for k, v in report.items() if k not in _HIDDEN}


def flat(report: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in report.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def report_markdown(title: str, tables: dict[str, DataFrame], most_rows: int = 200) -> str:
    """Small result tables as Markdown; more than `most_rows` rows are an error, not cut."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} isn't a small table")
        cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]
    return "\n".join(out)


def report_html(title: str, tables: dict[str, DataFrame], most_rows: int = 200) -> str:
    """Small result tables as HTML, escaped."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} isn't a small table")
        cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in r) + "</tr>"
        parts.append(f"<h2>{html.escape(name)}</h2><table>{cells(df.columns, 'th')}{''.join(cells(r, 'td') for r in rows)}</table>")
    return "\n".join(parts)
