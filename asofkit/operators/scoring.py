"""Pluggable scorers, and the result cache that lets a run go on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.functions.text import chunks_udf


class Scorer(Protocol):
    """Scores a batch of texts: label, score, raw_output and error of each. A failed text has an error and no label."""

    def score(self, texts: list[str]) -> pd.DataFrame: ...


class WordScorer:
    """A deterministic scorer without a model: positive less negative words over both."""

    def __init__(self, positive: str = r"\b(?:rose|jumped|climbed|advanced|improved|record|growth|beat|approved|lifted)\b", negative: str = r"\b(?:fell|dropped|slid|declined|eased|lost|lawsuit|warns|halts|cuts|misses)\b"):
        self.positive, self.negative = positive, negative

    def score(self, texts: list[str]) -> pd.DataFrame:
        s = pd.Series(texts, dtype=object)
        up, down = s.str.count(self.positive), s.str.count(self.negative)
        score = ((up - down) / (up + down).where(up + down > 0, 1)).astype(float)
        blank = s.str.strip() == ""
        label = pd.Series("neutral", index=s.index, dtype=object).mask(score > 0, "positive").mask(score < 0, "negative")
        return pd.DataFrame({"label": label.mask(blank, None), "score": score.mask(blank), "raw_output": label.mask(blank, ""), "error": pd.Series("", index=s.index, dtype=object).mask(blank, "blank text")})


def scored(df: DataFrame, key: str, text: str, make: Callable[[], Scorer] = WordScorer) -> DataFrame:
    """`key`, label, score, raw_output, error of each row; the scorer is made once per task. A batch that fails is scored row by row, so one row fails alone. Null text is an error."""
    types = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["t"]]
            try:
                out = scorer.score(texts)
            except Exception:
                parts = []
                for t in texts:
                    try:
                        parts.append(scorer.score([t]))
                    except Exception as e:
                        parts.append(pd.DataFrame({"label": [None], "score": [None], "raw_output": [""], "error": [f"{type(e).__name__}: {e}"]}))
                out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["label", "score", "raw_output", "error"])
            out.insert(0, "k", frame["k"].to_numpy())
            yield out

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {types[key]}, label string, score double, raw_output string, error string").withColumnRenamed("k", key)


def to_score(wanted: DataFrame, cache: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    """The rows without a cached result; with `retry_errors` a cached error is none."""
    have = cache.filter(F.trim(F.coalesce("error", F.lit(""))) == "") if retry_errors else cache
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def chunk_scores(df: DataFrame, key: str, text: str, make: Callable[[], Scorer] = WordScorer, most_chars: int = 1800, most_tokens: int = 512) -> DataFrame:
    """document_id, chunk_ix, score, error of the pieces of each text; a blank or null text is one piece with an error."""
    parts = df.select(F.col(key).alias("document_id"), F.posexplode_outer(chunks_udf(most_chars, most_tokens)(F.col(text))).alias("chunk_ix", "chunk"))
    held = parts.withColumn("piece", F.struct("document_id", F.coalesce("chunk_ix", F.lit(0)).alias("chunk_ix"))).withColumn("chunk", F.coalesce("chunk", F.lit("")))
    out = scored(held, "piece", "chunk", make)
    return out.select("piece.document_id", "piece.chunk_ix", "score", "error")
