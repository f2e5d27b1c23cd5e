"""Streams of records: daily counts with a watermark, first sightings, and running cluster sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from asofkit.session import checkpoint_dir


def daily_counts(stream: DataFrame, ts: str, kind: str, late: str = "2 days") -> DataFrame:
    """Counts by day and kind; records later than the watermark are dropped, as a stream must at some time."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str = "3 days") -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_sizes(stream: DataFrame, group: str, ts: str, idle: str = "3 days") -> DataFrame:
    """Per group and batch the number of records so far and the last time; state of a group idle beyond the watermark is dropped."""

    held = stream.withWatermark(ts, idle).select(F.col(group).cast("string").alias("g"), F.col(ts), F.unix_millis(ts).alias("t"))
    wait = int(stream.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {idle})")).first()[0])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for f in frames:
            n += len(f)
            last = max(last, int(f["t"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"g": [None if key[0] is None else str(key[0])], "n": [n], "last_ms": [last]})

    return held.groupBy("g").applyInPandasWithState(step, "g string, n long, last_ms long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what is there and reads what it wrote, in a folder of its own beside the checkpoints."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/data").awaitTermination()
    else:
        def whole(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/data")

        out.writeStream.outputMode(mode).foreachBatch(whole).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/data")
