"""Intake as a stream: exact duplicates within a watermark, counts by period, and snapshots that follow micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def event_time(rows: DataFrame) -> DataFrame:
    """``rows`` with at: publication, or fetching where that is unknown."""
    return rows.withColumn("at", F.coalesce("published_at", "fetched_at").cast("timestamp"))


def unique(rows: DataFrame, key: str = "url", lookback: str = "3 days") -> DataFrame:
    """The first row of each key; state is kept for ``lookback``."""
    return rows.withWatermark("at", lookback).dropDuplicatesWithinWatermark([key])


def counts(rows: DataFrame, period: str = "1 day", late: str | None = "3 days", slide: str | None = None) -> DataFrame:
    """start, n of each period (sliding where ``slide`` is given); with ``late`` None, by the watermark that ``rows`` have, as those of ``unique``."""
    by = F.window("at", period, slide) if slide else F.window("at", period)
    rows = rows if late is None else rows.withWatermark("at", late)
    return rows.groupBy(by.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def into(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch to ``step`` (a merge into the next snapshot); batches may come again, so it must be idempotent."""
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
