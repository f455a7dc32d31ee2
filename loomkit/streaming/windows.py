"""Tumbling, sliding and session windows with late data, and duplicates within a delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """df with ts as an instant and, on a stream, a watermark (which zoneless times don't take)."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], slide: str | None = None, delay: str | None = None) -> DataFrame:
    """aggs by keys and windows of `size`, each `slide` (or size) after the last; window_start and window_end are columns."""
    grouped = timed(df, ts, delay).groupBy(F.window(ts, size, slide or size), *keys).agg(*aggs)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *grouped.columns[1 + len(keys) :])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    grouped = timed(df, ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *grouped.columns[1 + len(keys) :])


def first_seen(df: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Rows without those whose keys came before; on a stream, state is kept for the delay."""
    df = timed(df, ts, delay)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
