"""Tumbling event-time aggregates, the same plan over a batch and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, metrics: dict[str, Column], delay: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(window_start, window_end, metrics) of windows [start, end). Rows without a time belong to none.

    delay: a watermark, for streams: in append mode a window is written once the watermark has passed its end, and
    rows later than that are dropped; windows not yet passed stay in state. In complete mode every window is written
    and nothing is dropped or evicted, which is what a bounded stream needs to equal the batch.
    """
    kind = dict(df.dtypes)[ts]
    if kind != "timestamp":  # watermarks need an instant
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    df = df.where(F.col(ts).isNotNull())
    if delay is not None:
        df = df.withWatermark(ts, delay)
    out = df.groupBy(F.window(ts, size).alias("w"), *(by or [])).agg(*[m.alias(n) for n, m in metrics.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), *metrics)


def formatted(df: DataFrame, start: str = "yyyy-MM-dd HH:mm:ss", end: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Window bounds as text."""
    return df.withColumn("window_start", F.date_format("window_start", start)).withColumn("window_end", F.date_format("window_end", end))


def closed(df: DataFrame, latest: Column, delay: str) -> DataFrame:
    """The windows that an append-mode stream has written when `latest` is the latest time it has seen."""
    return df.where(F.col("window_end") <= latest - F.expr(f"interval {delay}"))
