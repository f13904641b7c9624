"""Keyed lookups over the warehouse's tables, as a service or a dashboard asks them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators.dimensions import open_versions
from lakeweave.sources import readers
from lakeweave.sources.fs import Files


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def daily(df: DataFrame, day: str, value: str) -> DataFrame:
    """A day's row of a daily table."""
    return df.where(F.col(day).cast("date") == F.to_date(F.lit(value)))


def newest(df: DataFrame, order: list[str | Column], n: int = 1, **keys: object) -> DataFrame:
    """The last rows that a key has, by partition or time; top-k, no full sort."""
    return by_key(df, **keys).orderBy(*[(F.col(c) if isinstance(c, str) else c).desc() for c in order]).limit(n)


def newest_partition(spark: SparkSession, root: str, order: list[str | Column] | None = None, n: int = 1, **keys: object) -> DataFrame:
    """The last rows of a key in the newest day's partition that has any, with its `dt`.

    Partitions are asked one by one from the newest on, each by its own path and with the key pushed down to the scan,
    until one answers; older ones aren't touched. A key of no partition gives no rows, as does a root without any.
    """
    days = sorted((x.removeprefix("dt=") for x in Files(spark).names(root) if x.startswith("dt=") and x != "dt=__HIVE_DEFAULT_PARTITION__"), reverse=True)
    found = None
    for day in days:
        found = by_key(readers.leaf(spark, root, day), **keys).withColumn("dt", F.lit(day))
        found = newest(found, order or ["dt"], n)
        if not found.isEmpty():
            return found
    return found if found is not None else spark.createDataFrame([], "dt string")


def newest_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """For every key its last row, by partial aggregation."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def current_version(history: DataFrame, **keys: object) -> DataFrame:
    return by_key(open_versions(history), **keys)


class Cache:
    """Tables kept in memory for some seconds by name; an older one is read anew."""

    def __init__(self, seconds: float = 60, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.kept = seconds, clock, {}

    def get(self, name: str, load: Callable[[], DataFrame]) -> DataFrame:
        at, df = self.kept.get(name, (None, None))
        if at is None or self.clock() - at >= self.seconds:
            if df is not None:
                df.unpersist()
            df = load().cache()
            self.kept[name] = (self.clock(), df)
        return df

    def health(self) -> dict:
        return {"status": "ok", "cached": len(self.kept)}
