"""Daily, cumulative and rolling metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.scalar import half_up, zero_filled


def summary(df: DataFrame, metrics: dict[str, Column], by: list[str | Column] | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Named aggregates over all rows (one row, also of an empty table) or by group; then columns derived from them."""
    out = df.groupBy(*by).agg(*[m.alias(n) for n, m in metrics.items()]) if by else df.agg(*[m.alias(n) for n, m in metrics.items()])
    for name, c in (derived or {}).items():
        out = out.withColumn(name, c)
    return out


def cumulative(
    sides: list[tuple[DataFrame, Column | None, dict[str, Column]]], key: str, as_of: str, fill: list[str], derived: dict[str, Column] | None = None, partition_day: str | None = None, exclusive: bool = False
) -> DataFrame:
    """Metrics by key over everything up to a day, of several tables side by side.

    sides: (table, day column or None, metrics). Rows count up to and including as_of, or before it if exclusive. If
    partition_day names a partition column whose values are the rows' days, it is filtered too, so that later
    partitions aren't read. Sides meet in a full outer join on the key; NULL keys of two sides stay two rows. Counts
    and sums in `fill` are 0 where a side has no rows.
    """
    out = None
    end = F.to_date(F.lit(as_of))
    for df, on, metrics in sides:
        if partition_day:
            df = df.where(F.col(partition_day).cast("date") <= end)
        if on is not None:
            df = df.where(on < end if exclusive else on <= end)
        one = df.groupBy(key).agg(*[m.alias(n) for n, m in metrics.items()])
        out = one if out is None else out.join(one, key, "full_outer")
    out = out.withColumns({c: zero_filled(c) for c in fill})
    for name, c in (derived or {}).items():
        out = out.withColumn(name, c)
    return out


def rolling(daily: DataFrame, day: str, sums: dict[str, str], days: int = 7, calendar: bool = False, by: list[str] | None = None) -> DataFrame:
    """Sums over the last `days` rows of a daily series, or calendar days, the row itself included.

    By rows, a missing day widens the span; by calendar it doesn't. The series has one row a day and group, so a
    group's rows fit a task for any span of days.
    """
    w = Window.partitionBy(*(by or [])).orderBy(day if not calendar else F.datediff(F.col(day), F.to_date(F.lit("1970-01-01"))))
    w = w.rangeBetween(1 - days, 0) if calendar else w.rowsBetween(1 - days, 0)
    return daily.withColumns({name: F.sum(c).over(w) for c, name in sums.items()})


def change(daily: DataFrame, day: str, value: str, name: str, digits: int = 4, by: list[str] | None = None) -> DataFrame:
    """Relative change against the row before, whose value counts as at least 1; NULL in the first row."""
    before = F.lag(value, 1).over(Window.partitionBy(*(by or [])).orderBy(day))
    return daily.withColumn(name, F.when(before.isNotNull(), half_up((F.col(value) - before).cast("double") / F.greatest(before, F.lit(1)), digits)))


def enriched(facts: DataFrame, history: DataFrame, key: str, take: dict[str, str], fill: object = 0) -> DataFrame:
    """facts with history columns under new names, filled where the key has no history."""
    side = history.select(F.col(key).alias("_key"), *[F.col(a).alias(f"_take_{b}") for a, b in take.items()])
    joined = facts.join(side, F.col(key) == F.col("_key"), "left")
    return joined.select(*facts.columns, *[F.coalesce(F.col(f"_take_{b}"), F.lit(fill).cast(history.schema[a].dataType)).alias(b) for a, b in take.items()])
