"""Slowly changing dimensions: versioned rows [start_date, end_date], both inclusive, and joins as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.scalar import any_of

OPEN_END = "9999-12-31"


def first_versions(snapshot: DataFrame, key: str, attributes: list[str], dt: str) -> DataFrame:
    """Every row of a first snapshot becomes an open version from dt on."""
    return snapshot.select(key, *attributes, F.to_date(F.lit(dt)).alias("start_date"), F.to_date(F.lit(OPEN_END)).alias("end_date"))


def apply_snapshot(
    history: DataFrame | None, snapshot: DataFrame, key: str, attributes: list[str], dt: str,
    tracked: list[str] | None = None, null_safe: bool = False, close_missing: bool = False,
) -> DataFrame:
    """A day's full snapshot merged into the version history (key, attributes, start_date, end_date).

    A key without an open version gets one from dt. A key whose tracked attributes differ has its open version closed
    at dt - 1 and a new one opened; a change of other attributes makes no version. NULL against a value is a change
    only if null_safe. Keys missing from the snapshot stay open, or are closed if close_missing. Closed versions pass
    through. A version that began on dt itself is replaced, so the same day may be run again, with other attributes
    too; a day before an open version's start raises an error. One full outer join on the key: one shuffle a side.
    """
    if history is None:
        return first_versions(snapshot, key, attributes, dt)
    tracked = tracked or attributes
    columns = [key, *attributes, "start_date", "end_date"]
    history = history.select(*columns)
    today, forever = F.to_date(F.lit(dt)), F.to_date(F.lit(OPEN_END))
    old = history.where(F.col("end_date") == forever).select(F.struct(*columns).alias("old"))
    new = snapshot.select(F.struct(key, *attributes, today.alias("start_date"), forever.alias("end_date")).alias("new"))
    pairs = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    differs = [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) if null_safe else F.coalesce(F.col(f"old.{c}") != F.col(f"new.{c}"), F.lit(False)) for c in tracked]
    late = F.when(F.col("old.start_date") > today, F.raise_error(F.concat(F.lit("snapshot of "), today.cast("string"), F.lit(" comes after a later one")).cast("string")).cast("boolean")).otherwise(F.lit(False))
    closed = F.struct(*[F.col(f"old.{c}").alias(c) for c in columns[:-1]], F.date_sub(today, 1).alias("end_date"))
    versions = (
        F.when(F.col("old").isNull(), F.array("new"))
        .when(late, F.array("old"))
        .when(F.col("new").isNull(), F.array(closed) if close_missing else F.array("old"))
        .when(~any_of(differs), F.array("old"))
        .when(F.col("old.start_date") == today, F.array("new"))
        .otherwise(F.array(closed, "new"))
    )
    merged = pairs.select(F.explode(versions).alias("v")).select("v.*")
    return history.where(F.col("end_date") != forever).unionByName(merged)


def open_versions(history: DataFrame) -> DataFrame:
    return history.where(F.col("end_date") == F.to_date(F.lit(OPEN_END)))


def as_of_join(facts: DataFrame, history: DataFrame, key: str, on: Column, take: dict[str, str], history_key: str | None = None) -> DataFrame:
    """facts with columns of the version that was valid on a day, both ends included; without one they are NULL.

    take: {column of the history: its name in the result}. Overlapping versions give a row each. The key is an
    equality, the days a residual condition, so Spark joins by hash, or by sort and merge beyond its own size check
    for broadcasts.
    """
    side = history.select(F.col(history_key or key).alias("_key"), F.col("start_date").alias("_start"), F.col("end_date").alias("_end"), *[F.col(a).alias(f"_take_{b}") for a, b in take.items()])
    joined = facts.withColumn("_on", on).join(side, (F.col(key) == F.col("_key")) & (F.col("_on") >= F.col("_start")) & (F.col("_on") <= F.col("_end")), "left")
    return joined.select(*[F.col(c) for c in facts.columns], *[F.col(f"_take_{b}").alias(b) for b in take.values()])
