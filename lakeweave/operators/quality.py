"""Data-quality rules as rows, and reconciliation of a batch table with a stream's results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.scalar import relative_gap, total

RESULT = ["rule", "value", "threshold", "passed"]


def not_empty(df: DataFrame) -> DataFrame:
    n = F.count("*").cast("double")
    return df.agg(n.alias("value")).select(F.lit("not_empty").alias("rule"), "value", F.lit(1.0).alias("threshold"), (F.col("value") >= 1).alias("passed"))


def key_uniqueness(df: DataFrame, key: list[str], least: float = 1.0) -> DataFrame:
    """Share of distinct keys among rows; NULL is a value like any other. An empty table has share 0."""
    keys = df.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.count("*").alias("_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"))
    value = F.coalesce(F.try_divide(F.col("_keys").cast("double"), F.col("_rows").cast("double")), F.lit(0.0))
    return keys.select(F.lit("key_uniqueness").alias("rule"), value.alias("value"), F.lit(least).alias("threshold")).withColumn("passed", F.col("value") >= F.col("threshold"))


def null_rate(df: DataFrame, columns: list[str], most: float = 0.05) -> DataFrame:
    """The largest share of NULLs among columns, in one pass. An empty table has share 0."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns])
    worst = F.greatest(*[F.col(f"_null_{c}") for c in columns]) if len(columns) > 1 else F.col(f"_null_{columns[0]}")
    value = F.coalesce(F.try_divide(worst.cast("double"), F.col("_rows").cast("double")), F.lit(0.0))
    return counts.select(F.lit("null_rate").alias("rule"), value.alias("value"), F.lit(most).alias("threshold")).withColumn("passed", F.col("value") <= F.col("threshold"))


def latest_entries(ledger: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Of a ledger's rows for the same keys the one written last; rows without keys or value are skipped."""
    fit = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, value]])
    return ledger.where(fit).groupBy(*keys).agg(F.max_by(value, at).alias(value))


def volatility(counts: DataFrame, table: str, day: str, rows: str, most: float = 0.5) -> DataFrame:
    """Each day's row count against the day before it in the ledger: |n - before| / before.

    Without a day before, or with 0 rows then, the rule is skipped: value NULL, passed.
    """
    before = F.lag(rows).over(Window.partitionBy(table).orderBy(day))
    value = F.when(before > 0, F.abs(F.col(rows) - before).cast("double") / before)
    return counts.select(table, day, rows, value.alias("value")).withColumn("passed", F.coalesce(F.col("value") <= most, F.lit(True)))


def suite(df: DataFrame, key: list[str], columns: list[str] | None = None, least_unique: float = 1.0, most_null: float = 0.05) -> DataFrame:
    """All rules of one table as rows; `passed` of all of them is the gate."""
    rules = [not_empty(df), key_uniqueness(df, key, least_unique), null_rate(df, columns or key, most_null)]
    return reduce(DataFrame.unionByName, rules)


def gate(results: DataFrame) -> bool:
    """Whether all rules passed; an empty list of results doesn't pass."""
    n, failed = results.agg(F.count("*"), F.count_if(~F.col("passed"))).first()
    return n > 0 and failed == 0


def reconcile(batch: DataFrame, amount: str, stream: DataFrame, stream_count: str, stream_amount: str, tolerance: float = 0.01) -> DataFrame:
    """(metric, batch, stream, abs_diff, rel_diff, passed) for row counts and amounts.

    An empty stream side has nothing to compare and fails.
    """
    def sides(df: DataFrame, name: str, count, money) -> DataFrame:
        one = df.agg(count.cast("double").alias("count"), money.alias("amount"))
        return one.select(F.explode(F.create_map(F.lit("count"), "count", F.lit("amount"), "amount")).alias("metric", name))

    left = sides(batch, "batch", F.count("*"), F.coalesce(total(amount), F.lit(0.0)))
    right = sides(stream, "stream", F.sum(stream_count), total(stream_amount))
    rows = left.join(right, "metric")
    gap = F.when(F.col("stream").isNotNull(), relative_gap("batch", "stream"))
    return rows.withColumn("abs_diff", F.abs(F.col("stream") - F.col("batch"))).withColumn("rel_diff", gap).withColumn("passed", F.coalesce(F.col("rel_diff") <= tolerance, F.lit(False)))
