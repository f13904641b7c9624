"""Column expressions that the operators share; all of them stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: str | Column, digits: int) -> Column:
    """Rounds a double half up, in arithmetic that any engine repeats exactly."""
    return F.floor(col(c) * 10.0**digits + 0.5) / 10.0**digits


def money(c: str | Column) -> Column:
    """A double amount as a decimal of cents, whose sums don't depend on the order of rows."""
    return col(c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    """Sum of amounts, exact in cents, as a double; NULL over no rows."""
    return F.sum(money(c)).cast("double")


def total_where(condition: Column, c: str | Column) -> Column:
    """Sum of amounts of rows that meet a condition; rows that don't count as zero."""
    return F.sum(F.when(condition, money(c)).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double")


def count_where(condition: Column) -> Column:
    """Number of rows that meet a condition; 0 if none do, NULL over no rows."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def mean(c: str | Column, digits: int = 6) -> Column:
    """Average of doubles through an exact decimal sum, so the order of rows doesn't matter."""
    return (F.sum(col(c).cast(f"decimal(28,{digits})")).cast("double") / F.count(col(c))).cast("double")


def ratio(part: str | Column, whole: str | Column, digits: int = 4) -> Column:
    """part over whole, which counts as at least 1 (also if NULL), rounded half up."""
    return half_up(col(part).cast("double") / F.greatest(col(whole), F.lit(1)), digits)


def plain_ratio(part: str | Column, whole: str | Column, digits: int = 4) -> Column:
    """part over whole, NULL where whole is zero or NULL, rounded half up."""
    return half_up(F.try_divide(col(part).cast("double"), col(whole).cast("double")), digits)


def zero_filled(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def bucketize(c: str | Column, steps: list[tuple[float, str]], zero: str | None = None, beyond: str = "rest") -> Column:
    """The label of the first step whose bound the value doesn't exceed; zero has its own label if one is given.

    NULL exceeds every bound and so is `beyond`; negative values fall into the first step.
    """
    out = F.when(col(c) == 0, zero) if zero is not None else None
    for bound, label in steps:
        out = F.when(col(c) <= bound, label) if out is None else out.when(col(c) <= bound, label)
    return out.otherwise(beyond)


def stable_hash(*parts: str | Column) -> Column:
    """The first 48 bits of SHA-256 over the parts joined by '|', as a long: the same on every engine and run."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def surrogate_key(*parts: str | Column) -> Column:
    return F.xxhash64(*[col(p) for p in parts])


def portable_key(*parts: str | Column) -> Column:
    """A surrogate key that other engines can make as well: SHA-256 over the parts joined by '|'."""
    return F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)


def relative_gap(base: str | Column, other: str | Column) -> Column:
    """|other - base| / |base|; with base 0 or NULL it is 0 if other is so too, else 1."""
    b, o = F.coalesce(col(base).cast("double"), F.lit(0.0)), F.coalesce(col(other).cast("double"), F.lit(0.0))
    return F.when(b != 0, F.abs(o - b) / F.abs(b)).otherwise(F.when(o == 0, 0.0).otherwise(1.0))


def day(c: str | Column) -> Column:
    return F.to_date(col(c))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def source_table(expression: str | Column, layers: tuple[str, ...] = ("ods", "dwd", "dws", "ads")) -> Column:
    """layer.table at the start of a lineage expression layer.table.column, or NULL."""
    found = F.regexp_extract(col(expression), rf"^((?:{'|'.join(layers)})\.\w+)\.", 1)
    return F.nullif(found, F.lit(""))
