"""Key-based upserts, unions and skew-aware sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.scalar import all_of


def upsert(current: DataFrame | None, incoming: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """Incoming rows over current ones with the same keys; all others stay.

    An incoming NULL keeps the current value, unless replace, which takes matched rows as they come. Columns are the
    keys, then current's others; more columns of incoming are left out, missing ones are an error. NULL keys match
    nothing. A key that comes twice gives two rows. Without a current table incoming is the result as it is.
    """
    if current is None:
        return incoming
    others = [c for c in current.columns if c not in keys]
    gone = [c for c in [*keys, *others] if c not in incoming.columns]
    if gone:
        raise ValueError(f"incoming rows have no {', '.join(gone)}")
    old = current.select(F.struct(*keys, *others).alias("old"))
    new = incoming.select(F.struct(*keys, *others).alias("new"))
    pairs = old.join(new, all_of([F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]), "full_outer")

    def value(c: str) -> Column:
        if replace and c in others:
            return F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        return F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))

    return pairs.select(*[value(c).alias(c) for c in [*keys, *others]])


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows, columns matched by name in the first table's order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.select(*out.columns))
    return out


def keyed_sum(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """One shuffle; map-side partial sums already take a hot key down to a row a task."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def salted_sum(df: DataFrame, key: str, value: Column, name: str, salts: int = 16, spread: list[str] | None = None) -> DataFrame:
    """The same sums in two phases, by (key, salt) and by key. The salt hashes `spread` columns (or the whole row), so a task that is run again deals out the same rows."""
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(salts))
    first = df.groupBy(key, salt.alias("_salt")).agg(F.sum(value).alias("_part"))
    return first.groupBy(key).agg(F.sum("_part").alias(name))


def sampled(df: DataFrame, n: int, *by: str) -> DataFrame:
    """n rows in order of a stable hash of the given columns: the same rows on every run."""
    from lakeweave.functions.scalar import stable_hash

    return df.orderBy(stable_hash(*by), *by).limit(n)
