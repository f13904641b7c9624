"""Versioned tables: immutable snapshots, each visible once its manifest is there."""

from __future__ import annotations

import datetime
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators.merge import upsert

from .fs import Files, checked_name

HISTORY = "snapshot_id string, parent_id string, committed_at string, operation string, merge_keys array<string>, row_count long, format string"


class SnapshotStore:
    """Tables below one folder: {table}/snapshots/{id}/data and manifest.json; one writer at a time.

    The manifest is the commit: it is written beside its place and renamed, and snapshots without one don't exist
    for readers. allowed: names of the tables that may be stored, any plain name if None.
    """

    def __init__(self, spark: SparkSession, root: str, allowed: set[str] | None = None):
        self.spark, self.root, self.allowed, self.files = spark, root.rstrip("/"), allowed, Files(spark)

    def folder(self, table: str) -> str:
        if self.allowed is not None and table not in self.allowed:
            raise ValueError(f"{table!r} is no managed table")
        return f"{self.root}/{checked_name(table)}/snapshots"

    def ids(self, table: str) -> list[str]:
        at = self.folder(table)
        return sorted((n for n in self.files.names(at) if n.isdigit() and self.files.exists(f"{at}/{n}/manifest.json")), key=int)

    def current(self, table: str) -> str | None:
        return (self.ids(table) or [None])[-1]

    def manifest(self, table: str, snapshot: str) -> dict:
        return json.loads(self.files.read(f"{self.folder(table)}/{checked_name(snapshot)}/manifest.json"))

    def path(self, table: str, snapshot: str | None = None, as_of: str | None = None, version: int | None = None) -> str:
        """Data of the current snapshot, of one by id, the last up to a time (ISO, UTC), or the n-th from 0."""
        ids = self.ids(table)
        if as_of is not None:
            ids = [i for i in ids if self.manifest(table, i)["committed_at"] <= as_of]
        if version is not None:
            ids = ids[version : version + 1]
        got = (snapshot if snapshot in ids else None) if snapshot is not None else (ids or [None])[-1]
        if got is None:
            raise FileNotFoundError(f"{table} has no such snapshot")
        return f"{self.folder(table)}/{got}/data"

    def read(self, table: str, snapshot: str | None = None, as_of: str | None = None, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(table, snapshot, as_of, version))

    def commit(self, table: str, df: DataFrame, operation: str = "overwrite", keys: list[str] | None = None) -> str:
        """Writes a snapshot and then its manifest; the row count is taken while writing."""
        parent = self.current(table)
        new = str(max(time.time_ns() // 1_000_000, int(parent or 0) + 1))
        at = f"{self.folder(table)}/{new}"
        from pyspark.sql import Observation

        seen = Observation(f"rows-{new}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{at}/data")
        now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds")
        self.files.write(f"{at}/manifest.json", json.dumps({"snapshot_id": new, "parent_id": parent, "committed_at": now, "operation": operation, "merge_keys": keys or [], "row_count": seen.get["rows"], "format": "parquet"}))
        return new

    def merge(self, table: str, incoming: DataFrame, keys: list[str], replace: bool = False) -> str:
        """Upserts into the current snapshot; the result is a new one."""
        current = self.read(table) if self.current(table) else None
        return self.commit(table, upsert(current, incoming, keys, replace), "merge", keys)

    def history(self, table: str) -> DataFrame:
        """The manifests, newest first."""
        rows = [self.manifest(table, i) for i in reversed(self.ids(table))]
        names = [x.split()[0] for x in HISTORY.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], HISTORY)
