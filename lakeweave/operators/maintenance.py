"""Small-file compaction."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from lakeweave.sources.fs import Files

MB = 1 << 20


@dataclass
class Report:
    path: str
    files_before: int
    bytes_before: int
    due: bool
    files_after: int
    bytes_after: int


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back the old folder if a swap was broken off between its two renames; removes what else is left of one."""
    files, old, new = Files(spark), f"{path}.compact_old", f"{path}.compact_new"
    back = files.exists(old) and not files.exists(path)
    if back:
        files.move(old, path)
    for rest in (old, new):
        if files.exists(rest):
            files.delete(rest)
    return back


def compact(spark: SparkSession, path: str, most_files: int = 50, least_mb: float = 8, target_mb: float = 128, dry_run: bool = False) -> Report:
    """Rewrites a Parquet folder with more than most_files files, or files under least_mb on average, into files of about target_mb.

    The new folder is written whole, then swapped in by two renames; if the second fails the first is undone, and
    recover() mends a swap that a crash broke off. Rows stay the same as a multiset. Whether compaction is `due` is
    reported in a dry run as well. A single file is never due.
    """
    recover(spark, path)
    files = Files(spark)
    if not files.exists(path):
        raise FileNotFoundError(path)
    sizes = [n for _, n in files.sizes(path)]
    total = sum(sizes)
    due = len(sizes) > 1 and (len(sizes) > most_files or total / len(sizes) < least_mb * MB)
    if due and not dry_run:
        old, new = f"{path}.compact_old", f"{path}.compact_new"
        spark.read.parquet(path).coalesce(max(1, math.ceil(total / (target_mb * MB)))).write.mode("overwrite").parquet(new)
        files.move(path, old)
        try:
            files.move(new, path)
        except Exception:
            files.move(old, path)
            raise
        files.delete(old)
    after = [n for _, n in files.sizes(path)]
    return Report(path, len(sizes), total, due, len(after), sum(after))


def compact_all(spark: SparkSession, paths: list[str], **options):
    """One report row a folder."""
    rows = [tuple(asdict(compact(spark, p, **options)).values()) for p in paths]
    return spark.createDataFrame(rows, "path string, files_before long, bytes_before long, due boolean, files_after long, bytes_after long")
