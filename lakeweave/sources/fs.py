"""File operations of the driver through Hadoop's file systems, so that paths may be in any store Spark reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.=-]*")
DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def checked_name(name: str) -> str:
    """A name that may become part of a path: no separators, nothing that leads out of the folder."""
    if not NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a plain name: {name!r}")
    return name


def checked_day(day: str) -> str:
    """A calendar day as yyyy-MM-dd."""
    import datetime

    if not DAY.fullmatch(day):
        raise ValueError(f"not a day as yyyy-MM-dd: {day!r}")
    datetime.date.fromisoformat(day)
    return day


class Files:
    """What a driver does with files besides reading and writing tables."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of all data files below; names that begin with '_' or '.' are no data."""
        fs, p = self._at(path)
        out, todo = [], [p] if fs.exists(p) else []
        while todo:
            for x in fs.listStatus(todo.pop()):
                if x.getPath().getName()[0] in "_.":
                    continue
                if x.isDirectory():
                    todo.append(x.getPath())
                else:
                    out.append((x.getPath().toString(), x.getLen()))
        return sorted(out)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Beside the place first, then renamed: readers see the whole file or none."""
        fs, p = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"{path} can't be written")

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def copy(self, old: str, new: str) -> None:
        """As a stream, so the driver holds a buffer of it at most."""
        (fs, a), (to, b) = self._at(old), self._at(new)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, self.conf)

    def move(self, old: str, new: str) -> None:
        fs, a = self._at(old)
        if not fs.rename(a, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} can't be moved to {new}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


_own: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder, in local mode alone, since executors elsewhere don't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='lakeweave-')}")
    return base.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below shared_base()."""
    return f"{shared_base(spark)}/{checked_name(name)}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
