"""What the corpus operators share: the cluster's shared folder, written tables, Arrow batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lakeweave.sources.fs import shared_base

#: Bytes of text that a kernel takes at a time; bounds the numpy arrays of a Python worker.
CHUNK_BYTES = 1 << 19


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session options that hold for the jobs run within, and are as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder: later reads don't repeat its work, and survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table of written() that is no longer read."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name like this that df doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tokenizer_file(name: str) -> str:
    """Where this machine keeps a file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_id(df: DataFrame, id_col: str, ddl: str) -> StructType:
    """The schema of rows that carry df's id, whatever its type, as `id` before the columns of ddl."""
    return StructType([StructField("id", df.schema[id_col].dataType), *StructType.fromDDL(ddl).fields])


#: Bytes of an Arrow batch that a task gets at a time, instead of Spark's 64 MB: what a Python worker and its JVM
#: hold grows with it.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) over small batches. The session keeps the setting, since plans run later."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hands memory that was freed back to the system: workers live on for later tasks, whose needs differ."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library has it on Linux
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def crc_fold(spark_column, folds: int):
    """crc32 of an id as text, modulo `folds`: the fold that tells training rows from held-out ones."""
    return F.crc32(F.coalesce(spark_column.cast("string"), F.lit(""))) % folds


#: Tasks whose arrays are added up at a time, as a power of two, and such rounds before the last one.
FAN_BITS, ROUNDS = 5, 3


def task_group() -> int:
    """`part` of the rows that this task sends to added_up()."""
    return TaskContext.get().partitionId() >> FAN_BITS


def added_up(rows: DataFrame, keys: tuple[str, ...], add, schema: str, first=None) -> DataFrame:
    """Arrays that many tasks sent, added up by keys: rows of 32 tasks, then of 32 such groups and so on, so that no
    task holds more than 32 arrays of a key, for up to a million tasks.

    rows: of the schema, with task_group() in `part`. add: from a group's table to one row; first: the same for what
    tasks sent, if that differs.
    """
    for k in range(ROUNDS):
        rows = rows.withColumn("part", F.shiftright("part", FAN_BITS)) if k else rows
        rows = rows.groupBy(*keys, "part").applyInArrow(add if k else first or add, schema)
    return rows.groupBy(*keys).applyInArrow(add, schema)


#: Edges that a task of a step takes about.
EDGES = 50_000


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node that each can reach.

    Alternating large-star and small-star steps, each a shuffle by node with the minimum taken by partial
    aggregation, until nothing changes; the edges live in the shared folder between steps, so neither the
    driver nor one task ever holds a component. Null ends and loops are left out. Empty edges give no rows.
    """
    cur = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    cur = written(cur, name)
    rows = cur.count()
    parts = -(-rows // EDGES)  # steps never have more than twice the edges
    while rows:
        # large star: each larger neighbour of u points to the smallest of u and its neighbours
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each smaller neighbour of u, and u, point to the smallest of them
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = written(down.coalesce(parts), name)
        least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = down.join(least, down.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = written(nxt.coalesce(parts), name)
        drop_table(cur)
        drop_table(down)
        cur = nxt
        # done when it is a forest of stars: every node has one parent, and no parent has a parent
        count, nodes = cur.agg(F.count("*"), F.countDistinct("a")).first()
        if count == nodes and cur.join(cur.select(F.col("a").alias("p")), F.col("b") == F.col("p"), "left_semi").isEmpty():
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
