"""Sinks: idempotent partition overwrite, CSV and JSON exports, stream sinks, ledgers and reports."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .fs import Files, checked_day, checked_name, stored, workspace


def overwrite_day(df: DataFrame, root: str, day: str) -> str:
    """Replaces one day's partition; to run it again leaves the same state."""
    path = f"{root}/dt={checked_day(day)}"
    df.write.mode("overwrite").parquet(path)
    return path


def overwrite_partitions(df: DataFrame, root: str, by: str = "dt") -> None:
    """Replaces those partitions that df has rows of; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(root)


def export_csv(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """One CSV file with a header, in order: for reports of a row a day, not for whole tables."""
    (df.orderBy(order_by) if order_by else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def landing_batches(df: DataFrame, path: str, day: str, batches: int, order_by: str) -> Iterator[str]:
    """Writes the rows in order into files batch_{day}_{nnn}.json of JSON lines, and yields each one's path as it lands.

    Numbers count from 001; each file has ceil(n / batches) rows, the last what is left, so there may be fewer. A file
    is written beside the folder and renamed, so a stream sees it whole. Rows are numbered by sorted ranges and the
    ranges' sizes, so no task gets them all; NULLs come first, ties stay together in one range in any order.
    """
    spark, files = df.sparkSession, Files(df.sparkSession)
    ranged = stored(df.repartitionByRange(order_by).select("*", F.spark_partition_id().alias("_range")).sortWithinPartitions(order_by), "landing")
    before, sizes = 0, {}
    for r in sorted(ranged.groupBy("_range").count().collect()):
        sizes[r[0]], before = before, before + r[1]
    if not before:
        return
    each = math.ceil(before / max(1, batches))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("_range"))
    numbered = ranged.withColumn("_batch", F.floor((first + F.row_number().over(Window.partitionBy("_range").orderBy(order_by)) - 1) / each).cast("int"))
    beside = workspace(spark, "landing-files")
    numbered.drop("_range").repartition("_batch").sortWithinPartitions("_batch", order_by).write.partitionBy("_batch").json(beside)
    files.make(path)
    for k in range(math.ceil(before / each)):
        (name,) = [x for x in files.names(f"{beside}/_batch={k}") if x.startswith("part-")]
        target = f"{path}/batch_{checked_day(day)}_{k + 1:03d}.json"
        files.delete(target)
        files.move(f"{beside}/_batch={k}/{name}", target)
        yield target
    files.delete(beside)


def kafka_batch(df: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Rows as JSON messages, acknowledged by all replicas; needs Spark's Kafka package."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3", **options}).save()


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, bounded: bool = True) -> StreamingQuery:
    out = df.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint})
    return (out.trigger(availableNow=True) if bounded else out).start()


def file_sink(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", bounded: bool = True, every: str | None = None) -> StreamingQuery:
    """Append to files, exactly once by the checkpoint. bounded: up to what is there now; else every interval."""
    out = df.writeStream.format(kind).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if bounded else out.trigger(processingTime=every) if every else out
    return out.start()


def console_sink(df: DataFrame, rows: int = 20) -> StreamingQuery:
    return df.writeStream.format("console").outputMode("complete").option("numRows", rows).trigger(availableNow=True).start()


def replacing_sink(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result of an aggregate after each batch, each in a folder of its own; see latest_batch()."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest_batch(spark: SparkSession, path: str, schema) -> DataFrame:
    done = [n for n in Files(spark).names(path) if n.startswith("batch=") and Files(spark).exists(f"{path}/{n}/_SUCCESS")]
    return spark.read.schema(schema).parquet(f"{path}/{max(done)}") if done else spark.createDataFrame([], schema)


def fan_out(df: DataFrame, targets: list[tuple[str, str]], checkpoint: str, kind: str = "json") -> list[StreamingQuery]:
    """One metric stream into several sinks, each a query with its own checkpoint: (name, path) of each."""
    return [file_sink(df, path, f"{checkpoint}/{checked_name(name)}", kind) for name, path in targets]


def append_ledger(df: DataFrame, path: str) -> None:
    """(table, dt, rowcount, checked_at) rows added to the ledger."""
    df.write.mode("append").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "table string, dt string, rowcount long, checked_at timestamp"
    return spark.read.schema(schema).parquet(path) if Files(spark).exists(path) else spark.createDataFrame([], schema)


def report(df: DataFrame, path: str, most: int = 10_000, **head: object) -> None:
    """A small result as one JSON document: the head's fields and `rows`. A larger one than `most` rows is refused."""
    rows = [json.loads(x) for x in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it as a table")
    Files(df.sparkSession).write(path, json.dumps({**head, "rows": rows}, ensure_ascii=False, indent=1, default=str))
