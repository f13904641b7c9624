"""Scans: explicit-schema CSV, partition leaves and roots, fault-tolerant JSON lines, streams, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fs import Files, checked_day, workspace

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True, timestamp_format: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Columns bind by position to the schema given; a cell that doesn't fit its type is NULL."""
    return spark.read.schema(schema).option("header", header).option("timestampFormat", timestamp_format).option("enforceSchema", True).csv(path)


def with_audit(df: DataFrame, source: str | Column | None = None) -> DataFrame:
    """Adds etl_time and source_file: a given name, or the file that a row was read from."""
    name = F.col("_metadata.file_name") if source is None else F.lit(source) if isinstance(source, str) else source
    return df.select("*", F.current_timestamp().alias("etl_time"), name.alias("source_file"))


def leaf(spark: SparkSession, root: str, day: str) -> DataFrame:
    """One day's partition, read by its own path."""
    return spark.read.parquet(f"{root}/dt={checked_day(day)}")


def partitions(spark: SparkSession, root: str, until: str | None = None) -> DataFrame:
    """All partitions, or those up to a day, with dt as a string; later ones aren't listed for reading."""
    df = spark.read.parquet(root)
    if until is not None:
        df = df.where(F.col("dt") <= F.to_date(F.lit(checked_day(until))))
    return df.withColumn("dt", F.col("dt").cast("string"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, in_progress: bool = True, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a folder of JSON lines that may still be written: blank, broken and half-written lines are left out.

    Files in progress, whose names begin with a dot, are read too; those that begin with '._' and files of other
    systems that begin with '_' aren't. prefix: (column, start of its text) that rows must have. Spark's readers pass
    over names with a dot, so such files are copied under other names to the shared folder, as they are at this moment.
    """
    names = [n for n in Files(spark).names(path) if not n.startswith(("._", "_")) and (in_progress or not n.startswith(".")) and not n.endswith(".crc")]
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not names:
        return spark.createDataFrame([], kind)
    files, paths, beside = Files(spark), [f"{path}/{n}" for n in names if not n.startswith(".")], workspace(spark, "in-progress")
    for n in names:
        if n.startswith("."):
            files.copy(f"{path}/{n}", f"{beside}/open{n}")
            paths.append(f"{beside}/open{n}")
    lines = spark.read.text(paths)
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$").isNotNull().alias("whole"))
    rows = rows.where("whole and r is not null").select("r.*")
    return rows.where(F.col(prefix[0]).cast("string").startswith(prefix[1])) if prefix else rows


def from_payload(df: DataFrame, schema: StructType | str, value: str = "value") -> DataFrame:
    """The fields of JSON messages; a message that is no JSON object is left out."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(F.get_json_object(F.col(value).cast("string"), "$").alias("_v")).where("_v is not null").select(F.from_json("_v", kind).alias("r")).select("r.*")


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: StructType | str, **options: str) -> DataFrame:
    """A topic's JSON messages from the earliest on; with the trigger availableNow it ends at the latest offsets of its start.

    Needs Spark's Kafka package on the class path. Each query has its own offsets, so sinks never share a group.
    """
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}).load()
    return from_payload(raw, schema)


def json_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def parquet_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def footer_schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, mean_bytes) of a folder's data files."""
    sizes = [n for _, n in Files(spark).sizes(path)]
    return spark.createDataFrame([(len(sizes), sum(sizes), sum(sizes) / len(sizes) if sizes else 0.0)], "files long, bytes long, mean_bytes double")


def task_metrics(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Of an event log's finished tasks from a byte on: how many, longest, median and total run time, shuffle bytes written.

    The tasks' lines are told by the offset that Spark's own reader gives each of its splits; a line counts if it
    begins at `start` or later, so the caller may pass the log's size at the last reading.
    """
    schema = "Event string, `Task Metrics` struct<`Executor Run Time`: long, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>>"
    lines = spark.read.text(path) if not start else _text_from(spark, path, start)
    tasks = lines.select(F.from_json("value", schema).alias("e")).where("e.Event = 'SparkListenerTaskEnd'")
    run = F.col("e.`Task Metrics`.`Executor Run Time`")
    written = F.col("e.`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`")
    return tasks.agg(F.count("*").alias("tasks"), F.max(run).alias("max_ms"), F.median(run).cast("long").alias("median_ms"), F.sum(run).alias("total_ms"), F.coalesce(F.sum(written), F.lit(0)).alias("shuffle_bytes"))


def _text_from(spark: SparkSession, path: str, start: int) -> DataFrame:
    """Lines of one file that begin at a byte or later, by Hadoop's line reader, whose keys are the lines' offsets."""
    keyed = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return spark.createDataFrame(keyed, "at long, value string").where(F.col("at") >= start).select("value")
