"""Schema drift against a registry, and lineage.

A registry is {table: {"layer", "path", "columns": {column: {"type", "from"}}, "source", "format"}}.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeweave.functions.scalar import source_table
from lakeweave.sources.fs import Files

#: The registry's names of types, and Spark's.
TYPES = {"string": "string", "integer": "int", "int": "int", "bigint": "long", "long": "long", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "double": "double", "float": "float", "boolean": "boolean", "date": "date"}

REGISTRY = "table string, layer string, column string, type string, from string, position int"


def load(spark: SparkSession, path: str) -> dict:
    """A registry from JSON, or YAML where its library is installed."""
    text = Files(spark).read(path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)["tables"]
    return json.loads(text)["tables"]


def as_rows(spark: SparkSession, registry: dict) -> DataFrame:
    rows = [(t, spec.get("layer"), c, meta.get("type"), str(meta.get("from", "")), i) for t, spec in registry.items() for i, (c, meta) in enumerate(spec.get("columns", {}).items())]
    return spark.createDataFrame(rows, REGISTRY)


def type_name(kind: str) -> str:
    return TYPES.get(kind.lower(), kind.lower())


def schema_rows(spark: SparkSession, schemas: dict[str, StructType]) -> DataFrame:
    return spark.createDataFrame([(t, f.name, type_name(f.dataType.simpleString())) for t, s in schemas.items() for f in s.fields], "table string, column string, type string")


def drift(registered: DataFrame, actual: DataFrame) -> DataFrame:
    """(table, column, registered, actual, drift) of columns that are missing, extra or of another type.

    Tables without any actual schema are told apart as `skipped`, one row each.
    """
    there = actual.select("table").distinct().withColumn("there", F.lit(True))
    known = registered.select("table").distinct()
    r = registered.select("table", "column", F.col("type").alias("registered"))
    a = actual.select("table", "column", F.col("type").alias("actual")).join(known, "table", "left_semi")
    both = r.join(a, ["table", "column"], "full_outer").join(there, "table", "left")
    kind = F.when(F.col("there").isNull(), "skipped").when(F.col("actual").isNull(), "missing").when(F.col("registered").isNull(), "extra").when(F.col("registered") != F.col("actual"), "type")
    found = both.withColumn("drift", kind).where("drift is not null")
    blank = lambda c: F.when(F.col("drift") != "skipped", F.col(c)).alias(c)
    return found.select("table", blank("column"), blank("registered"), blank("actual"), "drift").distinct()


def edges(registered: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, target) of tables: every registered table that a column's expression names, and outer sources.

    An expression may name several tables, anywhere in it. sources: (table, source) such as bus://topic.
    """
    names = registered.select(F.col("table").alias("source")).distinct()
    found = F.regexp_extract_all("from", F.lit(r"\b((?:ods|dwd|dws|ads)\.\w+)\."), 1)
    out = registered.select(F.explode(found).alias("source"), F.col("table").alias("target")).where("source <> target").join(names, "source", "left_semi").distinct()
    if sources is not None:
        out = out.unionByName(sources.select(F.replace("source", F.lit("://"), F.lit(".")).alias("source"), F.col("table").alias("target")).distinct())
    return out


def direct_sources(registered: DataFrame) -> DataFrame:
    """(table, column, source) by the table at the start of each column's expression."""
    return registered.select("table", "column", source_table("from").alias("source")).where("source is not null and source <> table")


def mermaid(registry: dict, edge_rows: list[tuple[str, str]], layers: tuple[str, ...] = ("ods", "dwd", "dws", "ads")) -> str:
    """The lineage as a flowchart: a subgraph a layer, outer sources before them."""
    name = lambda t: t.replace(".", "_")
    node = lambda t, pad: f'{pad}{name(t)}["{t}"]'
    rank = {x: i for i, x in enumerate(layers)}
    out = ["flowchart TD", *(node(s, "    ") for s in sorted({s for s, _ in edge_rows} - set(registry)))]
    for layer in sorted({spec.get("layer", "other") for spec in registry.values()}, key=lambda x: (rank.get(x, len(rank)), x)):
        out.append(f"    subgraph {layer}")
        out += [node(t, "        ") for t in sorted(registry) if registry[t].get("layer", "other") == layer]
        out.append("    end")
    out += [f"    {name(a)} --> {name(b)}" for a, b in sorted(edge_rows)]
    return "\n".join(["```mermaid", *out, "```"])


def resolve(spark: SparkSession, pattern: str, day: str | None = None) -> str | None:
    """A path pattern with {dt} as the given or latest day and {snapshot} as the latest committed one; None if there is none."""
    files = Files(spark)
    for mark, prefix in (("{dt}", "dt="), ("{snapshot}", "")):
        if mark not in pattern:
            continue
        head = pattern.split(mark)[0]
        base, stem = head.rstrip("/").rpartition("/")[0] if prefix and head.endswith(prefix) else head.rstrip("/"), prefix
        found = [n.removeprefix(stem) for n in files.names(base) if n.startswith(stem)]
        if mark == "{snapshot}":
            found = sorted((n for n in found if n.isdigit() and files.exists(f"{base}/{n}/manifest.json")), key=int)
        value = day if mark == "{dt}" and day else (sorted(found) if mark == "{dt}" else found or [None])[-1] if found else None
        if value is None:
            return None
        pattern = pattern.replace(mark, value)
    return pattern if files.exists(pattern) else None


def tables_drift(spark: SparkSession, registry: dict, root: str, day: str | None = None) -> DataFrame:
    """drift() of all registered tables that can be found below a root; JSON tables are checked for being there only."""
    schemas, rows = {}, {}
    for t, spec in registry.items():
        path = resolve(spark, f"{root}/{spec['path']}", day)
        if spec.get("format", "parquet") == "json":
            if path is None:
                rows[t] = spec
            continue
        rows[t] = spec
        if path is not None:
            schemas[t] = spark.read.parquet(path).schema
    return drift(as_rows(spark, rows), schema_rows(spark, schemas))
