"""Sharding by a hierarchical weighted hash tree, all in DataFrame expressions.

A row descends from the root: at each level every child draws -ln(u) / weight, with u from a hash of the row's id and
the child's path, and the least draw takes the row. A node's weight is the sum of its shards'. When a weight changes,
only rows move that the changed node's draw wins or loses, so movement stays within subtrees whose weights change.
A shard that is added opens a region of its own: no other region's draw changes, so rows move only into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Racks a region and shards a rack of the tree that the first shards stand in.
REGIONS, RACKS, SHARDS = 2, 3, 4


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: a path that is its name in draws, a number, and children or a shard's weight."""

    path: str
    number: int
    children: tuple[Node, ...] = ()
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int = REGIONS * RACKS * SHARDS, weights: dict[int, float] | None = None) -> tuple[Node, ...]:
    """Regions of racks of shards 0 to shards - 1; those beyond REGIONS * RACKS * SHARDS have a region each."""
    weights, out = weights or {}, []
    for r in range(REGIONS):
        racks = []
        for k in range(RACKS):
            first = (r * RACKS + k) * SHARDS
            leaves = tuple(Node(f"{r}/{k}/{s}", s, (), weights.get(s, 1.0)) for s in range(first, min(first + SHARDS, shards)))
            if leaves:
                racks.append(Node(f"{r}/{k}", r * RACKS + k, leaves))
        if racks:
            out.append(Node(f"{r}", r, tuple(racks)))
    for i, s in enumerate(range(REGIONS * RACKS * SHARDS, shards)):
        r, k = REGIONS + i, REGIONS * RACKS + i
        out.append(Node(f"{r}", r, (Node(f"{r}/0", k, (Node(f"{r}/0/{s}", s, (), weights.get(s, 1.0)),)),)))
    return tuple(out)


def _draw(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / node.weight


def _choice(key: Column, nodes: tuple[Node, ...]) -> Column:
    """The number of the node with the least draw; of equal draws, the lower number."""
    live = [n for n in nodes if n.weight > 0]
    if len(live) == 1:
        return F.lit(live[0].number)
    return F.array_min(F.array(*[F.struct(_draw(key, n).alias("draw"), F.lit(n.number).alias("number")) for n in live]))["number"]


def _below(at: Column, key: Column, nodes: list[Node]) -> Column:
    """The choice among the children of the node whose number is at; only that node's children draw."""
    out = None
    for n in nodes:
        if n.weight > 0:
            out = F.when(at == n.number, _choice(key, n.children)) if out is None else out.when(at == n.number, _choice(key, n.children))
    return out


def placed(df: DataFrame, key: Column, regions: tuple[Node, ...], prefix: str = "") -> DataFrame:
    """df with columns region, rack and shard (after the prefix), decided by the key and the tree alone."""
    racks = [k for r in regions for k in r.children]
    df = df.withColumn(f"{prefix}region", _choice(key, regions))
    df = df.withColumn(f"{prefix}rack", _below(F.col(f"{prefix}region"), key, list(regions)))
    return df.withColumn(f"{prefix}shard", _below(F.col(f"{prefix}rack"), key, racks))


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, region, rack) for each row, by the law `key`.

    The id and the number of shards decide a row's shard; grown_shard is its shard with one more, which is either the
    same or the new one. size: UTF-8 bytes of the text (null: none) plus 8. slot: gapless from 0 within a shard.
    Slots are dealt without a sort of whole shards: rows go into hashed chunks of a shard, chunks get their first slot
    from running sums of counts, rows are numbered within a chunk. Rows equal in id, size and checksum are counted
    before the shuffle and spread out again at the end, so one id may hold any share of rows. A null id is a key like
    any other. Empty tables give no rows.
    """
    chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    same = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    key = F.col("id")
    same = placed(placed(same, key, tree(shards)), key, tree(shards + 1), "grown_")
    same = same.withColumn("chunk", F.pmod(F.xxhash64("id", "size", "text_crc32", F.lit("chunk")), F.lit(chunks)).cast("int"))
    order = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = same.groupBy("shard", "chunk").agg(F.sum("copies").alias("rows"))
    firsts = firsts.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "chunk").orderBy("id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = same.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    numbered = numbered.join(firsts, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))
    numbered = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("before") + F.col("copy")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"), "region", "rack",
    )
