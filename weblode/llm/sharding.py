"""Sharding by a hierarchical weighted hash tree (op 1); DataFrame functions only.

A cluster is a tree: regions hold racks, racks hold shards, and a node's weight is the sum
of its shards' weights. A key descends level by level. At each node every child draws
`-ln(u) / weight` with u uniform in (0, 1) from a hash of (key, child); the least draw wins, so
a child gets its share by weight, and a change of one child's weight moves keys only to or
from it. Movement is thus confined to subtrees whose weights change; a shard that joins as a
region of its own takes rows only into itself.

Each level's draws are one `least` over its few nodes. Slots are gapless within a shard: rows
fall into `buckets` hash buckets, a small table of bucket sizes gives each bucket its base
by a prefix sum, and within a bucket equal rows are counted once and fan out at the end.

Defined results: a null id is a key like any other; a null text has size 1 and the CRC of no
bytes; repeated rows go to one shard and get slots of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a shard that are numbered in one task: its hash range is cut into as many as it takes.
SLOT_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; `path` names it for its draws, `shard` is set on leaves."""

    path: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


@dataclass(frozen=True)
class Topology:
    regions: tuple[Node, ...]

    @property
    def shards(self) -> int:
        return sum(len(rack.children) for region in self.regions for rack in region.children)

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, as a region of its own: no other node's weight changes."""
        n = self.shards
        path = f"g{n}"
        rack = Node(f"{path}/0", weight, (Node(f"{path}/0/0", weight, shard=n),))
        return replace(self, regions=(*self.regions, Node(path, weight, (rack,))))


def uniform_topology(regions: int = 2, racks: int = 2, shards: int = 2, weights: dict[int, float] | None = None) -> Topology:
    """So many regions of so many racks of so many shards; `weights` by shard number, 1 where missing."""
    weights, top, number = weights or {}, [], 0
    for r in range(regions):
        mid = []
        for k in range(racks):
            leaves = []
            for s in range(shards):
                leaves.append(Node(f"r{r}/{k}/{s}", weights.get(number, 1.0), shard=number))
                number += 1
            mid.append(Node(f"r{r}/{k}", sum(x.weight for x in leaves), tuple(leaves)))
        top.append(Node(f"r{r}", sum(x.weight for x in mid), tuple(mid)))
    return Topology(tuple(top))


def uniform(key: Column, path: str) -> Column:
    """A number in (0, 1) from the first 48 bits of the MD5 of path and key."""
    digest = F.md5(F.concat_ws(":", F.lit(path), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _winner(key: Column, nodes: tuple[Node, ...]) -> Column:
    """Index of the child with the least draw."""
    if len(nodes) == 1:
        return F.lit(0)
    drawn = [F.struct((-F.ln(uniform(key, n.path)) / F.lit(n.weight)).alias("draw"), F.lit(i).alias("child")) for i, n in enumerate(nodes)]
    return F.array_min(F.array(*drawn))["child"]


def _descend(rows: DataFrame, key: str, topology: Topology, out: str) -> DataFrame:
    region, rack = f"__region_{out}", f"__rack_{out}"

    def choose(options: list[tuple[Column, Column]]) -> Column:
        found = functools.reduce(lambda c, o: c.when(o[0], o[1]), options[1:], F.when(*options[0]))
        return found

    tops = topology.regions
    rows = rows.withColumn(region, _winner(F.col(key), tops))
    rows = rows.withColumn(rack, choose([(F.col(region) == i, _winner(F.col(key), r.children)) for i, r in enumerate(tops)]))
    leaves = []
    for i, r in enumerate(tops):
        for j, k in enumerate(r.children):
            numbers = F.array(*(F.lit(s.shard) for s in k.children))
            leaves.append(((F.col(region) == i) & (F.col(rack) == j), F.get(numbers, _winner(F.col(key), k.children))))
    return rows.withColumn(out, choose(leaves).cast("int")).drop(region, rack)


def assign(rows: DataFrame, key: str, topology: Topology, column: str = "shard") -> DataFrame:
    """Adds each row's shard; no shuffle."""
    return _descend(rows, key, topology, column)


def shard_documents(docs: DataFrame, topology: Topology | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Every document's shard now and with one more shard, its size, checksum and slot within the shard.

    Slots follow a hash of the row, so they do not depend on how many buckets number them.
    """
    topology = topology or uniform_topology()
    buckets = max(64, -(-docs.count() // slot_rows))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = _descend(_descend(sized, "doc_id", topology, "shard"), "doc_id", topology.grown(), "grown_shard")
    row_name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    placed = placed.withColumn("draw", uniform(row_name, "slot")).withColumn("bucket", F.floor(F.col("draw") * buckets).cast("int"))
    same = ["shard", "bucket", "draw", "doc_id", "size", "text_crc32", "grown_shard"]
    counted = placed.groupBy(*same).agg(F.count("*").alias("copies"))
    # At most shards x buckets rows, whatever the table.
    sizes = counted.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    ranked = counted.withColumn("after", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    slots = F.sequence(F.col("base") + F.col("after") - F.col("copies"), F.col("base") + F.col("after") - 1)
    return ranked.join(F.broadcast(bases), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard"
    )
