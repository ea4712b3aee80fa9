"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws -ln(u) / weight, where u in (0, 1] is a
hash of the row's key and the child's path, and the least draw wins. A child whose weight grows can only win rows, so
rows move only into subtrees whose weights grew. Everything is Column expressions; the text is never shuffled.

Null keys all hash alike (one shard); a null text has 8 bytes of size and the CRC of the empty text; an empty table
gives an empty result; repeated rows each get a row and a slot of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Topology = dict[int, dict[int, dict[int, float]]]


def regular_topology(shards: int, region: int = 8, rack: int = 4, weights: dict[int, float] | None = None) -> Topology:
    """Shards 0..shards-1, so many a rack and a region. A shard beyond full regions opens a region of its own, and so takes rows only into itself."""
    tree: Topology = {}
    for s in range(shards):
        tree.setdefault(s // region, {}).setdefault(s // rack, {})[s] = (weights or {}).get(s, 1.0)
    return tree


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{child}")), 11) + F.lit(1)) / F.lit(2.0**53)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("d"), F.lit(child).alias("c"))


def _pick(key: Column, level: str, children: dict[int, float]) -> Column:
    draws = [_draw(key, level, c, w) for c, w in sorted(children.items()) if w > 0]
    return draws[0].getField("c") if len(draws) == 1 else F.least(*draws).getField("c")


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _descend(parent: Column, nodes: dict, key: Column, level: str) -> Column:
    out = None
    for k, children in sorted(nodes.items()):
        pick = _pick(key, level, {c: _weight(x) for c, x in children.items()})
        out = F.when(parent == k, pick) if out is None else out.when(parent == k, pick)
    return out


def assign(df: DataFrame, key: str, topology: Topology, prefix: str = "") -> DataFrame:
    """df with int columns <prefix>region, <prefix>rack and <prefix>shard."""
    k = F.col(f"`{key}`")
    region, rack, shard = (f"{prefix}{x}" for x in ("region", "rack", "shard"))
    racks = {a: b for r in topology.values() for a, b in r.items()}
    df = df.withColumn(region, _pick(k, "region", {r: _weight(x) for r, x in topology.items()}))
    df = df.withColumn(rack, _descend(F.col(region), topology, k, "rack"))
    return df.withColumn(shard, _descend(F.col(rack), racks, k, "shard"))


def slots(df: DataFrame, shard: str, order: list[str], buckets: int = 256) -> DataFrame:
    """df with `slot`: gapless from 0 in each shard. Shards are numbered in hash buckets, each by itself, and a bucket starts after those before it; the table of bucket sizes has shards x buckets rows, however many rows df has."""
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = b.groupBy(shard, "_bucket").count().select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    ranked = b.withColumn("_rank", F.row_number().over(within).cast("long"))
    return ranked.join(F.broadcast(starts), [shard, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_start", "_rank")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, size, text_crc32, region, rack, shard, slot, and grown_shard: its shard if there were one more."""
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{key}`").alias(key), (F.octet_length(words) + 8).cast("long").alias("size"), F.crc32(words.cast("binary")).alias("text_crc32"))
    d = assign(assign(d, key, regular_topology(shards)), key, regular_topology(shards + 1), "grown_")
    return slots(d.drop("grown_region", "grown_rack"), "shard", [key, "text_crc32", "size"])
