"""Connected components of a graph of links, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SALTS = 32
HOT = 100_000  # rows of a key from which on they are dealt to SALTS tasks


def lookup(rows: DataFrame, small: DataFrame, key: str, spread: str, few: bool) -> DataFrame:
    """rows joined with one row of `small` a key: broadcast where it is known to be small, else on (key, salt of `spread`), so that no hot key's rows meet in one task.

    Only keys of more than HOT rows get more than one salt, and only their rows of `small` are copied: at most one key in HOT rows. The others keep
    one salt, as a column of the join: on check_l a plain join by the key of checkpoints lost links, and why was not found out."""
    if few:
        return rows.join(F.broadcast(small), key)
    hot = checkpoint(rows.groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") > HOT).select(key, F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    return dealt.join(salted, [key, "_salt"]).drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, component_id) for every id in a link: the least id that can be reached.

    Alternates large-star and small-star rounds: each id's larger neighbours, then its smaller ones, are linked to its
    least neighbour. A round is two aggregations over the links, which combine on the map side, and the links become
    stars in a number of rounds that grows with the logarithm of their size. Links stay on the executors; each round is a
    reliable checkpoint. No links give no rows.
    """
    e = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    for _ in range(rounds):
        few = 2 * before[0] <= broadcast_rows
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = lookup(both, least, "u", "v", few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, low, "u", "v", few).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small)
        if (now := mark(e)) == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select("v", F.col("v").alias("component_id")).distinct())
        before = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")
