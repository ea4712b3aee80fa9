"""Keyed tables: a DataFrame of unique keys, and mutations that give the next version of it.

Each mutation is one join by key, so a version costs one shuffle of the table unless both sides are partitioned
alike, and Catalyst picks a broadcast where the updates are few. Several deltas of a key are combined on the map side before
they meet the table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; where none is set, a local master gets a temporary one and a cluster an error.

    placed: later plans know how its rows are partitioned, which a checkpoint of an adaptive plan forgets.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled")
    try:
        if placed:
            df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
        return df.checkpoint()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", adaptive)


@dataclass(frozen=True)
class UpdateFunction:
    """What an update does: the value of an absent key, deltas of one key combined, the combined delta applied."""

    init: Callable[[Column], Column]
    combine: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]


ADD = UpdateFunction(init=lambda key: F.lit(0).cast("long"), combine=F.sum, apply=lambda old, delta: old + delta)


class KeyedTable:
    """`df` has one row a key in columns `key` and `value`; keys and values are not null."""

    def __init__(self, df: DataFrame, update: UpdateFunction = ADD):
        self.df, self.function = df.select("key", "value"), update

    def _with(self, df: DataFrame) -> KeyedTable:
        return KeyedTable(df, self.function)

    # put

    def put(self, rows: DataFrame) -> KeyedTable:
        """Values of rows (key, value; a key once) in place of what there was."""
        new = rows.select("key", F.col("value").alias("_new"))
        return self._with(self.df.join(new, "key", "full").select("key", F.coalesce("_new", "value").alias("value")))

    def previous(self, keys: DataFrame) -> DataFrame:
        """(key, previous) of each key given: the value before a put or a removal, null if there was none."""
        return keys.select("key").join(self.df, "key", "left").select("key", F.col("value").alias("previous"))

    def multi_put(self, rows: DataFrame) -> KeyedTable:
        """rows (key, seq, value): of a key's rows the last counts."""
        return self.put(last_wins(rows))

    def put_if_absent(self, rows: DataFrame) -> KeyedTable:
        return self._with(self.df.unionByName(rows.select("key", "value").join(self.df, "key", "left_anti")))

    # get

    def get(self, key) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(key))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys that there are."""
        return self.df.join(keys.select("key").distinct(), "key", "left_semi")

    def multi_get_or_init(self, keys: DataFrame) -> DataFrame:
        """A row for each key given, absent ones with their initial value: what a worker pulls."""
        found = keys.select("key").distinct().join(self.df, "key", "left")
        return found.select("key", F.coalesce("value", self.function.init(F.col("key"))).alias("value"))

    def with_initial(self, keys: DataFrame) -> KeyedTable:
        """The version in which absent keys have their initial value."""
        absent = keys.select("key").distinct().join(self.df, "key", "left_anti")
        return self._with(self.df.unionByName(absent.select("key", self.function.init(F.col("key")).alias("value"))))

    # update and remove

    def update(self, deltas: DataFrame) -> KeyedTable:
        """deltas (key, delta), any number a key, in no order: what a worker pushes."""
        combined = deltas.groupBy("key").agg(self.function.combine(F.col("delta")).alias("_delta"))
        old = F.coalesce("value", self.function.init(F.col("key")))
        value = F.when(F.col("_delta").isNull(), F.col("value")).otherwise(self.function.apply(old, F.col("_delta")))
        return self._with(self.df.join(combined, "key", "full").select("key", value.alias("value")))

    def fold(self, deltas: DataFrame, step: Callable[[Column, Column], Column]) -> KeyedTable:
        """deltas (key, seq, delta), applied in the order of seq by step(value, delta): for updates that do not commute. A key's deltas are gathered; they are its own history, not a hot group's rows."""
        history = deltas.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]).alias("_deltas"))
        joined = self.df.join(history, "key", "full")
        old = F.coalesce("value", self.function.init(F.col("key")))
        return self._with(joined.select("key", F.when(F.col("_deltas").isNull(), F.col("value")).otherwise(F.aggregate("_deltas", old, step)).alias("value")))

    def remove(self, keys: DataFrame) -> KeyedTable:
        return self._with(self.df.join(keys.select("key"), "key", "left_anti"))

    def clear(self) -> KeyedTable:
        return self._with(self.df.where(F.lit(False)))

    def scan(self) -> DataFrame:
        return self.df

    def settle(self) -> KeyedTable:
        """The same version without its lineage."""
        return self._with(cut(self.df))


def last_wins(rows: DataFrame) -> DataFrame:
    """Of rows (key, seq, value) the last of each key, combined on the map side."""
    return rows.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("_last")).select("key", F.col("_last.value").alias("value"))


class Catalog:
    """Tables by name, for one application."""

    def __init__(self):
        self._tables: dict[str, KeyedTable] = {}

    def create(self, name: str, table: KeyedTable) -> KeyedTable:
        if name in self._tables:
            raise ValueError(f"table {name} is there already")
        self._tables[name] = table
        return table

    def get(self, name: str) -> KeyedTable:
        if name not in self._tables:
            raise KeyError(f"no table {name}")
        return self._tables[name]

    def drop(self, name: str) -> None:
        del self._tables[name]


# blocks

def hashed_block(key: Column, blocks: int) -> Column:
    """Block of a hashed table; the key's residue, so that SQL elsewhere can compute it too."""
    return F.pmod(key, F.lit(blocks)).cast("long")


def ordered_block(key: Column, blocks: int, largest: int = 2**63 - 1) -> Column:
    """Block of an ordered table: equal ranges of keys 0..largest; negative keys are refused."""
    size = -(-(largest + 1) // blocks)
    block = F.least(F.call_function("div", key, F.lit(size)), F.lit(blocks - 1)).cast("long")
    return F.when(key >= 0, block).otherwise(F.raise_error(F.lit("an ordered table's keys are not negative")).cast("long"))


class Block:
    """One block of a hashed table: the table's operations on keys that are its own. Rows of other blocks' keys are refused."""

    def __init__(self, table: KeyedTable, block: int, blocks: int):
        self.table, self.block, self.blocks = table, block, blocks

    def _mine(self, rows: DataFrame) -> DataFrame:
        mine = hashed_block(F.col("key"), self.blocks) == self.block
        return rows.withColumn("key", F.when(mine, F.col("key")).otherwise(F.raise_error(F.lit(f"a key is not of block {self.block}")).cast("long")))

    def rows(self) -> DataFrame:
        return self.table.scan().where(hashed_block(F.col("key"), self.blocks) == self.block)

    def put(self, rows: DataFrame) -> KeyedTable:
        return self.table.put(self._mine(rows))

    def put_if_absent(self, rows: DataFrame) -> KeyedTable:
        return self.table.put_if_absent(self._mine(rows))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.table.multi_get(self._mine(keys))

    def get_or_init(self, keys: DataFrame) -> DataFrame:
        return self.table.multi_get_or_init(self._mine(keys))

    def update(self, deltas: DataFrame) -> KeyedTable:
        return self.table.update(self._mine(deltas))

    def remove(self, keys: DataFrame) -> KeyedTable:
        return self.table.remove(self._mine(keys))

    def clear(self) -> KeyedTable:
        return self.table.remove(self.rows())


def block_stats(df: DataFrame) -> DataFrame:
    """df with block_id: rows a block."""
    return df.groupBy("block_id").agg(F.count("*").alias("items"))


def block_owners(spark, blocks: int, executors: int) -> DataFrame:
    """(block_id, owner): blocks dealt out in turn."""
    return spark.range(blocks).select(F.col("id").alias("block_id"), (F.col("id") % executors).alias("owner"))


def move_blocks(owners: DataFrame, source: int, target: int, n: int) -> DataFrame:
    """At most n blocks of the source, least ids first, go to the target. A block map has thousands of rows."""
    rank = F.row_number().over(Window.partitionBy("owner").orderBy("block_id"))
    moved = (F.col("owner") == source) & (F.col("_rank") <= n)
    return owners.withColumn("_rank", rank).select("block_id", F.when(moved, F.lit(target).cast("long")).otherwise(F.col("owner")).alias("owner"))


def checkpoint_sample(df: DataFrame, ratio: float) -> DataFrame:
    """Of each block (block_id) the first int(rows * ratio) rows by key."""
    if not 0 < ratio <= 1:
        raise ValueError("a ratio is over 0 and at most 1")
    w = Window.partitionBy("block_id")
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy("key"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rank") <= F.floor(F.col("_n") * F.lit(ratio))).drop("_rank", "_n")


def minibatches(df: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """One block, one mini-batch; `place` is a row's place in its batch's shuffled order. df: key."""
    d = df.withColumn("block_id", hashed_block(F.col("key"), blocks))
    mixed = F.pmod(F.pmod("key", F.lit(2**31 - 1)) * 48271 + F.lit(seed), F.lit(2**31 - 1))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("block_id").orderBy(mixed, "key")).cast("long") - 1)
