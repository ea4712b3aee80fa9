"""Queries of keyed tables, blocks, loading and parsing, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import tables as K
from quern.sources import loading, parsers

from .common import cents, query, table

BALANCES = "base AS (SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS value FROM customer)"
DELTAS = "deltas AS (SELECT o_custkey AS key, o_orderkey AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS delta FROM orders)"
TOTALS = "totals AS (SELECT key, CAST(sum(delta) AS BIGINT) AS delta FROM deltas GROUP BY key)"
LAST = "last AS (SELECT key, arg_max(delta, seq) AS value FROM deltas GROUP BY key)"


def balances(spark: SparkSession, d: str) -> K.KeyedTable:
    return K.KeyedTable(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), cents("c_acctbal").alias("value")))


def deltas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), cents("o_totalprice").alias("delta"))


def puts(spark: SparkSession, d: str) -> DataFrame:
    return deltas(spark, d).withColumnRenamed("delta", "value")


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Keys of which the table has some: suppliers' and customers' numbers are drawn alike."""
    return table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("key")).distinct()


@query(f"WITH {BALANCES}, {DELTAS}, {TOTALS} SELECT key, coalesce(b.value, 0) + coalesce(t.delta, 0) AS value FROM base b FULL JOIN totals t USING (key)")
def table_update(spark, d):
    return balances(spark, d).update(deltas(spark, d)).scan()


@query(f"WITH {BALANCES}, {DELTAS}, {TOTALS}, more AS (SELECT l_suppkey AS key, CAST(count(*) AS BIGINT) AS delta FROM lineitem GROUP BY 1) SELECT key, coalesce(b.value, 0) + coalesce(t.delta, 0) + coalesce(m.delta, 0) AS value FROM base b FULL JOIN totals t USING (key) FULL JOIN more m USING (key)")
def table_multi_update(spark, d):
    more = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.lit(1).cast("long").alias("delta"))
    return balances(spark, d).update(deltas(spark, d).select("key", "delta").union(more)).scan()


@query(f"WITH {BALANCES}, {DELTAS}, {LAST} SELECT key, coalesce(l.value, b.value) AS value, b.value AS previous FROM base b FULL JOIN last l USING (key)")
def table_put(spark, d):
    t, new = balances(spark, d), K.last_wins(puts(spark, d))
    return t.put(new).scan().join(t.df.withColumnRenamed("value", "previous"), "key", "left")


@query(f"WITH {BALANCES}, {DELTAS}, {LAST} SELECT key, coalesce(l.value, b.value) AS value FROM base b FULL JOIN last l USING (key)")
def table_multi_put(spark, d):
    return balances(spark, d).multi_put(puts(spark, d)).scan()


@query(f"WITH {BALANCES}, {DELTAS}, {LAST} SELECT key * 2 AS key, value FROM last WHERE key * 2 NOT IN (SELECT key FROM base) UNION ALL SELECT key, value FROM base")
def table_put_if_absent(spark, d):
    new = K.last_wins(puts(spark, d)).withColumn("key", F.col("key") * 2)
    return balances(spark, d).put_if_absent(new).scan()


@query(f"WITH {BALANCES} SELECT key, value FROM base WHERE key = 7")
def table_get(spark, d):
    return balances(spark, d).get(7)


@query(f"WITH {BALANCES} SELECT key, value FROM base WHERE key IN (SELECT o_custkey * 2 FROM orders)")
def table_multi_get(spark, d):
    return balances(spark, d).multi_get(nations(spark, d))


def _initial(t: K.KeyedTable) -> K.KeyedTable:
    return K.KeyedTable(t.df, K.UpdateFunction(init=lambda key: -key, combine=F.sum, apply=lambda old, delta: old + delta))


@query(f"WITH {BALANCES}, keys AS (SELECT DISTINCT o_custkey * 2 AS key FROM orders) SELECT key, coalesce(value, -key) AS value FROM keys LEFT JOIN base USING (key)")
def table_multi_get_or_init(spark, d):
    return _initial(balances(spark, d)).multi_get_or_init(nations(spark, d))


@query(f"WITH {BALANCES}, keys AS (SELECT DISTINCT o_custkey * 2 AS key FROM orders) SELECT key, value FROM base UNION ALL SELECT key, -key FROM keys WHERE key NOT IN (SELECT key FROM base)")
def table_get_or_init(spark, d):
    return _initial(balances(spark, d)).with_initial(nations(spark, d)).scan()


@query(f"WITH {BALANCES}, gone AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 8 = 0) SELECT key, value, 'left' AS what FROM base WHERE key NOT IN (SELECT key FROM gone) UNION ALL SELECT key, value, 'removed' FROM gone LEFT JOIN base USING (key)")
def table_remove(spark, d):
    t, keys = balances(spark, d), table(spark, d, "orders").where("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("key"))
    removed = t.previous(keys.distinct()).select("key", F.col("previous").alias("value"), F.lit("removed").alias("what"))
    return t.remove(keys).scan().withColumn("what", F.lit("left")).unionByName(removed)


@query(f"WITH {BALANCES} SELECT key, value FROM base WHERE false")
def table_clear(spark, d):
    return balances(spark, d).clear().scan()


@query(f"WITH {BALANCES} SELECT key, value FROM base")
def table_scan(spark, d):
    return balances(spark, d).scan()


@query("WITH d AS (SELECT o_custkey AS key, string_agg(substr(o_orderpriority, 1, 1), '' ORDER BY o_orderkey DESC) AS s FROM orders GROUP BY 1) SELECT c_custkey AS key, coalesce(s, '') || 'EMPTY' AS value FROM customer LEFT JOIN d ON key = c_custkey UNION ALL SELECT key, s || 'EMPTY' FROM d WHERE key NOT IN (SELECT c_custkey FROM customer)")
def table_fold(spark, d):
    """Updates that do not commute: each is put before the value that there is."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("EMPTY").alias("value"))
    text = K.UpdateFunction(init=lambda key: F.lit("EMPTY"), combine=F.max, apply=F.concat)
    prefix = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).alias("delta"))
    return K.KeyedTable(base, text).fold(prefix, lambda value, delta: F.concat(delta, value)).scan()


# parameter server

@query("SELECT key, CAST(n AS BIGINT) AS value FROM (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def add_integer(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("value"))
    return K.KeyedTable(base).update(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit(1).cast("long").alias("delta"))).scan()


@query("WITH n AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT c_custkey AS key FROM customer UNION SELECT key FROM n) SELECT key, i, CAST(coalesce(n, 0) * (i + 1) AS BIGINT) AS value FROM k LEFT JOIN n USING (key) CROSS JOIN range(5) t(i)")
def add_vector(spark, d):
    size = 5
    zero = F.array_repeat(F.lit(0).cast("long"), size)
    add = K.UpdateFunction(init=lambda key: zero, combine=lambda x: F.array(*(F.sum(F.get(x, F.lit(i))) for i in range(size))), apply=lambda old, delta: F.zip_with(old, delta, lambda a, b: a + b))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), zero.alias("value"))
    step = F.array(*(F.lit(i + 1).cast("long") for i in range(size)))
    t = K.KeyedTable(base, add).update(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), step.alias("delta")))
    return t.scan().select("key", F.posexplode("value").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


MODEL = "model AS (SELECT p_partkey AS key, CAST(round(p_retailprice * 100) AS BIGINT) AS value FROM part)"


def _model(spark, d) -> K.KeyedTable:
    return K.KeyedTable(table(spark, d, "part").select(F.col("p_partkey").alias("key"), cents("p_retailprice").alias("value")))


@query(f"WITH {MODEL}, k AS (SELECT DISTINCT l_partkey + 100 AS key FROM lineitem) SELECT key, coalesce(value, 0) AS value FROM k LEFT JOIN model USING (key)")
def ps_pull(spark, d):
    return _model(spark, d).multi_get_or_init(table(spark, d, "lineitem").select((F.col("l_partkey") + 100).alias("key")))


@query(f"WITH {MODEL}, t AS (SELECT l_partkey + 100 AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS delta FROM lineitem GROUP BY 1) SELECT key, coalesce(value, 0) + coalesce(delta, 0) AS value FROM model FULL JOIN t USING (key)")
def ps_push(spark, d):
    return _model(spark, d).update(table(spark, d, "lineitem").select((F.col("l_partkey") + 100).alias("key"), F.col("l_quantity").cast("long").alias("delta"))).scan()


# blocks

BLOCKS = 16


def _orders(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("value"))
    return o.withColumn("block_id", K.hashed_block(F.col("key"), BLOCKS))


@query("SELECT least(o_orderkey // 64, 1023) AS ordered_block, o_orderkey % 16 AS block_id, count(*) AS items FROM orders GROUP BY 1, 2")
def block_stats(spark, d):
    return _orders(spark, d).groupBy(K.ordered_block(F.col("key"), 1024, 65_535).alias("ordered_block"), "block_id").agg(F.count("*").alias("items"))


@query(f"WITH {BALANCES}, {DELTAS}, {TOTALS} SELECT key, coalesce(b.value, 0) + coalesce(t.delta, 0) AS value FROM base b FULL JOIN (SELECT * FROM totals WHERE key % {BLOCKS} = 5) t USING (key) WHERE key % {BLOCKS} <> 6")
def block_operations(spark, d):
    """Deltas of block 5 applied, block 6 cleared."""
    mine = deltas(spark, d).where(K.hashed_block(F.col("key"), BLOCKS) == 5)
    return K.Block(K.Block(balances(spark, d), 5, BLOCKS).update(mine), 6, BLOCKS).clear().scan()


@query(f"WITH {BALANCES}, keys AS (SELECT DISTINCT o_custkey * 2 AS key FROM orders WHERE (o_custkey * 2) % {BLOCKS} = 4) SELECT key, coalesce(value, -key) AS value FROM keys LEFT JOIN base USING (key)")
def block_get_or_init(spark, d):
    mine = nations(spark, d).where(K.hashed_block(F.col("key"), BLOCKS) == 4)
    return K.Block(_initial(balances(spark, d)), 4, BLOCKS).get_or_init(mine)


@query("SELECT CAST(block_id % 3 AS BIGINT) AS owner, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items FROM (SELECT o_orderkey % 16 AS block_id, count(*) AS items FROM orders GROUP BY 1) GROUP BY 1")
def block_assignment(spark, d):
    owned = K.block_stats(_orders(spark, d)).join(F.broadcast(K.block_owners(spark, BLOCKS, 3)), "block_id")
    return owned.groupBy("owner").agg(F.count("*").alias("blocks"), F.sum("items").alias("items"))


@query("SELECT CAST(i AS BIGINT) AS block_id, CAST(CASE WHEN i % 3 = 0 AND i // 3 < 4 THEN 2 ELSE i % 3 END AS BIGINT) AS owner, items FROM range(16) t(i) JOIN (SELECT o_orderkey % 16 AS b, count(*) AS items FROM orders GROUP BY 1) ON b = i")
def block_move(spark, d):
    return K.move_blocks(K.block_owners(spark, BLOCKS, 3), 0, 2, 4).join(K.block_stats(_orders(spark, d)), "block_id")


@query("WITH r AS (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderkey % 16 AS block_id, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderkey % 16) AS n FROM orders) SELECT key, value, block_id FROM r WHERE rn <= floor(n * 0.25)")
def checkpoint_sample(spark, d):
    return K.checkpoint_sample(_orders(spark, d), 0.25)


@query("SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderkey % 16 AS block_id FROM orders")
def checkpoint_roundtrip(spark, d):
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="table-")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    loading.save(_orders(spark, d), path)
    return loading.restore(spark, path).select("key", "value", F.col("block_id").cast("long").alias("block_id"))


@query("SELECT o_orderkey AS key, o_orderkey % 16 AS block_id, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY ((o_orderkey % 2147483647) * 48271 + 5) % 2147483647, o_orderkey) - 1 AS place FROM orders")
def minibatch_blocks(spark, d):
    return K.minibatches(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), BLOCKS, seed=5)


# loading and parsing

@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def load_exist_key(spark, d):
    lines = table(spark, d, "events").select("event_id", F.concat_ws(" ", "user_id", "event_type").alias("value"))
    keyed = parsers.content(lines).select("event_id", F.split("value", r"\s+").alias("p"))
    return loading.load_with_keys(keyed.select(F.element_at("p", 1).cast("long").alias("key"), F.col("event_id").alias("seq"), F.element_at("p", 2).alias("value")))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS key, c_name AS value, (row_number() OVER (ORDER BY c_custkey) - 1) % 16 AS block_id FROM customer")
def load_none_key(spark, d):
    keyed = loading.load_without_keys(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("value")), "c_custkey", BLOCKS)
    return keyed.select("key", "value", "block_id")


@query("SELECT lang, count(*) AS lines FROM (SELECT lang, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1")
def scan_count(spark, d):
    return table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n", -1))).groupBy("lang").agg(F.count("*").alias("lines"))


@query("SELECT CAST(16 AS BIGINT) AS partitions, count(*) AS rows FROM orders")
def exact_n_partitions(spark, d):
    o = loading.in_partitions(table(spark, d, "orders").select("o_orderkey"), 16)
    return o.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.count("*").alias("partitions"), F.sum("n").alias("rows"))


@query("SELECT event_id, props AS value FROM events WHERE event_type NOT IN ('error', 'signup')")
def parse_filter(spark, d):
    e = table(spark, d, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("# "), "props")).when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.col("props"))
    return parsers.content(e.select("event_id", line.alias("value")))


LIBSVM = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS label, CAST({j} AS BIGINT) AS j, {x} AS x FROM lineitem"


@query(" UNION ALL ".join(LIBSVM.format(j=j, x=x) for j, x in enumerate(("l_discount", "l_tax", "l_extendedprice"))))
def parse_libsvm(spark, d):
    line = F.concat_ws(" ", F.col("l_quantity").cast("long"), F.concat(F.lit("0:"), "l_discount"), F.concat(F.lit("1:"), "l_tax"), F.concat(F.lit("2:"), "l_extendedprice"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("value"))
    parsed = parsers.long_form(parsers.libsvm(lines, keep=["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber", "label"])
    return parsed.select("l_orderkey", *(F.col(c).cast("long").alias(c) for c in ("l_linenumber", "label", "j")), "x")


@query("SELECT l_orderkey + 1 AS i, CAST(l_linenumber AS BIGINT) AS j, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def parse_ratings(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("v"))
    cell = F.concat_ws(",", "l_linenumber", "v")
    lines = l.groupBy("l_orderkey").agg(F.concat_ws(" ", F.sort_array(F.collect_list(cell))).alias("cells")).select(F.concat((F.col("l_orderkey") + 1).cast("string"), F.lit(": "), "cells").alias("value"))
    return parsers.ratings(lines).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")


@query("SELECT s_name AS host, min(CAST(1000 + s_nationkey * 100 AS DOUBLE)) AS value FROM supplier GROUP BY 1")
def host_bandwidth(spark, d):
    lines = table(spark, d, "supplier").select(F.explode(F.array(F.lit("# host bandwidth"), F.concat_ws(" ", "s_name", F.col("s_nationkey") * 100 + 1000))).alias("value"))
    return loading.host_values(lines)


@query("SELECT s_name AS host, min(CAST(1 + s_nationkey % 8 AS INT)) AS value FROM supplier GROUP BY 1")
def host_cores(spark, d):
    lines = table(spark, d, "supplier").select(F.concat_ws(" ", "s_name", F.col("s_nationkey") % 8 + 1).alias("value"))
    return loading.host_values(lines, "int")
