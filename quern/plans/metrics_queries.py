"""Queries of metrics, the cost model, ranges and plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import metrics as X
from quern.operators import planner as P
from quern.operators import ranges as R
from quern.operators import training

from .common import query, table

BATCH = "b AS (SELECT user_id AS source, CAST(day(ts) AS BIGINT) AS epoch, event_id AS batch, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS items, value AS total_s, value / 4 AS pull_s, value / 8 AS push_s FROM events)"


def batches(spark, d) -> DataFrame:
    v = F.col("value")
    items = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("source"), F.dayofmonth("ts").cast("long").alias("epoch"), F.col("event_id").alias("batch"), items.alias("items"), v.alias("total_s"), (v / 4).alias("pull_s"), (v / 8).alias("push_s"))


@query(f"WITH {BATCH} SELECT batch, source, round(total_s - pull_s - push_s, 7) AS comp_s, round(CASE WHEN total_s <> 0 THEN items / total_s END, 4) AS rate FROM b")
def batch_metrics(spark, d):
    return X.batch_metrics(batches(spark, d)).select("batch", "source", F.round("comp_s", 7).alias("comp_s"), F.round("rate", 4).alias("rate"))


@query(f"WITH {BATCH} SELECT source, epoch, count(*) AS batches, CAST(sum(items) AS BIGINT) AS items, round(sum(total_s), 6) AS total_s, round(sum(total_s - pull_s - push_s), 6) AS comp_s FROM b GROUP BY 1, 2")
def epoch_metrics(spark, d):
    return X.epoch_metrics(batches(spark, d)).select("source", "epoch", "batches", "items", F.round("total_s", 6).alias("total_s"), F.round("comp_s", 6).alias("comp_s"))


@query(f"WITH {BATCH} SELECT source, round(sum(total_s), 6) AS total_s, round(sum(total_s) / count(*), 4) AS s_per_record, round(sum(total_s) / sum(items), 5) AS s_per_element FROM b GROUP BY 1")
def tracer_avg(spark, d):
    t = X.tracer(batches(spark, d), "source", "total_s", "items")
    return t.select("source", F.round("total_s", 6).alias("total_s"), F.round("s_per_record", 4).alias("s_per_record"), F.round("s_per_element", 5).alias("s_per_element"))


@query(f"WITH {BATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY batch) AS rn FROM b), k AS (SELECT * FROM r WHERE rn > 3) SELECT source, batch, items FROM k WHERE (SELECT count(DISTINCT source) FROM k) = (SELECT count(DISTINCT source) FROM b)")
def metrics_valid(spark, d):
    return X.valid(batches(spark, d), 3).select("source", "batch", "items")


@query(f"WITH {BATCH}, r AS (SELECT *, batch % 5 AS blocks, row_number() OVER (PARTITION BY source ORDER BY batch) AS rn FROM b), k AS (SELECT *, source % 2 = 0 AND batch >= 1000 AS after FROM r WHERE rn > 2), f AS (SELECT *, row_number() OVER (PARTITION BY source, after ORDER BY batch) AS first FROM k), g AS (SELECT * FROM f WHERE NOT (after AND first = 1) AND blocks <> 3 AND blocks = CASE WHEN source % 3 = 0 THEN 1 ELSE 2 END) SELECT source, batch, items FROM g WHERE (SELECT count(DISTINCT source) FROM g) = (SELECT count(DISTINCT source) FROM b)")
def metrics_valid_all(spark, d):
    """All four rules: the first rows, the first after a resumption, other numbers of blocks, every source reporting."""
    b = batches(spark, d).withColumn("blocks", F.col("batch") % 5)
    sources = b.select("source").distinct()
    resumed = sources.where("source % 2 = 0").withColumn("at", F.lit(1000).cast("long"))
    owned = sources.withColumn("owned", F.when(F.col("source") % 3 == 0, 1).otherwise(2))
    return X.valid(b, 2, resumed=resumed, blocks=owned).select("source", "batch", "items")


@query(f"WITH {BATCH}, r AS (SELECT source, items, row_number() OVER (PARTITION BY source ORDER BY batch DESC) - 1 AS i FROM b) SELECT source, round(sum(pow(0.7::DOUBLE, i) * items) / sum(pow(0.7::DOUBLE, i)), 5) AS ema FROM r WHERE i < 10 GROUP BY 1")
def metrics_ema(spark, d):
    return X.moving_average(batches(spark, d), 0.3, 10, value="items").select("source", F.round("ema", 5).alias("ema"))


@query("SELECT event_id, round(value, 4) AS value FROM events WHERE user_id = 8")
def metrics_series(spark, d):
    return X.series(table(spark, d, "events"), "user_id", 8).select("event_id", F.round("value", 4).alias("value"))


@query(f"WITH {BATCH} SELECT epoch, CAST(sum(items) AS BIGINT) AS items, round(sum(pull_s), 6) AS pull_s FROM b GROUP BY 1")
def server_rollup(spark, d):
    return X.server_rollup(batches(spark, d), ["items", "pull_s"], "epoch").withColumn("pull_s", F.round("pull_s", 6))


@query(f"WITH {BATCH}, w AS (SELECT source, sum(items) AS p, sum(items * 8) AS b, count(*) AS n FROM b GROUP BY 1) SELECT round(sum(b) / sum(p), 5) AS avg_pull_bytes, CAST(floor(avg(floor(p / n))) AS BIGINT) AS pulls_per_batch FROM w")
def pull_stats(spark, d):
    rows = batches(spark, d).select(F.col("source").alias("worker"), "batch", F.col("items").alias("pulls"), (F.col("items") * 8).alias("bytes"))
    return X.pull_stats(rows).withColumn("avg_pull_bytes", F.round("avg_pull_bytes", 5))


@query(f"WITH {BATCH} SELECT min(e) AS min_epoch FROM (SELECT source, max(epoch) AS e FROM b GROUP BY 1)")
def progress_min_epoch(spark, d):
    return X.least_epoch(batches(spark, d), "source")


@query(f"WITH {BATCH} SELECT source, count(*) AS batches, (SELECT count(*) FROM b) AS total FROM b GROUP BY 1")
def progress_batches(spark, d):
    return X.batches_done(batches(spark, d), "source")


@query(f"WITH {BATCH} SELECT DISTINCT epoch, round(0.1::DOUBLE * pow(0.9::DOUBLE, epoch // 5), 9) AS step FROM b")
def step_decay(spark, d):
    return batches(spark, d).select("epoch").distinct().select("epoch", F.round(training.step_column(0.1, 0.9, 5, F.col("epoch")), 9).alias("step"))


EXECUTORS = "x AS (SELECT s_suppkey AS id, s_acctbal + 1100::DOUBLE AS thr, CAST(1000 + s_nationkey * 100 AS DOUBLE) AS bw FROM supplier)"
COSTS = EXECUTORS + ", r AS (SELECT *, row_number() OVER (ORDER BY thr DESC, id) AS rank, count(*) OVER () AS n FROM x), w AS (SELECT a.rank AS workers, sum(b.bw) AS sbw FROM r a JOIN r b ON b.rank > a.rank GROUP BY 1), c AS (SELECT workers, 500::DOUBLE / sum(1 / (1 / thr + 3::DOUBLE * greatest(1 / bw, workers / sbw))) AS cost FROM w JOIN r ON rank <= workers GROUP BY 1)"


def costs(spark, d) -> DataFrame:
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + 1100).alias("throughput"), (F.lit(1000) + F.col("s_nationkey") * 100).cast("double").alias("bandwidth"))
    return P.cost_model(x, 500.0, 3.0)


@query(f"WITH {COSTS} SELECT workers, round(cost, 6) AS cost FROM c")
def cost_model(spark, d):
    return costs(spark, d).select("workers", F.round("cost", 6).alias("cost"))


@query(f"WITH {COSTS}, m AS (SELECT arg_min(workers, cost) AS workers, min(cost) AS cost, max(CASE WHEN workers = 3 THEN cost END) AS now FROM c) SELECT workers, round(cost, 6) AS cost, round((now - cost) / now, 6) AS benefit, (now - cost) / now >= 0.05 AS act FROM m")
def cost_best(spark, d):
    return P.best_plan(costs(spark, d), 3, 0.05).select("workers", F.round("cost", 6).alias("cost"), F.round("benefit", 6).alias("benefit"), "act")


BLOCKS = "s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(1 + n_regionkey AS BIGINT) AS share FROM nation), f AS (SELECT *, CAST(floor(1024 * share / sum(share) OVER ()) AS BIGINT) AS base, row_number() OVER (ORDER BY id) AS rank FROM s), a AS (SELECT id, share, base + CASE WHEN rank <= 1024 - sum(base) OVER () THEN 1 ELSE 0 END AS blocks FROM f)"


def shares(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("share"))


@query(f"WITH {BLOCKS} SELECT id, share, CAST(blocks AS BIGINT) AS blocks FROM a")
def block_allocation(spark, d):
    return P.allocate_blocks(shares(spark, d), 1024)


@query(f"WITH {BLOCKS}, e AS (SELECT id, 40 + CASE WHEN row_number() OVER (ORDER BY id) <= 24 THEN 1 ELSE 0 END AS even FROM s), j AS (SELECT id, even - blocks AS over FROM a JOIN e USING (id)), g AS (SELECT id, sum(over) OVER (ORDER BY id) - over AS s0, sum(over) OVER (ORDER BY id) AS s1 FROM j WHERE over > 0), t AS (SELECT id, -(sum(over) OVER (ORDER BY id) - over) AS t0, -(sum(over) OVER (ORDER BY id)) AS t1 FROM j WHERE over < 0) SELECT g.id AS source, t.id AS target, CAST(least(s1, t1) - greatest(s0, t0) AS BIGINT) AS blocks FROM g JOIN t ON s0 < t1 AND t0 < s1")
def transfer_steps(spark, d):
    s = shares(spark, d)
    even = P.allocate_blocks(s.withColumn("share", F.lit(1).cast("long")), 1024)
    return P.transfers(even, P.allocate_blocks(s, 1024))


ISLANDS = "{0} AS (SELECT min(k) AS first, max(k) AS last FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT {1} AS k FROM {2}) z) z GROUP BY g)"
A, B = ISLANDS.format("a", "l_orderkey", "lineitem WHERE l_returnflag = 'R'"), ISLANDS.format("b", "o_orderkey", "orders WHERE o_orderstatus = 'F'")


def _ranges(spark, d, span=R.SPAN) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    b = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return R.dense_ranges(a, span), R.dense_ranges(b, span)


@query(f"WITH {A} SELECT first, last FROM a")
def range_islands(spark, d):
    return _ranges(spark, d, 64)[0]


@query(f"WITH {A}, {B} SELECT greatest(a.first, b.first) AS first, least(a.last, b.last) AS last FROM a JOIN b ON a.first <= b.last AND b.first <= a.last")
def range_intersect(spark, d):
    return R.intersection(*_ranges(spark, d))


@query(f"WITH {A}, p AS (SELECT coalesce(lag(last) OVER (ORDER BY first), -1) + 1 AS first, first - 1 AS last FROM a UNION ALL SELECT max(last) + 1, 999999999 FROM a) SELECT first, last FROM p WHERE first <= last")
def range_complement(spark, d):
    return R.complement(_ranges(spark, d)[0], 0, 999_999_999)


def _dag(spark, d) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation")
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    more = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    every = e.union(more)
    v = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")).union(every.select("dst"))
    return v.distinct(), every


DAG = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), v AS (SELECT 'r' || r_regionkey AS id FROM region UNION SELECT dst FROM e)"


@query(f"WITH {DAG} SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)")
def dag_roots(spark, d):
    return R.roots(*_dag(spark, d))


@query(f"WITH {DAG} SELECT id, count(dst) AS in_degree FROM v LEFT JOIN e ON dst = id GROUP BY 1")
def dag_in_degrees(spark, d):
    return R.in_degrees(*_dag(spark, d))


@query(f"WITH {DAG} SELECT src AS id, dst FROM e WHERE src LIKE 'r%'")
def dag_neighbours(spark, d):
    v, e = _dag(spark, d)
    return R.neighbours(e, v.where("id like 'r%'"))


@query(f"WITH {DAG}, kept AS (SELECT * FROM e WHERE src NOT IN ('r0', 'n7') AND dst NOT IN ('r0', 'n7') AND NOT (src = 'r1' AND dst = 'n1')) SELECT id, count(dst) AS in_degree FROM v LEFT JOIN kept ON dst = id WHERE id NOT IN ('r0', 'n7') GROUP BY 1")
def dag_remove(spark, d):
    gone = spark.createDataFrame([("r0",), ("n7",)], "id string")
    v, e = R.without_vertices(*_dag(spark, d), gone)
    return R.in_degrees(v, R.without_edges(e, spark.createDataFrame([("r1", "n1")], "src string, dst string")))


@query(f"WITH {DAG} SELECT id, CAST(CASE left(id, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS INT) AS layer FROM v")
def dag_layers(spark, d):
    return R.layers(*_dag(spark, d))


@query(f"WITH {DAG}, t AS (SELECT src, string_agg('\"' || dst || '\"', ',' ORDER BY dst) AS l FROM e GROUP BY 1) SELECT id, '{{\"id\":\"' || id || '\",\"to\":[' || coalesce(l, '') || ']}}' AS json FROM v LEFT JOIN t ON src = id")
def dag_json(spark, d):
    return R.to_json(*_dag(spark, d))


KINDS = ("allocate", "create", "associate", "subscribe", "move", "start", "unassociate", "stop", "unsubscribe", "deallocate")


@query(f"WITH o AS (SELECT s_suppkey AS op, s_nationkey AS x, [{', '.join(map(repr, KINDS))}][s_suppkey % {len(KINDS)} + 1] AS kind FROM supplier), r AS (SELECT * FROM (VALUES {', '.join(f'({a!r}, {b!r})' for b, earlier in P.AFTER.items() for a in earlier)}) t(k1, k2)) SELECT a.op AS before, b.op AS after FROM o a JOIN r ON a.kind = k1 JOIN o b ON b.kind = k2 AND a.x = b.x")
def plan_dependencies(spark, d):
    kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod("s_suppkey", F.lit(len(KINDS))))
    return P.dependencies(table(spark, d, "supplier").select(F.col("s_suppkey").alias("op_id"), kind.alias("kind"), F.col("s_nationkey").alias("executor")))
