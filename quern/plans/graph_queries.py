"""Queries of vertex programs over the graph of parts and suppliers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.sources import parsers

from .common import query, table

FAR = 1_000_000_000_000  # suppliers' ids come after parts'
EDGES = f"e AS (SELECT l_partkey AS src, {FAR} + l_suppkey AS dst, CAST(min(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2), edges AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e), vertices AS (SELECT DISTINCT src AS id FROM edges)"
UPDATES, ROUNDS = 10, 14


def edges(spark, d, *more: str) -> DataFrame:
    """Packed edges both ways, with weight if asked for. Lines are dealt once, by where their edges start; what is left for a pair is found there."""
    way = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    part, supplier = F.col("l_partkey"), F.col("l_suppkey") + FAR
    both = table(spark, d, "lineitem").select(F.explode(F.array(way(part, supplier), way(supplier, part))).alias("e"), "l_quantity").select("e.*", *(["l_quantity"] if more else []))
    dealt = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").groupBy("src", "dst")
    return G.packed(dealt.agg(F.min("l_quantity").cast("long").alias("weight")) if more else dealt.agg(F.lit(1)).select("src", "dst"), dealt=True)


def _pagerank_sql() -> str:
    steps = [f"r{k} AS (SELECT id, {1 - G.DAMPING!r} + {G.DAMPING!r} * coalesce(m, 0) AS v FROM vertices LEFT JOIN (SELECT dst, sum(v / n) AS m FROM r{k - 1} JOIN edges ON id = src JOIN deg USING (src) GROUP BY dst) ON dst = id)" for k in range(1, UPDATES + 1)]
    return f"WITH {EDGES}, deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src), r0 AS (SELECT id, 1::DOUBLE AS v FROM vertices), {', '.join(steps)} SELECT id, round(v, 6) AS value FROM r{UPDATES}"


@query(_pagerank_sql())
def pagerank(spark, d):
    e = edges(spark, d)
    return G.pagerank(G.sources(e), e).select("id", F.round("value", 6).alias("value"))


def _sssp_sql(tail: str) -> str:
    steps = [f"d{k} AS (SELECT a.id, least(a.v, coalesce(m, a.v)) AS v FROM d{k - 1} a LEFT JOIN (SELECT dst, min(v + weight) AS m FROM d{k - 1} JOIN edges ON id = src WHERE v < {G.UNREACHED} GROUP BY dst) ON dst = a.id)" for k in range(1, ROUNDS + 1)]
    return f"WITH {EDGES}, d0 AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM vertices) THEN 0 ELSE {G.UNREACHED} END AS v FROM vertices), {', '.join(steps)} {tail}"


def _sssp(spark, d):
    e = edges(spark, d, "weight")
    v = G.sources(e)
    source = v.agg(F.min("id")).first()[0]
    return G.shortest_paths(v, e, source)


@query(_sssp_sql(f"SELECT id, CAST(v AS BIGINT) AS value FROM d{ROUNDS}"))
def sssp(spark, d):
    return _sssp(spark, d)[0]


@query(_sssp_sql(f"SELECT CAST(2 + {' + '.join(f'(SELECT count(*) > 0 FROM d{k} x JOIN d{k - 1} y USING (id) WHERE x.v <> y.v)::INT' for k in range(1, ROUNDS + 1))} AS BIGINT) AS supersteps"))
def pregel_supersteps(spark, d):
    return spark.range(1).select(F.lit(_sssp(spark, d)[1]).cast("long").alias("supersteps"))


@query("SELECT l_suppkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS message FROM lineitem GROUP BY 1")
def combine_sum(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("message"))


@query("SELECT l_suppkey AS dst, CAST(min(CAST(l_quantity AS BIGINT)) AS BIGINT) AS message FROM lineitem GROUP BY 1")
def combine_min(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dst")).agg(F.min(F.col("l_quantity").cast("long")).alias("message"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def graph_adjacency(spark, d):
    e = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    lines = e.groupBy("l_partkey").agg(F.concat_ws(" ", F.first("l_partkey").cast("string"), F.collect_list(F.col("l_suppkey").cast("string"))).alias("value"))
    return parsers.adjacency(lines.select("value"))[1]


@query(f"WITH {EDGES} SELECT src AS id, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY 1")
def graph_degree(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") + FAR).alias("dst")).agg(F.min("l_quantity").cast("long").alias("w"))
    lines = e.groupBy("l_partkey").agg(F.concat_ws(" ", F.first("l_partkey").cast("string"), F.collect_list(F.concat_ws(" ", "dst", "w"))).alias("value"))
    _, parsed = parsers.weighted_adjacency(lines.select("value"))
    weights = parsed.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("weight"))
    return G.degrees(parsed).join(weights, "id")
