"""Ranges of long keys, and small graphs of dependencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

SPAN = 1 << 20  # keys a bucket
MEET = 1 << 16  # keys a bucket where ranges of two sets meet


def dense_ranges(keys: DataFrame, span: int = SPAN) -> DataFrame:
    """keys (key) to (first, last) of runs without gaps. Runs are found within buckets of keys, then those that touch across a border are joined; only a row a bucket's run meets in the second step."""
    d = keys.select("key").distinct().withColumn("_b", F.call_function("div", F.col("key"), F.lit(span)))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("key"))
    runs = d.withColumn("_g", F.col("key") - rank).groupBy("_b", "_g").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    border = (F.pmod("first", F.lit(span)) == 0) | (F.pmod(F.col("last") + 1, F.lit(span)) == 0)
    w = Window.orderBy("first")  # two runs a bucket at most
    begins = F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True))
    joined = runs.where(border).withColumn("_begin", begins.cast("int")).withColumn("_run", F.sum("_begin").over(w))
    joined = joined.groupBy("_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    return runs.where(~border).select("first", "last").union(joined)


def intersection(a: DataFrame, b: DataFrame, span: int = MEET) -> DataFrame:
    """What both sets of ranges (first, last) hold, as ranges. Ranges meet in buckets of keys; an overlap is found in the bucket in which it begins.

    Of two ranges that overlap one begins within the other, and in order of beginnings those are neighbours: two binary searches a range find them, without trying pairs.
    """
    def cut(d: DataFrame, side: int) -> DataFrame:
        bucket = lambda k: F.call_function("div", F.col(k), F.lit(span)) - (F.col(k) % span < 0).cast("long")  # noqa: E731 - rounds down, also under 0
        return d.where("first <= last").select(F.lit(side).alias("side"), "first", "last", F.explode(F.sequence(bucket("first"), bucket("last"))).alias("_b"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = (rows.loc[rows["side"] == k, ["first", "last"]].sort_values("first").to_numpy("int64").T for k in (0, 1))
        out = []
        for (first, last), (first2, last2), after in ((one, two, "left"), (two, one, "right")):  # equal beginnings count for one side
            low = np.searchsorted(first2, first, after)
            n = np.maximum(np.searchsorted(first2, last, "right") - low, 0)
            other = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            out.append(np.stack([first2[other], np.minimum(np.repeat(last, n), last2[other])], axis=1))
        met = pd.DataFrame(np.concatenate(out), columns=["first", "last"])
        return met[met["first"] // span == rows["_b"].iloc[0]].drop_duplicates()

    return cut(a, 0).union(cut(b, 1)).groupBy("_b").applyInPandas(meet, "first long, last long")


def complement(ranges: DataFrame, first: int, last: int) -> DataFrame:
    """The gaps that disjoint ranges leave in [first, last]."""
    w = Window.orderBy("first")
    before = ranges.select((F.coalesce(F.lag("last").over(w), F.lit(first - 1)) + 1).alias("g0"), (F.col("first") - 1).alias("g1"))
    tail = ranges.agg((F.coalesce(F.max("last"), F.lit(first - 1)) + 1).alias("g0")).select("g0", F.lit(last).alias("g1"))
    return before.union(tail).select(F.greatest("g0", F.lit(first)).alias("first"), F.least("g1", F.lit(last)).alias("last")).where("first <= last")


def roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (id) that no edge (src, dst) leads to."""
    return vertices.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def in_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return vertices.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, dst): where edges (src, dst) lead from the vertices ids (id)."""
    return ids.select("id").join(edges, F.col("id") == F.col("src")).select("id", "dst")


def without_vertices(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph less the vertices ids (id) and the edges at either of their ends."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.select("src", "dst")


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges less those of `gone` (src, dst)."""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def layers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): roots are layer 0, others come one after the last vertex that leads to them. Raises if edges form a cycle.

    Each round removes the roots that are left, behind a checkpoint; rounds are as many as the longest path has vertices.
    """
    left, e, out, layer = cut(vertices.select("id").distinct()), cut(edges.select("src", "dst")), None, 0
    while not left.isEmpty():
        now = cut(roots(left, e).withColumn("layer", F.lit(layer)))
        if now.isEmpty():
            raise ValueError("the edges form a cycle")
        out = now if out is None else out.union(now)
        left, e = (cut(x) for x in without_vertices(left, e, now))
        layer += 1
    return vertices.select("id", F.lit(0).alias("layer")).where("false") if out is None else out


def to_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, json): a vertex and, in order, where its edges lead."""
    to = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("to"))
    return vertices.select("id").join(to, "id", "left").select("id", F.to_json(F.struct("id", F.coalesce("to", F.array().cast("array<string>")).alias("to"))).alias("json"))
