"""Vertex programs in supersteps: vertices join the messages that were combined for them, apply, and send along edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .tables import cut

DAMPING = 0.8500000238418579  # the float 0.85 as a double
UNREACHED = 2**63 - 1
LIST = 1 << 13  # edges in a row of packed ones


@dataclass(frozen=True)
class Computation:
    """A program of expressions over vertex columns id, value, n_edges, `message` (null: none) and, to send, an edge's weight.

    first: value at the start; sends_first: whether a vertex sends in superstep 0; apply: the next value; send: the message along
    an edge; active: whether a vertex sends after applying; combine: the aggregate of messages.
    """

    first: Column
    sends_first: Column
    apply: Column
    send: Column
    active: Column
    combine: Callable[[Column], Column]


def packed(edges: DataFrame, dealt: bool = False) -> DataFrame:
    """edges (src, dst and more) as checkpointed rows (src, dst array and more arrays), at most LIST edges a row, partitioned by src. dealt: edges are partitioned by src already.

    A superstep then reads 8 bytes a column of an edge, and neither moves nor sorts edges.
    """
    columns = [c for c in edges.columns if c != "src"]
    if not dealt:
        edges = edges.repartition(_parts(edges), "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    rows = edges.where("src is not null").withColumn("_list", F.call_function("div", place - 1, F.lit(LIST)))
    lists = rows.groupBy("src", "_list").agg(F.collect_list(F.struct(*columns)).alias("_e"))
    return cut(lists.select("src", *(F.col("_e")[c].alias(c) for c in columns)), placed=True)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sources(lists: DataFrame) -> DataFrame:
    """The vertices (id) that edges of packed() start from; no shuffle."""
    return lists.select(F.col("src").alias("id")).distinct()


def _deliver(vertices: DataFrame, lists: DataFrame, program: Computation) -> DataFrame:
    columns = [c for c in lists.columns if c != "src"]
    met = lists.join(vertices.where("active").hint("shuffle_hash"), F.col("id") == F.col("src"))
    each = met.select("id", "value", "n_edges", F.explode(F.arrays_zip(*columns)).alias("_e")).select("id", "value", "n_edges", "_e.*")
    return each.select(F.col("dst").alias("id"), program.send.alias("m")).groupBy("id").agg(program.combine(F.col("m")).alias("message"))


def pregel(vertices: DataFrame, edges: DataFrame, program: Computation, most: int = 1000, every: int = 5, fixed: int | None = None) -> tuple[DataFrame, int]:
    """(id, value) and the number of supersteps, superstep 0 included. edges: (src, dst and more), or such as packed() gives.

    Runs until no vertex is active, or `fixed` rounds of messages. A vertex wakes by a message; messages to ids that are no
    vertices go nowhere; combined messages are sent once. Lineage is cut by reliable checkpoints; a fixed number of rounds
    is one plan between them.
    """
    lists = edges if isinstance(edges.schema["dst"].dataType, ArrayType) else packed(edges)
    degree = lists.groupBy(F.col("src").alias("id")).agg(F.sum(F.size("dst")).alias("n_edges"))
    v = vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    v = cut(v.withColumn("value", program.first).withColumn("active", program.sends_first), placed=True)
    step = 0
    while step < most:
        if fixed is None and v.where("active").isEmpty() or step == fixed:
            break
        met = v.join(_deliver(v, lists, program).hint("shuffle_hash"), "id", "left")
        v = met.select("id", "n_edges", program.apply.alias("value"), program.active.alias("active"))
        step += 1
        if fixed is None or step % every == 0:
            v = cut(v, placed=True)
    return v.select("id", "value"), step + 1


def pagerank(vertices: DataFrame, edges: DataFrame, updates: int = 10, damping: float = DAMPING) -> DataFrame:
    """(id, value): 1 at first, then so many updates of (1 - d) + d * sum of value / out-degree; not normalised, what dangling vertices hold is not passed on."""
    value = F.lit(1 - damping) + F.lit(damping) * F.coalesce("message", F.lit(0.0))
    always = F.col("n_edges") > 0
    return pregel(vertices, edges.select("src", "dst"), Computation(F.lit(1.0), always, value, F.col("value") / F.col("n_edges"), always, F.sum), fixed=updates)[0]


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: int) -> tuple[DataFrame, int]:
    """(id, value): least distance from the source over long weights, UNREACHED if there is no path; and the supersteps."""
    start = F.col("id") == source
    far = F.lit(UNREACHED)
    better = F.coalesce(F.col("message") < F.col("value"), F.lit(False))
    program = Computation(F.when(start, F.lit(0).cast("long")).otherwise(far), start, F.when(better, F.col("message")).otherwise(F.col("value")), F.col("value") + F.col("weight"), better, F.min)
    return pregel(vertices, edges, program)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_edges"))
