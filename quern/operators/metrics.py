"""Roll-ups of training metrics: rows of batches, epochs and servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_metrics(batches: DataFrame) -> DataFrame:
    """batches (source, epoch, batch, items, total_s, pull_s, push_s) with comp_s, the rest of the time, and items a second (null in no time)."""
    return batches.withColumn("comp_s", F.col("total_s") - F.col("pull_s") - F.col("push_s")).withColumn("rate", F.try_divide("items", "total_s"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("items", "total_s", "comp_s", "pull_s", "push_s")]
    return batch_metrics(batches).groupBy("source", "epoch").agg(F.count("*").alias("batches"), *sums)


def tracer(rows: DataFrame, group: str, seconds: str, elements: str) -> DataFrame:
    """Time in all, a record, and an element (infinite if there were none)."""
    total, n = F.sum(seconds), F.sum(elements)
    per = F.when(n == 0, F.lit(float("inf"))).otherwise(F.try_divide(total, n))
    return rows.groupBy(group).agg(total.alias("total_s"), (total / F.count("*")).alias("s_per_record"), per.alias("s_per_element"))


def valid(rows: DataFrame, skip: int, order: str = "batch", source: str = "source", resumed: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Without each source's first `skip` rows, and nothing unless every source still reports.

    resumed (source, at): a source's first row at or after `at` goes too. blocks (source, owned): rows with another number of `blocks` go.
    """
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order))
    kept = rows.withColumn("_rank", rank).where(F.col("_rank") > skip).drop("_rank")
    if resumed is not None:
        after = F.coalesce(F.col(order) >= F.col("at"), F.lit(False))
        first = F.row_number().over(Window.partitionBy(source, "_after").orderBy(order)) == 1
        kept = kept.join(resumed, source, "left").withColumn("_after", after).withColumn("_first", first).where("not (_after and _first)").drop("at", "_after", "_first")
    if blocks is not None:
        kept = kept.join(blocks, source).where(F.col("blocks") == F.col("owned")).drop("owned")
    sources = lambda d: d.agg(F.count_distinct(source)).first()[0]
    return kept if sources(kept) == sources(rows) else kept.where(F.lit(False))


def moving_average(rows: DataFrame, factor: float, window: int, value: str = "value", source: str = "source", order: str = "batch") -> DataFrame:
    """Of each source's last `window` rows (0: all) the mean with weights (1 - factor) ** i, newest first."""
    i = F.row_number().over(Window.partitionBy(source).orderBy(F.desc(order))) - 1
    d = rows.withColumn("_i", i)
    d = d.where(F.col("_i") < window) if window else d
    weight = F.pow(F.lit(1 - factor), F.col("_i"))
    return d.groupBy(source).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("ema"))


def server_rollup(rows: DataFrame, columns: list[str], group: str) -> DataFrame:
    return rows.groupBy(group).agg(*(F.sum(c).alias(c) for c in columns))


def pull_stats(rows: DataFrame) -> DataFrame:
    """rows (worker, batch, pulls, bytes): mean bytes a pull over all, and the mean of the workers' whole-number mean pulls a batch."""
    by_worker = rows.groupBy("worker").agg(F.sum("pulls").alias("p"), F.sum("bytes").alias("b"), F.count("*").alias("n"))
    mean = F.floor(F.col("p") / F.col("n"))
    return by_worker.agg((F.sum("b") / F.sum("p")).alias("avg_pull_bytes"), F.floor(F.avg(mean)).cast("long").alias("pulls_per_batch"))


def series(rows: DataFrame, source: str, key) -> DataFrame:
    """What a chart reads: one source's points."""
    return rows.where(F.col(source) == F.lit(key))


def least_epoch(rows: DataFrame, worker: str = "worker", epoch: str = "epoch") -> DataFrame:
    """The epoch that every worker has reached."""
    return rows.groupBy(worker).agg(F.max(epoch).alias("e")).agg(F.min("e").alias("min_epoch"))


def batches_done(rows: DataFrame, worker: str = "worker") -> DataFrame:
    """(worker, batches, total): each worker's batches and those of all."""
    return rows.groupBy(worker).agg(F.count("*").alias("batches")).withColumn("total", F.sum("batches").over(Window.partitionBy()))  # one row a worker
