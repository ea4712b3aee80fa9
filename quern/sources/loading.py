"""Loading and saving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Lines of text files as `value`; splits are Spark's own."""
    return spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)


def content(lines: DataFrame) -> DataFrame:
    """Without blank lines and comments, as every parser begins."""
    return lines.where((F.length(F.trim("value")) > 0) & ~F.startswith(F.ltrim("value"), F.lit("#")))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines) of each file under the path."""
    return read_lines(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("lines"))


def in_partitions(df: DataFrame, n: int) -> DataFrame:
    """Exactly n partitions of even size."""
    return df.repartition(n)


def load_with_keys(rows: DataFrame) -> DataFrame:
    """rows (key, seq, value) of a bulk load: a key that comes twice has its last value."""
    from quern.operators.tables import last_wins

    return last_wins(rows)


def load_without_keys(rows: DataFrame, order: str, blocks: int, first: int = 0) -> DataFrame:
    """Values get keys first, first + 1, ... in the order given, and block_id = key mod blocks. Rows are ranked within ranges of the order, and a range begins after those before it, so no one task numbers all rows."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = F.array(*(F.lit(e) for e in sorted(set(ends))))
    ranged = rows.withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col(order))) if ends else F.lit(0))
    sizes = ranged.groupBy("_range").count()  # as many rows as partitions
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    keyed = ranged.withColumn("_rank", rank).join(F.broadcast(starts), "_range").withColumn("key", F.col("_start") + F.col("_rank") - 1 + F.lit(first))
    return keyed.drop("_range", "_rank", "_start").withColumn("block_id", F.pmod("key", F.lit(blocks)).cast("long"))


def save(df: DataFrame, path: str, by_block: bool = True) -> None:
    """A table's checkpoint: parquet, a folder a block."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("block_id") if by_block else writer).parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def host_values(lines: DataFrame, kind: str = "double") -> DataFrame:
    """`host value` to (host, value): bandwidths as numbers, or with kind `int` cores. Of repeated hosts the least value counts."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = content(lines).select(F.element_at(parts, 1).alias("host"), F.element_at(parts, 2).cast(kind).alias("value"))
    return pairs.groupBy("host").agg(F.min("value").alias("value"))


def read_test_data(spark: SparkSession, path: str | None, parse) -> DataFrame:
    """parse(lines) of the held-out lines at path; of no lines where no path is set."""
    return parse(spark.read.text(path) if path else spark.createDataFrame([], "value string"))
