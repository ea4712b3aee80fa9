"""Matrices as rows (i, j, v), absent elements zero. Products are a join on the inner index and a sum that combines on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_rows(df: DataFrame, row: str, vector: str) -> DataFrame:
    """The dense rows of a column of vectors."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(F.col(vector).cast("array<double>")).alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def shape(m: DataFrame) -> DataFrame:
    """(rows, columns, active): the extents of the indices and the elements that are not zero."""
    return m.agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"), F.count(F.when(F.col("v") != 0, 1)).alias("active"))


def element(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.where((F.col("i") == i) & (F.col("j") == j))


def slice_rows(m: DataFrame, start: int, end: int) -> DataFrame:
    return m.where((F.col("i") >= start) & (F.col("i") < end)).withColumn("i", F.col("i") - start)


def slice_columns(m: DataFrame, start: int, end: int) -> DataFrame:
    return m.where((F.col("j") >= start) & (F.col("j") < end)).withColumn("j", F.col("j") - start)


def put(m: DataFrame, part: DataFrame) -> DataFrame:
    """m with the elements of `part` in their places."""
    new = part.select("i", "j", F.col("v").alias("_new"))
    return m.join(new, ["i", "j"], "full").select("i", "j", F.coalesce("_new", "v").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def with_scalar(m: DataFrame, f) -> DataFrame:
    """f(v) of each element; the elements must be all there unless f(0) is 0."""
    return m.select("i", "j", f(F.col("v")).alias("v"))


def elementwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f(x, y) of the elements of both."""
    y = b.select("i", "j", F.col("v").alias("_y"))
    zero = F.lit(0.0)
    return a.join(y, ["i", "j"], "full").select("i", "j", f(F.coalesce("v", zero), F.coalesce("_y", zero)).alias("v"))


def times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """m (i, j, v) times x (j, x)."""
    return m.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    left = a.select("i", F.col("j").alias("k"), "v")
    return left.join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """X^T X of the rows of a column of vectors: a row's own products, summed; no join."""
    v: Column = F.col(vector).cast("array<double>")
    d = rows.select(v.alias("_v")).select("_v", F.posexplode("_v").alias("i", "_x")).select("i", "_x", F.posexplode("_v").alias("j", "_y"))
    return d.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))


def beside(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """b to the right of a, which has so many columns."""
    return a.unionByName(b.withColumn("j", F.col("j") + columns))


def below(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """b under a, which has so many rows."""
    return a.unionByName(b.withColumn("i", F.col("i") + rows))
