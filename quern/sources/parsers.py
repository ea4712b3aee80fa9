"""Parsers from lines to rows: DataFrame in, DataFrame out, all in built-in functions.

A user's own parser has the same shape: a function from lines (`value`) to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loading import content


def checked(good: Column, value: Column, message: str) -> Column:
    """value, or an error where it is not good."""
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)))


def libsvm(lines: DataFrame, label: str = "int", classes: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """`label i:v i:v ...` to (label, idx array<int>, val array<double>); labels are under `classes` if given."""
    keep = keep or []
    # generators, as Catalyst would cut a line again for each use of a plain column
    d = content(lines).select(*keep, F.explode(F.array(F.split(F.trim("value"), r"\s+"))).alias("_parts"))
    y = F.element_at("_parts", 1).cast(label)
    if classes is not None:
        y = checked((y >= 0) & (y < classes), y, f"labels are from 0 to {classes - 1}")
    pairs = F.transform(F.slice("_parts", F.lit(2), F.size("_parts")), lambda p: F.split(p, ":"))
    d = d.select(*keep, y.alias("label"), F.explode(F.array(pairs)).alias("_pairs"))
    idx = F.transform("_pairs", lambda p: F.element_at(p, 1).cast("int"))
    val = F.transform("_pairs", lambda p: F.element_at(p, 2).cast("double"))
    return d.select(*keep, "label", idx.alias("idx"), val.alias("val"))


def long_form(instances: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, j, x) of sparse instances."""
    pairs = F.explode(F.arrays_zip("idx", "val"))
    return instances.select(*keep, pairs.alias("p")).select(*keep, F.col("p.idx").alias("j"), F.col("p.val").alias("x"))


def feature_types(lines: DataFrame) -> DataFrame:
    """`idx:type ...` to (idx, type): 0 continuous, otherwise a number of categories; the last entry is the label's."""
    return content(lines).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("p")).select(F.split("p", ":").alias("p")).select(F.element_at("p", 1).cast("int").alias("idx"), F.element_at("p", 2).cast("int").alias("type"))


def ratings(lines: DataFrame) -> DataFrame:
    """`row: col,val col,val` to (i, j, v): indices from 1, values not negative."""
    halves = F.split("value", ":")
    row = F.trim(F.element_at(halves, 1)).cast("int")
    cells = F.filter(F.split(F.trim(F.element_at(halves, 2)), r"\s+"), lambda x: x != "")
    d = content(lines).select(row.alias("i"), F.explode(cells).alias("c")).select("i", F.split("c", ",").alias("c")).select("i", F.element_at("c", 1).cast("int").alias("j"), F.element_at("c", 2).cast("double").alias("v"))
    good = (F.col("i") >= 1) & (F.col("j") >= 1) & (F.col("v") >= 0)
    return d.select("i", "j", checked(good, F.col("v"), "indices are at least 1 and values at least 0").alias("v"))


def tokens(lines: DataFrame, doc: str) -> DataFrame:
    """Words by white space to (doc, pos, word)."""
    return lines.select(doc, F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("pos", "word"))


def adjacency(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`src dst dst ...` to (vertices, edges); a line without targets is a vertex all the same."""
    parts = F.transform(F.filter(F.split(F.trim("value"), " "), lambda x: x != ""), lambda x: x.cast("long"))
    rows = content(lines).select(parts.alias("p"))
    vertices = rows.select(F.element_at("p", 1).alias("id")).distinct()
    edges = rows.select(F.element_at("p", 1).alias("src"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("dst"))
    return vertices, edges


def weighted_adjacency(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`src dst w dst w ...` to (vertices, edges with weight); only sources of edges are vertices."""
    parts = F.transform(F.filter(F.split(F.trim("value"), " "), lambda x: x != ""), lambda x: x.cast("long"))
    rows = content(lines).select(parts.alias("p")).where(F.size("p") >= 3)
    edges = rows.select("p", F.explode(F.sequence(F.lit(2), F.size("p") - 1, F.lit(2))).alias("k")).select(F.element_at("p", 1).alias("src"), F.expr("element_at(p, k)").alias("dst"), F.expr("element_at(p, k + 1)").alias("weight"))
    return rows.select(F.element_at("p", 1).alias("id")).distinct(), edges


def key_values(lines: DataFrame) -> DataFrame:
    """`key value` to (key, value)."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return content(lines).select(F.element_at(parts, 1).cast("long").alias("key"), F.element_at(parts, 2).alias("value"))
