"""Lasso by coordinate descent on the Gram matrix, which is one pass over the instances (features array<double>, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.matrices import gram as _gram

from .training import literal


def gram(instances: DataFrame) -> DataFrame:
    """(i, j, v): products of columns, with the label as the last column."""
    return _gram(instances.select(F.concat("features", F.array("label")).alias("x")), "x")


def soft(x: float, by: float) -> float:
    return x - by if x > by else x + by if x < -by else 0.0


def descend(g: list[list[float]], weights: list[float], penalty: float, sweeps: int = 1, skip_zero: bool = True) -> list[float]:
    """Coordinates in order, each to its minimum; zero columns, and weights that are already zero if asked, are passed over. g: with the label's column last."""
    w = list(weights)
    for _ in range(sweeps):
        for j in range(len(w)):
            if not g[j][j] or skip_zero and abs(w[j]) < 1e-9:
                continue
            rest = g[j][-1] - sum(g[j][k] * w[k] for k in range(len(w)) if k != j)
            w[j] = soft(rest / g[j][j], penalty / g[j][j])
    return w


def train(instances: DataFrame, weights: list[float], penalty: float, step: float = 1.0, sweeps: int = 1, skip_zero: bool = True) -> list[float]:
    """Weights moved by `step` of the way to what the descent finds."""
    n = len(weights) + 1
    g = [[0.0] * n for _ in range(n)]
    for i, j, v in gram(instances).collect():  # features + 1 squared
        g[i][j] = v
    return [w + step * (x - w) for w, x in zip(weights, descend(g, weights, penalty, sweeps, skip_zero))]


def loss(instances: DataFrame, weights: list[float]) -> DataFrame:
    error = F.col("label") - V.dot(literal(weights, "array<double>"), F.col("features"))
    return instances.agg(F.sum(error * error).alias("loss"))
