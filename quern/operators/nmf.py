"""Non-negative matrix factorisation. Ratings (i, j, v); factors (id, f array<double>) of rows and of columns.

Factors grow with the ratings, so they are DataFrames joined by id; a gradient is the sum of a join, combined on the map side. Factors that
depend on id alone, as all do at the start, may be given as a function of the id's column instead, and then nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V

from .tables import cut


Factors = DataFrame | Callable[[Column], Column]


def hashed(rank: int, by: int = 31) -> Callable[[Column], Column]:
    """Values of 0 to 0.99 that depend on id and place alone."""
    return lambda i: F.array(*(F.pmod(i * by + F.lit(k * 17), F.lit(100)) / 100.0 for k in range(rank)))


def random(rank: int, seed: int = 0) -> Callable[[Column], Column]:
    """Values from 0 to 1 by a hash of id, place and seed: the same again when a task is redone."""
    return lambda i: F.array(*(F.shiftrightunsigned(F.xxhash64(i, F.lit(k), F.lit(seed)), 11) / F.lit(2.0**53) for k in range(rank)))


def hashed_factors(ids: DataFrame, rank: int, by: int = 31) -> DataFrame:
    """ids (id) with hashed() values."""
    return ids.select("id", hashed(rank, by)(F.col("id")).alias("f"))


def random_factors(ids: DataFrame, rank: int, seed: int = 0) -> DataFrame:
    """ids (id) with random() values."""
    return ids.select("id", random(rank, seed)(F.col("id")).alias("f"))


def with_factor(d: DataFrame, key: str, factors: Factors, name: str) -> DataFrame:
    """d with the factor of its column `key`."""
    if callable(factors):
        return d.where(F.col(key).isNotNull()).withColumn(name, factors(F.col(key)))
    return d.join(factors.select(F.col("id").alias(key), F.col("f").alias(name)), key)


def keys(ratings: DataFrame) -> DataFrame:
    """Distinct columns."""
    return ratings.select(F.col("j").alias("id")).distinct()


def errors(ratings: DataFrame, rows: Factors, columns: Factors) -> DataFrame:
    """ratings with factors l and r and the error e = l . r - v."""
    d = with_factor(with_factor(ratings, "i", rows, "l"), "j", columns, "r")
    return d.withColumn("e", V.dot(F.col("l"), F.col("r")) - F.col("v"))


def loss(ratings: DataFrame, rows: Factors, columns: Factors) -> DataFrame:
    return errors(ratings, rows, columns).agg(F.sum(F.col("e") * F.col("e")).alias("loss"))


def gradients(ratings: DataFrame, rows: Factors, columns: Factors, rank: int, penalty: float) -> tuple[DataFrame, DataFrame]:
    """(id, g) of rows and of columns: the sum of 2 e times the other's factor, and 2 penalty times its own once.

    Sums are plain doubles, so that they are combined in hash maps; a factor meets its own sum, not every rating's.
    """
    d = errors(ratings, rows, columns)
    side = lambda n, key, other: F.struct(F.lit(n).alias("side"), F.col(key).alias("id"), *(F.get(other, F.lit(k)).alias(f"o{k}") for k in range(rank)))
    both = d.select("e", F.explode(F.array(side(0, "i", "r"), side(1, "j", "l"))).alias("x")).select("e", "x.*")
    sums = cut(both.groupBy("side", "id").agg(*(F.sum(F.col(f"o{k}") * (2.0 * F.col("e"))).alias(f"s{k}") for k in range(rank))))  # a row a factor, so that the joins run once

    def of(n: int, key: str, factors: Factors) -> DataFrame:
        mine = sums.where(F.col("side") == n).withColumn("id", F.col("id").cast(ratings.schema[key].dataType))  # a hash depends on the type
        own = with_factor(mine, "id", factors, "own")
        return own.select("id", V.axpy(2.0 * penalty, F.col("own"), F.array(*(F.col(f"s{k}") for k in range(rank)))).alias("g"))

    return of(0, "i", rows), of(1, "j", columns)


def apply(factors: DataFrame, g: DataFrame, step: float, most: float) -> DataFrame:
    """factors - step * g, kept within [0, most]."""
    moved = F.zip_with("f", "g", lambda x, y: F.least(F.greatest(x - F.lit(step) * y, F.lit(0.0)), F.lit(most)))
    return factors.join(g, "id", "left").select("id", F.coalesce(moved, F.col("f")).alias("f"))


def train(ratings: DataFrame, rank: int, epochs: int, step: float = 0.01, penalty: float = 0.0, most: float = 1e9, seed: int = 0, start: tuple[Factors, Factors] | None = None, rate: float = 1.0, period: int = 1) -> tuple[DataFrame, DataFrame]:
    """Factors of rows and columns; both use the decayed step."""
    from .training import step_size

    rows, columns = start or (random(rank, seed), random(rank, seed + 1))
    ratings = cut(ratings) if epochs > 1 else ratings
    for epoch in range(epochs):
        eta = step_size(step, rate, period, epoch)
        a, b = gradients(ratings, rows, columns, rank, penalty)
        rows, columns = (cut(apply(with_factor(g.select("id"), "id", f, "f") if callable(f) else f, g, eta, most)) for f, g in ((rows, a), (columns, b)))
    if not epochs:
        rows, columns = (with_factor(ratings.select(F.col(c).alias("id")).distinct(), "id", f, "f") if callable(f) else f for c, f in (("i", rows), ("j", columns)))
    return rows, columns
