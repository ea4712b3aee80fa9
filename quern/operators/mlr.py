"""Multinomial logistic regression. Instances: id, label, features array<double>; a model is weights[class][feature].

Predictions stay in one row each; the gradient is a sum over (class, feature) with partial sums on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V

from .training import IterativeTrainer, literal

Weights = list[list[float]]


def probabilities(weights: Weights, features: Column) -> Column:
    """Softmax of W x, clamped."""
    return V.softmax(F.transform(literal(weights, "array<array<double>>"), lambda w: V.dot(w, features)))


def predict(instances: DataFrame, weights: Weights) -> DataFrame:
    d = instances.withColumn("p", probabilities(weights, F.col("features")))
    return d.withColumn("predicted", V.argmax(F.col("p")))


def gradient(instances: DataFrame, weights: Weights, step: float, penalty: float = 0.0) -> DataFrame:
    """(class, j, delta): the sum over instances of -step * (p - [class = label]) x, and of -step * penalty * w an instance."""
    d = instances.select("label", "features", F.posexplode(probabilities(weights, F.col("features"))).alias("class", "p"))
    error = F.col("p") - (F.col("class") == F.col("label")).cast("double")
    d = d.select("class", error.alias("e"), F.posexplode("features").alias("j", "x"))
    sums = d.groupBy("class", "j").agg(F.sum(F.col("e") * F.col("x")).alias("s"), F.count("*").alias("n"))
    w = F.get(F.get(literal(weights, "array<array<double>>"), F.col("class")), F.col("j"))
    return sums.select(F.col("class").cast("long").alias("class"), F.col("j").cast("long").alias("j"), (-step * F.col("s") - step * penalty * F.col("n") * w).alias("delta"))


def evaluate(instances: DataFrame, weights: Weights, penalty: float = 0.0) -> DataFrame:
    """(loss, reg_loss, accuracy): a sum of -ln p of the labels; accuracy is null without instances."""
    norm = sum(w * w for row in weights for w in row)
    d = predict(instances, weights)
    hit = (F.col("predicted") == F.col("label")).cast("double")
    return d.agg(F.sum(-F.ln(F.get("p", F.col("label").cast("int")))).alias("loss"), F.lit(penalty / 2 * norm / len(weights)).alias("reg_loss"), F.avg(hit).alias("accuracy"))


class Trainer(IterativeTrainer):
    def __init__(self, classes: int, features: int, penalty: float = 0.0):
        self.classes, self.features, self.penalty = classes, features, penalty

    def start(self) -> Weights:
        return [[0.0] * self.features for _ in range(self.classes)]

    def gradient(self, instances: DataFrame, model: Weights, step: float) -> list:
        return gradient(instances, model, step, self.penalty).collect()  # classes x features rows

    def apply(self, model: Weights, change: list) -> Weights:
        out = [row[:] for row in model]
        for c, j, delta in change:
            out[c][j] += delta
        return out

    def evaluate(self, instances: DataFrame, model: Weights) -> DataFrame:
        return evaluate(instances, model, self.penalty)
