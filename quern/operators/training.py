"""What trainers share: the loop over epochs, step sizes, and models as literals."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_size(first: float, rate: float, period: int, epoch: int) -> float:
    """The step shrinks by `rate` every `period` epochs."""
    if not 0 < rate <= 1:
        raise ValueError("a decay rate is over 0 and at most 1")
    return first * rate ** (epoch // period)


def step_column(first: float, rate: float, period: int, epoch: Column) -> Column:
    return F.lit(first) * F.pow(F.lit(rate), F.floor(epoch / period))


def literal(value, kind: str) -> Column:
    """A model (lists of numbers) as one constant of a plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class IterativeTrainer:
    """Hooks of a training job: start, gradient, apply and evaluate. A model is small enough for the driver; instances never go there."""

    def start(self):
        raise NotImplementedError

    def gradient(self, instances: DataFrame, model, step: float):
        raise NotImplementedError

    def apply(self, model, change):
        raise NotImplementedError

    def evaluate(self, instances: DataFrame, model) -> DataFrame:
        raise NotImplementedError

    def train(self, instances: DataFrame, epochs: int, step: float = 0.1, rate: float = 1.0, period: int = 1, batches: list[DataFrame] | None = None) -> tuple[object, list]:
        """The model, and the one after each epoch, for evaluation afterwards. Mini-batches, if given, are run in turn."""
        model, history = self.start(), []
        for epoch in range(epochs):
            eta = step_size(step, rate, period, epoch)
            for part in batches or [instances]:
                model = self.apply(model, self.gradient(part, model, eta))
            history.append(model)
        return model, history
