"""Votes of several 0/1 predictors, and predictions in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def votes(*columns: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def any_of(*columns: str) -> Column:
    """1 if one predictor at least says 1."""
    return (votes(*columns) >= 1).cast("int")


def majority_of(*columns: str) -> Column:
    """1 if more than half of the predictors say 1."""
    return (votes(*columns) > len(columns) / 2).cast("int")


def all_negative() -> Column:
    return F.lit(0)


def threshold(score: Column, at: float = 0.5) -> Column:
    """1 from the threshold on; a tie is positive."""
    return (score >= at).cast("int")


def long_predictions(wide: DataFrame, methods: dict[str, Column], *keep: str) -> DataFrame:
    """keep, method, pred: one row per row and method, without a join or a second scan."""
    pairs = F.array(*[F.struct(F.lit(name).alias("method"), c.cast("int").alias("pred")) for name, c in methods.items()])
    return wide.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.method", "m.pred")
