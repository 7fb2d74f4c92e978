"""Confusion counts, guarded metrics per fold, and macro averages over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("acc", "prec", "rec", "f1", "spec")


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def confusion_counts(predictions: DataFrame, *by: str, label: str = "y", pred: str = "pred") -> DataFrame:
    """by, tp, tn, fp, fn of 0/1 labels and predictions."""
    y, p = F.col(label), F.col(pred)
    return predictions.groupBy(*by).agg(
        _count((y == 1) & (p == 1)).alias("tp"),
        _count((y == 0) & (p == 0)).alias("tn"),
        _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds acc, prec, rec, f1, spec; an empty denominator gives 0, never null."""

    def over(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1)).cast("double")

    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns(
        {"acc": over(tp + tn, tp + tn + fp + fn), "prec": over(tp, tp + fp), "rec": over(tp, tp + fn), "spec": over(tn, tn + fp)}
    )
    f1 = 2 * F.col("prec") * F.col("rec") / F.greatest(F.col("prec") + F.col("rec"), F.lit(1e-12))
    return out.withColumn("f1", f1)


def metrics_by_fold(predictions: DataFrame, *by: str) -> DataFrame:
    """by, fold and the five metrics."""
    found = with_metrics(confusion_counts(predictions, *by, "fold"))
    return found.select(*by, "fold", *METRICS)


def macro(per_fold: DataFrame, *by: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and population deviation of each metric over folds; folds weigh alike, whatever their size."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy(*by).agg(*columns) if by else per_fold.agg(*columns)


def evaluate(predictions: DataFrame, *by: str) -> DataFrame:
    """Macro metrics of fixed predictions (by, fold, y, pred) in one plan for all methods at once."""
    return macro(metrics_by_fold(predictions, *by), *by)


def report_line(mean: Column, deviation: Column) -> Column:
    """Percent with one digit: ' 91.1± 0.4'."""
    return F.format_string("%5.1f±%3.1f", mean * 100, deviation * 100)


def percent(value: Column) -> Column:
    """value * 100 rounded to one digit, halves to even."""
    return F.bround(value * 100, 1)


def recall(y: str = "y", pred: str = "pred") -> Column:
    """Share of the positives that are predicted, as an aggregate."""
    return F.avg(F.when(F.col(y) == 1, F.col(pred).cast("double")))


def coverage(among: Column, pred: Column) -> Column:
    """Share of rows that meet a condition whose prediction is 1, as an aggregate; null for none."""
    return F.avg(F.when(among, pred.cast("double")))


def majority_floor(y: str = "y") -> Column:
    """Accuracy of always predicting the larger class, as an aggregate."""
    share = F.avg(F.col(y).cast("double"))
    return F.greatest(share, 1 - share)
