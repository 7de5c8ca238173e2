"""Evaluation metrics from one aggregate over (actual, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nan_div
from ..functions.columns import NAN

CLASSIFICATION = ("acc", "precision", "recall", "f1")
REGRESSION = ("mse", "mae", "r2", "pearson")


def confusion(actual: Column, predicted: Column, positive: str, negative: str | None) -> dict[str, Column]:
    """Counts tp, fp, tn, fn. A prediction other than positive is tn only if the actual class is the negative one, else fn,
    third classes included; without a negative class tn is 0."""
    p, a = predicted == positive, actual == positive
    no = F.coalesce(actual == negative, F.lit(False)) if negative is not None else F.lit(False)
    return {"tp": F.count_if(p & a), "fp": F.count_if(p & ~a), "tn": F.count_if(~p & no), "fn": F.count_if(~p & ~no)}


def metric_columns(names: tuple[str, ...] | list[str], actual: Column, predicted: Column, positive: str | None = None, negative: str | None = None) -> list[Column]:
    """An aggregate expression for each name, in order; a metric whose denominator is zero is NaN."""
    unknown = [m for m in names if m not in CLASSIFICATION + REGRESSION]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    out = {}
    if any(m in CLASSIFICATION for m in names):
        same = actual.cast("string") == predicted.cast("string")
        out["acc"] = F.avg(same.cast("double"))
    if any(m in CLASSIFICATION[1:] for m in names):
        if positive is None:
            raise ValueError("a positive class is needed")
        c = confusion(actual.cast("string"), predicted.cast("string"), str(positive), None if negative is None else str(negative))
        out["precision"], out["recall"] = nan_div(c["tp"], c["tp"] + c["fp"]), nan_div(c["tp"], c["tp"] + c["fn"])
        p, r = out["precision"], out["recall"]
        out["f1"] = F.when(F.isnan(p) | F.isnan(r), NAN).otherwise(nan_div(2 * p * r, p + r))
    if any(m in REGRESSION for m in names):
        a, p = actual.cast("double"), predicted.cast("double")
        out["mse"], out["mae"] = F.avg((p - a) * (p - a)), F.avg(F.abs(p - a))
        out["r2"] = 1 - nan_div(F.sum((a - p) * (a - p)), F.count(a) * F.var_pop(a))
        out["pearson"] = nan_div(F.covar_pop(a, p), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(p)))
    return [out[m].alias(m) for m in names]


def compute_metrics(df: DataFrame, actual: str, predicted: str, metrics: tuple[str, ...] | list[str], positive_class: str | None = None, negative_class: str | None = None) -> DataFrame:
    """One row with a double for each metric. Both columns are of one table, so rows cannot be misaligned."""
    return df.agg(*metric_columns(metrics, F.col(actual), F.col(predicted), positive_class, negative_class))
