"""k x 2 cross-validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..sources import DatasetSpec
from .metrics import metric_columns
from .models import GroupedModel, Model
from .preprocess import min_max_scale_attributes, standardize_attributes


def cross_validate(plans: dict[str, DataFrame], specs: dict[str, DatasetSpec], factory: Callable[[], Model], id_col: str = "row_id") -> DataFrame:
    """(dataset, metric, value): the mean over all reps and both directions.

    Each plan has rep and side (see ``cv_plan``; validation rows are left out) and is written once, as every repetition reads it.
    Scaling is fitted on the training side only. The predictions of all repetitions and directions meet in one aggregate. A
    ``GroupedModel`` is fitted for all repetitions and sides by one aggregate too, so its jobs don't grow with the repetitions.
    """
    parts = []
    for name, plan in plans.items():
        spec, plan = specs[name], durable(plan.filter("rep >= 0"))
        model = factory()
        if isinstance(model, GroupedModel) and spec.target not in (*spec.standardize_cols, *spec.min_max_scale_cols):
            parts.append(_measured(_grouped(model, plan, spec), name, spec))
            continue
        scored = []
        for rep in [r[0] for r in plan.select("rep").distinct().orderBy("rep").collect()]:
            own = plan.filter(F.col("rep") == rep)
            for side in (0, 1):
                train, test = (own.filter(F.col("side") == s).drop("rep", "side") for s in (1 - side, side))
                train, test = standardize_attributes(train, test, spec)
                train, test = min_max_scale_attributes(train, test, spec)
                got = factory().fit(train, spec, id_col).transform(test)
                scored.append(got.select(F.lit(rep).alias("_rep"), F.lit(side).alias("_side"), F.col(f"`{spec.target}`").alias("_actual"), F.col("prediction").alias("_predicted")))
        all_ = scored[0]
        for s in scored[1:]:
            all_ = all_.unionByName(s)
        parts.append(_measured(all_, name, spec))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("dataset", "metric").agg(F.avg("value").alias("value"))


def _grouped(model: GroupedModel, plan: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Predictions of every repetition and side by the fit on the other side: one aggregate, and a row for each of them sent to all tasks."""
    fits = model.fit_groups(plan.filter("side in (0, 1)"), spec, ["rep", "side"]).select(F.col("rep").alias("_rep"), (1 - F.col("side")).alias("_side"), F.col("prediction").alias("_predicted"))
    same = (F.col("rep") == F.col("_rep")) & (F.col("side") == F.col("_side"))
    return plan.join(F.broadcast(fits), same).select("_rep", "_side", F.col(f"`{spec.target}`").alias("_actual"), "_predicted")


def _measured(predicted: DataFrame, name: str, spec: DatasetSpec) -> DataFrame:
    """(dataset, metric, value) of each repetition and side."""
    per = predicted.groupBy("_rep", "_side").agg(*metric_columns(spec.metrics, F.col("_actual"), F.col("_predicted"), spec.positive_class, spec.negative_class))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in spec.metrics]))
    return per.select(F.lit(name).alias("dataset"), each.alias("m")).select("dataset", "m.*")
