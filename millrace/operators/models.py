"""The model interface and the null model."""

from __future__ import annotations

import abc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import DatasetSpec


class FittedModel(abc.ABC):
    """What a fit returns: immutable, small, and usable on batch and streaming tables alike unless said otherwise."""

    @abc.abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``prediction`` column; other columns and rows stay."""


class Model(abc.ABC):
    @abc.abstractmethod
    def fit(self, df: DataFrame, spec: DatasetSpec, id_col: str = "row_id") -> FittedModel:
        """Learn from ``df``, which holds the target column and a unique ``id_col``."""


class GroupedModel(Model):
    """A model whose fit is an aggregate of the rows and whose prediction needs no features: many groups are fitted by one job."""

    @abc.abstractmethod
    def fit_groups(self, df: DataFrame, spec: DatasetSpec, keys: list[str]) -> DataFrame:
        """(keys, prediction): a fit for each group of rows."""


class NullModel(GroupedModel):
    """Predicts the most common class (smallest of ties) or the mean output."""

    def says(self, spec: DatasetSpec):
        t = F.col(f"`{spec.target}`")
        return (F.mode(t.cast("string"), True) if spec.task == "classification" else F.avg(t.cast("double"))).alias("prediction")

    def fit(self, df, spec, id_col="row_id"):
        return FittedNull(df.agg(self.says(spec)))

    def fit_groups(self, df, spec, keys):
        return df.groupBy(*keys).agg(self.says(spec))


class FittedNull(FittedModel):
    def __init__(self, row: DataFrame):
        self.row = row

    def transform(self, df):
        return df.crossJoin(F.broadcast(self.row))  # one row: an aggregate without groups
