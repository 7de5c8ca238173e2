"""What the operators need to know of a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Literal

from pyspark.sql import types as T


@dataclass(frozen=True)
class DatasetSpec:
    """A table's name, task, columns and their kinds. Immutable; operators return a new one where kinds change.

    The target column is ``class`` (always a string) or ``output``. Columns neither nominal nor ordinal are numeric.
    ``header`` is None or the index of the header line, which is dropped with all before it: ``col_names`` hold instead.
    """

    name: str
    task: Literal["classification", "regression"]
    file_path: str = ""
    col_names: tuple[str, ...] = ()
    header: int | None = None
    ignore_cols: tuple[str, ...] = ()
    nominal_cols: tuple[str, ...] = ()
    ordinal_cols: Mapping[str, tuple] = field(default_factory=dict)
    standardize_cols: tuple[str, ...] = ()
    min_max_scale_cols: tuple[str, ...] = ()
    missing_value_symbol: str | None = None
    positive_class: str | None = None
    negative_class: str | None = None
    metrics: tuple[str, ...] = ()

    def __post_init__(self):
        if self.task not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.task!r}")
        for name in ("col_names", "ignore_cols", "nominal_cols", "standardize_cols", "min_max_scale_cols", "metrics"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "ordinal_cols", {k: tuple(v) for k, v in self.ordinal_cols.items()})

    @property
    def target(self) -> str:
        return "class" if self.task == "classification" else "output"

    def features(self, columns: list[str], id_col: str | None = None) -> list[str]:
        """The columns that models may look at."""
        return [c for c in columns if c not in (self.target, id_col, *self.ignore_cols)]

    def is_numeric(self, col: str) -> bool:
        return col not in self.nominal_cols and col not in self.ordinal_cols and not (col == "class" and self.task == "classification")

    @property
    def schema(self) -> T.StructType:
        """Types as read: numbers are text while a missing-value symbol may stand among them."""
        kind = lambda c: T.DoubleType() if self.is_numeric(c) and (self.missing_value_symbol is None or c == self.target) else T.StringType()
        return T.StructType([T.StructField(c, T.StringType() if c in self.ignore_cols else kind(c)) for c in self.col_names])

    def with_changes(self, **changes) -> DatasetSpec:
        return replace(self, **changes)
