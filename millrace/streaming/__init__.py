"""Scoring of streams with fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import FittedModel


def score_stream(stream: DataFrame, model: FittedModel, name: str, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Start a query that appends predictions to Parquet at ``path``, or to the memory table ``name``.

    For models whose transform is a projection or a join with one row: trees, forests, networks and the null model.
    """
    out = model.transform(stream).writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    return out.format("parquet").option("path", path).start() if path else out.format("memory").start()
