"""CSV sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import DatasetSpec

# Texts that stand for a missing cell in CSV files.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def load_dataset(spark: SparkSession, spec: DatasetSpec, path: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a spec's files with its names and types, without the ignored columns. Missing cells become null.

    ``multi_line``: quoted cells may hold line breaks; a file is then read by one task. So it is too if the header is not the first
    line: of every file its lines up to the header are dropped, counted from the file's first.
    """
    path = path or spec.file_path
    raw = T.StructType([T.StructField(c, T.StringType()) for c in spec.col_names])
    below = spec.header is not None and spec.header > 0
    reader = spark.read.schema(raw).option("header", spec.header == 0).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("multiLine", multi_line or below).option("escape", '"')
    df = reader.csv(path)
    if below:
        # a file's lines follow one another in one partition, and so do their numbers
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
        start = placed.groupBy(F.col("_file").alias("_of")).agg(F.min("_line").alias("_start"))
        df = placed.join(start, F.col("_file") == F.col("_of")).filter(F.col("_line") - F.col("_start") > spec.header).drop("_file", "_of", "_line", "_start")
    cell = lambda c: F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`"))
    out = [(cell(f.name).try_cast("double") if isinstance(f.dataType, T.DoubleType) else cell(f.name)).alias(f.name) for f in spec.schema if f.name not in spec.ignore_cols]
    return df.select(*out)


def load_datasets(spark: SparkSession, specs: dict[str, DatasetSpec]) -> dict[str, DataFrame]:
    return {name: load_dataset(spark, spec) for name, spec in specs.items()}


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the position of each row, counted from 0 over partitions. The rows of each partition are counted first; the counts' running
    sum, a row for each partition, is sent to every task."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    counts = at.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"))
    base = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    placed = at.join(F.broadcast(base), F.shiftright("_at", 33) == F.col("_p"))
    return placed.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base")).drop("_at", "_p", "_base")
