"""Shared pieces of the corpus operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import discard, durable, shared_dir, written  # noqa: F401
from ..plans.joins import spread_join  # noqa: F401

#: A word is a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile("[^\x20\x09-\x0d]+")

#: Rows per Arrow batch handed to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def one_length(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has the most common length, of ties the longest: vectors of other lengths cannot be compared with them."""
    top = vectors.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return vectors if top is None else vectors.filter(F.size(column) == top["n"])


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS if it is larger.

    It stays so: Spark reads the setting when a plan is run, and the operators return plans that have not run yet.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
