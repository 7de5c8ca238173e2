"""Joins with one row a key, and numbering, that no heavy key puts into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Rows of a key up to which a join leaves the key to one task, and the number of keys that are sent to all tasks at most.
KEY_ROWS, SENT_KEYS = 4096, 100_000


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: str, total: int, how: str = "inner", key_rows: int = KEY_ROWS) -> DataFrame:
    """``left`` joined with ``right`` (one row a key), whose column ``size`` counts the key's rows in ``left``, ``total`` in all.

    Heavy keys have over ``key_rows`` rows. They go out by broadcast and their rows stay where they are; only rows of other keys are
    shuffled. If ``total`` allows more than SENT_KEYS of them, those over a SENT_KEYS-th of all rows are taken, which are no more than that.
    Without heavy keys, which a count finds out, it is a plain join. Column names must differ. how: inner or left.
    """
    least = max(key_rows, total // SENT_KEYS)
    top = right.filter(F.col(size) > least)
    same = F.col(left_key) == F.col(right_key)
    if total <= least or top.isEmpty():
        return left.join(right, same, how)
    heavy = left.join(F.broadcast(top), same)
    others = left.join(F.broadcast(top.select(F.col(right_key).alias("_top"))), F.col(left_key) == F.col("_top"), "left_anti")
    return heavy.unionByName(others.join(right.filter(F.col(size) <= least), same, how))


def enumerated(rows: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``rows``, written to the shared folder, with a number from ``start`` on: each partition counts its rows and takes its place among them."""
    dealt = durable(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.lit(start) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")
