"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, spread_join, written

#: Links of a node up to which they meet in one task; links that are worth a task of their own.
HUB, TASK_LINKS = 100_000, 50_000


def _tasks(df: DataFrame, links: int) -> DataFrame:
    """``df`` in no more tasks than its links are worth, if that is fewer than a shuffle makes: many rounds over few links are all overhead."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-links // TASK_LINKS))
    return df.coalesce(wanted) if wanted < shuffle_partitions(df.sparkSession) else df


def _least(edges: DataFrame, links: int) -> DataFrame:
    """(_u, m, degree): of each u its least neighbour and the number of its links."""
    return _tasks(edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"), F.count("*").alias("degree")), links)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, links).withColumn("m", F.least("_u", "m"))
    # a hub's links stay where they are: only its least neighbour goes to them
    moved = spread_join(both.filter("v > u"), least, "u", "_u", "degree", 2 * links, key_rows=HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return _tasks(_tasks(moved, links).distinct(), links)


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Takes edges with u > v."""
    least = _least(edges, links)
    moved = spread_join(edges, least, "u", "_u", "degree", links, key_rows=HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return _tasks(_tasks(moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))), links).distinct(), links)


def components(edges: DataFrame) -> DataFrame:
    """Label every node that has a link with the least node of its component.

    edges(u long, v long): undirected links; self-links and repeats are harmless, rows with a null are dropped.
    Returns (node long, root long), roots included. Each round shuffles the links by node, but for those of hubs, and rounds go on
    until none changes anything: their number grows with the logarithm of the nodes. Nothing reaches the driver but a
    count and a checksum. Every round is written to the shared folder, and the one before it is then deleted.
    """
    spark = edges.sparkSession
    e, path = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, after = None, stamp(e)
    while after[0] and after != before:
        last, (e, path) = path, written(_small_star(_large_star(e, after[0]), after[0]))
        before, after = after, stamp(e)
        discard(spark, last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
