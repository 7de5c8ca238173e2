"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set first if it is not: to the one that spark.checkpoint.dir names, or to a temporary one in local mode.

    On a cluster a folder of one machine would be lost on the others, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation.

    Spark deletes a checkpoint's files once nothing refers to it, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """``durable``, and without Spark's estimate of its size, for loops whose rounds join what the last ones left.

    The estimate of a join is the product of both sides' and a checkpoint keeps it, so it gets several times as many digits a round: in growing
    trees five times a level, until the driver cannot hold the number.
    """
    kept, spark = durable(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def written(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and the table's path: what ``discard`` takes once it is no longer read."""
    path = path or f"{shared_dir(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
