"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, one_length, table
from .negatives import MOST, scores

#: Queries that are sent to the tasks at once; with 64 components a block is 2 MB.
BLOCK = 4096
BINS = 1024
SCALE = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as doubles, which hold these integers exactly at any size. Vectors that are null, empty or hold a null or non-finite component, and rows without an id, are left out."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * F.lit(float(scale))).cast("double")).otherwise(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of candidates: their ids, the scores of all queries, and which pairs count."""
    step = max(1, (1 << 22) // max(1, len(ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            cand = part.column(0).to_numpy()
            yield cand, np.maximum(scores(q, _matrix(part.column(1))), -MOST), ids[:, None] != cand[None, :]


def _histograms(vectors: DataFrame, sent, k: int, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(q, bin, n): how many scores of a query fall into a bin of [low, low + BINS * width), and above it (bin BINS).

    A task leaves out the bins below the one that holds its own k-th best score: the k-th best of all cannot be lower.
    """

    def run(batches):
        ids, q = sent.value
        hist = np.zeros((len(ids), BINS + 2), np.int64)
        row = np.arange(len(ids))[:, None] * (BINS + 2)
        for _, s, ok in _batches(batches, ids, q):
            above = s.view(np.uint64) - low.view(np.uint64)[:, None]  # unsigned, as a range may be wider than 63 bits
            b = np.where(s < low[:, None], 0, np.minimum(above // width.view(np.uint64)[:, None], BINS).astype(np.int64) + 1)
            hist += np.bincount((row + b)[ok], minlength=hist.size).reshape(hist.shape)
        above = hist[:, ::-1].cumsum(1)[:, ::-1]  # scores in this bin or higher
        at = np.maximum((above >= k).sum(1) - 1, 0)
        hist[np.arange(BINS + 2)[None, :] < at[:, None]] = 0
        i, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array((b - 1).astype(np.int32)), pa.array(hist[i, b])], names=["q", "bin", "n"])

    return vectors.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_bins(histograms: DataFrame, k: int) -> DataFrame:
    """(q, bin, above): the bin that holds the k-th best score, or the last one if there are fewer, and the number of scores above it."""
    down = Window.partitionBy("q").orderBy(F.col("bin").desc())
    h = histograms.withColumn("upto", F.sum("n").over(down)).withColumn("total", F.sum("n").over(Window.partitionBy("q")))
    return h.filter((F.col("upto") >= F.least(F.lit(k), F.col("total"))) & (F.col("upto") - F.col("n") < F.least(F.lit(k), F.col("total")))).select("q", "bin", (F.col("upto") - F.col("n")).alias("above"))


def _kth(vectors: DataFrame, sent, ids: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query of the block the k-th best score (the least, if there are fewer), and how many scores are above it.

    The histogram's range is narrowed to the bin that holds the k-th score until bins are one score wide.
    """
    low = -bounds
    width = np.array([-(-(2 * int(b) + 1) // BINS) for b in bounds], np.int64)
    above = np.zeros(len(ids), np.int64)
    while True:
        at, got = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for r in _kth_bins(_histograms(vectors, sent, k, low, width), k).collect():  # a row for each query of the block
            at[r["q"]], above[r["q"]], got[r["q"]] = r["bin"], r["above"], True
        low = low + at * width
        if (width == 1).all():
            return np.where(got, low, np.iinfo(np.int64).max), above
        width = np.maximum(1, -(-width // BINS))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides, the k largest integer inner products.

    All other rows are candidates; rows with the query's vec_id are its own. Ties go to the smaller vec_id; repeated candidates count each, a
    repeated query id is asked once, with its least vector. Scores beyond 64 bits are held at their ends. Vectors of another length than most have take no part. Queries go out in
    blocks of bounded size, one after another, each block's result being written before the next goes out; candidates are never moved: every round is a pass that scores each pair, and tasks send back only
    the upper end of a histogram. With each k-th value known, a last pass sends the scores above it and, of those equal to it, as many of
    the least ids as are wanted; so no more than k rows per task and query travel, however many vectors tie.
    """
    spark = vectors.sparkSession
    cand = one_length(durable(quantised(vectors, scale)), "v")
    asked = durable(cand.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    peak = cand.select(F.transform("v", F.abs).alias("v")).agg(F.max(F.array_max("v"))).first()[0] or 0.0
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    parts = []
    for number in range(blocks):
        rows = sorted(dealt.filter(F.col("block") == number).select("vec_id", "v").collect())
        ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float).reshape(len(rows), -1) if rows else np.empty((0, 1))
        sent = spark.sparkContext.broadcast((ids, q))
        bounds = np.array([min(MOST, int(b * (1 + 1e-9)) + 1) for b in np.minimum(np.abs(q).sum(1) * peak, 2.0**64)], np.int64)  # of any score
        kth, above = _kth(cand, sent, ids, k, bounds) if len(ids) else (ids, ids)
        parts.append(durable(_filtered(cand, sent, k, kth, k - above)))
        sent.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _filtered(vectors: DataFrame, sent, k: int, kth: np.ndarray, ties: np.ndarray) -> DataFrame:
    def run(batches):
        ids, q = sent.value
        tied: dict[int, list[np.ndarray]] = {}
        for cand, s, ok in _batches(batches, ids, q):
            i, j = np.nonzero(ok & (s > kth[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(cand[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])
            i, j = np.nonzero(ok & (s == kth[:, None]))
            for x in np.unique(i):
                tied[x] = [np.sort(np.concatenate([*tied.get(x, []), cand[j[i == x]]]))[: ties[x]]]
        i = np.array([x for x, c in tied.items() for _ in c[0]], np.int64)
        c = np.concatenate([c[0] for c in tied.values()]) if tied else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(c), pa.array(kth[i])], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
