"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, one_length, table

#: Vectors that centroids and codebooks are fitted on, taken by hash of the id: a bounded sample. All vectors are indexed.
SAMPLE = 20_000
BLOCK = 4096
#: Lists, at most and per square root of the vectors; share of the lists that a query visits; sub-vectors; candidates that a unit of work reranks for a query.
#: The share suits vectors without any clusters, of which 0.25 would find three quarters; clustered ones need far less.
MAX_LISTS, LISTS_PER_ROOT, PROBE_SHARE, PARTS, RERANK = 4096, 2, 0.6, 16, 96
#: Vectors of a unit of work in a search.
UNIT = 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles. Those null, empty, zero or holding a null or non-finite component, and rows without an id, are left out."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; an empty cluster keeps its centroid."""
    base = np.unique(x, axis=0)
    c = base[rng.permutation(len(base))[:k]]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        s = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (x[at : at + 8192] @ c.T - half).argmax(1)
    return out


@dataclass
class Index:
    """Coarse centroids, and codebooks of the residuals' sub-vectors; its size depends on the parameters only."""

    centroids: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, seed: int = 5) -> Index:
        rng = np.random.default_rng(seed)
        c = k_means(x, lists, rng)
        r = x - c[nearest(x, c)]
        edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
        return cls(c, [k_means(r[:, a:b], 256, rng, 8) for a, b in zip(edges, edges[1:])], edges)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)
        r = x - self.centroids[own]
        codes = np.stack([nearest(r[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], 1)
        return own, codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables (part, code, query): inner products of a query's parts with the codewords."""
        out = np.zeros((len(self.books), 256, len(q)), np.float32)
        for i, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False)):
            out[i, : len(book)] = book @ q[:, a:b].T
        return out


def build(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> tuple[DataFrame, Index | None]:
    """The coded vectors (vec_id, v, list, code), sorted by list within tasks, and the index."""
    spark = vectors.sparkSession
    good = one_length(durable(usable(vectors)), "v")
    n = good.count()
    if not n:
        return good.withColumn("list", F.lit(0)).withColumn("code", F.lit(b"")), None
    fit = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    lists = int(max(1, min(MAX_LISTS, LISTS_PER_ROOT * n**0.5, len(fit) / 8)))
    index = Index.fit(_unit(np.array([r["v"] for r in fit])), lists, parts)
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = sent.value.encode(_unit(_rows(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "list", "code"])

    return durable(good.mapInArrow(run, "vec_id long, v array<double>, list int, code binary")), index


def search(vectors: DataFrame, k: int = 5, every: int = 50, probe_share: float = PROBE_SHARE, rerank: int = RERANK, block: int = BLOCK, sample: int = SAMPLE, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides, the k nearest found by cosine.

    All other rows are candidates; rows with the query's vec_id are its own; a repeated query id is asked once, with its least vector. Vectors of another length than most have take no part.
    A query visits the lists whose centroids have the largest inner product with it. Each task scores the visited
    codes from the query's tables, keeps the best ``rerank`` of a unit, scores those exactly on the original vectors
    and sends k of them; the best k of all tasks are the result. Queries go out in blocks of bounded size. The coded vectors lie in
    the tasks that encoded them, so a list that holds a third of all vectors is spread like any other.
    """
    spark = vectors.sparkSession
    coded, index = build(vectors, sample, parts)
    asked = durable(coded.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = []
    for number in range(blocks):
        rows = sorted(dealt.filter(F.col("block") == number).select("vec_id", "v").collect())
        ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.empty((0, 1), np.float64)
        sent = spark.sparkContext.broadcast((ids, q, index))
        found.append(durable(coded.mapInArrow(_searcher(sent, k, probe_share, rerank), "query_id long, vec_id long, score double")))
        sent.unpersist()
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to UNIT rows or more, as far as there are so many."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= UNIT:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searcher(sent, k: int, probe_share: float, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, index = sent.value
        if not len(ids):
            return
        unit = _unit(q)
        coarse = unit @ index.centroids.T
        probes = max(1, int(np.ceil(probe_share * len(index.centroids))))
        visits = np.zeros(coarse.shape, bool)
        np.put_along_axis(visits, np.argsort(-coarse, 1, kind="stable")[:, :probes], True, 1)
        tables, near, seen = index.tables(unit), coarse.T.astype(np.float32), visits.T
        step = max(256, (1 << 22) // len(ids))
        for batch in _units(batches):
            vec, own = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(vec), -1)
            exact = _rows(batch.column(1))
            order = np.lexsort((vec, own))
            vec, own, codes, exact = vec[order], own[order], codes[order], exact[order]
            held_q, held_c, held_s = [], [], []
            for at in range(0, len(vec), step):  # rows of a few lists, or of a part of a large one
                lists, code = own[at : at + step], codes[at : at + step]
                who = np.flatnonzero(seen[np.unique(lists)].any(0))
                if not len(who):
                    continue
                some = slice(None) if len(who) == len(ids) else who
                s = near[lists][:, some]
                for m in range(codes.shape[1]):
                    s += tables[m][:, some][code[:, m]]
                s[~seen[lists][:, some] | (vec[at : at + step, None] == ids[who][None, :])] = -np.inf
                s = np.ascontiguousarray(s.T)
                keep = min(rerank, s.shape[1])
                top = np.argpartition(s, s.shape[1] - keep, 1)[:, s.shape[1] - keep :]
                held_q.append(np.repeat(who, keep))
                held_c.append((top + at).ravel())
                held_s.append(np.take_along_axis(s, top, 1).ravel())
            if not held_q:
                continue
            hq, hc, hs = np.concatenate(held_q), np.concatenate(held_c), np.concatenate(held_s)
            fine = hs > -np.inf
            hq, hc, hs = hq[fine], hc[fine], hs[fine]
            for keep, score in ((rerank, hs), (k, None)):
                if score is None:
                    score = np.concatenate([cosine(q[hq[at : at + 50_000]], exact[hc[at : at + 50_000]]) for at in range(0, len(hq), 50_000)]) if len(hq) else np.empty(0)
                o = np.lexsort((vec[hc], -score, hq))
                hq, hc, score = hq[o], hc[o], score[o]
                first = np.flatnonzero(np.r_[True, hq[1:] != hq[:-1]]) if len(hq) else np.empty(0, np.int64)
                place = np.arange(len(hq)) - np.repeat(first, np.diff(np.r_[first, len(hq)]))
                hq, hc, score = hq[place < keep], hc[place < keep], score[place < keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[hq]), pa.array(vec[hc]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
