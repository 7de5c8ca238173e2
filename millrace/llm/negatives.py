"""Hard-negative mining by a Voronoi-partitioned join of largest inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, one_length, shuffle_partitions, table

#: Pivots: one for so many anchors, within these bounds. They are sent to all tasks: MOST_PIVOTS vectors.
ANCHORS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 128, 4, 512
#: Anchors of a cell that are compared in one group, and candidates that such a group gets at once.
BLOCK, CHUNK = 1024, 32768
#: Scores that are held at once.
SLICE = 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Relative slack of the bounds against rounding.
SLACK = 1e-9


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component, as doubles, which hold these integers exactly at any size.

    Rows with a null id, label or vector, an empty one, or one that holds a null or a non-finite component are left out, and then those
    whose vector has another length than most.
    """
    e = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    whole = F.transform(e, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return one_length(durable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))), "v")


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integral rows, exact: through doubles where all sums stay below 2**53, else by Python's integers, held at the ends of 64 bits."""
    if not len(c) or not len(q):
        return np.empty((len(q), len(c)), np.int64)
    size = np.abs(q).max() * q.shape[1] * np.abs(c).max(1)
    wide = ~(size < 2.0**53)
    if not wide.any():
        return (q @ c.T).astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    out[:, ~wide] = (q @ c[~wide].T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    out[:, wide] = np.clip(whole(q) @ whole(c[wide]).T, LEAST, MOST).astype(np.int64)
    return out


class _Cells:
    """Voronoi cells around pivots, with what is known of each cell's anchors: all of it small arrays by cell."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.p, self.top = pivots, top  # top: the largest squared norm
        self.norm = (pivots * pivots).sum(1)
        self.lift = np.sqrt(np.maximum(0, top - self.norm))  # the coordinate that gives all candidates one norm
        self.radius = self.near = self.far = np.zeros(len(pivots))
        self.blocks = self.first = self.salts = np.ones(len(pivots), np.int64)

    def of_anchors(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each anchor and an upper bound of the distance to it."""
        norm = (v * v).sum(1)
        d = norm[:, None] + self.norm[None, :] - 2 * (v @ self.p.T)
        at = np.argmin(d, 1)
        return at, np.sqrt(np.maximum(0, d[np.arange(len(v)), at]) + SLACK * (norm + self.norm[at] + 1))

    def home(self, v: np.ndarray) -> np.ndarray:
        """The pivot that is nearest to each norm-augmented candidate."""
        lift = np.sqrt(np.maximum(0, self.top - (v * v).sum(1)))
        near = np.argmax(v @ self.p.T + lift[:, None] * self.lift[None, :], 1)
        out = np.zeros((len(v), len(self.p)), bool)
        out[np.arange(len(v)), near] = True
        return out

    def served(self, v: np.ndarray) -> np.ndarray:
        """Which cells' anchors a candidate might serve: rows are candidates.

        Anchors have 0 for the added coordinate, so a candidate is sqrt(top + |p|^2 - 2 x.p) from a pivot among them, and by the triangle
        inequality no nearer to and no farther from an anchor of the cell than this less or more the cell's radius.
        """
        d = self.top + self.norm[None, :] - 2 * (v @ self.p.T)
        slack = SLACK * (self.top + self.norm + 1)[None, :]
        least = np.sqrt(np.maximum(0, d - slack)) - self.radius
        most = np.sqrt(np.maximum(0, d + slack)) + self.radius
        return ~(least > self.near) & ~(most < self.far)  # a bound that is not a number leaves nothing out


def _routed(rows: DataFrame, sent, home: bool) -> DataFrame:
    """(grp, salt, vec_id, label, v): each candidate once for every block of anchors that it might serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = sent.value, 0
        for batch in batches:
            v = _matrix(batch.column(2))
            if not len(v):
                continue
            i, c = np.nonzero(cells.home(v) if home else cells.served(v))
            n = cells.blocks[c]
            at, cell = np.repeat(i, n), np.repeat(c, n)
            block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            salt = (seen + at) % np.maximum(cells.salts[cell], 1)
            seen += len(v)
            for k in range(0, len(at), 8192):
                part = slice(k, k + 8192)
                own = batch.take(pa.array(at[part]))
                yield pa.RecordBatch.from_arrays([pa.array((cells.first[cell] + block)[part]), pa.array(salt[part]), own.column(0), own.column(1), own.column(2)], names=["grp", "salt", "vec_id", "label", "v"])

    return rows.mapInArrow(run, "grp long, salt long, vec_id long, label long, v array<double>")


def _loads(rows: DataFrame, sent, home: bool) -> DataFrame:
    """(cell, n): candidates that each cell's anchors get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = sent.value, 0
        for batch in batches:
            v = _matrix(batch.column(2))
            n += (cells.home(v) if home else cells.served(v)).sum(0) if len(v) else 0
        n = np.zeros(len(cells.p), np.int64) + n
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["cell", "n"])

    return rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _best(score: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest wanted scores of each row, of ties the first columns."""
    n = wanted.sum(1)
    few = n <= k
    i, j = np.nonzero(wanted & few[:, None])
    many = np.flatnonzero(~few)
    if not len(many):
        return i, j
    s = np.where(wanted[many], score[many], LEAST)
    kth = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k][:, None]
    above, tied = wanted[many] & (s > kth), wanted[many] & (s == kth)
    tied &= tied.cumsum(1) <= k - above.sum(1)[:, None]
    x, y = np.nonzero(above | tied)
    return np.r_[i, many[x]], np.r_[j, y]


class _Group:
    """The queries of one group, and the best candidates so far of each."""

    def __init__(self, rows: list[pa.RecordBatch], k: int, same: bool):
        t = pa.Table.from_batches(rows)
        self.k, self.same = k, same
        self.anchor, self.tag, self.label, self.low, self.high = (t.column(c).to_numpy() for c in ("anchor", "tag", "label", "low", "high"))
        ids, once, self.own = np.unique(self.anchor, return_index=True, return_inverse=True)  # an anchor's queries share its scores
        self.q = _matrix(t.column("v").combine_chunks())[once]
        self.row, self.vec, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(len(self.anchor), LEAST)  # the k-th score so far

    def meet(self, ids: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        step = max(1, SLICE // max(1, len(self.anchor)))
        for at in range(0, len(order), step):
            part = order[at : at + step]
            s = scores(self.q, v[part])[self.own]
            wanted = (self.label[:, None] == label[part][None, :]) == self.same
            wanted &= (self.anchor[:, None] != ids[part][None, :]) & (s >= np.maximum(self.low, self.least)[:, None]) & (s <= self.high[:, None])
            i, j = _best(s, wanted, self.k)
            if len(i):
                self.keep(np.r_[self.row, i], np.r_[self.vec, ids[part][j]], np.r_[self.score, s[i, j]])

    def keep(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((vec, np.bitwise_not(score), row))  # not: descending without overflow
        row, vec, score = row[order], vec[order], score[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        kept = place < self.k
        last = place == self.k - 1
        self.least[row[last]] = score[last]
        self.row, self.vec, self.score = row[kept], vec[kept], score[kept]

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.anchor[self.row]), pa.array(self.tag[self.row]), pa.array(self.vec), pa.array(self.score)], names=["anchor", "tag", "vec_id", "score"])


def _joined(queries: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, tag, vec_id, score): the k best candidates of each query within each (grp, salt).

    Queries come first in their group and are held, at most a block of anchors; candidates stream past them.
    """
    none = F.lit(None).cast("long")
    asks = queries.select("grp", "salt", F.lit(0).alias("kind"), "anchor", "tag", "label", "low", "high", F.lit(0).cast("long").alias("vec_id"), "v")
    gives = candidates.select("grp", "salt", F.lit(1).alias("kind"), none.alias("anchor"), none.alias("tag"), "label", none.alias("low"), none.alias("high"), "vec_id", "v")
    ready = asks.unionByName(gives).repartition(shuffle_partitions(queries.sparkSession), "grp", "salt").sortWithinPartitions("grp", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, group, held = None, [], None, []

        def compare() -> None:
            nonlocal group, held
            if asked and held:
                group = group or _Group(asked, k, same)
                t = pa.Table.from_batches(held)
                group.meet(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v").combine_chunks()))
            held = []

        for batch in batches:
            grp, salt, kind = (batch.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1]), True]) if batch.num_rows else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if now != (grp[a], salt[a]):
                    compare()
                    if group:
                        yield group.out()
                    now, asked, group = (grp[a], salt[a]), [], None
                if kind[a] == 0:
                    asked.append(batch.slice(a, b - a))
                elif asked:  # without queries there is nothing to find
                    held.append(batch.slice(a, b - a))
                    if sum(x.num_rows for x in held) >= 4096:
                        compare()
        compare()
        if group:
            yield group.out()

    return ready.mapInArrow(run, "anchor long, tag long, vec_id long, score long")


def _search(rows: DataFrame, asked: DataFrame, cells: _Cells, k: int, same: bool, home: bool, block: int, chunk: int) -> DataFrame:
    """(anchor, tag, vec_id, score, rank): for each row of asked(anchor, tag, label, v, cell, radius, low, high) its k largest scores within low to high.

    Candidates are the rows of the same or of another label. With ``home``, only those of the query's own cell: what a first look finds.
    """
    spark = rows.sparkSession
    reach = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + cells.top - 2 * F.col(c).cast("double")) + SLACK * (F.col("norm") + cells.top + 1 + F.abs(F.col(c).cast("double"))))
    norm = asked.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    near = F.when(F.col("low") == LEAST, F.lit(float("inf"))).otherwise(reach("low"))
    slack = 2 * SLACK * (F.col("norm") + cells.top + 1 + F.abs(F.col("high").cast("double")))
    far = F.when(F.col("high") == MOST, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + cells.top - 2 * F.col("high").cast("double") - slack)))
    cells.radius, cells.near, cells.far = (np.full(len(cells.p), x) for x in (0.0, -np.inf, np.inf))
    cells.blocks, cells.first, cells.salts = (np.zeros(len(cells.p), np.int64) for _ in range(3))
    for r in norm.groupBy("cell").agg(F.max("radius").alias("radius"), F.max(near).alias("near"), F.min(far).alias("far"), F.count_distinct("anchor").alias("n")).collect():  # a row for each pivot
        c = r["cell"]
        cells.radius[c], cells.near[c], cells.far[c], cells.blocks[c] = r["radius"], r["near"], r["far"], -(-r["n"] // block)
    cells.first = np.cumsum(cells.blocks) - cells.blocks
    counting = spark.sparkContext.broadcast(cells)
    for r in _loads(rows, counting, home).collect():  # a row for each pivot
        cells.salts[r["cell"]] = -(-r["n"] // chunk)
    cells.salts[cells.blocks == 0] = 0
    sent = spark.sparkContext.broadcast(cells)
    spread = spark.createDataFrame([(c, int(cells.first[c]), int(cells.blocks[c]), int(cells.salts[c])) for c in range(len(cells.p)) if cells.blocks[c] and cells.salts[c]], "_cell long, first long, blocks long, salts long")
    dealt = asked.join(F.broadcast(spread), F.col("cell") == F.col("_cell")).withColumn("grp", F.col("first") + F.pmod(F.xxhash64("anchor"), F.col("blocks")))
    queries = dealt.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "anchor", "tag", "label", "low", "high", "v")
    found = _joined(queries, _routed(rows, sent, home), k, same)
    order = Window.partitionBy("anchor", "tag").orderBy(F.col("score").desc(), "vec_id")
    got = durable(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    counting.unpersist()
    sent.unpersist()
    return got


def _narrowed(rows: DataFrame, asked: DataFrame, cells: _Cells, k: int, same: bool, block: int, chunk: int) -> DataFrame:
    """``asked`` with low raised to the k-th score that a look into the query's own cell finds: the k-th best of all cannot be lower."""
    first = _search(rows, asked, cells, k, same, True, block, chunk).filter(F.col("rank") == k).select(F.col("anchor").alias("_a"), F.col("tag").alias("_t"), F.col("score").alias("_s"))
    return durable(asked.join(first, (F.col("anchor") == F.col("_a")) & (F.col("tag") == F.col("_t")), "left").withColumn("low", F.greatest("low", F.coalesce("_s", F.lit(LEAST)))).drop("_a", "_t", "_s"))


def _percent(score: str, percent: int, up: bool) -> F.Column:
    """percent / 100 of a long, rounded up or down, without overflow."""
    s = F.col(score)
    rest = F.lit(percent) * (s % 100) / 100
    return F.lit(percent) * F.call_function("div", s, F.lit(100).cast("long")) + (F.ceil(rest) if up else F.floor(rest)).cast("long")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, embedding, label).

    Anchors: rows whose vec_id ``every`` divides; a repeated one is asked once, with its least label and vector. Score: inner product of
    floor(scale * x). An anchor's positives are its ``positives`` best other rows of its label; for each of them come the ``negatives`` best
    rows of other labels with ``low`` to ``high`` percent of its score; ties go to the smaller vec_id. Rows with the anchor's vec_id are its
    own; other repeated rows count each. ``prepared`` says which rows take part. Scores beyond 64 bits are held at its ends. Other
    columns are ignored; without anchors, positives or negatives there are no rows.

    A coordinate is added that gives every candidate the same norm, so the largest inner product is the least distance. Anchors belong to the
    cell of their nearest pivot, at most ``block`` of them to a group. A first join of every cell with its own candidates gives each query a
    score that its last result reaches at least; a cell's radius and the range of distances its queries still ask for then say which
    candidates they might need, and only those are sent to them, in chunks, for the exact join. Nothing else is left out.
    """
    rows = prepared(vectors, scale)
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor", "a.label", "a.v")
    anchors = durable(anchors)
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, anchors.count() // ANCHORS_PER_PIVOT))
    picked = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "v").limit(pivots).collect()] or [[0.0]]
    cells = _Cells(np.unique(np.array(picked, float).reshape(len(picked), -1), axis=0), top or 0.0)
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = sent.value.of_anchors(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64)), pa.array(far)], names=["anchor", "label", "v", "cell", "radius"])

    placed = durable(anchors.mapInArrow(place, "anchor long, label long, v array<double>, cell long, radius double"))
    wide = placed.select("*", F.lit(0).cast("long").alias("tag"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    best = _search(rows, _narrowed(rows, wide, cells, positives, True, block, chunk), cells, positives, True, False, block, chunk)
    best = best.select(F.col("anchor").alias("_anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("_tag"))
    ranges = placed.join(best, F.col("anchor") == F.col("_anchor")).select("anchor", F.col("_tag").alias("tag"), "label", "v", "cell", "radius", _percent("positive_score", low, True).alias("low"), _percent("positive_score", high, False).alias("high"))
    ranges = durable(ranges.filter("low <= high"))
    found = _search(rows, _narrowed(rows, ranges, cells, negatives, False, block, chunk), cells, negatives, False, False, block, chunk)
    out = found.join(best, (F.col("anchor") == F.col("_anchor")) & (F.col("tag") == F.col("_tag")))
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and coalesce(isfinite(x), false)))
),
s as (
  select a.vec_id as anchor_id, a.label = c.label as same, c.vec_id, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 10
"""
