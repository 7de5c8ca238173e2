"""Near-duplicates by SetSketch: registers of exponentially spaced, truncated minima (Ertl, 2021), banded, estimated jointly, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, shuffle_partitions, small_batches, spread_join, table, written
from .components import components
from .simhash import jaccard_links, named_classes, normalised, shingle_hashes, shingle_sets

#: Words of a shingle; registers of a band; largest share of pairs at the threshold that share no band.
WIDTH, ROWS, MISSED = 5, 7, 1e-6
#: SetSketch's base, rate, and the largest register value: values fit 16 bits at every set size.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: Standard deviations by which a pair's likelihood at the threshold may fall short of its best.
Z = 5.0
#: Rows of a bucket that one task compares at once; larger buckets are dealt out by pairs of blocks.
BLOCK = 1024
GRID = np.linspace(0.0, 1.0, 101)


def band_count(similarity: float) -> int:
    """Bands of ROWS registers, so that sets of that similarity share none with probability MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log1p(-min(similarity**ROWS, 1 - 1e-9)))


def multipliers(similarity: float) -> np.ndarray:
    """Odd factors, one a register, that turn a shingle's hash into the register's own."""
    return np.random.default_rng(11).integers(0, 1 << 64, band_count(similarity) * ROWS, np.uint64) | np.uint64(1)


def least_hashes(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Each register's least hash over the set; those of a union are the lesser ones of its parts."""
    least = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 2048):  # bounded memory for long texts
        np.minimum(least, (factors[:, None] * h[None, at : at + 2048]).min(1), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Registers from least hashes: a hash is an exponential value of rate RATE by its rank among all, and a register is the floor of
    1 - log(least value) to the base BASE, held between 0 and LIMIT. Registers of a union are the larger ones of its parts."""
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, LIMIT).astype("<u2")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def _log_likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    up, down = _p(u - v * j), _p(v - u * j)
    return more * np.log(np.maximum(up, 1e-300)) + less * np.log(np.maximum(down, 1e-300)) + same * np.log(np.maximum(1 - up - down, 1e-300))


def likely(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray, count: int, similarity: float) -> np.ndarray:
    """Whether sets of n and m elements may reach ``similarity``, from the registers that are larger in the first and in the second.

    The joint likelihood of the counts of larger, smaller and equal registers is a concave function of the similarity, known set sizes given. A
    pair is ruled out if sizes alone forbid the similarity, or if the likelihood there is Z standard deviations below its maximum.
    """
    small, large = np.minimum(n, m), np.maximum(n, m)
    out = small >= similarity * large - 1e-9
    i = np.flatnonzero(out)
    for at in range(0, len(i), 8192):
        k = i[at : at + 8192]
        a, b, c = (x[:, None].astype(float) for x in (more[k], less[k], count - more[k] - less[k]))
        total = (n[k] + m[k]).astype(float)
        u, v = (n[k] / total)[:, None], (m[k] / total)[:, None]
        top = (small[k] / large[k])[:, None]
        best = _log_likelihood(a, b, c, u, v, GRID[None, :] * top).max(1)
        there = _log_likelihood(a, b, c, u, v, similarity + (top - similarity) * GRID[None, :].clip(0, 1)).max(1)
        out[k] = best - there <= Z * Z / 2
    return out


def _key(h: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(h.tobytes())


def sketches(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, raw_key, set_key, n, registers): of each row the size of its set of shingles, a 128-bit key of that set, and its registers.

    A text without words has an empty set, whose key and registers are null. Whole texts are hashed.
    """
    small_batches(docs.sparkSession)
    factors = multipliers(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, regs = [], [], []
            for text in batch.column(1):
                h = np.unique(shingle_hashes(normalised(text.as_py()), WIDTH))
                keys.append(_key(h) if len(h) else None)
                sizes.append(len(h))
                regs.append(registers(least_hashes(h, factors)).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "raw_key", "set_key", "n", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("raw_key")).mapInArrow(run, "doc_id long, raw_key long, set_key string, n long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a > b).sum(-1), (a < b).sum(-1)


def _likely_pairs(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs(u, v) whose registers say that they may be linked. A node that stands in many pairs is sent to them."""
    of = classes.select("node", "n", "registers")
    right = of.select(F.col("node").alias("_v"), F.col("n").alias("m"), F.col("registers").alias("other"))
    degree = pairs.groupBy(F.col("u").alias("_d")).agg(F.count("*").alias("degree"))
    left = durable(degree.join(of, F.col("_d") == F.col("node")).select(F.col("_d").alias("_u"), "degree", "n", "registers"))
    both = spread_join(pairs.join(right, F.col("v") == F.col("_v")), left, "u", "_u", "degree", pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(4)), _matrix(batch.column(5))
                more, less = _counts(a, b)
                ok = likely(more, less, batch.column(2).to_numpy(), batch.column(3).to_numpy(), a.shape[1], similarity)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["u", "v"])

    return both.select("u", "v", "n", "m", "registers", "other").mapInArrow(run, "u long, v long")


def deal_families(rows: DataFrame, block: int) -> DataFrame:
    """rows(key, node, family) with part, so that any two rows of a key that are of different families meet in a part of it.

    Keys of up to ``block`` rows are one part. Of others the largest family and the rest are cut into blocks by hash; each block of the rest
    meets every block, those of the family never each other: the work is in proportion to the family, times the rows outside it.
    """
    zero, upto = F.lit(0).cast("long"), lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    per = rows.groupBy("key", "family").agg(F.count("*").alias("k"))
    most = per.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("k", "family")).alias("top"), F.sum("k").alias("all"))
    cut = lambda n: F.ceil(n / (block / 2)).cast("long")
    large = durable(most.filter(F.col("all") > block).select("_key", "all", F.col("top.family").alias("top"), cut(F.col("top.k")).alias("a"), cut(F.col("all") - F.col("top.k")).alias("b")))
    if large.isEmpty():
        return rows.withColumn("part", zero)
    placed = spread_join(rows, large, "key", "_key", "all", rows.count(), "left")
    i, j, b = F.pmod(F.xxhash64("node"), F.col("a")), F.pmod(F.xxhash64("node"), F.col("b")), F.col("b")
    others = F.concat(F.array_distinct(F.transform(upto("b"), lambda k: F.least(j, k) * b + F.greatest(j, k))), F.transform(upto("a"), lambda k: b * (b + k) + j))
    parts = F.when(b.isNull(), F.array(zero)).when(F.col("family") == F.col("top"), F.transform(upto("b"), lambda k: b * (b + i) + k)).otherwise(others)
    return placed.select("key", "node", "family", F.explode(parts).alias("part"))


def _forest(node: np.ndarray, family: np.ndarray, n: np.ndarray, regs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, over families, of the likely pairs among rows of different families. Rows of the largest family meet the others only."""
    names, own, count = np.unique(family, return_inverse=True, return_counts=True)
    order = np.argsort(own == count.argmax(), kind="stable")  # the largest family last
    node, own, n, regs = node[order], own[order], n[order], regs[order]
    stop, root = len(node) - int(count.max()), list(range(len(names)))
    step = max(1, 4_000_000 // max(1, regs.size))
    us, vs = [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, stop, step):
        now = np.array([find(x) for x in range(len(names))])[own]
        rows = np.arange(at, min(stop, at + step))
        i, j = np.nonzero((now[rows][:, None] != now[None, :]) & (np.arange(len(node))[None, :] > rows[:, None]))
        i = rows[i]
        for k in range(0, len(i), 16384):
            x, y = i[k : k + 16384], j[k : k + 16384]
            more, less = _counts(regs[x], regs[y])
            ok = likely(more, less, n[x], n[y], regs.shape[1], similarity)
            for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                a, b = find(own[p]), find(own[q])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    us.append(node[p])
                    vs.append(node[q])
    return np.array(us, np.int64), np.array(vs, np.int64)


def _bucket_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """Likely links (u, v) between families within each (key, part) of dealt(key, part, node, family, n, registers)."""
    ready = dealt.repartition(shuffle_partitions(dealt.sparkSession), "key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> pa.RecordBatch:
            u = v = np.empty(0, np.int64)
            if held:
                t = pa.Table.from_batches(held)
                u, v = _forest(*(t.column(c).to_numpy() for c in ("node", "family", "n")), _matrix(t.column("registers")), similarity)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]), True]) if batch.num_rows else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if now != (key[a], part[a]):
                    yield flush()
                    now, held = (key[a], part[a]), []
                held.append(batch.slice(a, b - a))
        yield flush()

    return ready.select("key", "part", "node", "family", "n", "registers").mapInArrow(run, "u long, v long")


def candidate_groups(classes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, root): groups of classes(node, n, registers) that likely pairs chain together; classes without a likely partner are left out.

    Classes that share a band of registers are in a bucket. First each bucket's least class meets the others, as distinct pairs over all
    buckets, which joins families of copies by linear work and settles buckets of two. Buckets that then hold several families are
    opened: their registers are shipped, and all pairs of different families are estimated inside the tasks, large buckets in blocks.
    Only spanning forests of likely pairs leave a task, never all pairs.
    """
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", k * width + 1, width)) for k in range(band_count(similarity))])
    keyed = classes.select("node", F.explode(F.array_distinct(keys)).alias("key"))
    met = durable(keyed.groupBy(F.col("key").alias("_key")).agg(F.min("node").alias("u"), F.count("*").alias("k")).filter("k > 1"))
    total = max(1, classes.count() * band_count(similarity))
    inside = durable(spread_join(keyed, met, "key", "_key", "k", total).select("key", "node", "u", "k"))
    stars = durable(inside.filter("node > u").select("u", F.col("node").alias("v")).distinct())
    links = durable(_likely_pairs(stars, classes, similarity))
    # the least class that a class is found alike in any bucket: copies of one text agree on it, unless chance hides it from one
    first = links.groupBy(F.col("v").alias("_node")).agg(F.min("u").alias("least"))
    several = durable(inside.filter("k > 2").select("key", "node", "k").join(first, F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("least", "node").alias("family")))
    opened = durable(several.groupBy(F.col("key").alias("_key")).agg(F.min("family").alias("a"), F.max("family").alias("b"), F.count("*").alias("k")).filter("a < b").select("_key", "k"))
    dealt = deal_families(spread_join(several, opened, "key", "_key", "k", max(1, several.count())).select("key", "node", "family"), block)
    of = classes.select(F.col("node").alias("_n"), "n", "registers")
    more = _bucket_links(dealt.join(of, F.col("node") == F.col("_n")).select("key", "part", "node", "family", "n", "registers"), similarity)
    return components(durable(links.unionByName(more)))


def near_duplicates(docs: DataFrame, similarity: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of texts whose sets of 5-word shingles have a Jaccard similarity of ``similarity`` or more.

    Needs doc_id and text; other columns are ignored. Texts are lower-cased in A-Z and split at blanks and the controls 9 to 13; with fewer
    than five words the whole sequence is the one shingle; null texts and those without words have an empty set and are linked with nothing.
    component_id is the least doc_id reachable by links, kept says whether it is the row's own. Repeated rows each give a row; a row
    without an id can link others but names a component only if alone, with null. An empty table gives no rows.

    Rows of one set are a class. A SetSketch of registers is made of each; candidates are classes that share a band (a pair at the threshold
    shares none with probability MISSED at most) and whose joint likelihood does not rule the threshold out. Chains of candidates are groups,
    and within these exact set sizes and intersections, by 64-bit hashes of shingles, decide. Links are transitive.
    """
    spark = docs.sparkSession
    rows, path = written(sketches(docs, similarity))
    grouped = rows.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.min("raw_key").alias("text_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = durable(grouped.withColumn("node", F.monotonically_increasing_id()))
    groups = candidate_groups(classes, similarity, block)
    wanted = durable(classes.join(groups.select(F.col("node").alias("_n"), F.col("root").alias("group")), F.col("node") == F.col("_n")).select("node", "group", "text_id", "rows"))
    texts = docs.select("text", F.xxhash64("text").alias("text_key"))
    found = spread_join(texts, wanted, "text_key", "text_id", "rows", rows.count()).groupBy("node", "group").agg(F.first("text").alias("text"))
    links = components(jaccard_links(shingle_sets(found), similarity))
    named = durable(named_classes(classes.select(F.col("node").alias("_node"), "set_key", "least_id", "rows"), links).withColumnRenamed("set_key", "_set"))
    linked = spread_join(rows.filter("n > 0").select("doc_id", "set_key", "n"), named, "set_key", "_set", "rows", rows.count()).select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = durable(linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    discard(spark, path)
    return out


def op11_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
words as (select rid, unnest(w) as x, generate_subscripts(w, 1) as i, len(w) as n from d),
runs as (select rid, i, n, string_agg(x, ' ') over (partition by rid order by i rows between current row and 4 following) as g from words),
shingles_ as (select distinct rid, md5(g) as g from runs where i = 1 or i <= n - 4),
sets as (select d.rid, doc_id, coalesce(k.n, 0) as n, k.key from d left join (select rid, count(*) as n, md5(string_agg(g, '' order by g)) as key from shingles_ group by rid) k using (rid)),
classes as (select min(rid) as cid, min(doc_id) as least, key, any_value(n) as n from sets where n > 0 group by key),
texts as (select cid, n, g from shingles_ join classes on cid = rid),
names as (select g, row_number() over () as k from (select g from texts group by g having count(*) > 1)),
shingles as (select cid, n, k as g from texts join names using (g)),
links as (select a.cid as u, b.cid as v from shingles a join shingles b on a.g = b.g and a.cid < b.cid and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.cid, b.cid, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ as (select u, v from links union all select v, u from links),
reach(cid, id) as (select cid, least from classes union select v, id from reach join both_ on u = cid),
named as (select cid, min(id) as component from reach group by cid)
select doc_id, sets.n as n_shingles, case when sets.n = 0 then doc_id else component end as component_id, doc_id is not distinct from case when sets.n = 0 then doc_id else component end as kept
from sets left join classes on classes.key = sets.key left join named using (cid)
"""
