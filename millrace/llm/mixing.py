"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions, spread_join, table, word_count

#: Documents rounded together in one group; also the number of residuals that meet in one node of the reduction tree.
CHUNK = 8192
SCHEMA = "source string, doc_id long, no_id boolean, text_key long, n long, size long, whole long, p double, chunk long, final boolean"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources of ``sizes(source, source_size)``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all sizes; a target stops at
    ``cap`` times its source's size and the excess is shared among the others by weight until none is above. One row per
    source; each round is one aggregate over that table. Returns (source, source_size, target).
    """
    # ranks in two levels: sources are dealt out by ranges, counted for each range and numbered within it, so no task holds all
    dealt = durable(sizes.repartitionByRange(shuffle_partitions(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = ranges.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    order = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights) + 1).cast("int"))
    s = durable(dealt.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn("w", w).drop("_range", "_r", "_before"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # the water level: an open source gets level * w, a closed one its cap
        above = F.lit(cap) * F.col("source_size") <= F.lit(level) * F.col("w")
        row = s.agg(F.sum(F.when(above, F.lit(cap) * F.col("source_size")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w"))), F.count_if(above)).first()
        if not row[1] or row[2] == full:
            break
        full, level = row[2], max(0.0, share * total - row[0]) / row[1]
    return s.select("source", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("w")).alias("target"))


def _dice(seed: int, *key) -> random.Random:
    return random.Random(int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "big"))


def _round_group(last: bool, seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "text_key"], ascending=[False, True, True], kind="stable")
        weight = (pdf["size"] * pdf["n"]).tolist()
        rng = _dice(seed, level, pdf["source"].iloc[0], int(pdf["chunk"].iloc[0]))
        p = pdf["p"].tolist()
        got, at, x = pairwise(weight, p, rng)
        pdf = pdf.assign(final=True)
        if at is not None and last:
            got[at] = int(x >= 0.5)
            at = None
        pdf["whole"] = pdf["whole"] + got
        pdf["p"] = 0.0
        if at is not None:
            pdf.iloc[at, pdf.columns.get_loc("p")] = x
            pdf.iloc[at, pdf.columns.get_loc("final")] = False
        return pdf

    return run


def pairwise(size: list[int], p: list[float], rng: random.Random) -> tuple[list[int], int | None, float]:
    """Round the copy probabilities ``p`` so that sum(size * p) and each expectation stay as they are.

    A fractional document is paired with the next: mass (in words) moves from one to the other, in a direction drawn so that
    neither's expectation changes, until one of the two is integral; the other is paired on. At most one stays fractional.
    Returns the roundings, the position of the fractional one (or None) and its probability.
    """
    out, held, x = [0] * len(p), None, 0.0
    for i, (a, y) in enumerate(zip(size, p, strict=True)):
        if y <= 1e-9 or y >= 1 - 1e-9:
            out[i] = round(y)
            continue
        if held is None:
            held, x = i, y
            continue
        b = size[held]
        up, down = min(b * (1 - x), a * y), min(b * x, a * (1 - y))
        moved = up if rng.random() * (up + down) < down else -down
        x, y = x + moved / b, y - moved / a
        if x <= 1e-9 or x >= 1 - 1e-9:
            out[held], held, x = round(x), i, y
        if held == i and (y <= 1e-9 or y >= 1 - 1e-9):
            out[i], held = round(y), None
        elif held != i:
            out[i] = round(y)
    return out, held, x


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """Copies of each document so that every source's words meet its target.

    docs needs doc_id, text and source; other columns are ignored, whatever their names. A unit is a distinct (source, doc_id,
    text): n repeated identical rows share one decision. A null text counts no words; a document without words is taken once
    if its source's target is at least its size, as whole copies go first (its ``taken`` is 0 either way). An empty table
    gives an empty result. A document of a source with ratio r = target / size is copied floor(r) times, and once more with
    probability r - floor(r), by pivotal rounding of pairs, largest documents first, that preserves the source's words: groups of at
    most about ``chunk`` documents each leave at most one fractional document, and those meet in the next level of a reduction tree, until one is
    left per source and is rounded to the nearer side. The rows of a hot source are spread over its chunks, so no task holds
    more than a chunk. Fixed hashes drive all choices: reruns agree.

    Returns (source, doc_id, text_key, n, size, source_size, target, copies): one row per unit.
    """
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("text_key"), word_count(F.col("text")).alias("size"))
    units = durable(rows.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  # null is a source of its own
    count = sizes.select(key(F.col("source")).alias("k"), "units")
    goal = targets(sizes.drop("units"), weights, share, cap).withColumn("_key", key(F.col("source"))).drop("source")
    goal = durable(goal.join(count, F.col("_key") == F.col("k")).drop("k"))
    total = units.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("units") / chunk)).cast("long")
    state = spread_join(units.withColumn("_k", key(F.col("source"))), goal, "_k", "_key", "units", total).select(
        "source", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text_key", "n", "size", F.floor(near).alias("whole"), (near - F.floor(near)).alias("p"),
        F.pmod(F.xxhash64("doc_id", "text_key"), pieces).alias("chunk"), F.lit(False).alias("final"))
    done = state.filter("p = 0 or size = 0").withColumn("final", F.lit(True))
    most = goal.agg(F.max(F.ceil(F.col("units") / chunk))).first()[0] or 0
    open_, level, parts = state.filter("p > 0 and size > 0"), 0, [done]
    while most:
        last = most <= 1
        got = durable(open_.groupBy("source", "chunk").applyInPandas(_round_group(last, seed, level), SCHEMA))
        parts.append(got.filter("final"))
        if last:
            break
        open_, level, most = got.filter("not final").withColumn("chunk", F.floor(F.col("chunk") / chunk)), level + 1, -(-most // chunk)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return spread_join(out.withColumn("_k", key(F.col("source"))), goal, "_k", "_key", "units", total).select("source", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text_key", "n", "size", "source_size", "target", F.col("whole").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` decides (not at all, once, ...), all columns kept."""
    names = {"source": "_millrace_source", "doc_id": "_millrace_id", "text_key": "_millrace_key", "copies": "_millrace_copies"}
    # fresh names: checkpoints keep the attributes of docs, which a join of both could not tell apart
    plan = mix(docs, **options).filter("copies > 0").select(*[F.col(c).alias(x) for c, x in names.items()])
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["text"].isNull())
    same = docs["source"].eqNullSafe(F.col("_millrace_source")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_millrace_id")) & (key == F.col("_millrace_key"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_millrace_copies").cast("int")))
    return docs.join(plan, same).select(*[docs[c] for c in docs.columns], copies.alias("_millrace_copy")).drop("_millrace_copy")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    each = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", each.alias("row_no")).drop("row_no")
