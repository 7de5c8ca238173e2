"""Random and stratified partitions, cross-validation plans, bootstrap and mini-batch samples.

Randomness is the MD5 of seed and row id, so that every engine and every rerun draws alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket, hash_key
from ..plans.durable import durable
from ..sources import DatasetSpec


def ranked(df: DataFrame, id_col: str, seed: int | str, by: str | None = None, rep: str | None = None) -> DataFrame:
    """Add _rank (from 0, in hash order) and _rows (the number of rows), per value of ``by`` if given.

    With ``rep``, a column, every repetition is ranked on its own, by the hash of seed, repetition and id. Two levels: rows are
    counted by the hash's first three digits, and ranked within them; so a whole table or a class that holds a third of it
    is spread over 4096 groups.
    """
    keys = [F.col(f"`{by}`") if by else F.lit(0), F.col(f"`{rep}`") if rep else F.lit(0)]
    ids = [*([F.col(f"`{rep}`")] if rep else []), F.col(id_col)]
    h = df.select("*", keys[0].alias("_by"), keys[1].alias("_rep"), hash_key(seed, *ids).alias("_hash")).withColumn("_slice", F.substring("_hash", 1, 3))
    counts = h.groupBy("_by", "_rep", "_slice").agg(F.count("*").alias("_n"))
    per = Window.partitionBy("_by", "_rep")
    base = counts.select(F.col("_by").alias("_b"), F.col("_rep").alias("_p"), F.col("_slice").alias("_s"), (F.sum("_n").over(per.orderBy("_slice")) - F.col("_n")).alias("_before"), F.sum("_n").over(per).alias("_rows"))
    out = h.join(base, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_rep") == F.col("_p")) & (F.col("_slice") == F.col("_s")))
    rank = F.row_number().over(Window.partitionBy("_by", "_rep", "_slice").orderBy("_hash", id_col)) - 1 + F.col("_before")
    return out.withColumn("_rank", rank).drop("_by", "_rep", "_b", "_p", "_s", "_hash", "_slice", "_before")


def split(df: DataFrame, id_col: str, k: int | None = None, frac: list[float] | None = None, stratify_by: str | None = None, seed: int | str = 0, name: str = "partition", rep: str | None = None) -> DataFrame:
    """Add the number of the partition that each row falls into, in ``name``.

    ``k`` equal parts or parts by ``frac``: just one of them. Part i gets int(rows * frac[i]) rows, what remains goes to
    random parts; with ``stratify_by`` within every class, with ``rep`` within every repetition. No copies are made: a partition is a filter.
    """
    if (k is None) == (frac is None):
        raise ValueError("give either k or frac")
    frac = frac or [1 / k] * k
    r = ranked(df, id_col, seed, stratify_by, rep)
    upto = [F.floor(F.col("_rows") * F.lit(f)) for f in frac]
    total = F.lit(0)
    edges = []
    for q in upto:
        total = total + q
        edges.append(total)
    part = bucket(f"{seed}", len(frac), *([F.col(f"`{rep}`")] if rep else []), F.lit("surplus"), F.col(id_col))
    for i in reversed(range(len(frac))):
        part = F.when(F.col("_rank") < edges[i], F.lit(i).cast("long")).otherwise(part)
    return r.withColumn(name, part.cast("int")).drop("_rank", "_rows")


def cv_plan(df: DataFrame, spec: DatasetSpec, strategy: str, k: int, id_col: str, seed: int = 0, include_validation: bool = True) -> DataFrame:
    """Add rep and side for cross-validation, stratified in classification.

    A fifth of the rows is for validation (rep -1, side 0). The others: strategy "k" puts them into sides 0 to k - 1 of rep 0;
    "kx2" repeats them for each rep 0 to k - 1 with sides 0 and 1. All repetitions are ranked in one pass.
    """
    by = "class" if spec.task == "classification" else None
    if strategy not in ("k", "kx2"):
        raise ValueError(f"unknown strategy {strategy!r}")
    reps, sides = (1, k) if strategy == "k" else (k, 2)
    if include_validation:
        df = split(df, id_col, frac=[0.8, 0.2], stratify_by=by, seed=f"{seed}:validation", name="_val")
    else:
        df = df.withColumn("_val", F.lit(0))
    # validation rows are repetition -1 of their own, so that one ranking serves all
    df = df.withColumn("rep", F.explode(F.when(F.col("_val") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(reps - 1))))).drop("_val")
    out = split(df, id_col, k=sides, stratify_by=by, seed=seed, name="side", rep="rep")
    return out.withColumn("side", F.when(F.col("rep") < 0, F.lit(0)).otherwise(F.col("side")))


def bootstrap(df: DataFrame, id_col: str, trees: int, fraction: float = 0.5, seed: int | str = 0) -> DataFrame:
    """(tree_id, id_col, weight): for each tree int(rows * fraction) draws with replacement, counted per row that was drawn.

    Draw j of a tree takes the row whose rank in hash order is a hash of (tree, j): draws are generated where they are joined, and
    combined before the shuffle.
    """
    rows = ranked(df.select(id_col), id_col, seed)
    n = rows.count()
    draws = int(n * fraction)
    ids = df.sparkSession.range(trees * draws).select((F.col("id") / F.lit(max(1, draws))).cast("long").alias("tree_id"), (F.col("id") % F.lit(max(1, draws))).alias("_j"))
    drawn = ids.select("tree_id", bucket(seed, max(1, n), F.col("tree_id"), F.col("_j")).alias("_rank")).groupBy("tree_id", "_rank").agg(F.count("*").alias("weight"))
    return drawn.join(rows.select(id_col, "_rank"), "_rank").select("tree_id", id_col, "weight")


def minibatch(df: DataFrame, id_col: str, step: int, batch_size: int, seed: int | str = 0) -> DataFrame:
    """``batch_size`` rows drawn without replacement; another step draws independently of it. Only the least hashes of each task travel."""
    order = hash_key(seed, F.lit(step), F.col(id_col))
    return df.orderBy(order, id_col).limit(batch_size)


def minibatches(df: DataFrame, id_col: str, steps: list[int], batch_size: int, seed: int | str = 0, rows: int | None = None) -> DataFrame:
    """The rows of ``minibatch`` of each of ``steps``, with _step and their place _rank in it: all steps are drawn by one scan.

    A row is a candidate of a step if its hash is below the batch's share of all hashes and a margin of six deviations; candidates are
    then ranked, about a batch of them a step. A step that finds fewer than a batch, or, as ids may repeat, none at all, is drawn anew.
    """
    n = df.count() if rows is None else rows
    share = min(1.0, (batch_size + 6 * batch_size**0.5 + 16) / max(1, n))
    many = df.withColumn("_step", F.explode(F.array(*[F.lit(t) for t in steps])))
    many = many.withColumn("_hash", hash_key(seed, F.col("_step"), F.col(id_col)))
    if share < 1:
        many = durable(many.filter(F.substring("_hash", 1, 8) <= format(int(share * 2**32) & 0xFFFFFFFF, "08x")))
    per = Window.partitionBy("_step").orderBy("_hash", id_col)
    out = many.withColumn("_rank", F.row_number().over(per) - 1).filter(F.col("_rank") < batch_size).drop("_hash")
    if share < 1:
        enough = {r["_step"] for r in many.groupBy("_step").count().filter(F.col("count") >= batch_size).collect()}  # a number for each step
        for t in set(steps) - enough:
            anew = minibatch(df, id_col, t, batch_size, seed).withColumn("_step", F.lit(t))
            again = Window.orderBy(hash_key(seed, F.lit(t), F.col(id_col)), id_col)  # a batch of rows
            out = out.filter(F.col("_step") != t).unionByName(anew.withColumn("_rank", F.row_number().over(again) - 1).select(*out.columns))
    return out
