"""Scaling, discretisation, imputation and encoding. Statistics of any number of columns come from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floordiv, nan_div
from ..plans.durable import durable
from ..sources import DatasetSpec


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _with_stats(train: DataFrame, frames: tuple[DataFrame, ...], cols: tuple[str, ...], stats: dict, value) -> tuple[DataFrame, ...]:
    """Replace ``cols`` in every frame by ``value(column, statistics of train)``; the statistics are one row, joined lazily."""
    if not cols:
        return frames
    row = train.agg(*[f(_c(c).cast("double")).alias(f"_{k}{i}") for i, c in enumerate(cols) for k, f in stats.items()])
    at = {c: {k: F.col(f"_{k}{i}") for k in stats} for i, c in enumerate(cols)}
    return tuple(f.crossJoin(F.broadcast(row)).select(*[value(_c(c).cast("double"), **at[c]).alias(c) if c in at else _c(c) for c in f.columns]) for f in frames)


def standardize(train: DataFrame, test: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Z-scores by the training rows' mean and sample deviation; a constant column gives NaN."""
    return _with_stats(train, (train, test), cols, {"m": F.avg, "s": F.stddev_samp}, lambda x, m, s: nan_div(x - m, s))


def standardize_attributes(train: DataFrame, test: DataFrame, spec: DatasetSpec) -> tuple[DataFrame, DataFrame]:
    return standardize(train, test, *spec.standardize_cols)


def min_max_scale(train: DataFrame, test: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """To [0, 1] by the training rows' range, without clipping other rows; a constant column gives NaN."""
    return _with_stats(train, (train, test), cols, {"l": F.min, "h": F.max}, lambda x, l, h: nan_div(x - l, h - l))  # noqa: E741


def min_max_scale_attributes(train: DataFrame, test: DataFrame, spec: DatasetSpec) -> tuple[DataFrame, DataFrame]:
    return min_max_scale(train, test, *spec.min_max_scale_cols)


def discretize(df: DataFrame, col: str, strategy: str, n_bins: int) -> DataFrame:
    """Replace a column by bins 1 to ``n_bins``.

    equal-width: by range; a constant column is bin 1. equal-frequency: floor((average rank - 1) / n_bins) + 1, clipped: that
    divides by the number of bins, as the definition followed here does, and so fills bins evenly only if rows are n_bins squared.
    quantile: bins of even size (ties by value share a bin's border as they fall).
    """
    clip = lambda b: F.least(F.greatest(b, F.lit(1)), F.lit(n_bins)).cast("int")
    if strategy == "equal-width":
        def bins(x, l, h):  # noqa: E741
            width = (h - l) / n_bins
            return F.when(x.isNull(), None).otherwise(F.when(width == 0, 1).otherwise(clip(floordiv(x - l, width) + 1)))

        return _with_stats(df, (df,), (col,), {"l": F.min, "h": F.max}, bins)[0]
    if strategy not in ("equal-frequency", "quantile"):
        raise ValueError(f"unknown discretisation strategy {strategy!r}")
    # ranks come from the histogram of values, and its running sum from two levels, so no task sees all rows
    hist = durable(df.filter(_c(col).isNotNull()).groupBy(_c(col).alias("_v")).agg(F.count("*").alias("_n")))
    ranked = running_total(hist, "_v", "_n", "_upto")
    if strategy == "equal-frequency":
        rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
        bin_ = clip(F.floor((rank - 1) / n_bins) + 1)
    else:
        total = hist.agg(F.sum("_n").alias("_all"))
        ranked = ranked.crossJoin(F.broadcast(total))
        bin_ = clip(F.floor((F.col("_upto") - F.col("_n")) * n_bins / F.col("_all")) + 1)
    # bins ascend with values, so the least value of each bin says all: one row, and no join by value
    least = ranked.groupBy(bin_.alias("b")).agg(F.min("_v").alias("v"))
    cuts = least.agg(F.array_sort(F.collect_list(F.struct("v", "b"))).alias("_millrace_cuts"))
    bin_of = F.try_element_at(F.filter("_millrace_cuts", lambda c: c["v"] <= _c(col)), F.lit(-1))["b"]
    return df.crossJoin(F.broadcast(cuts)).select(*[bin_of.alias(c) if c == col else _c(c) for c in df.columns])


def running_total(df: DataFrame, order: str, n: str, out: str, pieces: int = 64) -> DataFrame:
    """Running sum of ``n`` by ``order`` (distinct), through sums of value ranges: a range's own running sum, plus the ranges before."""
    kind, x = dict(df.dtypes)[order], F.col(order)
    if kind == "string":  # ranges come from a sample of the sort; they are written, so that a rerun cannot cut them elsewhere
        part = durable(df.repartitionByRange(pieces, x).withColumn("_part", F.spark_partition_id()))
    else:
        number = (F.unix_date(x) if kind == "date" else x).cast("double") if not kind.startswith("timestamp_ntz") else F.unix_micros(x.cast("timestamp")).cast("double")
        marks = df.agg(F.percentile_approx(number, F.lit([i / pieces for i in range(1, pieces)]), 10000).alias("_marks"))
        part = df.crossJoin(F.broadcast(marks)).withColumn("_part", F.size(F.filter(F.col("_marks"), lambda m: m < number))).drop("_marks")
    sums = part.groupBy("_part").agg(F.sum(n).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    return part.join(F.broadcast(sums), "_part").withColumn(out, F.sum(n).over(Window.partitionBy("_part").orderBy(order)) + F.col("_before")).drop("_part", "_before")


def impute(df: DataFrame, spec: DatasetSpec, id_col: str | None = "row_id") -> DataFrame:
    """Replace the missing-value symbol: by the mode (smallest of ties) in nominal and ordinal columns, else by the mean.

    The target and ``id_col`` stay as they are, and so does a column without any value. Numeric columns become doubles; a
    cell there that is neither a number, null nor the symbol is an error when the result is read, as it has no mean to count in.
    """
    symbol = spec.missing_value_symbol
    if symbol is None:
        return df
    cols = [c for c in df.columns if c not in (spec.target, id_col)]
    number = [c for c in cols if spec.is_numeric(c)]
    known = lambda c: F.when(_c(c).cast("string") != symbol, _c(c).cast("string"))
    fill = [(F.avg(known(c).try_cast("double")) if c in number else F.mode(known(c), True)).alias(f"_f{i}") for i, c in enumerate(cols)]
    row = df.agg(*fill)
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(_c(c))
            continue
        x, f = _c(c).cast("string"), F.col(f"_f{cols.index(c)}")
        if c in number:
            value = x.try_cast("double")
            bad = F.raise_error(F.concat(F.lit(f"{c} holds a cell that is no number: "), x)).cast("double")
            out.append(F.when(x == symbol, f).when(x.isNotNull() & value.isNull(), bad).otherwise(value).alias(c))
        else:
            out.append(F.when(x == symbol, F.coalesce(f, x)).otherwise(x).alias(c))
    return df.crossJoin(F.broadcast(row)).select(*out)


def categories(df: DataFrame, *cols: str, most: int = 10_000) -> dict[str, list]:
    """The sorted values of each column; more than ``most`` are refused, as each would become a column.

    A sketch of the number of values comes first, so that no buffer gathers many more than may be kept.
    """
    if not cols:
        return {}
    counts = df.agg(*[F.approx_count_distinct(_c(c), 0.02).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    for c, n in zip(cols, counts, strict=True):
        if n > most * 1.2:
            raise ValueError(f"{c} has more than {most} values")
    row = df.agg(*[F.array_sort(F.collect_set(_c(c))).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    for c, v in zip(cols, row, strict=True):
        if len(v) > most:
            raise ValueError(f"{c} has more than {most} values")
    return dict(zip(cols, row, strict=True))


def one_hot_encode(df: DataFrame, *cols: str, values: dict[str, list] | None = None) -> DataFrame:
    """0/1 columns ``{col}_{value}`` for all but the first value in sorted order; null gives zeros. New columns go to the end."""
    values = values or categories(df, *cols)
    new = [F.coalesce((_c(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in cols for v in values[c][1:]]
    return df.select(*[_c(c) for c in df.columns if c not in cols], *new)


def encode_ordinal(df: DataFrame, col: str, values: list | tuple) -> DataFrame:
    """Replace a value by its place in ``values``, from 1. Values are compared as strings, all at once; another one is an error."""
    x = _c(col).cast("string")
    out = F.lit(None).cast("long")
    for i, v in reversed(list(enumerate(values, 1))):
        out = F.when(x == str(v), F.lit(i).cast("long")).otherwise(out)
    seen = F.when(x.isNull() | x.isin(*[str(v) for v in values]), out).otherwise(F.raise_error(F.concat(F.lit(f"{col} holds a value that is not in its order: "), x)).cast("long"))
    return df.withColumn(col, seen)


def encode_categorical(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    for c, v in spec.ordinal_cols.items():
        df = encode_ordinal(df, c, v)
    return one_hot_encode(df, *spec.nominal_cols) if spec.nominal_cols else df


def preprocess(df: DataFrame, spec: DatasetSpec, impute_missing: bool = True, one_hot: bool = True, ordinal: bool = True, id_col: str | None = "row_id") -> tuple[DataFrame, DatasetSpec]:
    """Impute, one-hot encode and number ordinals, each if asked for. Returns the table and the spec that now holds."""
    if impute_missing:
        df, spec = impute(df, spec, id_col), spec.with_changes(missing_value_symbol=None)
    if one_hot and spec.nominal_cols:
        df, spec = one_hot_encode(df, *spec.nominal_cols), spec.with_changes(nominal_cols=())
    if ordinal:
        for c, v in spec.ordinal_cols.items():
            df = encode_ordinal(df, c, v)
        spec = spec.with_changes(ordinal_cols={})
    return df, spec


def preprocess_all(frames: dict[str, DataFrame], specs: dict[str, DatasetSpec], **switches) -> tuple[dict[str, DataFrame], dict[str, DatasetSpec]]:
    done = {k: preprocess(frames[k], specs[k], **switches) for k in frames}
    return {k: d for k, (d, _) in done.items()}, {k: s for k, (_, s) in done.items()}
