"""Decision trees and random forests as distributed node tables: large nodes are split level by level by Spark jobs, small ones grown to their end in a task."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import unsized
from ..plans.joins import enumerated, spread_join
from ..sources import DatasetSpec
from .models import FittedModel, Model
from .split import bootstrap

#: Impurities and gains are compared after rounding, so that the order of additions cannot decide a tie.
DIGITS = 12
#: Ranges that the values of an attribute are cut into, so that running sums of a node with very many values have no single task.
RANGES = 64
#: Values (rows times attributes) up to which a node may be grown to its end by one task; rows up to which it is, whatever its share of all.
TASK_VALUES, TASK_ROWS = 2_000_000, 65_536
#: Nodes up to which a forest is scored by nested CASE expressions, and up to which it is sent to all tasks as arrays.
CASE_NODES, SENT_NODES = 200, 100_000
#: Rows that meet one subtree of a larger forest at once.
WALK_ROWS = 100_000
#: A node that a Spark job opened has its number shifted by so many bits as its id; nodes below it, grown in one task, count on from it.
SHIFT = 24
#: spread: whether the children are nodes that Spark jobs opened; top: the opened node that a node is or was grown from.
NODES = "tree int, id long, parent long, branch string, depth int, n double, attribute string, threshold double, label string, value double, spread boolean, top long"


@dataclass
class Node:
    tree: int
    id: int
    parent: int | None
    depth: int
    n: float
    prediction: str | float
    attribute: str | None = None
    threshold: float | None = None
    children: dict = field(default_factory=dict)  # value, or "left" and "right" -> node id


def _impurity(classes: list[str] | None, n: Column, parts: list[Column]) -> Column:
    """Entropy in bits of class counts, or the population variance from (sum, sum of squares)."""
    if classes is None:
        s, q = parts
        return F.greatest(F.try_divide(q, n) - F.pow(F.try_divide(s, n), F.lit(2)), F.lit(0.0))
    share = [F.try_divide(c, n) for c in parts]
    return -sum((F.when(c > 0, p * F.log2(p)).otherwise(F.lit(0.0)) for c, p in zip(parts, share, strict=True)), F.lit(0.0))


class Grower:
    """State and steps of growing trees. Rows: (_id, _tree, _node, _w, _y, _num array, _nom array)."""

    def __init__(self, df: DataFrame, spec: DatasetSpec, id_col: str, epsilon: float, constant_gain: str):
        self.spec, self.epsilon, self.constant_gain = spec, epsilon, constant_gain
        self.cols = spec.features(df.columns, id_col)
        self.nominal = [c for c in self.cols if c in spec.nominal_cols]
        self.numeric = [c for c in self.cols if c not in self.nominal]
        self.classes = None
        y = F.col(f"`{spec.target}`")
        if spec.task == "classification":
            self.classes = [r[0] for r in df.select(y.cast("string").alias("y")).filter("y is not null").distinct().orderBy("y").collect()]
            self.centre = 0.0
            y = y.cast("string")
        else:
            self.centre = df.agg(F.avg(y.cast("double"))).first()[0] or 0.0
            y = y.cast("double") - F.lit(self.centre)
        number = lambda c: F.when(~F.isnan(c), c)  # noqa: E731  # NaN counts as null: both go right
        num, nom = F.array(*[number(F.col(f"`{c}`").cast("double")) for c in self.numeric]), F.array(*[F.col(f"`{c}`").cast("string") for c in self.nominal]).cast("array<string>")
        self.rows = df.select(F.col(id_col).cast("long").alias("_id"), y.alias("_y"), num.cast("array<double>").alias("_num"), nom.alias("_nom"))
        self.rows = self.rows.filter("_y is not null")

    @cached_property
    def marks(self) -> dict[int, list[float]]:
        """Borders of the ranges of each numeric attribute, by its position among all."""
        shares = F.lit([i / RANGES for i in range(1, RANGES)])
        got = self.rows.agg(*[F.percentile_approx(F.col("_num")[i], shares, 10000).alias(f"_{i}") for i in range(len(self.numeric))]).first() if self.numeric else []
        return {self.cols.index(c): sorted(set(got[i] or [])) for i, c in enumerate(self.numeric)}

    def sums(self) -> list[Column]:
        w = F.col("_w")
        if self.classes is None:
            return [F.sum(w).alias("_n"), F.sum(w * F.col("_y")).alias("_p0"), F.sum(w * F.col("_y") * F.col("_y")).alias("_p1")]
        return [F.sum(w).alias("_n"), *[F.sum(F.when(F.col("_y") == c, w).otherwise(0)).cast("double").alias(f"_p{i}") for i, c in enumerate(self.classes)]]

    @property
    def parts(self) -> list[str]:
        return [f"_p{i}" for i in range(2 if self.classes is None else len(self.classes))]

    def impurity(self, n: str, parts: list[str]) -> Column:
        return F.round(_impurity(self.classes, F.col(n), [F.col(p) for p in parts]), DIGITS)

    def long(self, state: DataFrame) -> DataFrame:
        at = [F.struct(F.lit(self.cols.index(c)).alias("a"), F.col("_num")[i].alias("v"), F.lit(None).cast("string").alias("s")) for i, c in enumerate(self.numeric)]
        at += [F.struct(F.lit(self.cols.index(c)).alias("a"), F.lit(None).cast("double").alias("v"), F.col("_nom")[i].alias("s")) for i, c in enumerate(self.nominal)]
        return state.select("_tree", "_node", "_y", "_w", F.explode(F.array(*at)).alias("_a")).select("_tree", "_node", "_y", "_w", "_a.a", "_a.v", "_a.s")

    def ranges(self) -> Column:
        """The range that a value falls into, in the order of values; nulls come last. Nominal values are spread by hash."""
        spread = F.pmod(F.xxhash64("s"), F.lit(RANGES)).cast("int")
        out = spread
        for a, marks in self.marks.items():
            among = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("v"))) if marks else F.lit(0)
            out = F.when(F.col("a") == a, F.when(F.col("v").isNull(), F.lit(RANGES)).otherwise(among)).otherwise(out)
        return out

    def candidates(self, state: DataFrame) -> DataFrame:
        """(_tree, _node, a, gain, threshold, values, fit, ...): the best split of every attribute in every open node, and the node's sums.

        fit: whether the attribute is a candidate; see ``constant_gain``.

        Running sums over values go in two levels: within a range of values, and over the ranges' own sums.
        """
        at, total = ["_tree", "_node", "a"], ["_n", *self.parts]
        hist = unsized(self.long(state).groupBy(*at, "v", "s").agg(*self.sums()).withColumn("_range", self.ranges()))
        numeric = F.col("a").isin(*[self.cols.index(c) for c in self.numeric]) if self.numeric else F.lit(False)
        per = hist.groupBy(*[F.col(c).alias(f"b{c}") for c in at], F.col("_range").alias("b_range")).agg(*[F.sum(c).alias(f"s{c}") for c in total], F.min("v").alias("_low"))
        node = Window.partitionBy(*[f"b{c}" for c in at])
        before = node.orderBy("b_range").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(*[f"b{c}" for c in at], "b_range", *[F.sum(f"s{c}").over(node).alias(f"t{c}") for c in total], *[F.coalesce(F.sum(f"s{c}").over(before), F.lit(0.0)).alias(f"e{c}") for c in total], F.lead("_low").over(node.orderBy("b_range")).alias("_beyond"))
        same = [F.col(c) == F.col(f"b{c}") for c in (*at, "_range")]
        within = Window.partitionBy(*at, "_range").orderBy(F.col("v").asc_nulls_last())
        up = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = hist.join(per, same).select("*", *[(F.sum(c).over(up) + F.col(f"e{c}")).alias(f"u{c}") for c in total], F.coalesce(F.lead("v").over(within), "_beyond").alias("_next"))
        h = h.select("*", *[(F.col(f"t{c}") - F.col(f"u{c}")).alias(f"r{c}") for c in total], numeric.alias("_numeric"))
        whole, own = self.impurity("t_n", [f"t{p}" for p in self.parts]), self.impurity("_n", self.parts)
        left, right = self.impurity("u_n", [f"u{p}" for p in self.parts]), self.impurity("r_n", [f"r{p}" for p in self.parts])
        two = F.round((F.col("u_n") * left + F.col("r_n") * right) / F.col("t_n"), DIGITS)
        mid = (F.col("v") + F.col("_next")) / 2
        best = h.groupBy(*at, "_numeric").agg(
            F.max(whole).alias("whole"), *[F.max(f"t{c}").alias(c) for c in total], F.sum(F.col("_n") / F.col("t_n") * own).alias("inside"),
            F.min(F.when(F.col("v").isNotNull() & F.col("_next").isNotNull(), F.struct(two.alias("imp"), mid.alias("threshold")))).alias("split"), F.count_if(F.col("v").isNotNull() | ~F.col("_numeric")).alias("values"))
        gain = F.when(~F.col("_numeric"), F.col("whole") - F.col("inside")).otherwise(F.col("whole") - F.coalesce(F.col("split.imp"), F.lit(0.0)))
        fit = F.lit(True) if self.constant_gain == "full" else (F.col("values") > 1) | ~F.col("_numeric")
        return best.select(*at, "_numeric", "whole", *total, F.round(gain, DIGITS - 2).alias("gain"), "split.threshold", "values", fit.alias("fit"))

    def grow(self, draws: DataFrame | None, min_rows: float, max_depth: int | None) -> DataFrame:
        """The node table of all trees. Rows are routed by joins on their node; the driver learns how many nodes a level has, never which."""
        state = self.rows.withColumns({"_tree": F.lit(0), "_w": F.lit(1.0)}) if draws is None else self.rows.join(draws, "_id")
        state = unsized(state.withColumn("_node", F.shiftleft(F.col("_tree").cast("long"), SHIFT)))
        none = F.lit(None)
        opened = state.select(F.col("_tree").alias("tree"), F.col("_node").alias("id")).distinct().select("tree", "id", none.cast("long").alias("parent"), none.cast("string").alias("branch"))
        used = (state.agg(F.max("_tree")).first()[0] or 0) + 1
        pieces, depth, total = [], 0, None
        tasks = state.sparkSession.sparkContext.defaultParallelism
        while True:
            sizes = unsized(state.groupBy(F.col("_node").alias("_key")).agg(F.count("*").alias("_rows")))
            total = total or sizes.agg(F.sum("_rows")).first()[0] or 0
            # a node goes to a task if it fits, and if it is small or one of many, or if there were levels enough to make many
            small = (F.col("_rows") * max(1, len(self.cols)) <= TASK_VALUES) & ((F.col("_rows") <= TASK_ROWS) | (F.col("_rows") * tasks <= total) | F.lit(2**depth >= tasks))
            got = sizes.agg(F.count("*"), F.coalesce(F.count_if(small), F.lit(0)), F.sum("_rows")).first()
            if not got[0]:
                break
            if got[1] == got[0]:
                pieces.append(self.finish(state, opened, depth, min_rows, max_depth))
                break
            split = spread_join(state, sizes, "_node", "_key", "_rows", got[2]).drop("_key")
            if got[1]:
                split = unsized(split)
                pieces.append(self.finish(split.filter(small).drop("_rows"), opened, depth, min_rows, max_depth))
            nodes, state, opened, count = self.level(split.filter(~small), sizes, opened, depth, min_rows, max_depth, used, got[2])
            pieces.append(nodes)
            if not count:
                break
            used, depth = used + count, depth + 1
        out = self.rows.sparkSession.createDataFrame([], NODES)
        for p in pieces:
            out = out.unionByName(p)
        return unsized(out)

    def says(self) -> list[Column]:
        """label and value from a node's sums: the class of most weight, of ties the smallest; or the mean output."""
        if self.classes is None:
            return [F.lit(None).cast("string").alias("label"), (F.col("_p0") / F.col("_n") + self.centre).alias("value")]
        most = F.array_max(F.array(*[F.struct(F.col(p).alias("n"), F.lit(-i).alias("i")) for i, p in enumerate(self.parts)]))
        return [F.get(F.array(*[F.lit(c) for c in self.classes]), -most["i"]).alias("label"), F.lit(None).cast("double").alias("value")]

    def level(self, state: DataFrame, sizes: DataFrame, opened: DataFrame, depth: int, min_rows: float, max_depth: int | None, used: int, rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
        """Split every node of ``state`` once: their rows of the node table, the rows in the nodes opened below, these nodes and their number."""
        last = not self.cols or (max_depth is not None and depth >= max_depth)
        if last:
            best = state.groupBy("_tree", "_node").agg(*self.sums()).withColumns({"a": F.lit(-1), "threshold": F.lit(None).cast("double"), "_split": F.lit(False), "_numeric": F.lit(False)})
        else:
            first = Window.partitionBy("_tree", "_node").orderBy(F.col("fit").desc(), F.col("gain").desc(), "a")
            best = self.candidates(state).withColumn("_r", F.row_number().over(first)).filter("_r = 1")
            ok = F.col("fit") & (F.col("whole") > self.epsilon) & F.when(F.col("_numeric"), F.col("threshold").isNotNull()).otherwise((F.col("values") > 1) | (F.col("gain") > 0))
            best = best.withColumn("_split", ok & (F.col("_n") >= min_rows) if min_rows else ok)
        best = unsized(best)
        name = F.when(F.col("_split"), F.get(F.array(*[F.lit(c) for c in self.cols]).cast("array<string>"), F.col("a")))
        nodes = best.join(opened, F.col("_node") == F.col("id")).select(
            "tree", "id", "parent", "branch", F.lit(depth).alias("depth"), F.col("_n").alias("n"), name.alias("attribute"), F.when(F.col("_split"), F.col("threshold")).alias("threshold"), *self.says(), F.col("_split").alias("spread"), F.col("id").alias("top"))
        split = best.filter("_split").select("_tree", "_node", "a", "threshold", "_numeric")
        split = split.join(sizes, F.col("_node") == F.col("_key")).drop("_key")
        below = split.filter("_numeric").select("_tree", "_node", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("branch"), F.lit(None).cast("long").alias("_k"))
        if self.nominal:
            values = spread_join(self.long(state).filter("s is not null or v is null"), split.filter("not _numeric").select(F.col("_node").alias("_key"), F.col("a").alias("_a"), "_rows"), "_node", "_key", "_rows", rows).filter("a = _a")
            below = below.unionByName(values.groupBy("_tree", "_node", F.col("s").alias("branch")).agg(F.count("*").alias("_k")))
        below = unsized(enumerated(below.repartition("_node").sortWithinPartitions("_node", "branch"), "_child", used).withColumn("_child", F.shiftleft("_child", SHIFT)))
        count = below.count()
        if not count:
            return nodes, None, None, 0
        side = lambda x: F.max(F.when(F.col("branch") == x, F.col("_child"))).alias(f"_{x}")
        numeric = split.filter("_numeric").join(below.filter("_k is null").groupBy(F.col("_node").alias("_b")).agg(side("left"), side("right")), F.col("_node") == F.col("_b"))
        steps = numeric.select("_node", "a", "threshold", "_left", "_right", "_rows")
        if self.nominal:
            steps = steps.unionByName(split.filter("not _numeric").select("_node", "a", "threshold", F.lit(None).cast("long").alias("_left"), F.lit(None).cast("long").alias("_right"), "_rows"))
        steps = steps.withColumnRenamed("_node", "_key").withColumnRenamed("_rows", "_size")
        moved = spread_join(state.drop("_rows"), steps, "_node", "_key", "_size", rows)
        x = F.lit(None).cast("double")
        for i, c in enumerate(self.numeric):
            x = F.when(F.col("a") == self.cols.index(c), F.col("_num")[i]).otherwise(x)
        moved = moved.withColumn("_to", F.when(F.col("_left").isNotNull(), F.when(x <= F.col("threshold"), F.col("_left")).otherwise(F.col("_right"))))
        if self.nominal:
            s = F.lit(None).cast("string")
            for i, c in enumerate(self.nominal):
                s = F.when(F.col("a") == self.cols.index(c), F.col("_nom")[i]).otherwise(s)
            key = lambda node, value: F.concat(node.cast("string"), F.coalesce(F.concat(F.lit("="), value), F.lit("")))
            to = below.filter("_k is not null").select(key(F.col("_node"), F.col("branch")).alias("_value"), F.col("_child").alias("_to2"), "_k")
            moved = spread_join(moved.withColumn("_is", F.when(F.col("_left").isNull(), key(F.col("_node"), s))), to, "_is", "_value", "_k", rows, "left").withColumn("_to", F.coalesce("_to", "_to2"))
        moved = unsized(moved.select("_id", "_y", "_num", "_nom", "_tree", "_w", F.col("_to").alias("_node")))
        return nodes, moved, below.select(F.col("_tree").alias("tree"), F.col("_child").alias("id"), F.col("_node").alias("parent"), "branch"), count

    def finish(self, state: DataFrame, opened: DataFrame, depth: int, min_rows: float, max_depth: int | None) -> DataFrame:
        """The rows of the node table of all nodes of ``state`` and below, each node grown in one task."""
        classes, centre, cols, numeric, nominal, grower = self.classes, self.centre, self.cols, self.numeric, self.nominal, self.in_task()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            n = len(pdf)
            pdf = pdf.sort_values("_id", kind="stable")
            x = np.array(pdf["_num"].tolist(), float).reshape(n, len(numeric))
            s = np.array([list(v) for v in pdf["_nom"]], object).reshape(n, len(nominal))
            y = pdf["_y"].to_numpy()
            target = np.searchsorted(np.array(classes, object), y).astype(np.int64) if classes is not None else y.astype(float)
            out = grower(x, s, target, pdf["_w"].to_numpy(float), depth, min_rows, max_depth)
            top = int(pdf["_node"].iloc[0])
            a, guess = out.pop("a"), out.pop("guess")
            got = pd.DataFrame(out)
            got["tree"], got["id"], got["top"] = int(pdf["_tree"].iloc[0]), top + np.arange(len(got)), top
            got["parent"] = pd.array([None if p < 0 else top + p for p in out["parent"]], "Int64")
            got["attribute"] = [cols[i] if i >= 0 else None for i in a]
            got["label"] = None if classes is None else [classes[int(g)] for g in guess]
            got["value"] = guess + centre if classes is None else np.nan
            return got.assign(spread=False)[names]

        names = ["tree", "id", "parent", "branch", "depth", "n", "attribute", "threshold", "label", "value", "spread", "top"]
        got = state.select("_id", "_tree", "_node", "_y", "_w", "_num", "_nom").groupBy("_node").applyInPandas(run, NODES)
        above = opened.select(F.col("id").alias("_key"), F.col("parent").alias("_parent"), F.col("branch").alias("_branch"))
        got = unsized(got.join(above, F.col("id") == F.col("_key"), "left"))
        blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
        return got.select("tree", "id", F.coalesce("parent", "_parent").alias("parent"), F.coalesce("branch", "_branch").alias("branch"), "depth", "n", "attribute", blank("threshold"), "label", blank("value"), "spread", "top")

    def in_task(self):
        """The same rules over arrays: a function to all nodes below and with a node's rows, level by level, parents first."""
        kinds = [(c in self.numeric, (self.numeric if c in self.numeric else self.nominal).index(c)) for c in self.cols]
        k, exclude, epsilon = len(self.classes) if self.classes is not None else None, self.constant_gain == "exclude", self.epsilon

        def sums(group: np.ndarray, groups: int, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            """(groups, 1 + parts): weight, and class weights or sums of y and its square."""
            if k is None:
                return np.stack([np.bincount(group, v, groups) for v in (w, w * y, w * y * y)], 1)
            parts = np.bincount(group * k + y, w, groups * k).reshape(groups, k)
            return np.concatenate([parts.sum(1, keepdims=True), parts], 1)

        def impurity(t: np.ndarray) -> np.ndarray:
            n = t[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                if k is None:
                    out = np.where(n > 0, np.maximum(t[:, 2] / n - (t[:, 1] / n) ** 2, 0.0), 0.0)
                else:
                    out = np.zeros(len(t))
                    for c in range(1, k + 1):
                        p = t[:, c] / n
                        out = out + np.where(t[:, c] > 0, p * np.log2(p), 0.0)
                    out = -out
            return np.round(out, DIGITS)

        def groups(own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """An order by node and value, the number of each sorted row's group of equal ones, and where groups start."""
            order = np.lexsort((value, own))
            a, b = own[order], value[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
            return order, np.cumsum(new) - 1, np.flatnonzero(new)

        def running(t: np.ndarray, node: np.ndarray) -> np.ndarray:
            """Running sums within each node, none of which holds another node's."""
            out = np.empty_like(t)
            edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                np.cumsum(t[a:b], 0, out=out[a:b])
            return out

        def grow(x, s, y, w, depth, min_rows, max_depth) -> dict:
            codes = []
            for i in range(s.shape[1]):
                names = sorted(dict.fromkeys(s[:, i]), key=lambda v: (v is not None, v or ""))
                at = {v: j for j, v in enumerate(names)}
                codes.append((names, np.fromiter((at[v] for v in s[:, i]), np.int64, len(s))))
            made: dict[str, list] = {c: [] for c in ("parent", "branch", "depth", "n", "guess", "a", "threshold")}
            rows, own, parent, branch, first = np.arange(len(y)), np.zeros(len(y), np.int64), np.array([-1]), np.array([None], object), 0
            while m := len(parent):
                total = sums(own, m, y[rows], w[rows])
                whole, n = impurity(total), total[:, 0]
                pick, fit, gain = np.full(m, -1), np.zeros(m, bool), np.full(m, -np.inf)
                threshold, split = np.full(m, np.nan), np.zeros(m, bool)
                if max_depth is None or depth < max_depth:
                    for a, (numeric, i) in enumerate(kinds):
                        if numeric:
                            known = np.flatnonzero(~np.isnan(x[rows, i]))
                            value, node = x[rows[known], i], own[known]
                            order, group, start = groups(node, value)
                            t, node, value = sums(group, len(start), y[rows[known]][order], w[rows[known]][order]), node[order][start], value[order][start]
                            values = np.bincount(node, minlength=m)
                            inner = np.flatnonzero(node[1:] == node[:-1]) if len(node) else np.empty(0, np.int64)
                            upto = running(t, node)[inner] if len(node) else t
                            of, all_ = node[inner], total[node[inner]]
                            rest = all_ - upto
                            two = np.round((upto[:, 0] * impurity(upto) + rest[:, 0] * impurity(rest)) / all_[:, 0], DIGITS) if len(inner) else np.empty(0)
                            least = np.full(m, np.inf)
                            np.minimum.at(least, of, two)
                            hits = np.flatnonzero(two == least[of])
                            who, at = np.unique(of[hits], return_index=True)
                            at = inner[hits[at]]
                            cut, imp = np.full(m, np.nan), np.zeros(m)
                            cut[who], imp[who] = (value[at] + value[at + 1]) / 2, least[who]
                            f, ok = (values > 1) if exclude else np.ones(m, bool), ~np.isnan(cut)
                            g = np.round(whole - imp, DIGITS - 2)
                        else:
                            code = codes[i][1][rows]
                            order, group, start = groups(own, code)
                            t, node = sums(group, len(start), y[rows][order], w[rows][order]), own[order][start]
                            inside = np.bincount(node, t[:, 0] / total[node, 0] * impurity(t), m)
                            f, cut = np.ones(m, bool), np.full(m, np.nan)
                            g = np.round(whole - inside, DIGITS - 2)
                            ok = (np.bincount(node, minlength=m) > 1) | (g > 0)
                        better = (pick < 0) | (f & ~fit) | ((f == fit) & (g > gain))
                        for held, new in ((pick, np.full(m, a)), (fit, f), (gain, g), (threshold, cut), (split, ok)):
                            held[better] = new[better]
                    split &= fit & ~(whole <= epsilon)
                    if min_rows:
                        split &= ~(n < min_rows)
                guess = total[:, 1] / n if k is None else total[:, 1:].argmax(1).astype(float)
                for c, v in (("parent", parent), ("branch", branch), ("depth", np.full(m, depth)), ("n", n), ("guess", guess), ("a", np.where(split, pick, -1)), ("threshold", np.where(split, threshold, np.nan))):
                    made[c].append(v)
                stay = split[own]
                rows, own = rows[stay], own[stay]
                key = np.zeros(len(rows), np.int64)  # place of a row's branch among all of the node's attribute
                for a, (numeric, i) in enumerate(kinds):
                    mine = pick[own] == a
                    key[mine] = ~(x[rows[mine], i] <= threshold[own[mine]]) if numeric else codes[i][1][rows[mine]]
                order, group, start = groups(own, key)
                node, place = own[order][start], key[order][start]
                own[order] = group
                branch = np.empty(len(node), object)
                for j, (u, p) in enumerate(zip(node.tolist(), place.tolist(), strict=True)):
                    numeric, i = kinds[pick[u]]
                    branch[j] = ("left", "right")[p] if numeric else codes[i][0][p]
                parent, first, depth = node + first, first + m, depth + 1
            return {c: np.concatenate(v) for c, v in made.items()}

        return grow


def _is(x: Column, value: str | None) -> Column:
    return x.isNull() if value is None else x.cast("string") == F.lit(value)


@dataclass
class FittedTrees(FittedModel):
    """Trees as one node table (NODES). A nominal value that a node has not seen gets that node's own prediction; null is a value like others.

    Up to SENT_NODES nodes are sent to all tasks; the rows that a larger forest scores are routed by joins on its table.
    """

    spec: DatasetSpec
    table: DataFrame
    numeric: tuple[str, ...]
    classes: list[str] | None = None

    @classmethod
    def of(cls, spark, spec: DatasetSpec, trees: list[list[Node]], numeric: tuple[str, ...], classes: list[str] | None = None) -> FittedTrees:
        """A model of nodes that the driver holds."""
        labels = spec.task == "classification"
        rows = []
        for t in trees:
            branch = {c: v for n in t for v, c in n.children.items()}
            rows += [(n.tree, n.id, n.parent, branch.get(n.id), n.depth, float(n.n), n.attribute if n.children else None, n.threshold if n.children else None, n.prediction if labels else None, None if labels else n.prediction, False, min(x.id for x in t)) for n in t]
        return cls(spec, spark.createDataFrame(rows, NODES), numeric, classes)

    @cached_property
    def size(self) -> int:
        return self.table.count()

    @cached_property
    def trees(self) -> list[list[Node]]:
        """All nodes, by tree, in the driver; refused beyond SENT_NODES."""
        if self.size > SENT_NODES:
            raise ValueError(f"{self.size} nodes stay in their table; the driver holds up to {SENT_NODES}")
        rows = self.table.orderBy("tree", "depth", "id").toArrow().to_pylist()
        labels = self.spec.task == "classification"
        by = {(r["tree"], r["id"]): Node(r["tree"], r["id"], r["parent"], r["depth"], r["n"], r["label"] if labels else float("nan") if r["value"] is None else r["value"], r["attribute"], r["threshold"]) for r in rows}
        for r in rows:
            if r["parent"] is not None:
                by[r["tree"], r["parent"]].children[r["branch"]] = r["id"]
        out: dict[int, list[Node]] = {}
        for n in by.values():
            out.setdefault(n.tree, []).append(n)
        return [out[t] for t in sorted(out)]

    def column(self, tree: list[Node]) -> Column:
        by = {n.id: n for n in tree}

        def build(n: Node) -> Column:
            if not n.children:
                return F.lit(n.prediction)
            x = F.col(f"`{n.attribute}`")
            if n.attribute in self.numeric:
                return F.when(x.cast("double") <= F.lit(n.threshold), build(by[n.children["left"]])).otherwise(build(by[n.children["right"]]))
            out = F.lit(n.prediction)
            for v, c in reversed(n.children.items()):
                out = F.when(_is(x, v), build(by[c])).otherwise(out)
            return out

        return build(next(n for n in tree if n.parent is None))

    def transform(self, df):
        name = next(f"_votes{i}" for i in range(len(df.columns) + 1) if f"_votes{i}" not in df.columns)
        if self.size <= CASE_NODES:
            votes = F.array(*[self.column(t) for t in self.trees])
        else:
            df = self.route(df, name)
            votes = F.col(name)
        if self.spec.task == "regression":
            out = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v) / F.size(votes)
        else:  # most votes, smallest label of ties
            count = lambda v: F.size(F.filter(votes, lambda u: u == v))
            best = F.array_max(F.transform(F.array_distinct(votes), count))
            out = F.array_min(F.filter(votes, lambda v: count(v) == best))
        return df.withColumn("prediction", out).drop(name)

    def route(self, df: DataFrame, name: str = "_votes") -> DataFrame:
        """Add what each tree says: over Arrow batches if the nodes can be sent to them, else by ``landed``."""
        labels = self.spec.task == "classification"
        if self.size <= SENT_NODES:
            return df.withColumn(name, self.walked(labels))
        if df.isStreaming:
            raise ValueError(f"a forest of over {SENT_NODES} nodes scores no streams")
        number = next(f"_row{i}" for i in range(len(df.columns) + 1) if f"_row{i}" not in df.columns)
        rows = unsized(df.withColumn(number, F.monotonically_increasing_id()))
        says = self.table.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), F.col("label" if labels else "value").alias("_says"))
        ends = self.landed(rows.withColumn("_row", F.col(number)))
        per = ends.groupBy(F.col("_tree").alias("_pt"), F.col("_node").alias("_pn")).agg(F.count("*").alias("_k"))
        says = unsized(says.join(per, (F.col("_t") == F.col("_pt")) & (F.col("_i") == F.col("_pn"))).select("_i", "_says", "_k"))
        votes = spread_join(ends, says, "_node", "_i", "_k", ends.count()).groupBy(F.col("_row").alias("_vote_row")).agg(F.array_sort(F.collect_list(F.struct("_tree", "_says"))).alias("_all"))
        return rows.join(votes.select("_vote_row", F.col("_all._says").alias(name)), F.col(number) == F.col("_vote_row")).drop(number, "_vote_row")

    def walked(self, labels: bool | None) -> Column:
        """An array of what each tree says, or, with None, of the last node's id."""
        numeric = sorted({n.attribute for t in self.trees for n in t if n.children and n.attribute in self.numeric})
        nominal = sorted({n.attribute for t in self.trees for n in t if n.children and n.attribute not in self.numeric})
        sent = self.table.sparkSession.sparkContext.broadcast([_arrays(t, numeric, nominal, labels) for t in self.trees])

        @F.pandas_udf("array<string>" if labels else "array<long>" if labels is None else "array<double>")
        def votes(x: pd.Series, s: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            numbers, texts = np.array(x.tolist(), float).reshape(len(x), -1), [list(v) for v in s]
            return pd.Series(list(np.stack([_walk(t, numbers, texts) for t in sent.value], 1)))

        number = [F.col(f"`{c}`").cast("double") for c in numeric]
        text = [F.col(f"`{c}`").cast("string") for c in nominal]
        return votes(F.array(*number).cast("array<double>"), F.array(*text).cast("array<string>"))

    def landed(self, df: DataFrame) -> DataFrame:
        """(_row, _tree, _node): the last node of each row in each tree; ``df`` has _row.

        Over the part of the trees that Spark jobs opened, rows are routed by a join a level; below it the rows of a subtree, in parts of
        WALK_ROWS at most, walk down in a task that holds the subtree.
        """
        if self.size <= SENT_NODES:
            return df.select("_row", F.posexplode(self.walked(None)).alias("_tree", "_node"))
        nominal = [c for c in self.spec.features(df.columns, "_row") if c in self.spec.nominal_cols]
        numeric = list(self.numeric)
        num = F.array(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in numeric]).cast("array<double>")
        nom = F.array(*[F.col(f"`{c}`").cast("string") for c in nominal]).cast("array<string>")
        roots = [r["tree"] for r in self.table.select("tree").distinct().orderBy("tree").collect()]  # a number for each tree
        now = unsized(df.select("_row", num.alias("_num"), nom.alias("_nom"), F.explode(F.array(*[F.lit(t) for t in roots])).alias("_tree")).withColumn("_node", F.shiftleft(F.col("_tree").cast("long"), SHIFT)))
        total = now.count()
        inner = self.table.filter("spread")
        below = self.table.filter("id = top and parent is not null")
        levels = inner.agg(F.max("depth")).first()[0]
        x, s = F.lit(None).cast("double"), F.lit(None).cast("string")
        for i, c in enumerate(numeric):
            x = F.when(F.col("attribute") == c, F.col("_num")[i]).otherwise(x)
        for i, c in enumerate(nominal):
            s = F.when(F.col("attribute") == c, F.col("_nom")[i]).otherwise(s)
        key = lambda node, value: F.concat(node.cast("string"), F.coalesce(F.concat(F.lit("="), value), F.lit("")))
        for d in range(0 if levels is None else levels + 1):
            at = inner.filter(F.col("depth") == d).select(F.col("id").alias("_key"), "attribute", "threshold")
            sizes = now.groupBy(F.col("_node").alias("_n")).agg(F.count("*").alias("_k"))
            at = unsized(at.join(sizes, F.col("_key") == F.col("_n")).drop("_n"))
            moved = spread_join(now, at, "_node", "_key", "_k", total, "left").drop("_key", "_k")
            is_number = F.col("attribute").isin(*numeric) if numeric else F.lit(False)
            branch = F.when(is_number, F.when(x <= F.col("threshold"), "left").otherwise("right")).otherwise(s)
            moved = unsized(moved.withColumn("_is", F.when(F.col("attribute").isNotNull(), key(F.col("_node"), branch))).drop("attribute", "threshold"))
            to = below.filter(F.col("depth") == d + 1).select(key(F.col("parent"), F.col("branch")).alias("_key"), F.col("id").alias("_to"))
            met = moved.groupBy(F.col("_is").alias("_n")).agg(F.count("*").alias("_k"))
            to = unsized(to.join(met, F.col("_key") == F.col("_n")).drop("_n"))
            now = unsized(spread_join(moved, to, "_is", "_key", "_k", total, "left").select("_row", "_num", "_nom", "_tree", F.coalesce("_to", "_node").alias("_node")))
        # no spread node but those of unseen values is left: these stay, the others are tops of subtrees
        sizes = unsized(now.groupBy(F.col("_node").alias("_n")).agg(F.count("*").alias("_k")).withColumn("_parts", F.ceil(F.col("_k") / WALK_ROWS).cast("long")))
        dealt = spread_join(now, sizes, "_node", "_n", "_k", total).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).select("_row", "_num", "_nom", "_tree", F.col("_node").alias("_top"), "_part")
        trees = self.table.join(sizes, F.col("top") == F.col("_n")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))

        def run(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(nodes):
                return pd.DataFrame({"_row": [], "_tree": [], "_node": []})
            tree = _nodes(nodes)
            numbers = np.array(rows["_num"].tolist(), float).reshape(len(rows), -1)
            ends = _walk(_arrays(tree, numeric, nominal, None), numbers, [list(v) for v in rows["_nom"]])
            return pd.DataFrame({"_row": rows["_row"], "_tree": rows["_tree"], "_node": ends})

        picked = trees.select(F.col("top").alias("_top"), "_part", "id", F.coalesce("parent", F.lit(-1)).alias("parent"), "branch", "depth", "attribute", "threshold", "spread")
        return unsized(dealt.groupBy("_top", "_part").cogroup(picked.groupBy("_top", "_part")).applyInPandas(run, "_row long, _tree int, _node long"))

    def nodes(self, spark=None) -> DataFrame:
        kind = F.when(F.col("attribute").isNull(), "leaf").when(F.col("attribute").isin(*self.numeric) if self.numeric else F.lit(False), "numeric").otherwise("nominal")
        says = F.col("label") if self.spec.task == "classification" else F.col("value").cast("string")
        return self.table.select(F.col("tree").alias("tree_id"), F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "depth", kind.alias("kind"), "attribute", "threshold", "n", says.alias("predict"))

    def explain(self, tree: int = 0) -> str:
        by = {n.id: n for n in self.trees[tree]}

        def show(n: Node, label: str) -> list[str]:
            head = "  " * n.depth + label
            if not n.children:
                return [f"{head}{n.prediction}"]
            out = [f"{head}{n.attribute}:"]
            for k, c in n.children.items():
                out += show(by[c], {"left": f"<= {n.threshold}: ", "right": f"> {n.threshold}: "}.get(k, f"= {k}: ") if n.attribute in self.numeric else f"= {k}: ")
            return out

        return "\n".join(show(next(n for n in by.values() if n.parent is None), ""))

    def collapsed(self, leaves: set[int]) -> FittedTrees:
        """The first tree with those nodes as leaves; of a model that the driver can hold."""
        by = {n.id: n for n in self.trees[0]}
        out, open_ = [], [next(n.id for n in by.values() if n.parent is None)]
        while open_:
            n = by[open_.pop()]
            kids = {} if n.id in leaves else n.children
            out.append(Node(n.tree, n.id, n.parent, n.depth, n.n, n.prediction, n.attribute, n.threshold, kids))
            open_ += kids.values()
        return FittedTrees.of(self.table.sparkSession, self.spec, [sorted(out, key=lambda n: n.id)], self.numeric, self.classes)


def _nodes(rows: pd.DataFrame) -> list[Node]:
    """Nodes of one subtree; a node whose children are nodes that Spark jobs opened is a leaf of it."""
    by = {}
    for i, a, t, spread, depth in zip(rows["id"].tolist(), rows["attribute"].tolist(), rows["threshold"].tolist(), rows["spread"].tolist(), rows["depth"].tolist(), strict=True):
        by[i] = Node(0, i, None, depth, 0.0, 0.0, None if spread else a, t)
    for i, p, b in zip(rows["id"].tolist(), rows["parent"].tolist(), rows["branch"].tolist(), strict=True):
        if p in by:
            by[i].parent = p
            by[p].children[b] = i
    return list(by.values())


def _arrays(tree: list[Node], numeric: list[str], nominal: list[str], labels: bool | None) -> tuple:
    """A tree by position: kind (0 leaf, 1 numeric, 2 nominal), column, threshold, left, right, children by value, prediction."""
    at = {n.id: i for i, n in enumerate(sorted(tree, key=lambda n: n.id))}
    kind, column, side = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64), np.zeros((2, len(at)), np.int64)
    threshold, by_value = np.zeros(len(at)), {}
    for n in tree:
        i = at[n.id]
        if n.children and n.attribute in numeric:
            kind[i], column[i], threshold[i] = 1, numeric.index(n.attribute), n.threshold
            side[:, i] = at[n.children["left"]], at[n.children["right"]]
        elif n.children:
            kind[i], column[i] = 2, nominal.index(n.attribute)
            by_value[i] = {v: at[c] for v, c in n.children.items()}
    says = np.array(sorted(at)) if labels is None else np.array([n.prediction for n in sorted(tree, key=lambda n: n.id)], object if labels else float)
    return kind, column, threshold, side, by_value, says


def _walk(tree: tuple, numbers: np.ndarray, texts: list[list]) -> np.ndarray:
    kind, column, threshold, side, by_value, says = tree
    at, open_ = np.zeros(len(texts), np.int64), np.arange(len(texts))
    while len(open_ := open_[kind[at[open_]] > 0]):
        here = at[open_]
        plain = kind[here] == 1
        rows, nodes = open_[plain], here[plain]
        at[rows] = np.where(numbers[rows, column[nodes]] <= threshold[nodes], side[0][nodes], side[1][nodes])
        stay = np.ones(len(open_), bool)
        for j in np.flatnonzero(~plain):
            i = here[j]
            to = by_value[i].get(texts[open_[j]][column[i]])
            if to is None:  # a value that the node has not seen
                stay[j] = False
            else:
                at[open_[j]] = to
        open_ = open_[stay]
    return says[at]


class DecisionTree(Model):
    """pruning: None, "pre-prune" (nodes under ``leaf_size`` of the training rows become leaves, as always in regression) or
    "post-prune" (``post_prune`` "root": the whole tree or one leaf; "full": every subtree, bottom up; by ``validation``).
    ``constant_gain`` "full": an attribute that is constant in a node counts as a perfect split and makes a leaf; "exclude": it is no candidate.
    """

    def __init__(self, pruning: str | None = None, leaf_size: float = 0.0, validation: DataFrame | None = None, epsilon: float = 0.001, post_prune: str = "root", constant_gain: str = "full", max_depth: int | None = None):
        if pruning not in (None, "pre-prune", "post-prune"):
            raise ValueError(f"unknown pruning {pruning!r}")
        self.pruning, self.leaf_size, self.validation, self.epsilon, self.post_prune, self.constant_gain, self.max_depth = pruning, leaf_size, validation, epsilon, post_prune, constant_gain, max_depth

    def fit(self, df, spec, id_col="row_id"):
        g = Grower(df, spec, id_col, self.epsilon, self.constant_gain)
        limit = self.leaf_size * df.count() if self.pruning == "pre-prune" or spec.task == "regression" else 0
        model = FittedTrees(spec, g.grow(None, limit, self.max_depth), tuple(g.numeric), g.classes)
        if not model.size:
            return FittedTrees.of(df.sparkSession, spec, [[Node(0, 0, None, 0, 0, "" if g.classes is not None else float("nan"))]], tuple(g.numeric), g.classes)
        return self.prune(model, spec) if self.pruning == "post-prune" else model

    def prune(self, model: FittedTrees, spec: DatasetSpec) -> FittedTrees:
        """A node becomes a leaf if the validation rows are then predicted no worse, nodes bottom up.

        Validation rows are counted at the node they end in: by class, or as sums of outputs and squares about the mean. Subtrees that were
        grown in a task are pruned in one, all at once, and send their sums and loss to the node above; over the part that Spark jobs opened
        sums go up by one aggregate a level, and a cut goes down by one join a level. Losses of outputs are compared at 9 digits.
        """
        target, root_only = F.col(f"`{spec.target}`"), self.post_prune != "full"
        classes, centre = model.classes, 0.0
        actual = target.cast("string") if classes is not None else target.cast("double")
        rows = unsized(self.validation.withColumn("_row", F.monotonically_increasing_id()))
        known = rows.select(F.col("_row").alias("_r"), actual.alias("_actual"))
        if classes is None:
            centre = known.agg(F.avg("_actual")).first()[0] or 0.0
            t = F.col("_actual") - centre
            parts = [F.sum(t).alias("p0"), F.sum(t * t).alias("p1")]
        else:
            parts = [F.count_if(F.col("_actual") == c).cast("double").alias(f"p{i}") for i, c in enumerate(classes)]
        names = ["k", *[f"p{i}" for i in range(len(parts))]]
        ends = model.landed(rows).join(known, F.col("_row") == F.col("_r")).groupBy(F.col("_node").alias("_at")).agg(F.count("*").cast("double").alias("k"), *parts)

        def losses(sums: np.ndarray, label: np.ndarray, value: np.ndarray) -> np.ndarray:
            """Of rows with these sums if predicted so."""
            if classes is None:
                p = value - centre
                return np.maximum(sums[:, 2] - 2 * p * sums[:, 1] + sums[:, 0] * p * p, 0.0)
            at = np.array([classes.index(x) if x in classes else -1 for x in label], np.int64)
            return sums[:, 0] - np.where(at >= 0, sums[np.arange(len(sums)), 1 + np.maximum(at, 0)], 0.0)

        slack = 1e-12 if classes is not None else 1e-9

        def run(nodes: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(nodes):
                return pd.DataFrame({c: [] for c in out})
            nodes = nodes.sort_values("id").reset_index(drop=True)
            ids = nodes["id"].to_numpy()
            sums = np.zeros((len(ids), len(names)))
            if len(found):
                sums[np.searchsorted(ids, found["_at"].to_numpy())] = found[names].to_numpy(float)
            label, value = nodes["label"].to_numpy(), nodes["value"].to_numpy(float)
            loss = losses(sums, label, value)  # of rows that stop here, as no child takes them
            inner, opened, depth = nodes["attribute"].notna().to_numpy(), nodes["spread"].to_numpy(bool), nodes["depth"].to_numpy()
            parent, root = np.searchsorted(ids, nodes["parent"].to_numpy()), (nodes["parent"] < 0).to_numpy()
            leaf = np.zeros(len(ids), bool)
            for d in sorted(set(depth.tolist()), reverse=True):
                now = np.flatnonzero(depth == d)
                own = losses(sums[now], label[now], value[now])
                cut = inner[now] & ~opened[now] & (own <= loss[now] + slack * (loss[now] if classes is not None else sums[now, 2])) & (root[now] | (not root_only))
                leaf[now], loss[now] = cut, np.where(cut, own, loss[now])
                up = now[ids[now] != nodes["top"].iloc[0]]
                np.add.at(sums, parent[up], sums[up])
                np.add.at(loss, parent[up], loss[up])
            gone = np.zeros(len(ids), bool)
            for i in np.argsort(depth, kind="stable"):
                if ids[i] != nodes["top"].iloc[0]:
                    gone[i] = gone[parent[i]] or leaf[parent[i]]
            got = nodes.assign(leaf=leaf, loss=loss, **{c: sums[:, j] for j, c in enumerate(names)})[~gone]
            return got[out]

        out = [c.split(" ")[0] for c in NODES.split(", ")] + ["leaf", "loss", *names]
        schema = NODES + ", leaf boolean, loss double, " + ", ".join(f"{c} double" for c in names)
        tops = model.table.select(F.col("id").alias("_id"), F.col("top").alias("_top"))
        found = ends.join(tops, F.col("_at") == F.col("_id")).select("_top", "_at", *names)
        table = unsized(model.table.withColumns({"_top": F.col("top"), "parent": F.coalesce("parent", F.lit(-1))}).groupBy("_top").cogroup(found.groupBy("_top")).applyInPandas(run, schema))
        blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
        table = table.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent"))).select(*[blank(c) if c in ("threshold", "value") else c for c in out])
        most = table.filter("spread").agg(F.max("depth")).first()[0]
        if most is None:
            pruned = table
        else:
            pruned = self.prune_spread(table, most, names, classes, centre, slack, root_only)
        end = F.when(~F.col("leaf"), F.col("attribute")).alias("attribute"), F.when(~F.col("leaf"), F.col("threshold")).alias("threshold")
        columns = [c.split(" ")[0] for c in NODES.split(", ")]
        pruned = pruned.withColumn("spread", F.col("spread") & ~F.col("leaf"))
        return FittedTrees(spec, unsized(pruned.select(*[dict(attribute=end[0], threshold=end[1]).get(c, c) for c in columns])), model.numeric, classes)

    def prune_spread(self, table: DataFrame, most: int, names: list[str], classes: list[str] | None, centre: float, slack: float, root_only: bool) -> DataFrame:
        """``table`` with the decisions on nodes that Spark jobs opened, and without the subtrees below those that become leaves."""
        at = F.lit(None).cast("double")
        if classes is None:
            p = F.col("value") - centre
            own = F.greatest(F.col("p1") - 2 * p * F.col("p0") + F.col("k") * p * p, F.lit(0.0))
        else:
            at = F.coalesce(F.get(F.array(*[F.col(f"p{i}") for i in range(len(classes))]), F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int") - 1), F.lit(0.0))
            own = F.col("k") - at
        opened = table.filter("id = top")
        level = {d: opened.filter((F.col("depth") == d) & ~F.col("spread")) for d in range(most + 2)}
        done = {}
        for d in range(most, -1, -1):  # sums and losses of a level's nodes, with all that comes from below
            sent = done.get(d + 1, level[d + 1]).groupBy(F.col("parent").alias("_p")).agg(*[F.sum(c).alias(f"s_{c}") for c in (*names, "loss")])
            here = opened.filter((F.col("depth") == d) & F.col("spread")).join(sent, F.col("id") == F.col("_p"), "left").drop("_p")
            here = here.withColumns({c: F.col(c) + F.coalesce(f"s_{c}", F.lit(0.0)) for c in (*names, "loss")}).drop(*[f"s_{c}" for c in (*names, "loss")])
            limit = F.col("loss") + slack * (F.col("loss") if classes is not None else F.col("p1"))
            cut = (own <= limit) & (F.col("parent").isNull() if root_only else F.lit(True))
            here = unsized(here.withColumn("leaf", cut).withColumn("loss", F.when(cut, own).otherwise(F.col("loss"))))
            done[d] = here.unionByName(level[d])
            done[d] = unsized(done[d])
        kept, tops = done[0], done[0]
        for d in range(1, most + 2):  # a node stays if its parent stays and is no leaf
            parents = kept.filter("spread and not leaf").select(F.col("id").alias("_p"))
            kept = done.get(d, level[d]).join(parents, F.col("parent") == F.col("_p")).drop("_p")
            kept = unsized(kept)
            tops = tops.unionByName(kept)
        stay = tops.select(F.col("id").alias("_t"))
        return tops.unionByName(table.filter("id <> top").join(stay, F.col("top") == F.col("_t"), "left_semi"))


class RandomForest(Model):
    """Trees on bootstrap samples of ``fraction`` of the rows, grown in the same jobs. All attributes are candidates in every node."""

    def __init__(self, num_trees: int = 100, fraction: float = 0.5, pruning: str | None = None, leaf_size: float = 0.0, epsilon: float = 0.001, seed: int = 0, max_depth: int | None = None, constant_gain: str = "full"):
        self.num_trees, self.fraction, self.pruning, self.leaf_size, self.epsilon, self.seed, self.max_depth, self.constant_gain = num_trees, fraction, pruning, leaf_size, epsilon, seed, max_depth, constant_gain

    def fit(self, df, spec, id_col="row_id"):
        g = Grower(df, spec, id_col, self.epsilon, self.constant_gain)
        draws = bootstrap(df, id_col, self.num_trees, self.fraction, self.seed).select(F.col("tree_id").cast("int").alias("_tree"), F.col(id_col).cast("long").alias("_id"), F.col("weight").cast("double").alias("_w"))
        limit = self.leaf_size * int(df.count() * self.fraction) if self.pruning == "pre-prune" or spec.task == "regression" else 0
        return FittedTrees(spec, g.grow(draws, limit, self.max_depth), tuple(g.numeric), g.classes)
