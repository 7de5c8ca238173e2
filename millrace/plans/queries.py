"""The queries of the tabular operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crossval, knn, metrics, models, neural, preprocess, split, tree
from ..sources import DatasetSpec

PART = DatasetSpec("part", "classification", standardize_cols=("p_size", "p_retailprice"), metrics=("acc",))
COLS = ("p_partkey", "p_size", "p_retailprice", "p_type")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _part(spark, sf, target="class", *features) -> DataFrame:
    f = features or ("p_size", "p_retailprice")
    y = F.col("p_type").alias("class") if target == "class" else F.col("p_retailprice").alias("output")
    return _t(spark, sf, "part").select("p_partkey", *[F.col(c).cast("double").alias(c) for c in f], y)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def standardize(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    a, b = preprocess.standardize(df.filter("p_partkey % 5 <> 0"), df.filter("p_partkey % 5 = 0"), "p_size", "p_retailprice")
    return a.withColumn("is_train", F.lit(True)).unionByName(b.withColumn("is_train", F.lit(False))).select("p_partkey", _r("p_size"), _r("p_retailprice"), "is_train")


def min_max_scale(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    a, b = preprocess.min_max_scale(df.filter("c_custkey % 5 <> 0"), df.filter("c_custkey % 5 = 0"), "c_acctbal")
    return a.unionByName(b).select("c_custkey", _r("c_acctbal"))


def discretize_equal_width(spark, sf):
    return preprocess.discretize(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "equal-width", 10)


def discretize_equal_freq(spark, sf):
    return preprocess.discretize(_t(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "equal-frequency", 10)


def _holes(spark, sf) -> DataFrame:
    gap = lambda c, m: F.when(F.col("o_orderkey") % m == 0, "?").otherwise(F.col(c).cast("string")).alias(c)
    return _t(spark, sf, "orders").select("o_orderkey", gap("o_orderstatus", 7), gap("o_totalprice", 11), "o_orderpriority")


PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
ORDERS = DatasetSpec("orders", "regression", nominal_cols=("o_orderstatus",), ordinal_cols={"o_orderpriority": PRIORITIES}, missing_value_symbol="?")


def discretize_quantile(spark, sf):
    return preprocess.discretize(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "quantile", 7)


def impute(spark, sf):
    return preprocess.impute(_holes(spark, sf).drop("o_orderpriority"), ORDERS.with_changes(ordinal_cols={}), "o_orderkey").select("o_orderkey", "o_orderstatus", _r("o_totalprice", 2))


def one_hot(spark, sf):
    return preprocess.one_hot_encode(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


def ordinal_encode(spark, sf):
    return preprocess.encode_ordinal(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", PRIORITIES)


def encode_categorical(spark, sf):
    """All nominal and ordinal columns of a descriptor at once."""
    return preprocess.encode_categorical(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ORDERS)


def preprocess_pipeline(spark, sf):
    got, _ = preprocess.preprocess(_holes(spark, sf), ORDERS, id_col="o_orderkey")
    return got.select("o_orderkey", _r("o_totalprice", 2), "o_orderpriority", "o_orderstatus_O", "o_orderstatus_P")


def random_split(spark, sf):
    return split.split(_t(spark, sf, "part").select("p_partkey"), "p_partkey", frac=[0.5, 0.3, 0.2], seed=7)


def stratified_split(spark, sf):
    return split.split(_part(spark, sf).select("p_partkey", "class"), "p_partkey", k=5, stratify_by="class", seed=7)


def kfold_plan(spark, sf):
    return split.cv_plan(_part(spark, sf).select("p_partkey", "class"), PART, "k", 5, "p_partkey", 3)


def kx2_plan(spark, sf):
    return split.cv_plan(_part(spark, sf).select("p_partkey", "class"), PART, "kx2", 3, "p_partkey", 3)


def bootstrap(spark, sf):
    return split.bootstrap(_t(spark, sf, "part").select("p_partkey"), "p_partkey", 5, 0.5, 1)


def minibatch_sample(spark, sf):
    return split.minibatch(_t(spark, sf, "part").select("p_partkey"), "p_partkey", 0, 32, 5)


def binary_metrics(spark, sf):
    df = _t(spark, sf, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("p"))
    return metrics.compute_metrics(df, "a", "p", metrics.CLASSIFICATION, "1", "0").select(*[_r(m) for m in metrics.CLASSIFICATION])


def regression_metrics(spark, sf):
    df = _t(spark, sf, "part").select(F.col("p_retailprice").alias("a"), (F.col("p_size") * 20.0 + 900).alias("p"))
    return metrics.compute_metrics(df, "a", "p", metrics.REGRESSION).select(*[_r(m, 4) for m in metrics.REGRESSION])


def null_class(spark, sf):
    df = _part(spark, sf)
    return models.NullModel().fit(df, PART).transform(df).select("p_partkey", "prediction")


def null_reg(spark, sf):
    df = _t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("output"))
    return models.NullModel().fit(df, ORDERS).transform(df).select("o_orderkey", _r("prediction", 4))


def _split5(df):
    return df.filter("p_partkey % 5 <> 0"), df.filter("p_partkey % 5 = 0")


def knn_class(spark, sf):
    train, test = _split5(_part(spark, sf))
    return knn.KNN(5).fit(train, PART, "p_partkey").transform(test).select("p_partkey", "prediction")


def knn_reg(spark, sf):
    train, test = _split5(_part(spark, sf, "output", "p_size"))
    return knn.KNN(5).fit(train, DatasetSpec("part", "regression"), "p_partkey").transform(test).select("p_partkey", _r("prediction", 4))


def knn_embed(spark, sf):
    df = _t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("class"))
    got = knn.KNN(5).fit(df.filter("vec_id % 5 <> 0"), DatasetSpec("e", "classification"), "vec_id").transform(df.filter("vec_id % 5 = 0"))
    return got.select("vec_id", "prediction")


def knn_nominal(spark, sf):
    """Nearest neighbours over a nominal and a numeric column: the distance of two values is that of their class shares in the training rows."""
    df = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_size") / 50).alias("size"), F.col("p_type").alias("class"))
    train, test = _split5(df)
    return knn.KNN(3).fit(train, PART.with_changes(nominal_cols=("brand",)), "p_partkey").transform(test).select("p_partkey", "prediction")


def vdm_matrix(spark, sf):
    df = _t(spark, sf, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("class"))
    return knn.vdm_matrix(df, "o_orderstatus").select("v1", "v2", _r("vdm_sq", 9))


def _suppliers(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("bal"), (F.col("s_nationkey") % 3).cast("string").alias("class"))


def edited_knn(spark, sf):
    return knn.EditedKNN(3).fit(_suppliers(spark, sf), DatasetSpec("s", "classification"), "s_suppkey").train.select(F.col("_id").alias("s_suppkey"), F.col("_y").alias("class"))


def condensed_knn(spark, sf):
    return knn.CondensedKNN(3).fit(_suppliers(spark, sf), DatasetSpec("s", "classification"), "s_suppkey").train.select(F.col("_id").alias("s_suppkey"), F.col("_y").alias("class"))


def info_gain(spark, sf):
    """Best split of every attribute at the root: entropy, gain and threshold (price falls in cents: half cents are midpoints)."""
    df = _part(spark, sf, "class", "p_size", "p_retailprice").withColumn("brand", F.col("class").substr(1, 1))
    g = tree.Grower(df, PART.with_changes(nominal_cols=("brand",)), "p_partkey", 0.001, "full")
    got = g.candidates(g.rows.withColumns({"_tree": F.lit(0), "_w": F.lit(1.0), "_node": F.lit(0)}))
    names = F.element_at(F.array(*[F.lit(c) for c in g.cols]), F.col("a") + 1)
    return got.select(names.alias("attribute"), F.round("whole", 6).alias("entropy"), _r("gain"), _r("threshold", 3))


def _root(df: DataFrame, spec: DatasetSpec, id_col: str) -> tuple[tree.Grower, DataFrame]:
    g = tree.Grower(df, spec, id_col, 0.001, "full")
    return g, g.rows.withColumns({"_tree": F.lit(0), "_w": F.lit(1.0), "_node": F.lit(0)})


def entropy(spark, sf):
    """Entropy in bits of a class and variance of a number, over all rows of a table."""
    g, state = _root(_part(spark, sf), PART, "p_partkey")
    bits = state.agg(*g.sums()).select(F.lit("p_type").alias("target"), g.impurity("_n", g.parts).alias("impurity"))
    g, state = _root(_part(spark, sf, "output", "p_size"), DatasetSpec("part", "regression"), "p_partkey")
    spread = state.agg(*g.sums()).select(F.lit("p_retailprice").alias("target"), g.impurity("_n", g.parts).alias("impurity"))
    return bits.unionByName(spread).select("target", _r("impurity", 4))


def info_gain_nominal(spark, sf):
    """Gain of a split by each value of a nominal attribute."""
    df = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "MM").alias("month"), F.col("o_orderstatus").alias("class"))
    spec = DatasetSpec("o", "classification", nominal_cols=("o_orderpriority", "month"))
    g, state = _root(df, spec, "o_orderkey")
    names = F.element_at(F.array(*[F.lit(c) for c in g.cols]), F.col("a") + 1)
    return g.candidates(state).select(names.alias("attribute"), _r("gain", 8))


def best_threshold(spark, sf):
    """Best threshold and gain of numeric attributes for a class, over the lines of all orders (no unique key is needed)."""
    df = _t(spark, sf, "lineitem").select(F.lit(0).alias("row_id"), F.col("l_quantity").cast("double").alias("l_quantity"), (F.col("l_discount") * 100).cast("double").alias("l_discount"), F.col("l_returnflag").alias("class"))
    g, state = _root(df, DatasetSpec("l", "classification"), "row_id")
    names = F.element_at(F.array(*[F.lit(c) for c in g.cols]), F.col("a") + 1)
    return g.candidates(state).select(names.alias("attribute"), _r("gain", 8), _r("threshold", 6))


def tree_stump(spark, sf):
    train, test = _split5(_part(spark, sf))
    return tree.DecisionTree(constant_gain="exclude", max_depth=1).fit(train, PART, "p_partkey").transform(test).select("p_partkey", "prediction")


def tree_nominal(spark, sf):
    """A root split by a nominal attribute with a branch for each value; unseen values get what the root says."""
    df = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("class"))
    train, test = _split5(df)
    return tree.DecisionTree(max_depth=1).fit(train, DatasetSpec("part", "classification", nominal_cols=("brand",)), "p_partkey").transform(test).select("p_partkey", "prediction")


def forest_stump(spark, sf):
    train, test = _split5(_part(spark, sf, "output", "p_size"))
    model = tree.RandomForest(3, constant_gain="exclude", max_depth=1).fit(train, DatasetSpec("part", "regression"), "p_partkey")
    return model.transform(test).select("p_partkey", _r("prediction", 4))


def tree_predict(spark, sf):
    train, test = _split5(_part(spark, sf))
    return tree.DecisionTree("pre-prune", 0.05, constant_gain="exclude").fit(train, PART, "p_partkey").transform(test).select("p_partkey", "prediction")


def tree_prune(spark, sf):
    train, test = _split5(_part(spark, sf))
    return tree.DecisionTree("post-prune", validation=test, post_prune="full", constant_gain="exclude").fit(train, PART, "p_partkey").transform(test).select("p_partkey", "prediction")


def forest_predict(spark, sf):
    train, test = _split5(_part(spark, sf))
    return tree.RandomForest(5, pruning="pre-prune", leaf_size=0.1, constant_gain="exclude").fit(train, PART, "p_partkey").transform(test).select("p_partkey", "prediction")


def nn_forward(spark, sf):
    net = neural.Network([neural.Dense(2, "relu", [[0.5, -0.25], [0.1, 0.3]], [0.1, -0.2]), neural.Dense(2, "softmax", [[1.0, -1.0], [0.5, 0.25]], [0.0, 0.1])])
    df = _part(spark, sf).select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"))
    return df.select("p_partkey", net.column(F.array("a", "b")).alias("o")).select("p_partkey", F.round(F.col("o")[0], 6).alias("y0"), F.round(F.col("o")[1], 6).alias("y1"))


def nn_sgd_step(spark, sf):
    """One step of gradient descent over all rows from fixed weights: the parameters after it."""
    net = neural.Network([neural.Dense(2, "tanh", [[0.5, -0.25], [0.1, 0.3]], [0.1, -0.2]), neural.Dense(1, "linear", [[1.0, -1.0]], [0.05])])
    rows = _part(spark, sf).select(F.array(F.col("p_size") / 50, F.col("p_retailprice") / 2000).alias("_x"), F.array((F.col("p_partkey") % 10) / 10.0).alias("_y"))
    net.apply(neural.partial_gradients(rows, net), neural.SGD(0.5), 1)
    got = [(k, i, j, float(w)) for k, layer in enumerate(net.layers) for i in range(layer.units) for j, w in enumerate([*layer.weights[i], layer.bias[i]])]
    return spark.createDataFrame(got, "layer int, unit int, input int, value double").select("layer", "unit", "input", _r("value", 8))


def nn_train(spark, sf):
    df = _t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("class"))
    m = neural.NeuralNetwork([neural.Input(64), neural.Dense(16, "relu"), neural.Dense(10, "softmax")], batch_size=64, epochs=3, optimizer=neural.Adam(0.01)).fit(df, DatasetSpec("e", "classification"), "vec_id")
    return m.transform(df).select("vec_id", "prediction")


def _cv(spark, sf, factory):
    plan = split.cv_plan(_part(spark, sf), PART, "kx2", 2, "p_partkey", 3)
    return crossval.cross_validate({"part": plan}, {"part": PART}, factory, "p_partkey").select("dataset", "metric", _r("value"))


def cross_validate_null(spark, sf):
    return _cv(spark, sf, models.NullModel)


def cross_validate_knn(spark, sf):
    return _cv(spark, sf, lambda: knn.KNN(5))


QUERIES = {f.__name__: f for f in (
    standardize, min_max_scale, discretize_equal_width, discretize_equal_freq, discretize_quantile, impute, one_hot, ordinal_encode, encode_categorical, preprocess_pipeline, random_split, stratified_split, kfold_plan, kx2_plan, bootstrap, minibatch_sample,
    binary_metrics, regression_metrics, null_class, null_reg, knn_class, knn_reg, knn_embed, knn_nominal, vdm_matrix, edited_knn, condensed_knn, entropy, info_gain, info_gain_nominal, best_threshold, tree_stump, tree_nominal, forest_stump, tree_predict, tree_prune, forest_predict, nn_forward, nn_sgd_step, nn_train, cross_validate_null, cross_validate_knn)}

_HOLES = "select o_orderkey, case when o_orderkey % 7 = 0 then '?' else o_orderstatus end as s, case when o_orderkey % 11 = 0 then null else o_totalprice end as t, o_orderpriority as p from orders"
_FILLED = f"with h as ({_HOLES}), m as (select s from h where s <> '?' group by s order by count(*) desc, s limit 1), f as (select o_orderkey, case when h.s = '?' then m.s else h.s end as s, round(coalesce(t, (select avg(t) from h)), 2) as t, p from h, m) "
_RANK = "row_number() over ({by}order by md5('{seed}:' || p_partkey), p_partkey) - 1"
_MEAN5 = "select q.p_partkey, c.p_partkey as id, {y} as y, round(sqrt({d}), 9) as d from part q join part c on q.p_partkey % 5 = 0 and c.p_partkey % 5 <> 0"
_VOTE = "select {id}, prediction from (select {id}, y as prediction, row_number() over (partition by {id} order by count(*) desc, y) as r from k group by {id}, y) where r = 1"


def _quota(name: str, source: str, seed: str, fracs: list[float], by: str = "", keep: str = "p_partkey") -> str:
    """SQL of split()."""
    cut = " + ".join
    whens = " ".join(f"when r < {cut(f'floor(n * {f})' for f in fracs[: i + 1])} then {i}" for i in range(len(fracs)))
    over = f"partition by {by} " if by else ""
    return f"select {keep}, (case {whens} else ('0x' || substr(md5('{seed}:surplus:' || p_partkey), 1, 8))::bigint % {len(fracs)} end)::int as {name} from (select *, {_RANK.format(by=over, seed=seed)} as r, count(*) over ({over}) as n from {source})"


_VAL = "with base as (select p_partkey, p_type as class from part), v as (" + _quota("val", "base", "3:validation", [0.8, 0.2], "class", "p_partkey, class") + "), tr as (select p_partkey, class from v where val = 0) "
_EMPTY = "select p_partkey, class, -1 as rep, 0 as side from v where val = 1 "


def _reps(k: int) -> str:
    return " union all ".join(f"select p_partkey, class, {r} as rep, side from (" + _quota("side", "tr", f"3:{r}", [0.5] * 2, "class", "p_partkey, class") + ")" for r in range(k))


def _gains(long: str, classes: bool = True) -> str:
    """CTEs: ``best``(g, a, whole, n, gain, threshold, vals) of each attribute a of each group g of long(g, a, v double, s, y, w); numeric where v is not null."""
    entropy = lambda x: f"coalesce(log2(sum({x})) - sum(case when {x} > 0 then {x} * log2({x}) end) / nullif(sum({x}), 0), 0)"
    if classes:
        return f"""lg as ({long}), cl as (select distinct y from lg), hist as (select g, a, v, s, y, sum(w)::double as c from lg group by all),
        vals as (select distinct g, a, v from hist where v is not null),
        cum as (select g, a, v, y, sum(c) over (partition by g, a, y order by v) as u, sum(c) over (partition by g, a, y) as t
                from (select vals.g, vals.a, vals.v, cl.y, coalesce(hist.c, 0) as c from vals cross join cl left join hist on hist.g = vals.g and hist.a = vals.a and hist.v = vals.v and hist.y = cl.y)),
        cut as (select g, a, v, sum(u) as un, sum(t) as tn, round({entropy("u")}, 12) as hl, round({entropy("(t - u)")}, 12) as hr, round({entropy("t")}, 12) as whole from cum group by g, a, v),
        nom as (select g, a, s, sum(c) as sn, round({entropy("c")}, 12) as h from hist where s is not null group by g, a, s),
        tot as (select g, a, sum(c) as n, round({entropy("c")}, 12) as whole from (select g, a, y, sum(c) as c from hist where s is not null group by g, a, y) group by g, a),"""  + _CHOICE
    return f"""lg as ({long}), hist as (select g, a, v, sum(w)::double as c, sum(w * y) as q1, sum(w * y * y) as q2 from lg group by all),
        cum as (select g, a, v, sum(c) over o as un, sum(q1) over o as u1, sum(q2) over o as u2, sum(c) over p as tn, sum(q1) over p as t1, sum(q2) over p as t2 from hist window o as (partition by g, a order by v), p as (partition by g, a)),
        cut as (select g, a, v, un, tn, greatest(u2 / un - (u1 / un) * (u1 / un), 0) as hl, case when tn > un then greatest((t2 - u2) / (tn - un) - ((t1 - u1) / (tn - un)) * ((t1 - u1) / (tn - un)), 0) else 0 end as hr,
                greatest(t2 / tn - (t1 / tn) * (t1 / tn), 0) as whole from cum),
        nom as (select 0 as g, 0 as a, '' as s, 0.0::double as sn, 0.0::double as h where false), tot as (select 0 as g, 0 as a, 0.0::double as n, 0.0::double as whole where false),""" + _CHOICE


_CHOICE = """
        nxt as (select *, lead(v) over (partition by g, a order by v) as nv from cut),
        thr as (select *, round((un * hl + (tn - un) * hr) / tn, 12) as imp, (v + nv) / 2 as mid from nxt),
        best as (select g, a, max(whole) as whole, max(tn) as n, round(max(whole) - coalesce(min(imp) filter (where nv is not null), 0), 10) as gain, arg_min(mid, struct_pack(i := imp, m := mid)) filter (where nv is not null) as threshold, count(*) as vals from thr group by g, a
                 union all select tot.g, tot.a, any_value(tot.whole), any_value(tot.n), round(any_value(tot.whole) - sum(nom.sn / tot.n * nom.h), 10), null, count(*) from nom join tot on tot.g = nom.g and tot.a = nom.a group by tot.g, tot.a)"""

_TRAIN = "select p_partkey as id, p_partkey % 5 = 0 as test, p_size::double as x0, p_retailprice as x1, p_type as y from part"


def _grown(rows: str, levels: int, min_rows: str = "0", attributes: int = 2, classes: bool = True) -> str:
    """CTEs of growing trees: ``st0``(tree, id, test, x0, x1, y, w, node) to the state after ``levels`` levels, and ``st`` of all with lvl.

    Test rows go along with weight 0. A node's name is its path. Constant attributes are no candidates; an impurity of at most 0.001 or a
    weight under ``min_rows`` makes a leaf.
    """
    out = [f"st0 as materialized ({rows})"]
    for k in range(levels):
        union = " union all ".join(f"select (tree, node) as g, {a} as a, x{a} as v, null::varchar as s, y, w from st{k} where w > 0" for a in range(attributes))
        inner = f"(with {_gains(union, classes)} select g, arg_max(struct_pack(a := a, threshold := threshold), struct_pack(gain := gain, a := -a)) as pick from best where vals > 1 and whole > 0.001 and n >= {min_rows} group by g)"
        pick = "case s.pick.a " + " ".join(f"when {a} then x{a}" for a in range(attributes)) + " end"
        out.append(f"sp{k} as materialized {inner}, st{k + 1} as materialized (select t.* exclude (node), node || case when {pick} <= s.pick.threshold then 'L' else 'R' end as node from st{k} t join sp{k} s on (t.tree, t.node) = s.g)")
    out.append("st as (" + " union all ".join(f"select {k} as lvl, * from st{k}" for k in range(levels + 1)) + ")")
    if classes:
        out.append("says as (select tree, node, lvl, arg_max(y, struct_pack(c := c, y := -r)) as pred from (select *, dense_rank() over (order by y) as r from (select tree, node, lvl, y, sum(w) as c from st group by all) where c > 0) group by all)")
    else:
        out.append("says as (select tree, node, lvl, sum(w * y) / sum(w) as pred from st group by all)")
    return ", ".join(out)


#: Levels that the SQL of whole trees is written out to: more than they have on the table of scale 0.01.
_LEVELS = 40
_LAST = "select id, tree, pred from st join says using (tree, node, lvl) where test qualify row_number() over (partition by tree, id order by lvl desc) = 1"
_DRAWN = """select d.tree, t.id, t.test, t.x0, t.x1, t.{y} as y, d.w, '' as node from base t join drawn d using (id) union all select tree, id, test, x0, x1, {y}, 0, '' from base, range({trees}) r(tree) where test"""


def _forest(trees: int, y: str) -> str:
    """CTEs ``base``, ``drawn`` and the rows of a forest on half of the training rows."""
    base = f"base as (select p_partkey as id, p_partkey % 5 = 0 as test, p_size::double as x0, p_retailprice as x1, p_type, p_retailprice - (select avg(p_retailprice) from part where p_partkey % 5 <> 0) as price from part)"
    drawn = f"p as (select id, row_number() over (order by md5('0:' || id), id) - 1 as r from base where not test), n as (select count(*) as n from p), d as (select t as tree, ('0x' || substr(md5('0:' || t || ':' || j), 1, 8))::bigint % n as r from range({trees}) a(t), n, range(1000000) b(j) where j < floor(n * 0.5)), drawn as (select tree, id, count(*) as w from d join p using (r) group by all)"
    return f"{base}, {drawn}"


def _pruned(levels: int) -> str:
    """CTEs: what each node of one tree says after full pruning by the test rows, bottom up."""
    out = ["own as (select says.node, says.lvl, says.pred, count(*) filter (where st.test and st.y <> says.pred) as leaf from says join st using (node, lvl) group by all)"]
    out.append(f"k{levels} as (select node, pred, leaf as loss, false as cut from own where lvl = {levels})")
    for k in reversed(range(levels)):
        out.append(f"k{k} as (select o.node, o.pred, case when c.kept is null then o.leaf else least(o.leaf, c.kept) end as loss, c.kept is not null and o.leaf <= c.kept as cut from own o left join (select left(node, {k}) as node, sum(loss) as kept from k{k + 1} group by 1) c on c.node = o.node where o.lvl = {k})")
    return ", ".join(out)


_EDITED = "s0 as (select s_suppkey as id, s_acctbal::double as b, (s_nationkey % 3)::varchar as y from supplier), " + ", ".join(
    f"e{k} as (select a.id, a.b, a.y from s{k} a left join s{k} c on a.id <> c.id group by all having count(c.id) = 0 or arg_min(c.y, struct_pack(d := round(sqrt((a.b - c.b) * (a.b - c.b)), 9), i := c.id)) filter (where c.id is not null) <> a.y), s{k + 1} as (select * from e{k} union all select * from s{k} where not exists (select 1 from e{k}))" for k in range(5))
ORACLES = {
    "standardize": "with s as (select avg(p_size) ma, stddev_samp(p_size) sa, avg(p_retailprice) mb, stddev_samp(p_retailprice) sb from part where p_partkey % 5 <> 0) select p_partkey, round((p_size - ma) / sa, 6) as p_size, round((p_retailprice - mb) / sb, 6) as p_retailprice, p_partkey % 5 <> 0 as is_train from part, s",
    "min_max_scale": "with s as (select min(c_acctbal) l, max(c_acctbal) h from customer where c_custkey % 5 <> 0) select c_custkey, round((c_acctbal - l) / (h - l), 6) as c_acctbal from customer, s",
    "discretize_equal_width": "with s as (select min(o_totalprice) l, (max(o_totalprice) - min(o_totalprice)) / 10 w from orders) select o_orderkey, least(greatest(round(((o_totalprice - l) - (o_totalprice - l) % w) / w) + 1, 1), 10)::int as o_totalprice from orders, s",
    "discretize_equal_freq": "select p_partkey, least(greatest(floor((rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 - 1) / 10) + 1, 1), 10)::int as p_size from part",
    "impute": _FILLED + "select o_orderkey, s as o_orderstatus, t as o_totalprice from f",
    "one_hot": "select o_orderkey, (o_orderstatus = 'O')::int as \"o_orderstatus_O\", (o_orderstatus = 'P')::int as \"o_orderstatus_P\" from orders",
    "encode_categorical": "select o_orderkey, (o_orderstatus = 'O')::int as \"o_orderstatus_O\", (o_orderstatus = 'P')::int as \"o_orderstatus_P\", list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority)::bigint as o_orderpriority from orders",
    "ordinal_encode": "select o_orderkey, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority)::bigint as o_orderpriority from orders",
    "preprocess_pipeline": _FILLED + "select o_orderkey, t as o_totalprice, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], p)::bigint as o_orderpriority, (s = 'O')::int as \"o_orderstatus_O\", (s = 'P')::int as \"o_orderstatus_P\" from f",
    "random_split": _quota("partition", "part", "7", [0.5, 0.3, 0.2]),
    "stratified_split": _quota("partition", "(select p_partkey, p_type as class from part)", "7", [0.2] * 5, "class", "p_partkey, class"),
    "kfold_plan": _VAL + _EMPTY + "union all select p_partkey, class, 0, side from (" + _quota("side", "tr", "3:0", [0.2] * 5, "class", "p_partkey, class") + ")",
    "kx2_plan": _VAL + _EMPTY + "union all " + _reps(3),
    "bootstrap": "with p as (select p_partkey, " + _RANK.format(by="", seed=1) + " as r, count(*) over () as n from part), d as (select t as tree_id, ('0x' || substr(md5('1:' || t || ':' || j), 1, 8))::bigint % n as r from range(5) a(t), (select count(*) as n from part), range(100000) b(j) where j < floor(n * 0.5)) select tree_id, p_partkey, count(*) as weight from d join p using (r) group by all",
    "minibatch_sample": "select p_partkey from part order by md5('5:0:' || p_partkey), p_partkey limit 32",
    "binary_metrics": "with c as (select count(*) n, count_if(quality = toxic) s, count_if(toxic = 1 and quality = 1) tp, count_if(toxic = 1 and quality <> 1) fp, count_if(toxic <> 1 and quality <> 0) fn from labels) select round(s / n, 6) as acc, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from c",
    "regression_metrics": "with c as (select p_retailprice a, p_size * 20.0::double + 900 p from part) select round(avg((p - a) * (p - a)), 4) as mse, round(avg(abs(p - a)), 4) as mae, round(1 - sum((a - p) * (a - p)) / (count(*) * var_pop(a)), 4) as r2, round(corr(a, p), 4) as pearson from c",
    "null_class": "select p_partkey, (select p_type from part group by 1 order by count(*) desc, 1 limit 1) as prediction from part",
    "null_reg": "select o_orderkey, round((select avg(o_totalprice) from orders), 4) as prediction from orders",
    "knn_class": "with n as (" + _MEAN5.format(y="c.p_type", d="(q.p_size - c.p_size) * (q.p_size - c.p_size) + (q.p_retailprice - c.p_retailprice) * (q.p_retailprice - c.p_retailprice)") + "), k as (select * from n qualify row_number() over (partition by p_partkey order by d, id) <= 5) " + _VOTE.format(id="p_partkey"),
    "knn_reg": "with n as (" + _MEAN5.format(y="c.p_retailprice", d="(q.p_size - c.p_size) * (q.p_size - c.p_size)") + "), k as (select * from n qualify row_number() over (partition by p_partkey order by d, id) <= 5), g as (select 1 / stddev_samp(p_retailprice) as g from part where p_partkey % 5 <> 0) select p_partkey, round(sum(exp(-g * d) * y) / sum(exp(-g * d)), 4) as prediction from k, g group by 1",
    "knn_embed": "with n as (select q.vec_id, c.vec_id as id, c.label::varchar as y, round(list_distance(q.embedding::double[], c.embedding::double[]), 9) as d from embeddings q join embeddings c on q.vec_id % 5 = 0 and c.vec_id % 5 <> 0), k as (select * from n qualify row_number() over (partition by vec_id order by d, id) <= 5) " + _VOTE.format(id="vec_id"),
    "knn_nominal": """
with r as (select p_partkey as id, p_brand as b, p_size / 50 as s, p_type as y, p_partkey % 5 = 0 as test from part), c as (select b, y, count(*) as n from r where not test group by all), sh as (select b, y, n / sum(n) over (partition by b) as p from c),
f as (select vs.b, ks.y, coalesce(p, 0) as p from (select distinct b from r) vs cross join (select distinct y from c) ks left join sh on sh.b = vs.b and sh.y = ks.y), v as (select a.b as b1, d.b as b2, sum((a.p - d.p) * (a.p - d.p)) as sq from f a join f d using (y) group by all),
n as (select q.id, t.id as tid, t.y, round(sqrt(sq + (q.s - t.s) * (q.s - t.s)), 9) as d from r q join r t on q.test and not t.test join v on b1 = q.b and b2 = t.b), k as (select * from n qualify row_number() over (partition by id order by d, tid) <= 3)
select id as p_partkey, y as prediction from (select id, y, count(*) as c from k group by all) qualify row_number() over (partition by id order by c desc, y) = 1""",
    "tree_nominal": """
with r as (select p_partkey as id, p_brand as b, p_type as y, p_partkey % 5 = 0 as test from part), c as (select b, y, count(*) as n from r where not test group by all), m as (select b, y from c qualify row_number() over (partition by b order by n desc, y) = 1),
top as (select y from c group by y order by sum(n) desc, y limit 1) select id as p_partkey, coalesce(m.y, (select y from top)) as prediction from r left join m using (b) where test""",
    "vdm_matrix": "with c as (select o_orderstatus v, o_orderpriority k, count(*) n from orders group by all), p as (select v, k, n / sum(n) over (partition by v) as p from c), f as (select vs.v, ks.k, coalesce(p, 0) as p from (select distinct v from c) vs cross join (select distinct k from c) ks left join p on p.v = vs.v and p.k = ks.k) select a.v as v1, b.v as v2, round(sum((a.p - b.p) * (a.p - b.p)), 9) as vdm_sq from f a join f b using (k) group by all",
    "nn_forward": "with x as (select p_partkey, p_size / 50.0::double a, p_retailprice / 2000 b from part), h as (select p_partkey, greatest(0.5::double * a - 0.25::double * b + 0.1::double, 0) h0, greatest(0.1::double * a + 0.3::double * b - 0.2::double, 0) h1 from x), z as (select p_partkey, h0 - h1 z0, 0.5::double * h0 + 0.25::double * h1 + 0.1::double z1 from h) select p_partkey, round(exp(z0) / (exp(z0) + exp(z1)), 6) as y0, round(exp(z1) / (exp(z0) + exp(z1)), 6) as y1 from z",
    "discretize_quantile": "select o_orderkey, least(greatest(floor((rank() over (order by o_totalprice) - 1) * 7 / (select count(*) from orders)) + 1, 1), 7)::int as o_totalprice from orders",
    "entropy": "select 'p_type' as target, round(-sum(p * log2(p)), 4) as impurity from (select count(*) / sum(count(*)) over () as p from part group by p_type) union all select 'p_retailprice', round(var_pop(p_retailprice), 4) from part",
    "info_gain": "with " + _gains("select 0 as g, 0 as a, p_size::double as v, null as s, p_type as y, 1 as w from part union all select 0, 1, p_retailprice, null, p_type, 1 from part union all select 0, 2, null, left(p_type, 1), p_type, 1 from part") + " select ['p_size', 'p_retailprice', 'brand'][a + 1] as attribute, round(whole, 6) as entropy, round(gain, 6) as gain, round(threshold, 3) as threshold from best",
    "info_gain_nominal": "with " + _gains("select 0 as g, 0 as a, null::double as v, o_orderpriority as s, o_orderstatus as y, 1 as w from orders union all select 0, 1, null, strftime(o_orderdate, '%m'), o_orderstatus, 1 from orders") + " select ['o_orderpriority', 'month'][a + 1] as attribute, round(gain, 8) as gain from best",
    "best_threshold": "with " + _gains("select 0 as g, 0 as a, l_quantity::double as v, null::varchar as s, l_returnflag as y, 1 as w from lineitem union all select 0, 1, l_discount * 100, null, l_returnflag, 1 from lineitem") + " select ['l_quantity', 'l_discount'][a + 1] as attribute, round(gain, 8) as gain, round(threshold, 6) as threshold from best",
    "tree_stump": f"with base as ({_TRAIN}), " + _grown("select 0 as tree, *, case when test then 0 else 1 end as w, '' as node from base", 1) + f" select id as p_partkey, pred as prediction from ({_LAST})",
    "forest_stump": "with " + _forest(3, "price") + ", " + _grown(_DRAWN.format(trees=3, y="price"), 1, attributes=1, classes=False) + f" select id as p_partkey, round(avg(pred) + (select avg(p_retailprice) from part where p_partkey % 5 <> 0), 4) as prediction from ({_LAST}) group by id",
    "tree_predict": f"with base as ({_TRAIN}), " + _grown("select 0 as tree, *, case when test then 0 else 1 end as w, '' as node from base", _LEVELS, "0.05 * (select count(*) from part where p_partkey % 5 <> 0)") + f" select id as p_partkey, pred as prediction from ({_LAST})",
    "tree_prune": f"with base as ({_TRAIN}), " + _grown("select 0 as tree, *, case when test then 0 else 1 end as w, '' as node from base", _LEVELS) + ", " + _pruned(_LEVELS) + ", k as (" + " union all ".join(f"select *, {k} as lvl from k{k}" for k in range(_LEVELS + 1)) + ") select st.id as p_partkey, arg_min(k.pred, case when k.cut then st.lvl else 100 - st.lvl end) as prediction from st join k using (node, lvl) where st.test group by st.id",
    "forest_predict": "with " + _forest(5, "p_type") + ", " + _grown(_DRAWN.format(trees=5, y="p_type"), _LEVELS, "0.1 * floor((select count(*) from part where p_partkey % 5 <> 0) * 0.5)") + f" select id as p_partkey, pred as prediction from (select id, pred, count(*) as c from ({_LAST}) group by all) qualify row_number() over (partition by id order by c desc, pred) = 1",
    "edited_knn": f"with {_EDITED} select id as s_suppkey, y as class from s5",
    "condensed_knn": "with recursive r as (select row_number() over (order by s_suppkey) - 1 as i, s_suppkey, s_acctbal::double as b, (s_nationkey % 3)::varchar as y from supplier), n as (select count(*) as n from r), st as (select 0::bigint as step, [0]::bigint[] as kept union all select step + 1, case when list_contains(kept, x.i) or (select arg_min(k.y, struct_pack(d := round(sqrt((k.b - x.b) * (k.b - x.b)), 9), i := k.i)) from r k where list_contains(st.kept, k.i)) = x.y then kept else list_append(kept, x.i) end from st, n, r x where step < 5 * n and x.i = step % n) select s_suppkey, y as class from r where list_contains((select arg_max(kept, step) from st), i)",
    "cross_validate_null": _VAL + ", r as (" + _reps(2) + "), c as (select rep, side, class, count(*) as n from r group by all), m as (select rep, 1 - side as side, arg_max(class, struct_pack(n := n, k := -rk)) as pred from (select *, dense_rank() over (order by class) as rk from c) group by all), a as (select rep, side, avg((class = pred)::int) as acc from r join m using (rep, side) group by all) select 'part' as dataset, 'acc' as metric, round(avg(acc), 6) as value from a",
    "cross_validate_knn": _VAL + ", r as (select r.*, p_size::double as x, p_retailprice as z from (" + _reps(2) + ") r join part using (p_partkey)), s as (select rep, 1 - side as side, avg(x) as mx, stddev_samp(x) as sx, avg(z) as mz, stddev_samp(z) as sz from r group by all), q as (select t.rep, t.side, t.p_partkey as id, t.class, c.class as y, row_number() over (partition by t.rep, t.p_partkey order by round(sqrt(pow((t.x - mx) / sx - (c.x - mx) / sx, 2) + pow((t.z - mz) / sz - (c.z - mz) / sz, 2)), 9), c.p_partkey) as k from r t join s on s.rep = t.rep and s.side = t.side join r c on c.rep = t.rep and c.side <> t.side), votes as (select rep, side, id, class, y, count(*) as n from q where k <= 5 group by all), p as (select * from votes qualify row_number() over (partition by rep, side, id order by n desc, y) = 1) select 'part' as dataset, 'acc' as metric, round(avg(acc), 6) as value from (select avg((class = y)::int) as acc from p group by rep, side)",
    "nn_sgd_step": "with x as (select p_size / 50.0::double as a, p_retailprice / 2000 as b, (p_partkey % 10) / 10.0::double as y from part), h as (select *, tanh(0.5::double * a - 0.25::double * b + 0.1::double) as h0, tanh(0.1::double * a + 0.3::double * b - 0.2::double) as h1 from x), d as (select *, h0 - h1 + 0.05::double - y as e from h), z as (select *, e * (1 - h0 * h0) as z0, -e * (1 - h1 * h1) as z1 from d), g as (select avg(z0 * a) / 2 as w00, avg(z0 * b) / 2 as w01, avg(z0) as b0, avg(z1 * a) / 2 as w10, avg(z1 * b) / 2 as w11, avg(z1) as b1, avg(e * h0) as v0, avg(e * h1) as v1, avg(e) as c from z) select layer, unit, input, round(start - 0.5::double * step, 8) as value from g, lateral (values (0, 0, 0, 0.5::double, w00), (0, 0, 1, -0.25, w01), (0, 0, 2, 0.1, b0), (0, 1, 0, 0.1, w10), (0, 1, 1, 0.3, w11), (0, 1, 2, -0.2, b1), (1, 0, 0, 1.0, v0), (1, 0, 1, -1.0, v1), (1, 0, 2, 0.05, c)) t(layer, unit, input, start, step)",
}
