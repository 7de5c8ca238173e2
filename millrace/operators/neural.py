"""Feed-forward neural networks: layers and optimizers on the driver, rows in Spark."""

from __future__ import annotations

import abc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain_hash_key
from ..plans.durable import durable
from ..sources import DatasetSpec
from .metrics import compute_metrics
from .models import FittedModel, Model
from .split import minibatches, ranked

#: Training values (rows times features), and rows, that are held in the driver. Of a larger set a task holds batches of no more than so
#: many and takes their steps; the gradient of a larger batch is added up in Spark. Batches are the same either way.
LOCAL_VALUES, LOCAL_ROWS = 2_000_000, 50_000


def _softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _sigmoid(z):
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


ACTIVATIONS = {"linear": lambda z: z, "relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "sigmoid": _sigmoid, "softmax": _softmax}
#: Slopes from outputs. Softmax has a(1 - a) as the followed definition has it; ``exact_gradient`` leaves it out for the last layer.
SLOPES = {"linear": np.ones_like, "relu": lambda a: (a > 0).astype(float), "tanh": lambda a: 1 - a * a, "sigmoid": lambda a: a * (1 - a), "softmax": lambda a: a * (1 - a)}


class Layer:
    """forward and backward take whole batches, one row each."""

    def build(self, width: int, rng: np.random.Generator) -> int:
        return width

    def forward(self, x: np.ndarray, training: bool = False) -> np.ndarray:
        raise NotImplementedError

    def backward(self, da: np.ndarray, x: np.ndarray, a: np.ndarray, slope: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """The derivative by the layer's input, and the mean updates (weights, bias) over the batch."""
        raise NotImplementedError

    def start_batch(self, rng: np.random.Generator) -> None:
        pass

    def update(self, steps: list[np.ndarray]) -> None:
        pass


class Input(Layer):
    def __init__(self, width: int):
        self.width = width

    def build(self, width, rng):
        if width != self.width:
            raise ValueError(f"{width} features do not fit an input of {self.width}")
        return width

    def forward(self, x, training=False):
        return x

    def backward(self, da, x, a, slope=True):
        return da, []


class Dense(Layer):
    def __init__(self, units: int, activation: str = "linear", weights=None, bias=None):
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation!r}")
        self.units, self.activation = units, activation
        self.weights = None if weights is None else np.array(weights, float)
        self.bias = None if bias is None else np.array(bias, float)

    def build(self, width, rng):
        """He-uniform for relu, Xavier-uniform for tanh and sigmoid, standard normal otherwise; bias 0."""
        if self.weights is None:
            shape = (self.units, width)
            if self.activation == "relu":
                self.weights = rng.uniform(-1, 1, shape) * np.sqrt(6 / width)
            elif self.activation in ("tanh", "sigmoid"):
                self.weights = rng.uniform(-1, 1, shape) * np.sqrt(6 / (width + self.units))
            else:
                self.weights = rng.normal(size=shape)
        if self.weights.shape != (self.units, width):
            raise ValueError(f"weights {self.weights.shape} do not fit ({self.units}, {width})")
        self.bias = np.zeros(self.units) if self.bias is None else self.bias
        return self.units

    def forward(self, x, training=False):
        return ACTIVATIONS[self.activation](x @ self.weights.T + self.bias)

    def backward(self, da, x, a, slope=True):
        """The weights' update is divided by the layer's width, the bias' is not."""
        dz = da * SLOPES[self.activation](a) if slope else da
        return dz @ self.weights, [-(dz.T @ x) / len(x) / self.units, -dz.mean(0)]

    def update(self, steps):
        self.weights, self.bias = self.weights + steps[0], self.bias + steps[1]


class Dropout(Layer):
    """One mask per batch; kept nodes are scaled up by the share that is dropped. Identity outside training."""

    def __init__(self, rate: float):
        self.rate, self.mask = rate, None

    def build(self, width, rng):
        self.width = width
        if round(width * self.rate) >= width:
            raise ValueError("dropout would drop every node")
        return width

    def start_batch(self, rng):
        self.mask = rng.binomial(1, 1 - self.rate, self.width).astype(float)

    def forward(self, x, training=False):
        if not training:
            return x
        if self.mask is None:
            raise RuntimeError("start_batch comes first")
        return x * self.mask / (1 - round(self.width * self.rate) / self.width)

    def backward(self, da, x, a, slope=True):
        return da * self.mask, []


class Optimizer(abc.ABC):
    @abc.abstractmethod
    def steps(self, key: int, deltas: list[np.ndarray], t: int) -> list[np.ndarray]:
        """What is added to the parameters of layer ``key`` in step ``t`` (from 1), by the mean updates of the batch."""


class SGD(Optimizer):
    def __init__(self, rate: float = 0.001):
        self.rate = rate

    def steps(self, key, deltas, t):
        return [self.rate * d for d in deltas]


class Adam(Optimizer):
    """Without ``carry_moments`` moments start at zero in every step, as the followed definition in effect does."""

    def __init__(self, rate: float = 0.0001, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8, carry_moments: bool = False):
        self.rate, self.beta1, self.beta2, self.epsilon, self.carry = rate, beta1, beta2, epsilon, carry_moments
        self.moments: dict = {}

    def steps(self, key, deltas, t):
        out = []
        for i, d in enumerate(deltas):
            m, v = self.moments.get((key, i), (0.0, 0.0)) if self.carry else (0.0, 0.0)
            m, v = self.beta1 * m + (1 - self.beta1) * d, self.beta2 * v + (1 - self.beta2) * d * d
            self.moments[key, i] = m, v
            out.append(self.rate * (m / (1 - self.beta1**t)) / (np.sqrt(v / (1 - self.beta2**t)) + self.epsilon))
        return out


class Network:
    def __init__(self, layers: list[Layer], exact_gradient: bool = False):
        self.layers, self.exact = layers, exact_gradient

    def build(self, width: int, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        for layer in self.layers:
            width = layer.build(width, rng)
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[list[np.ndarray]]:
        """Mean updates of every layer; the last layer starts from output minus target."""
        outs = [x]
        for layer in self.layers:
            outs.append(layer.forward(outs[-1], True))
        d, got = outs[-1] - y, []
        for i in reversed(range(len(self.layers))):
            d, g = self.layers[i].backward(d, outs[i], outs[i + 1], not (self.exact and i == len(self.layers) - 1))
            got.append(g)
        return got[::-1]

    def start_batch(self, rng) -> None:
        for layer in self.layers:
            layer.start_batch(rng)

    def apply(self, gradients: list[list[np.ndarray]], optimizer: Optimizer, t: int) -> None:
        for i, (layer, g) in enumerate(zip(self.layers, gradients, strict=True)):
            if g:
                layer.update(optimizer.steps(i, g, t))

    def column(self, x: Column) -> Column:
        """The forward pass as a column expression, for small networks."""
        act = {"linear": lambda z: z, "relu": lambda z: F.greatest(z, F.lit(0.0)), "tanh": F.tanh, "sigmoid": lambda z: 1 / (1 + F.exp(-z))}
        for layer in self.layers:
            if isinstance(layer, Dense):
                z = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(float(b)) for w, b in zip(layer.weights, layer.bias, strict=True)]
                if layer.activation == "softmax":
                    x = _softmax_column(F.array(*z))
                else:
                    x = F.array(*[act[layer.activation](v) for v in z])
        return x


def _softmax_column(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))


@dataclass
class FittedNetwork(FittedModel):
    spec: DatasetSpec
    network: Network
    features: list[str]
    classes: list[str] | None
    history: list[tuple[int, str, str, float]]

    def history_table(self, spark) -> DataFrame:
        """(epoch, split, metric, value): the metrics after each epoch on the rows of training and, if given, of validation."""
        return spark.createDataFrame(self.history, "epoch int, split string, metric string, value double")

    def transform(self, df):
        """Adds the prediction over Arrow batches; all columns pass through."""
        kind = "string" if self.classes else "double"
        sent = df.sparkSession.sparkContext.broadcast((self.network, self.classes))

        @F.pandas_udf(kind)
        def run(x):
            network, classes = sent.value
            if not len(x):
                return x.astype(object)
            out = network.forward(np.array(x.tolist(), float))
            import pandas as pd

            return pd.Series([classes[i] for i in out.argmax(1)] if classes else out[:, 0])

        return df.withColumn("prediction", run(inputs(df, self.features)))


def inputs(df: DataFrame, features: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.concat(*[F.transform(F.col(f"`{c}`"), lambda v: v.cast("double")) if kinds[c].startswith("array") else F.array(F.col(f"`{c}`").cast("double")) for c in features])


class NeuralNetwork(Model):
    """Mini-batch training: each epoch has ceil(n / batch_size) batches, drawn by hash order, independently of one another.

    The first layer is Input. With ``verbose`` the spec's metrics are taken after each epoch, without dropout, on all training rows
    and on the rows of ``validation``. A network of another fit is not touched: layers are built anew by the seed.
    """

    def __init__(self, layers: list[Layer], batch_size: int = 32, epochs: int = 100, optimizer: Optimizer | None = None, exact_gradient: bool = False, seed: int = 0, verbose: bool = False, validation: DataFrame | None = None):
        if not layers or not isinstance(layers[0], Input):
            raise ValueError("the first layer must be an Input")
        self.layers, self.batch_size, self.epochs, self.optimizer, self.exact, self.seed, self.verbose, self.validation = layers, batch_size, epochs, optimizer or SGD(), exact_gradient, seed, verbose, validation

    def fit(self, df, spec, id_col="row_id"):
        features = spec.features(df.columns, id_col)
        y = F.col(f"`{spec.target}`")
        rows = df.select(F.col(id_col).alias("_id"), inputs(df, features).alias("_x"), (y.cast("string") if spec.task == "classification" else y.cast("double")).alias("_y"))
        n, width = rows.agg(F.count("*"), F.max(F.size("_x"))).first()
        if not n or self.batch_size > n:
            raise ValueError(f"a batch of {self.batch_size} needs as many rows; there are {n}")
        classes = None
        if spec.task == "classification":
            classes = [r["_y"] for r in rows.groupBy("_y").agg(F.min("_id").alias("i")).orderBy("i", "_y").collect()]
        net, rng = Network(self.layers, self.exact).build(width, self.seed), np.random.default_rng(self.seed)
        advance = self.advance_of(net, rng, rows, classes, n, width)
        fitted, steps = FittedNetwork(spec, net, features, classes, []), -(-n // self.batch_size)
        for epoch in range(self.epochs):
            advance(epoch * steps + 1, (epoch + 1) * steps)
            if self.verbose:
                for name, part in (("train", df), ("validation", self.validation)):
                    if part is not None:
                        got = compute_metrics(fitted.transform(part), spec.target, "prediction", spec.metrics, spec.positive_class, spec.negative_class).first()
                        fitted.history += [(epoch, name, m, got[m]) for m in spec.metrics]
        return fitted

    def advance_of(self, net: Network, rng: np.random.Generator, rows: DataFrame, classes: list[str] | None, n: int, width: int):
        """A function that takes the steps from one number to another; the batch of a step is the rows of the least hashes of (seed, step, id)."""
        at = {c: i for i, c in enumerate(classes or [])}

        def arrays(got) -> tuple[np.ndarray, np.ndarray]:
            x = np.array([r["_x"] for r in got], float)
            return x, np.array([[r["_y"]] for r in got], float) if classes is None else np.eye(len(classes))[[at[r["_y"]] for r in got]]

        def one_by_one(gradients):
            def advance(first: int, last: int) -> None:
                for t in range(first, last + 1):
                    net.start_batch(rng)
                    net.apply(gradients(t), self.optimizer, t)

            return advance

        if n * width <= LOCAL_VALUES and n <= LOCAL_ROWS:
            held = rows.orderBy("_id").collect()
            ids, (x, y) = [r["_id"] for r in held], arrays(held)

            def local(t: int):
                keys = [plain_hash_key(self.seed, t, i) for i in ids]
                pick = sorted(range(n), key=keys.__getitem__)[: self.batch_size]  # stable: ties by id
                return net.gradients(x[pick], y[pick])

            return one_by_one(local)
        if self.batch_size * width <= LOCAL_VALUES:
            kept = durable(rows)
            ahead = max(1, min(-(-n // self.batch_size), LOCAL_VALUES // (self.batch_size * width), LOCAL_ROWS // self.batch_size, 256))

            def advance(first: int, last: int) -> None:
                for t in range(first, last + 1, ahead):  # the batches of so many steps by one scan
                    drawn = minibatches(kept, "_id", list(range(t, min(t + ahead, last + 1))), self.batch_size, self.seed, n)
                    _stepped(drawn, net, self.optimizer, rng, arrays)

            return advance
        target = F.array("_y") if classes is None else F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: (c == F.col("_y")).cast("double"))
        ready = durable(rows.select("_id", "_x", target.alias("_y")))
        return one_by_one(lambda t: partial_gradients(ready if self.batch_size == n else ranked(ready, "_id", f"{self.seed}:{t}").filter(F.col("_rank") < self.batch_size), net))


def _stepped(drawn: DataFrame, net: Network, optimizer: Optimizer, rng: np.random.Generator, arrays) -> None:
    """Take the steps whose batches drawn(_step, _rank, _x, _y) holds: one task takes them in order, and layers, moments and random state come back."""
    state = cloudpickle.dumps((net.layers, net.exact, optimizer, rng))
    sent = drawn.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, exact, opt, draws = cloudpickle.loads(sent.value)
        own, held, at = Network(layers, exact), [], None

        def step() -> None:
            own.start_batch(draws)
            own.apply(own.gradients(*arrays(held)), opt, at)

        for batch in batches:
            for r in batch.to_pylist():
                if at is not None and r["_step"] != at:
                    step()
                    held = []
                at = r["_step"]
                held.append(r)
        if held:
            step()
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps((layers, opt, draws))], pa.binary())], names=["state"])

    ordered = drawn.select("_step", "_rank", "_x", "_y").repartition(1).sortWithinPartitions("_step", "_rank")
    layers, opt, draws = cloudpickle.loads(bytes(ordered.mapInArrow(run, "state binary").first()["state"]))
    for layer, now in zip(net.layers, layers, strict=True):
        layer.__dict__.update(now.__dict__)
    optimizer.__dict__.update(opt.__dict__)
    rng.bit_generator.state = draws.bit_generator.state
    sent.unpersist()


def partial_gradients(df: DataFrame, network: Network) -> list[list[np.ndarray]]:
    """Mean updates over all rows of df(_x array, _y array): one flat partial sum per task, added up by position in Spark."""
    sent = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x, y = (np.array(b.column(i).to_pylist(), float) for i in (0, 1))
                g = np.concatenate([a.ravel() for layer in sent.value.gradients(x, y) for a in layer]) * len(x)
                total, n = g if total is None else total + g, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.r_[n, total])], names=["i", "g"])

    got = np.array([r["g"] for r in df.select("_x", "_y").mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()])
    out, at = [], 1
    for layer in network.layers:
        shapes = [layer.weights.shape, layer.bias.shape] if isinstance(layer, Dense) else []
        part = []
        for s in shapes:
            k = int(np.prod(s))
            part.append(got[at : at + k].reshape(s) / got[0])
            at += k
        out.append(part)
    return out
