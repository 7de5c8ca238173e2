"""Quality classifier: a sparse ensemble of rules over text statistics (after Friedman and Popescu, 2008)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, durable, fresh, small_batches, table

#: Labelled rows that the model is fitted on, at most; taken by hash of the id.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, ROUNDS = 60, 3, 0.0015, 1500
#: Statistics of a text, none of them of its language, source or id.
STATS = ("chars", "words", "word_length", "upper", "digit", "other_ascii", "symbol", "symbol_words", "pipe", "exclaim", "stop", "comma", "non_ascii", "distinct_words", "distinct_lines", "line_words", "longest_word", "top_word", "upper_words", "alpha_words")
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_OTHER = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_SYMBOL = np.frombuffer(b"#$%&*@^~<>{}[]\\_=+|", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The numbers of STATS for a whole text; an empty or null one has zeros."""
    text = text or ""
    words = WORD_RE.findall(text)
    if not words:
        return [0.0] * len(STATS)
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, k = len(text), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    top = max(seen.values())
    marked = sum(c for w, c in seen.items() if not w.isalnum() and not w[:-1].isalnum())
    upper = sum(c for w, c in seen.items() if w.isupper())
    alpha = sum(c for w, c in seen.items() if w.isalpha())
    length = sum(map(len, words))
    return [
        float(np.log1p(n)), float(np.log1p(k)), length / k, data[_UPPER].sum() / n, data[_DIGIT].sum() / n, data[_OTHER].sum() / n, data[_SYMBOL].sum() / n, marked / k,
        data[124] / k, data[33] / k, data[46] / k, data[44] / k, data[128:].sum() / n, len(seen) / k, len(set(lines)) / max(1, len(lines)), float(np.log1p(k / max(1, len(lines)))),
        float(np.log1p(max(map(len, seen)))), top / k, upper / k, alpha / k]


def stats_column(text: Column) -> Column:
    """STATS as a struct of doubles, computed over Arrow batches."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=list(STATS), dtype="float64")

    return run(text)


@dataclass
class Rules:
    """score = logistic(bias + sum of the weights of the rules that hold); a rule is a conjunction of (statistic, above, threshold)."""

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def column(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, above, t in rule:
                x = stats[STATS[f]]
                holds = holds & ((x > F.lit(t)) if above else (x <= F.lit(t)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * holds(x, rule)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rng: np.random.Generator, out: list) -> None:
    """Add the paths to all nodes of a random small tree that splits by the Gini criterion."""
    p = y[rows].mean()
    if not depth or len(rows) < 10 or p in (0.0, 1.0):
        return
    best = None
    for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
        v = x[rows, f]
        for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
            left = v <= t
            n = left.sum()
            if 3 <= n <= len(rows) - 3:
                a, b = y[rows][left].mean(), y[rows][~left].mean()
                g = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
                if best is None or g < best[0]:
                    best = g, int(f), float(t), left
    if best is None or best[0] >= len(rows) * p * (1 - p) * 0.999:
        return
    _, f, t, left = best
    for above, part in ((False, rows[left]), (True, rows[~left])):
        out.append((*path, (f, above, t)))
        _grow(x, y, part, depth - 1, out[-1], rng, out)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, rounds: int = ROUNDS, seed: int = 3) -> Rules:
    """Tree paths as rules, weighted by logistic regression with an L1 penalty (accelerated proximal gradient).

    Without labels the score is 1/2, with labels of one kind close to that label for all.
    """
    if not len(y):
        return Rules(0.0, [])
    prior = np.clip(y.mean(), 0.01, 0.99)
    bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return Rules(bias, [])
    rng = np.random.default_rng(seed)
    paths: list = []
    for _ in range(trees):
        # rarer labels are drawn as often as the others, so that trees look for both kinds
        pick = np.concatenate([rng.choice(np.flatnonzero(y == c), min(2000, max(20, int((y == c).sum() // 2)))) for c in (0, 1)])
        _grow(x, y, pick, depth, (), rng, paths)
    cover: dict[bytes, tuple] = {}
    for p in sorted(set(paths), key=lambda p: (len(p), p)):
        cover.setdefault(np.packbits(holds(x, p)).tobytes(), p)
    paths = list(cover.values())
    # rows that the same rules hold for count as one, with a weight; until then a rule takes a bit of a row
    bits = np.packbits(np.stack([holds(x, p) for p in paths], 1), axis=1)
    bits, own = np.unique(bits, axis=0, return_inverse=True)
    z = np.unpackbits(bits, axis=1, count=len(paths)).astype(float)
    n = np.bincount(own.ravel(), minlength=len(z)) / len(y)
    y = np.bincount(own.ravel(), weights=y, minlength=len(z)) / len(y)
    mean = n @ z
    z -= mean
    step = 4.0 / max(1e-9, np.linalg.eigvalsh(z.T @ (z * n[:, None]))[-1] + 1)
    w, v, b, c, m = np.zeros(z.shape[1]), np.zeros(z.shape[1]), bias, bias, 1.0
    for _ in range(rounds):
        g = n / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        nw = v - step * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * g.sum()
        nm = (1 + np.sqrt(1 + 4 * m * m)) / 2
        if max(np.abs(nw - w).max(), abs(nb - b)) < 1e-6:
            break
        v, c, w, b, m = nw + (m - 1) / nm * (nw - w), nb + (m - 1) / nm * (nb - b), nw, nb, nm
    keep = np.abs(w) > 1e-6
    return Rules(float(b - mean[keep] @ w[keep]), [(paths[i], float(w[i])) for i in np.flatnonzero(keep)])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; a null id has no remainder and is not held out, but has no label either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fit on the labelled documents outside the held-out third; labels only from there. At most ``sample`` labels, by hash of the id, are
    used; that bound also makes their broadcast safe, so that documents are read once and not shuffled.
    Of the rows that repeat an id, the one of least statistics counts."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_y"))
    known = durable(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(known), "_id")
    stats = rows.select("_id", "_y", stats_column(F.col("_text")).alias("s"))
    got = stats.groupBy("_id", "_y").agg(F.min("s").alias("s")).select("_id", "_y", "s.*").collect()
    got.sort()
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(STATS))
    return fit_rules(x, np.array([r[1] for r in got], float))


def scored(docs: DataFrame, rules: Rules, name: str = "_score") -> DataFrame:
    """``docs`` with the score as column ``name``, which docs must not have: its own columns all stay. Rules are column expressions over
    statistics of the whole text; null and empty texts are scored too."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name!r} already")
    small_batches(docs.sparkSession)
    held = fresh(docs, "_millrace_stats")
    with_stats = docs.withColumn(held, stats_column(F.col("text")))
    return with_stats.withColumn(name, rules.column(F.col(held))).drop(held)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
