"""Neural regressors for every segment at once.

One net per (segment, model size), all trained together by full-batch Adam:
a step is one job whose tasks sum the gradients of all nets over their rows,
keyed by (segment, model). The driver holds parameters only (a few thousand
numbers per net, at most ``MAX_SEGMENTS`` segments), and rows never leave
the executors, so a segment may hold any share of the rows.

Rows are scaled by their segment's training statistics and packed once into
blocks of one segment each (a written table), so a step is matrix products on
ready arrays. A net drops out of the steps when its plateau rule fires: the
step size is cut by ``lr_factor`` after ``lr_patience`` steps that don't beat the
best loss so far by ``tol``, and training stops after ``patience`` of them.

Rows without a target or a segment take no part in training; a missing feature
counts as the segment's mean. A feature that is constant in a segment's
training rows is left out of its nets. A segment without training rows
has no net and no predictions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tastemill.operators.regression import TREE_FROM, parameter_count
from tastemill.session import materialize

MAX_SEGMENTS = 1000
FEW_TASKS = 4                 # of so few, the driver adds up the gradients itself
SUMS = "segment string, model string, g binary, loss double, n long"


def unpack(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) per layer, as views of the flat parameters."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def activations(layers, x: np.ndarray) -> list[np.ndarray]:
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    return acts


def gradient(theta: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over the rows: gradient and half the squared error."""
    layers = unpack(theta, sizes)
    acts = activations(layers, x)
    delta = acts[-1] - y[:, None]
    loss = 0.5 * float(np.sum(delta * delta))
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads += [delta.sum(axis=0), (acts[i].T @ delta).ravel()]
        if i:
            delta = (delta @ layers[i][0].T) * (acts[i] > 0)
    return np.concatenate(grads[::-1]), loss


@dataclass
class Net:
    """One net's parameters and the state of its training."""

    sizes: list[int]
    theta: np.ndarray
    lr: float
    best: float = np.inf
    stale: int = 0
    since_cut: int = 0
    done: bool = False
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def __post_init__(self):
        self.m1, self.m2 = np.zeros_like(self.theta), np.zeros_like(self.theta)

    def update(self, step: int, g: np.ndarray, loss: float, rule: "SegmentNets") -> None:
        self.history.append((step, loss, self.lr))
        self.m1 = 0.9 * self.m1 + 0.1 * g
        self.m2 = 0.999 * self.m2 + 0.001 * g * g
        self.theta = self.theta - self.lr * (self.m1 / (1 - 0.9 ** step)) / (np.sqrt(self.m2 / (1 - 0.999 ** step)) + 1e-8)
        improved, self.best = loss < self.best - rule.tol, min(self.best, loss)
        if improved:
            self.stale, self.since_cut = 0, 0
            return
        self.stale, self.since_cut = self.stale + 1, self.since_cut + 1
        if self.since_cut >= rule.lr_patience:
            self.lr, self.since_cut = self.lr * rule.lr_factor, 0
        self.done = self.stale >= rule.patience


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(g) for g in pdf["g"]], axis=0)
    return pd.DataFrame({"segment": pdf["segment"][:1], "model": pdf["model"][:1], "g": [total.tobytes()],
                         "loss": [float(pdf["loss"].sum())], "n": [int(pdf["n"].sum())]})


def summed(made: DataFrame, n_parts: int) -> DataFrame:
    """Gradients of ``n_parts`` tasks added up on the executors: the driver gets
    a row per net and step, or, from few tasks, a row of each of them."""
    if n_parts > TREE_FROM:      # in groups of partitions first
        part = F.pmod(F.spark_partition_id(), F.lit(int(n_parts ** 0.5)))
        made = made.withColumn("part", part).groupBy("segment", "model", "part").applyInPandas(lambda pdf: _add(pdf), SUMS)
    if n_parts > FEW_TASKS:
        made = made.groupBy("segment", "model").applyInPandas(lambda pdf: _add(pdf), SUMS)
    return made


class SegmentNets:
    """``models``: name -> hidden layer sizes, one net of each per segment."""

    def __init__(self, models: dict[str, tuple[int, ...]], max_iter: int = 500, lr: float = 0.01, alpha: float = 1e-4,
                 seed: int = 42, tol: float = 1e-4, patience: int = 20, lr_patience: int = 5, lr_factor: float = 0.2):
        self.models, self.max_iter, self.lr, self.alpha, self.seed = models, max_iter, lr, alpha, seed
        self.tol, self.patience, self.lr_patience, self.lr_factor = tol, patience, lr_patience, lr_factor

    def _scales(self, df: DataFrame) -> None:
        """Per segment: rows, mean and deviation of target and features, used features."""
        cols = [self.label, *self.features]
        stats = (df.groupBy(F.col(self.by).cast("string").alias("segment"))
                 .agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
                      *[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(cols)]))
        rows = stats.limit(MAX_SEGMENTS + 1).collect()
        if len(rows) > MAX_SEGMENTS:
            raise ValueError(f"more than {MAX_SEGMENTS} segments: their parameters would outgrow the driver")
        self.scale = {}
        for r in rows:
            mean = np.array([r[f"m{i}"] if r[f"m{i}"] is not None else 0.0 for i in range(len(cols))])
            dev = np.array([r[f"s{i}"] or 1.0 for i in range(len(cols))])
            used = [i for i in range(len(self.features)) if r[f"v{i + 1}"]]
            self.scale[r["segment"]] = (int(r["n"]), mean, dev, used)

    def _init(self, segment: str, model: str) -> Net:
        sizes = [len(self.scale[segment][3]), *self.models[model], 1]
        rng = np.random.RandomState(self.seed)
        parts = []
        for a, b in zip(sizes[:-1], sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return Net(sizes, np.concatenate(parts), self.lr)

    def _inputs(self, pdf: pd.DataFrame, segment: str) -> np.ndarray:
        _, mean, dev, used = self.scale[segment]
        x = pdf[[self.features[i] for i in used]].to_numpy(dtype=np.float64)
        return np.nan_to_num((x - mean[1:][used]) / dev[1:][used], nan=0.0)

    def fit(self, df: DataFrame, by: str, features: list[str], label: str) -> "SegmentNets":
        self.by, self.features, self.label = by, list(features), label
        df = df.where(F.col(by).isNotNull() & F.col(label).isNotNull()).select(
            F.col(by).cast("string").alias(by), F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in features])
        self._scales(df)
        self.nets = {(s, m): self._init(s, m) for s in sorted(self.scale) for m in self.models}
        if not self.nets:
            return self
        spark, inputs, scale = df.sparkSession, self._inputs, self.scale

        def packed(batches):
            for pdf in batches:
                for s, rows in pdf.groupby(by):
                    y = (rows[label].to_numpy(dtype=np.float64) - scale[s][1][0]) / scale[s][2][0]
                    yield pd.DataFrame({"segment": [s], "x": [inputs(rows, s).tobytes()], "y": [y.tobytes()]})

        blocks = materialize(df.mapInPandas(packed, "segment string, x binary, y binary"), "segment-blocks").persist()
        n_parts = blocks.rdd.getNumPartitions()
        for step in range(1, self.max_iter + 1):
            live = {k: (net.theta, net.sizes) for k, net in self.nets.items() if not net.done}
            if not live:
                break
            held = spark.sparkContext.broadcast(live)      # parameters of the nets, of bounded size

            def sums(batches, held=held):
                total: dict = {}
                for pdf in batches:
                    for s, x, y in zip(pdf["segment"], pdf["x"], pdf["y"]):
                        y = np.frombuffer(y)
                        x = np.frombuffer(x).reshape(len(y), -1)
                        for (segment, model), (theta, sizes) in held.value.items():
                            if segment == s:
                                g, loss = gradient(theta, sizes, x, y)
                                was = total.get((segment, model), (0.0, 0.0, 0))
                                total[segment, model] = (was[0] + g, was[1] + loss, was[2] + len(y))
                if total:
                    yield pd.DataFrame([(s, m, g.tobytes(), loss, n) for (s, m), (g, loss, n) in total.items()],
                                       columns=["segment", "model", "g", "loss", "n"])

            made = summed(blocks.mapInPandas(sums, SUMS), n_parts)
            found: dict = {}
            for r in made.collect():
                g, loss = found.get((r["segment"], r["model"]), (0.0, 0.0))
                found[r["segment"], r["model"]] = (g + np.frombuffer(r["g"]), loss + r["loss"])
            held.unpersist()
            for key, (g, loss) in found.items():
                net, n = self.nets[key], scale[key[0]][0]
                net.update(step, (g + self.alpha * net.theta) / n, (loss + 0.5 * self.alpha * float(net.theta @ net.theta)) / n, self)
        blocks.unpersist()
        return self

    def n_params(self, segment: str, model: str) -> int:
        return parameter_count(self.nets[segment, model].sizes)

    def predict(self, df: DataFrame) -> DataFrame:
        """One row per input row and model of its segment: the input's
        columns, ``model`` and ``prediction``."""
        inputs, scale, by = self._inputs, self.scale, self.by
        held = df.sparkSession.sparkContext.broadcast({k: (net.theta, net.sizes) for k, net in self.nets.items()})
        schema = StructType([*df.schema.fields, StructField("model", StringType()), StructField("prediction", DoubleType())])

        def run(batches):
            for pdf in batches:
                for s, rows in pdf.groupby(pdf[by].astype("string")):
                    if s in scale:
                        x = inputs(rows, s)
                        for (segment, model), (theta, sizes) in held.value.items():
                            if segment == s:
                                out = activations(unpack(theta, sizes), x)[-1][:, 0]
                                yield rows.assign(model=model, prediction=out * scale[s][2][0] + scale[s][1][0])

        return df.mapInPandas(run, schema)
