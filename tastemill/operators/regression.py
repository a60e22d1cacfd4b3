"""Regression and model-size comparison.

* ``train_test_split``: md5 bucket of the key (stable under repartitioning).
* ``segment_ols``: closed-form per-segment simple regression with the SQL
  aggregates ``regr_slope`` / ``regr_intercept`` (one grouped aggregate).
* ``MLPRegressor``: Spark ML has no MLP regressor, so this is a
  data-parallel full-batch trainer: the weights are broadcast, every
  partition makes one gradient sum through ``mapInPandas``, the sums are
  added up in a tree on the executors, and the driver takes an Adam step.
  Rows never leave the executors; the driver only holds the parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.core import split_bucket


def train_test_split(df: DataFrame, key: str, seed: int = 42, test_pct: int = 20) -> DataFrame:
    """Adds ``split`` = 'test' for hash bucket < test_pct (of 100), else 'train'."""
    return df.withColumn("split", F.when(split_bucket(seed, key) < test_pct, "test").otherwise("train"))


def check_no_leak(features: list[str], target: str) -> None:
    if target in features:
        raise ValueError(f"target {target!r} is also listed as a feature")


def segment_ols(train: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., slope, intercept) per segment."""
    g = train.groupBy(*by) if by else train.groupBy()
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def regression_metrics(pred: DataFrame, y: str = "target", p: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    """MSE and R² = 1 - SSE / (n · var_pop(y))."""
    by = by or []
    err = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    g = pred.groupBy(*by) if by else pred.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mse"),
                 (F.lit(1.0) - F.sum(err) / F.nullif(F.count(F.lit(1)) * F.var_pop(y), F.lit(0))).alias("r2"))


def parameter_count(layers: list[int]) -> int:
    """Σ (in · out + out) over consecutive layer sizes."""
    return int(sum(a * b + b for a, b in zip(layers[:-1], layers[1:])))


def parameter_count_table(models: DataFrame) -> DataFrame:
    """models(model, layers array<int>) → (model, n_params) with posexplode + lead."""
    e = models.select("model", F.posexplode("layers").alias("i", "size"))
    w = Window.partitionBy("model").orderBy("i")
    e = e.withColumn("nxt", F.lead("size").over(w)).filter(F.col("nxt").isNotNull())
    return e.groupBy("model").agg(F.sum(F.col("size") * F.col("nxt") + F.col("nxt")).cast("bigint").alias("n_params"))


def pred_vs_actual(pred: DataFrame, bins: int = 10, y: str = "target", p: str = "prediction") -> DataFrame:
    """Equal-width bins of the actual value: count, mean actual, mean predicted."""
    st = pred.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    width = (hi - lo) if hi is not None and hi > lo else 1.0
    b = F.least(F.floor((F.col(y) - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")
    return pred.withColumn("bin", b).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_actual"), F.avg(p).alias("mean_pred"))


# ------------------------------------------------------------------- MLP trainer
TREE_FROM = 64      # partitions whose gradients the driver adds itself, at most


def _add_gradients(key, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0).tolist()],
                         "loss": [float(pdf["loss"].sum())], "n": [int(pdf["n"].sum())]})


class MLPRegressor:
    """ReLU MLP regressor trained by data-parallel full-batch Adam.

    ``fit`` expects ``features`` (array<double>, already scaled) and
    ``label`` (double). The target is standardised on the training rows
    and predictions are mapped back. Early stopping: stop after
    ``n_iter_no_change`` steps that don't beat the best loss so far by ``tol``;
    the step size is cut by ``lr_factor`` after ``lr_patience`` stale
    steps. ``history`` keeps (step, loss, lr).
    """

    def __init__(self, hidden: tuple[int, ...] = (100, 50), max_iter: int = 500, lr: float = 0.01,
                 alpha: float = 1e-4, seed: int = 42, tol: float = 1e-4, n_iter_no_change: int = 20,
                 lr_patience: int = 5, lr_factor: float = 0.2):
        self.hidden = tuple(hidden)
        self.max_iter, self.lr, self.alpha, self.seed = max_iter, lr, alpha, seed
        self.tol, self.n_iter_no_change = tol, n_iter_no_change
        self.lr_patience, self.lr_factor = lr_patience, lr_factor
        self.history: list[tuple[int, float, float]] = []

    # parameters are one flat float64 vector; shapes kept for (un)packing
    def _shapes(self, d: int):
        sizes = [d, *self.hidden, 1]
        return [((a, b), (b,)) for a, b in zip(sizes[:-1], sizes[1:])]

    def _unpack(self, theta: np.ndarray, d: int):
        out, i = [], 0
        for (wa, wb), (bb,) in self._shapes(d):
            W = theta[i:i + wa * wb].reshape(wa, wb)
            i += wa * wb
            b = theta[i:i + bb]
            i += bb
            out.append((W, b))
        return out

    def n_params(self, d: int) -> int:
        return parameter_count([d, *self.hidden, 1])

    def _init(self, d: int) -> np.ndarray:
        rng = np.random.RandomState(self.seed)
        parts = []
        for (wa, wb), (bb,) in self._shapes(d):
            bound = np.sqrt(6.0 / (wa + wb))   # Glorot uniform
            parts += [rng.uniform(-bound, bound, wa * wb), rng.uniform(-bound, bound, bb)]
        return np.concatenate(parts)

    @staticmethod
    def _forward(layers, X):
        acts = [X]
        h = X
        for k, (W, b) in enumerate(layers):
            z = h @ W + b
            h = np.maximum(z, 0.0) if k < len(layers) - 1 else z
            acts.append(h)
        return acts

    def fit(self, df: DataFrame) -> "MLPRegressor":
        spark = df.sparkSession
        stats = df.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s"),
                       F.count(F.lit(1)).alias("n"), F.first(F.size("features")).alias("d")).first()
        self.y_mean, self.y_std = float(stats["m"]), float(stats["s"] or 1.0) or 1.0
        n, d = int(stats["n"]), int(stats["d"])
        self.d = d
        data = df.select("features", ((F.col("label") - self.y_mean) / self.y_std).alias("y")).persist()
        n_parts = data.rdd.getNumPartitions()
        theta = self._init(d)
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        b1, b2, eps = 0.9, 0.999, 1e-8
        lr, best, stale, since_cut = self.lr, np.inf, 0, 0
        sc = spark.sparkContext
        P = len(theta)
        for step in range(1, self.max_iter + 1):
            bc = sc.broadcast(theta)
            fwd, unpack = self._forward, self._unpack

            def grads(it, bc=bc):
                layers = unpack(bc.value, d)
                g = np.zeros(P)
                loss, cnt = 0.0, 0
                for pdf in it:
                    if len(pdf) == 0:
                        continue
                    X = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                    y = pdf["y"].to_numpy(dtype=np.float64).reshape(-1, 1)
                    acts = fwd(layers, X)
                    delta = acts[-1] - y
                    loss += float(0.5 * np.sum(delta * delta))
                    cnt += len(pdf)
                    gs = []
                    for k in range(len(layers) - 1, -1, -1):
                        W, _ = layers[k]
                        gs.append((acts[k].T @ delta, delta.sum(axis=0)))
                        if k > 0:
                            delta = (delta @ W.T) * (acts[k] > 0)
                    flat = []
                    for gw, gb in reversed(gs):
                        flat += [gw.ravel(), gb.ravel()]
                    g += np.concatenate(flat)
                yield pd.DataFrame({"g": [g.tolist()], "loss": [loss], "n": [cnt]})

            made = data.mapInPandas(grads, "g array<double>, loss double, n long")
            if n_parts > TREE_FROM:     # add up on the executors, in groups of partitions
                made = (made.groupBy(F.pmod(F.spark_partition_id(), F.lit(int(n_parts ** 0.5))).alias("k"), F.lit(0).alias("z"))
                        .applyInPandas(_add_gradients, "g array<double>, loss double, n long"))
            parts = made.collect()
            bc.unpersist()
            g = np.sum([np.asarray(r["g"]) for r in parts], axis=0) / n + self.alpha * theta / n
            loss = sum(r["loss"] for r in parts) / n + 0.5 * self.alpha * float(theta @ theta) / n
            self.history.append((step, loss, lr))
            m1 = b1 * m1 + (1 - b1) * g
            m2 = b2 * m2 + (1 - b2) * g * g
            theta = theta - lr * (m1 / (1 - b1 ** step)) / (np.sqrt(m2 / (1 - b2 ** step)) + eps)
            improved, best = loss < best - self.tol, min(best, loss)
            if improved:
                stale, since_cut = 0, 0
            else:
                stale += 1
                since_cut += 1
                if since_cut >= self.lr_patience:
                    lr *= self.lr_factor
                    since_cut = 0
                if stale >= self.n_iter_no_change:
                    break
        data.unpersist()
        self.theta = theta
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        sc = df.sparkSession.sparkContext
        bc = sc.broadcast(self.theta)
        d, fwd, unpack, ym, ys = self.d, self._forward, self._unpack, self.y_mean, self.y_std
        from pyspark.sql.types import DoubleType, StructField, StructType
        schema = StructType(list(df.schema.fields) + [StructField("prediction", DoubleType())])

        def pred(it):
            layers = unpack(bc.value, d)
            for pdf in it:
                if len(pdf) == 0:
                    yield pdf.assign(prediction=pd.Series(dtype="float64"))
                    continue
                X = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                yield pdf.assign(prediction=fwd(layers, X)[-1][:, 0] * ys + ym)

        return df.mapInPandas(pred, schema)
