"""Full and pruned nets per segment, compared on their test rows.

The ten nets (five segments, two sizes) are trained in one run. Their
predictions are written once per application and source folder; metrics,
comparison and predicted-against-actual read that table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6
from tastemill.operators import regression as G
from tastemill.operators.segment_nets import SegmentNets
from tastemill.plans.q_regression import _LAYERS, _split, FEATURES, SEED, TARGET
from tastemill.plans.registry import query
from tastemill.sources import tables as S

MODELS = {name: _LAYERS[name] for name in ("full", "pruned")}
BINS = 10


def predictions(spark, sf):
    """(order_id, segment, target, model, prediction, n_params, steps) of the test rows."""
    def build():
        rows = _split(spark, sf)
        nets = SegmentNets(MODELS, seed=SEED).fit(rows.where(F.col("split") == "train"), "segment", FEATURES, TARGET)
        done = nets.predict(rows.where((F.col("split") == "test") & F.col(TARGET).isNotNull()).select("order_id", "segment", TARGET, *FEATURES))
        about = spark.createDataFrame([(s, m, nets.n_params(s, m), len(net.history)) for (s, m), net in nets.nets.items()],
                                      "segment string, model string, n_params long, steps int")
        return done.join(F.broadcast(about), ["segment", "model"]).select("order_id", "segment", TARGET, "model", "prediction", "n_params", "steps")

    return S._derived(spark, sf, "segment-predictions", build)


def metrics(pred):
    per = G.regression_metrics(pred, TARGET, "prediction", ["segment", "model"])
    about = pred.groupBy("segment", "model").agg(F.first("n_params").alias("n_params"), F.first("steps").alias("steps"))
    return per.join(about, ["segment", "model"])


def comparison(pred):
    """Per segment: errors of both sizes, their differences (full less pruned)
    and the parameters saved."""
    m = metrics(pred)
    pick = lambda c, model: F.max(F.when(F.col("model") == model, F.col(c)))
    both = m.groupBy("segment").agg(*[pick(c, k).alias(f"{c}_{k}") for c in ("mse", "r2", "n_params") for k in MODELS])
    less = F.col("n_params_full") - F.col("n_params_pruned")
    return both.select("segment", *[f"{c}_{k}" for c in ("mse", "r2", "n_params") for k in MODELS],
                       (F.col("mse_full") - F.col("mse_pruned")).alias("mse_diff"), (F.col("r2_full") - F.col("r2_pruned")).alias("r2_diff"),
                       less.alias("reduction"), r6(100.0 * less / F.col("n_params_full")).alias("reduction_pct"))


def binned(pred, bins: int = BINS):
    """Predicted against actual: equal-width bins of a segment's actual values."""
    span = pred.groupBy("segment").agg(F.min(TARGET).alias("lo"), F.max(TARGET).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col(TARGET) - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("int")
    return (pred.join(span, "segment").groupBy("segment", "model", at.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("mean_actual"), F.avg("prediction").alias("mean_pred")))


@query("segment_nets")
def segment_nets(spark, sf):
    return metrics(predictions(spark, sf))


@query("segment_nets_comparison")
def segment_nets_comparison(spark, sf):
    return comparison(predictions(spark, sf))


@query("segment_nets_pred_vs_actual")
def segment_nets_pred_vs_actual(spark, sf):
    return binned(predictions(spark, sf))
