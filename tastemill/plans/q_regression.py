"""Regression, model-size comparison and preference-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6
from tastemill.operators import features as X
from tastemill.operators import preference as PR
from tastemill.operators import regression as G
from tastemill.plans import inputs as I
from tastemill.plans.registry import query
from tastemill.sources import tables as S

SEED = 42
FEATURES = ["n_lines", "sum_qty", "avg_discount", "avg_tax", "acctbal", "priority"]
TARGET = "target"
X1 = "sum_qty"          # single regressor of the closed-form baselines
G.check_no_leak(FEATURES, TARGET)

_BUCKET = f"CAST(('0x' || substr(md5('{SEED}:' || CAST(order_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100"
_SPLIT = I.with_(I.REGRESSION) + f""", sp AS (SELECT *, CASE WHEN {_BUCKET} < 20 THEN 'test' ELSE 'train' END AS split
FROM regression)"""
_OLS = _SPLIT + f""",
seg AS (SELECT segment, regr_slope({TARGET}, {X1}) AS slope, regr_intercept({TARGET}, {X1}) AS intercept
        FROM sp WHERE split = 'train' GROUP BY segment),
gl AS (SELECT regr_slope({TARGET}, {X1}) AS slope, regr_intercept({TARGET}, {X1}) AS intercept FROM sp WHERE split = 'train'),
pred AS (SELECT t.segment, t.{TARGET}, s.intercept + s.slope * t.{X1} AS p_full, g.intercept + g.slope * t.{X1} AS p_pruned
         FROM sp t JOIN seg s ON s.segment = t.segment, gl g WHERE t.split = 'test')"""


def _split(spark, sf):
    return G.train_test_split(S.regression_rows(spark, sf), "order_id", SEED)


def _ols_pred(spark, sf):
    sp = _split(spark, sf)
    tr = sp.filter(F.col("split") == "train")
    seg = G.segment_ols(tr, X1, TARGET, ["segment"])
    glob = G.segment_ols(tr, X1, TARGET, []).first()
    te = sp.filter(F.col("split") == "test").join(seg, "segment")   # one row per segment: small side
    return te.select("segment", TARGET,
                     (F.col("intercept") + F.col("slope") * F.col(X1)).alias("p_full"),
                     (F.lit(glob["intercept"]) + F.lit(glob["slope"]) * F.col(X1)).alias("p_pruned"))


@query("train_test_split", _SPLIT + " SELECT order_id, split FROM sp")
def train_test_split(spark, sf):
    return _split(spark, sf).select("order_id", "split")


_sc = ", ".join(f"round(({c} - st.m_{c}) / (CASE WHEN st.s_{c} = 0 OR st.s_{c} IS NULL THEN 1.0 ELSE st.s_{c} END), 6) + 0.0 AS {c}"
                for c in FEATURES)
_st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)


@query("standard_scale_train_only", _SPLIT + f""", st AS (SELECT {_st} FROM sp WHERE split = 'train')
SELECT order_id, {_sc} FROM sp, st""")
def standard_scale_train_only(spark, sf):
    sp = _split(spark, sf)
    z = X.standard_scale(sp, FEATURES, fit_on=sp.filter(F.col("split") == "train"))
    return z.select("order_id", *[r6(c).alias(c) for c in FEATURES])


@query("segment_models", _OLS + " SELECT segment, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM seg")
def segment_models(spark, sf):
    tr = _split(spark, sf).filter(F.col("split") == "train")
    return G.segment_ols(tr, X1, TARGET, ["segment"]).select("segment", r6("slope").alias("slope"),
                                                              r6("intercept").alias("intercept"))


@query("regression_metrics", _OLS + f""",
m AS (SELECT segment, count(*) AS n, avg(({TARGET} - p_full) * ({TARGET} - p_full)) AS mse,
             1.0 - sum(({TARGET} - p_full) * ({TARGET} - p_full)) / (count(*) * var_pop({TARGET})) AS r2
      FROM pred GROUP BY segment)
SELECT segment, CAST(n AS BIGINT) AS n, round(mse / 1e6, 6) AS mse_millions, round(r2, 6) AS r2 FROM m""")
def regression_metrics(spark, sf):
    m = G.regression_metrics(_ols_pred(spark, sf).withColumnRenamed("p_full", "prediction"), TARGET, "prediction",
                             ["segment"])
    return m.select("segment", "n", r6(F.col("mse") / 1e6).alias("mse_millions"), r6("r2").alias("r2"))


_PF = G.parameter_count([1, 1]) * 5   # slope + intercept per segment (5 segments)
_PP = G.parameter_count([1, 1])


@query("model_comparison", _OLS + f""",
m AS (SELECT avg(({TARGET} - p_full) * ({TARGET} - p_full)) AS mse_full,
             avg(({TARGET} - p_pruned) * ({TARGET} - p_pruned)) AS mse_pruned,
             1.0 - sum(({TARGET} - p_full) * ({TARGET} - p_full)) / (count(*) * var_pop({TARGET})) AS r2_full,
             1.0 - sum(({TARGET} - p_pruned) * ({TARGET} - p_pruned)) / (count(*) * var_pop({TARGET})) AS r2_pruned,
             count(DISTINCT segment) AS n_seg FROM pred)
SELECT round(mse_full / 1e6, 6) AS mse_full_m, round(mse_pruned / 1e6, 6) AS mse_pruned_m, round((mse_pruned - mse_full) / 1e6, 6) AS mse_diff_m,
       round(r2_full, 6) AS r2_full, round(r2_pruned, 6) AS r2_pruned, round(r2_full - r2_pruned, 6) AS r2_diff,
       CAST(2 * n_seg AS BIGINT) AS params_full, CAST(2 AS BIGINT) AS params_pruned,
       CAST(2 * n_seg - 2 AS BIGINT) AS reduction, round(100.0 * (2 * n_seg - 2) / (2 * n_seg), 6) AS reduction_pct
FROM m""")
def model_comparison(spark, sf):
    """Per-segment line (full) against one global line (pruned) on the test rows."""
    p = _ols_pred(spark, sf)
    err_f = (F.col(TARGET) - F.col("p_full")) ** 2
    err_p = (F.col(TARGET) - F.col("p_pruned")) ** 2
    n = F.count(F.lit(1))
    m = p.agg(F.avg(err_f).alias("mse_full"), F.avg(err_p).alias("mse_pruned"),
              (1.0 - F.sum(err_f) / (n * F.var_pop(TARGET))).alias("r2_full"),
              (1.0 - F.sum(err_p) / (n * F.var_pop(TARGET))).alias("r2_pruned"),
              F.countDistinct("segment").alias("n_seg"))
    return m.select(r6(F.col("mse_full") / 1e6).alias("mse_full_m"), r6(F.col("mse_pruned") / 1e6).alias("mse_pruned_m"),
                    r6((F.col("mse_pruned") - F.col("mse_full")) / 1e6).alias("mse_diff_m"),
                    r6("r2_full").alias("r2_full"), r6("r2_pruned").alias("r2_pruned"),
                    r6(F.col("r2_full") - F.col("r2_pruned")).alias("r2_diff"),
                    (2 * F.col("n_seg")).cast("bigint").alias("params_full"), F.lit(2).cast("bigint").alias("params_pruned"),
                    (2 * F.col("n_seg") - 2).cast("bigint").alias("reduction"),
                    r6(100.0 * (2 * F.col("n_seg") - 2) / (2 * F.col("n_seg"))).alias("reduction_pct"))


@query("pred_vs_actual", _OLS + f""",
r AS (SELECT min({TARGET}) AS lo, max({TARGET}) AS hi FROM pred)
SELECT CAST(least(floor(({TARGET} - r.lo) / (r.hi - r.lo) * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n,
       round(avg({TARGET}), 6) AS mean_actual, round(avg(p_full), 6) AS mean_pred
FROM pred, r GROUP BY 1""")
def pred_vs_actual(spark, sf):
    b = G.pred_vs_actual(_ols_pred(spark, sf).withColumnRenamed("p_full", "prediction"), 10, TARGET, "prediction")
    return b.select("bin", "n", r6("mean_actual").alias("mean_actual"), r6("mean_pred").alias("mean_pred"))


_LAYERS = {"full": (100, 50), "pruned": (50, 25), "pruned_small": (20, 10)}


_VARIES = " + ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN 1 ELSE 0 END" for c in FEATURES)


@query("parameter_count", _SPLIT + f"""
, d AS (SELECT segment, {_VARIES} AS k FROM sp WHERE split = 'train' GROUP BY segment),
m AS (SELECT 'full' AS model, 100 AS h1, 50 AS h2 UNION ALL SELECT 'pruned', 50, 25 UNION ALL SELECT 'pruned_small', 20, 10)
SELECT segment || '/' || model AS model, CAST(d.k * h1 + h1 + h1 * h2 + h2 + h2 + 1 AS BIGINT) AS n_params FROM m, d""")
def parameter_count(spark, sf):
    """Parameters of each model per segment: the input layer is as wide as
    the number of features that vary in the segment's training rows."""
    train = _split(spark, sf).filter(F.col("split") == "train")
    used = [F.when(F.min(c) != F.max(c), 1).otherwise(0) for c in FEATURES]
    width = used[0]
    for u in used[1:]:
        width = width + u
    per = train.groupBy("segment").agg(width.alias("k"))
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(x) for x in v]).alias("hidden")) for n, v in _LAYERS.items()]))
    models = per.withColumn("m", models).select(F.concat_ws("/", "segment", "m.name").alias("model"),
                                                F.concat(F.array(F.col("k").cast("int")), F.col("m.hidden"), F.array(F.lit(1))).alias("layers"))
    return G.parameter_count_table(models)


def _mlp_data(spark, sf):
    sp = _split(spark, sf)
    z = X.standard_scale(sp, FEATURES, fit_on=sp.filter(F.col("split") == "train"))
    return z.select("order_id", "split", F.array(*FEATURES).alias("features"), F.col(TARGET).alias("label"))


def _mlp(spark, sf, name, max_iter=500):
    data = _mlp_data(spark, sf)
    m = G.MLPRegressor(hidden=_LAYERS[name], max_iter=max_iter, seed=SEED).fit(data.filter(F.col("split") == "train"))
    pred = m.transform(data.filter(F.col("split") == "test"))
    met = G.regression_metrics(pred, "label", "prediction")
    return m, met.select(F.lit(name).alias("model"), F.lit(m.n_params(len(FEATURES))).cast("bigint").alias("n_params"),
                         "n", "mse", "r2", F.lit(len(m.history)).alias("steps"))


@query("mlp_full")
def mlp_full(spark, sf):
    return _mlp(spark, sf, "full")[1]


@query("mlp_pruned")
def mlp_pruned(spark, sf):
    return _mlp(spark, sf, "pruned")[1]


@query("early_stop_plateau")
def early_stop_plateau(spark, sf):
    """Loss and step size per step of the pruned model's training run."""
    m, _ = _mlp(spark, sf, "pruned")
    return spark.createDataFrame([(int(s), float(l), float(r)) for s, l, r in m.history],
                                 "step int, loss double, lr double")


# ------------------------------------------------------------------- preference
PREF_COLS = ["price", "size", "n_orders"]


def _pref_inputs(spark, sf):
    feats = X.item_features(S.catalog(spark, sf), PREF_COLS)
    return S.feedback(spark, sf), feats


@query("training_set", I.with_(I.CATALOG, I.FEEDBACK) + """
, j AS (SELECT f.user_id, f.label FROM feedback f JOIN catalog c ON c.item_id = f.item_id WHERE f.label <> 0),
u AS (SELECT user_id, count(*) AS n_rows, count_if(label = 1) AS n_like FROM j GROUP BY user_id HAVING count(*) >= 2)
SELECT user_id, CAST(sum(CASE WHEN (label = 1 AND n_like - 1 > 0) OR (label = -1 AND n_like > 0) THEN 1 ELSE 0 END) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN label = 1 AND n_like - 1 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos
FROM j JOIN u USING (user_id) GROUP BY user_id
HAVING sum(CASE WHEN (label = 1 AND n_like - 1 > 0) OR (label = -1 AND n_like > 0) THEN 1 ELSE 0 END) > 0""")
def training_set(spark, sf):
    fb, feats = _pref_inputs(spark, sf)
    t = PR.training_set(fb, feats, PREF_COLS)
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").cast("bigint").alias("n_pos"))


@query("augment_training", I.with_(I.CATALOG, I.FEEDBACK) + f"""
, j AS (SELECT f.user_id, f.label FROM feedback f JOIN catalog c ON c.item_id = f.item_id WHERE f.label <> 0),
u AS (SELECT user_id, count(*) AS n_rows, count_if(label = 1) AS n_like FROM j GROUP BY user_id HAVING count(*) >= 2),
t AS (SELECT user_id, sum(CASE WHEN (label = 1 AND n_like - 1 > 0) OR (label = -1 AND n_like > 0) THEN 1 ELSE 0 END) AS n
      FROM j JOIN u USING (user_id) GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN n < {PR.AUGMENT_BELOW} THEN n * {1 + PR.AUGMENT_COPIES} ELSE n END AS BIGINT) AS n_rows
FROM t WHERE n > 0""")
def augment_training(spark, sf):
    fb, feats = _pref_inputs(spark, sf)
    a = PR.augment_training(PR.training_set(fb, feats, PREF_COLS), PREF_COLS, SEED)
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


def _pref_model(spark, sf):
    fb, feats = _pref_inputs(spark, sf)
    train = PR.augment_training(PR.training_set(fb, feats, PREF_COLS), PREF_COLS, SEED)
    return fb, feats, PR.fit_preference(train, PREF_COLS)


@query("preference_classifier")
def preference_classifier(spark, sf):
    """Fitted coefficients: curvature κ and linear term γ per feature."""
    _, _, (m, kappa, gamma, b) = _pref_model(spark, sf)
    rows = [(c, float(kappa[i]), float(gamma[i])) for i, c in enumerate(PREF_COLS)] + [("intercept", 0.0, float(b))]
    return spark.createDataFrame(rows, "feature string, kappa double, gamma double")


@query("preference_recommend")
def preference_recommend(spark, sf):
    fb, feats, (m, kappa, gamma, b) = _pref_model(spark, sf)
    return PR.preference_recommend(fb, feats, PREF_COLS, kappa, gamma, b, n=15)
