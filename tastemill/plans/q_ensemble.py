"""Ensemble, adaptive weights and round-robin queries.

Model lists come from the baseline recommenders; success is measured by
recommending from early feedback rounds (<= 1997) and scoring against
the later ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.operators import baselines as B
from tastemill.operators import ensemble as E
from tastemill.operators import profiles as P
from tastemill.operators.features import item_features
from tastemill.plans import inputs as I
from tastemill.plans import q_recs as R
from tastemill.plans.registry import query
from tastemill.sources import tables as S

N = 15
EARLY = 1997
MODELS = ["genre", "popularity", "pruned"]


def _model_recs(spark, sf, fb, models=MODELS):
    cat = S.catalog(spark, sf)
    out = []
    for i, m in enumerate(models):
        if m == "genre":
            r = B.genre_based_recommend(fb, cat, n=N, seed=R.SEED)
        elif m == "popularity":
            r = B.popularity_recommend(fb, cat, "n_orders", n=N, seed=R.SEED)
        else:
            r = B.pruned_recommend(fb, item_features(cat, R.PRUNED_COLS), R.PRUNED_COLS, n=N)
        out.append(r.select("user_id", "item_id", "rank", F.lit(m).alias("model"), F.lit(i).alias("model_idx")))
    u = out[0]
    for o in out[1:]:
        u = u.unionByName(o)
    return u


def _weights(spark, models=MODELS):
    return spark.createDataFrame([(m, 1.0 / len(models)) for m in models], "model string, weight double")


def _sub(sql: str) -> str:
    return "(" + sql + ")"


_RECS_SQL = f"""recs AS (
  SELECT user_id, item_id, rank, 'genre' AS model, 0 AS model_idx FROM {_sub(R.GENRE_SQL)} g
  UNION ALL SELECT user_id, item_id, rank, 'popularity', 1 FROM {_sub(R.POP_SQL)} p
  UNION ALL SELECT user_id, item_id, rank, 'pruned', 2 FROM {_sub(R.PRUNED_SQL)} q)"""


def _vote_sql(recs_cte: str, n_models: int) -> str:
    return f"""WITH {recs_cte},
l AS (SELECT *, count(*) OVER (PARTITION BY user_id, model) AS L FROM recs),
s AS (SELECT user_id, item_id, sum((1.0 / {n_models}) * (1.0 - (rank - 1) / L)) AS score,
             min(model_idx * 1000000 + rank) AS first FROM l GROUP BY user_id, item_id)
SELECT user_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, first, item_id) AS rank FROM s) t
WHERE rank <= {N}"""


@query("ensemble_vote", _vote_sql(_RECS_SQL, 3))
def ensemble_vote(spark, sf):
    fb = S.feedback(spark, sf)
    return E.ensemble_vote(_model_recs(spark, sf, fb), _weights(spark), N)


_RECS2_SQL = f"""recs AS (
  SELECT user_id, item_id, rank, 'genre' AS model, 0 AS model_idx FROM {_sub(R.GENRE_SQL)} g
  UNION ALL SELECT user_id, item_id, rank, 'popularity', 1 FROM {_sub(R.POP_SQL)} p)"""


@query("ensemble_failure_mask", _vote_sql(_RECS2_SQL, 3))
def ensemble_failure_mask(spark, sf):
    """Three models with equal weights, the third failed: it contributes
    no rows and so no votes; the weights are not renormalised."""
    fb = S.feedback(spark, sf)
    recs = _model_recs(spark, sf, fb, ["genre", "popularity"])
    failed = recs.limit(0).withColumn("model", F.lit("pruned")).withColumn("model_idx", F.lit(2))
    return E.ensemble_vote(recs.unionByName(failed), _weights(spark), N)


_EARLY_FB = I.FEEDBACK.replace(
    "GROUP BY o.o_custkey, l.l_partkey)",
    f"GROUP BY o.o_custkey, l.l_partkey HAVING year(min(o.o_orderdate)) <= {EARLY})")
_GENRE_EARLY = R.GENRE_SQL.replace(I.FEEDBACK, _EARLY_FB)
_POP_EARLY = R.POP_SQL.replace(I.FEEDBACK, _EARLY_FB)
_LOG_SQL = f"""rec_log AS (
  SELECT user_id, item_id, 'genre' AS model FROM {_sub(_GENRE_EARLY)} g
  UNION ALL SELECT user_id, item_id, 'popularity' FROM {_sub(_POP_EARLY)} p)"""

_RATES_SQL = f"""{_LOG_SQL}, {I.FEEDBACK},
rates AS (
  SELECT r.user_id, r.model, count(f.label) AS total, sum(CASE WHEN f.label = 1 THEN 1 ELSE 0 END) AS success,
         CASE WHEN count(f.label) > 0 THEN (sum(CASE WHEN f.label = 1 THEN 1 ELSE 0 END) + 1.0) / (count(f.label) + 2.0) ELSE 0.5 END AS rate
  FROM rec_log r LEFT JOIN feedback f ON f.user_id = r.user_id AND f.item_id = r.item_id
  GROUP BY r.user_id, r.model)"""


def _log(spark, sf):
    fb = S.feedback(spark, sf)
    early = fb.filter(F.col("round_id") <= EARLY)
    return _model_recs(spark, sf, early, ["genre", "popularity"]), fb


@query("model_success_rate", f"""WITH {_RATES_SQL}
SELECT user_id, model, CAST(total AS BIGINT) AS total, CAST(success AS BIGINT) AS success, round(rate, 6) AS rate
FROM rates""")
def model_success_rate(spark, sf):
    log, fb = _log(spark, sf)
    r = E.model_success_rate(log, fb)
    return r.select("user_id", "model", "total", "success", r6("rate").alias("rate"))


@query("update_weights", f"""WITH {_RATES_SQL}
SELECT user_id, model, round(0.5 * rate / sum(0.5 * rate) OVER (PARTITION BY user_id), 6) AS weight FROM rates""")
def update_weights(spark, sf):
    log, fb = _log(spark, sf)
    r = E.model_success_rate(log, fb)
    w = E.update_weights(r, _weights(spark, ["genre", "popularity"]))
    return w.select("user_id", "model", r6("weight").alias("weight"))


@query("weight_replay", f"""WITH {_LOG_SQL}, {I.FEEDBACK},
grid AS (SELECT DISTINCT l.user_id, l.model, r.round FROM rec_log l,
  (SELECT DISTINCT round_id AS round FROM feedback WHERE round_id > {EARLY}) r),
j AS (SELECT g.user_id, g.model, g.round, count(f.label) AS total, sum(CASE WHEN f.label = 1 THEN 1 ELSE 0 END) AS success
      FROM grid g JOIN rec_log r ON r.user_id = g.user_id AND r.model = g.model
      LEFT JOIN feedback f ON f.user_id = r.user_id AND f.item_id = r.item_id AND f.round_id = g.round
      GROUP BY g.user_id, g.model, g.round),
rr AS (SELECT *, CASE WHEN total > 0 THEN (success + 1.0) / (total + 2.0) ELSE 0.5 END AS rate FROM j),
c AS (SELECT *, 0.5 * exp(sum(ln(rate)) OVER (PARTITION BY user_id, model ORDER BY round
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS raw FROM rr)
SELECT user_id, model, CAST(round AS INTEGER) AS round,
       round(raw / sum(raw) OVER (PARTITION BY user_id, round), 6) AS weight FROM c""")
def weight_replay(spark, sf):
    """Weights after each later round of the feedback: per round the success
    rate of the early lists against that round's feedback."""
    log, fb = _log(spark, sf)
    rounds = fb.where(F.col("round_id") > EARLY).agg(F.sort_array(F.collect_set("round_id")).alias("rounds"))   # one row: the years
    grid = (log.select("user_id", "model").distinct().crossJoin(F.broadcast(rounds))
            .select("user_id", "model", F.explode("rounds").alias("round")))
    j = (grid.join(log.select("user_id", "model", "item_id"), ["user_id", "model"])
         .join(fb.select("user_id", "item_id", "label", F.col("round_id").alias("round")),
               ["user_id", "item_id", "round"], "left"))
    rr = (j.groupBy("user_id", "model", "round")
          .agg(F.count("label").alias("total"), F.count_if(F.col("label") == 1).alias("success"))
          .withColumn("rate", F.when(F.col("total") > 0, (F.col("success") + 1.0) / (F.col("total") + 2.0))
                      .otherwise(F.lit(0.5))))
    w = E.weight_replay(rr, _weights(spark, ["genre", "popularity"]))
    return w.select("user_id", "model", F.col("round").cast("int"), r6("weight").alias("weight"))


# the five models of the full ensemble, in voting order, each with a fifth of the vote
FULL = ["content", "clustering", "pure_cf", "matrix_factorization", "deep"]


def _five_lists(spark, sf, fb):
    """The five models' lists for the users of ``fb``, written once:
    (user_id, item_id, rank, model, model_idx)."""
    from tastemill.operators import cf as C
    from tastemill.operators import clusters as K
    from tastemill.operators import content_topn as CT
    from tastemill.operators import preference as PR
    from tastemill.plans import q_content as QC
    from tastemill.plans import q_models as QM
    from tastemill.plans import q_regression as QR
    from tastemill.session import materialize
    cat = S.catalog(spark, sf)
    feats, cols = QC.content_features(spark, sf)
    assigns = {m: d.select("item_id", F.col("cluster").cast("string").alias("cluster")) for m, d in QM._model_assigns(spark, sf).items()}
    ratings = QM.mf_ratings(spark, sf, fb)      # the users' own rows are in before anything is scored
    disliked = P.fully_disliked_genres(fb, cat)
    factors = C.als_train(ratings, rank=QM.ALS_RANK, max_iter=QM.ALS_ITER, seed=QM.SEED)
    wide = C.als_topn(factors, fb.select("user_id"), ratings, 3 * N, exclude_genres=disliked, catalog=cat)
    pref = item_features(cat, QR.PREF_COLS)
    train = PR.augment_training(PR.training_set(fb, pref, QR.PREF_COLS), QR.PREF_COLS, QR.SEED)
    _, kappa, gamma, b = PR.fit_preference(train, QR.PREF_COLS)
    lists = {
        "content": CT.content_topn(fb, feats, cols, P.feature_importance(fb, feats, cols), n=N),
        "clustering": K.cluster_recommend(fb.join(assigns["kmeans"].select("item_id"), "item_id", "left_semi"), assigns,
                                          {"kmeans": 0.4, "gmm": 0.3, "hierarchical": 0.3}, N, fb),
        "pure_cf": C.als_topn(factors, fb.select("user_id"), ratings, N),
        "matrix_factorization": E.genre_round_robin(wide, cat, P.liked_genres(fb, cat), disliked, N),
        "deep": PR.preference_recommend(fb, pref, QR.PREF_COLS, kappa, gamma, b, n=N),
    }
    out = None
    for i, m in enumerate(FULL):
        one = lists[m].select("user_id", "item_id", F.col("rank").cast("int").alias("rank"), F.lit(m).alias("model"), F.lit(i).alias("model_idx"))
        out = one if out is None else out.unionByName(one)
    return materialize(out, "five-lists")


@query("ensemble_full")
def ensemble_full(spark, sf):
    """The weighted vote over all five models' lists, 0.2 each."""
    return E.ensemble_vote(_five_lists(spark, sf, S.feedback(spark, sf)), _weights(spark, FULL), N)


@query("ensemble_round2")
def ensemble_round2(spark, sf):
    """One turn of the feedback loop: lists from the early rounds, success
    rates from what the users said later, updated weights per user, and a
    second vote over the items not rated since."""
    fb = S.feedback(spark, sf)
    lists = _five_lists(spark, sf, fb.filter(F.col("round_id") <= EARLY))
    later = fb.filter(F.col("round_id") > EARLY)
    weights = E.update_weights(E.model_success_rate(lists, later), _weights(spark, FULL))
    left = lists.join(later.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return E.ensemble_vote(left, weights, N)


_POP45 = R.POP_SQL.replace(f"WHERE rank <= {N}", f"WHERE rank <= {3 * N}")


@query("genre_round_robin", I.with_(I.CATALOG, I.FEEDBACK) + f"""
, cands AS (SELECT user_id, item_id, rank FROM {_sub(_POP45)} p),
lg AS (SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = 1),
dg AS (SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = -1),
fd AS (SELECT * FROM dg EXCEPT SELECT * FROM lg),
c AS (SELECT k.user_id, k.item_id, k.rank, c.genre, CASE WHEN lg.genre IS NULL THEN 0 ELSE 1 END AS is_liked
      FROM cands k JOIN catalog c ON c.item_id = k.item_id
      LEFT JOIN lg ON lg.user_id = k.user_id AND lg.genre = c.genre
      WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.user_id = k.user_id AND fd.genre = c.genre)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre ORDER BY rank) AS turn,
             min(rank) OVER (PARTITION BY user_id, genre) AS first FROM c)
SELECT user_id, item_id, genre, CAST(pos AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, is_liked DESC, first) AS pos FROM t) z
WHERE pos <= {N}""")
def genre_round_robin(spark, sf):
    """Diversify the top 3n popularity candidates: one per genre per turn."""
    fb = S.feedback(spark, sf)
    cat = S.catalog(spark, sf)
    cands = B.popularity_recommend(fb, cat, "n_orders", n=3 * N, seed=R.SEED)
    return E.genre_round_robin(cands, cat, P.liked_genres(fb, cat), P.fully_disliked_genres(fb, cat), N)
