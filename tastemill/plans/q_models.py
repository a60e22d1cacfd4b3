"""Clustering and collaborative-filtering queries.

Model fits (k-means, GMM, bisecting k-means, ALS) are checked by rows and
invariants; scoring on fixed assignments and all interaction reshaping
have SQL twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.operators import cf as C
from tastemill.operators import clusters as K
from tastemill.operators import ensemble as E
from tastemill.operators import profiles as P
from tastemill.plans import inputs as I
from tastemill.plans.registry import query
from tastemill.sources import tables as S

N = 15
SEED = 42
SAMPLE = 10000
ALS_RANK, ALS_ITER = 100, 30      # fixed values of the reference setup
DIM = 64


def _vec(spark, sf):
    return S.vectors(spark, sf)


def _fb_vec(spark, sf):
    """Feedback restricted to items that have a vector."""
    return S.feedback(spark, sf).join(_vec(spark, sf).select("item_id"), "item_id", "left_semi")


def _h(*parts: str) -> str:
    inner = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5('{SEED}:' || {inner})"


def _hnum(h: str, width: int = 6) -> str:
    return f"CAST(('0x' || substr({h}, 1, {width})) AS BIGINT)"


@query("cluster_count", I.with_(I.VECTORS) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(greatest(2, least(20, count(*) // 100)) AS INTEGER) AS k FROM vectors""")
def cluster_count(spark, sf):
    v = _vec(spark, sf)
    n = v.count()
    return v.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("k", F.lit(K.cluster_count(n)).cast("int"))


@query("training_sample", I.with_(I.VECTORS) + f"""
SELECT item_id FROM vectors ORDER BY {_h('item_id')}, item_id LIMIT {SAMPLE}""")
def training_sample(spark, sf):
    return K.training_sample(_vec(spark, sf), SAMPLE, SEED).select("item_id")


_CENT = ", ".join(f"avg(features[{i + 1}])" for i in range(DIM))


@query("cluster_centroids", I.with_(I.VECTORS) + f"""
SELECT genre AS cluster, list_transform([{_CENT}], lambda x: round(x, 6) + 0.0) AS centroid
FROM vectors GROUP BY genre""")
def cluster_centroids(spark, sf):
    v = _vec(spark, sf)
    c = K.cluster_centroids(v, v.select("item_id", F.col("genre").alias("cluster")))
    return c.select("cluster", F.transform("centroid", lambda x: r6(x)).alias("centroid"))


@query("nearest_centroid", I.with_(I.VECTORS) + f"""
, c AS (SELECT genre AS cluster, [{_CENT}] AS centroid FROM vectors GROUP BY genre),
d AS (SELECT v.item_id, c.cluster,
             list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v.features[i] - c.centroid[i]) * (v.features[i] - c.centroid[i]))) AS d2
      FROM vectors v, c)
SELECT item_id, arg_min(cluster, d2 * 1e6 + cluster) AS cluster FROM (
  SELECT item_id, cluster, d2, row_number() OVER (PARTITION BY item_id ORDER BY d2, cluster) AS r FROM d) z
WHERE r = 1 GROUP BY item_id""")
def nearest_centroid(spark, sf):
    v = _vec(spark, sf)
    c = K.cluster_centroids(v, v.select("item_id", F.col("genre").alias("cluster")))
    return K.nearest_centroid(v, c).select("item_id", "cluster")


_AFF_SQL = I.with_(I.CATALOG, I.FEEDBACK, I.VECTORS) + f"""
, fb AS (SELECT f.* FROM feedback f WHERE f.item_id IN (SELECT item_id FROM vectors)),
per AS (SELECT f.user_id, v.genre AS cluster, count_if(f.label = 1) AS n_like, count_if(f.label = -1) AS n_dis
        FROM fb f JOIN vectors v ON v.item_id = f.item_id GROUP BY f.user_id, v.genre),
sc AS (SELECT user_id, cluster, n_like / sum(n_like) OVER (PARTITION BY user_id) AS score FROM per),
ok AS (SELECT s.user_id, s.cluster, s.score FROM sc s JOIN per p ON p.user_id = s.user_id AND p.cluster = s.cluster
       WHERE p.n_dis = 0 AND p.n_like > 0),
users AS (SELECT DISTINCT user_id FROM feedback),
cand AS (SELECT u.user_id, v.item_id, coalesce(ok.score, 0.0) AS score
         FROM users u CROSS JOIN vectors v LEFT JOIN ok ON ok.user_id = u.user_id AND ok.cluster = v.genre
         WHERE NOT EXISTS (SELECT 1 FROM fb x WHERE x.user_id = u.user_id AND x.item_id = v.item_id))
SELECT user_id, item_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM cand) z
WHERE rank <= {N}"""


@query("cluster_affinity", _AFF_SQL)
def cluster_affinity(spark, sf):
    """Items scored by the share of the user's likes in their cluster
    (fixed assignment: the vector label)."""
    v = _vec(spark, sf)
    return K.cluster_recommend(_fb_vec(spark, sf), {"label": v.select("item_id", F.col("genre").alias("cluster"))},
                               {"label": 1.0}, N, S.feedback(spark, sf))


_BLEND_W = {"label": 0.4, "genre": 0.3, "brand": 0.3}


def _scored(name, col_expr):
    return f"""per_{name} AS (SELECT f.user_id, {col_expr} AS cluster, count_if(f.label = 1) AS n_like,
                 count_if(f.label = -1) AS n_dis FROM fb f JOIN items i ON i.item_id = f.item_id GROUP BY 1, 2),
ok_{name} AS (SELECT user_id, cluster, n_like / sum(n_like) OVER (PARTITION BY user_id) AS score, n_dis, n_like FROM per_{name})"""


_BLEND_SQL = I.with_(I.CATALOG, I.FEEDBACK, I.VECTORS) + f"""
, items AS (SELECT v.item_id, CAST(v.genre AS VARCHAR) AS c_label, c.genre AS c_genre, c.subgenre AS c_brand
            FROM vectors v JOIN catalog c ON c.item_id = v.item_id),
fb AS (SELECT f.* FROM feedback f WHERE f.item_id IN (SELECT item_id FROM items)),
{_scored('label', 'i.c_label')},
{_scored('genre', 'i.c_genre')},
{_scored('brand', 'i.c_brand')},
users AS (SELECT DISTINCT user_id FROM feedback),
cand AS (SELECT u.user_id, i.item_id,
           {_BLEND_W['label']} * coalesce(CASE WHEN a.n_dis = 0 AND a.n_like > 0 THEN a.score END, 0.0)
         + {_BLEND_W['genre']} * coalesce(CASE WHEN b.n_dis = 0 AND b.n_like > 0 THEN b.score END, 0.0)
         + {_BLEND_W['brand']} * coalesce(CASE WHEN c.n_dis = 0 AND c.n_like > 0 THEN c.score END, 0.0) AS score
         FROM users u CROSS JOIN items i
         LEFT JOIN ok_label a ON a.user_id = u.user_id AND a.cluster = i.c_label
         LEFT JOIN ok_genre b ON b.user_id = u.user_id AND b.cluster = i.c_genre
         LEFT JOIN ok_brand c ON c.user_id = u.user_id AND c.cluster = i.c_brand
         WHERE NOT EXISTS (SELECT 1 FROM fb x WHERE x.user_id = u.user_id AND x.item_id = i.item_id))
SELECT user_id, item_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM cand) z
WHERE rank <= {N}"""


def _fixed_assigns(spark, sf):
    v = _vec(spark, sf).select("item_id", F.col("genre").cast("string").alias("cluster"))
    cat = S.catalog(spark, sf).join(v.select("item_id"), "item_id", "left_semi")
    return {"label": v,
            "genre": cat.select("item_id", F.col("genre").alias("cluster")),
            "brand": cat.select("item_id", F.col("subgenre").alias("cluster"))}


@query("cluster_blend_fixed", _BLEND_SQL)
def cluster_blend_fixed(spark, sf):
    """0.4 / 0.3 / 0.3 blend over three fixed assignments (label, type, brand)."""
    a = _fixed_assigns(spark, sf)
    fb = S.feedback(spark, sf).join(a["genre"].select("item_id"), "item_id", "left_semi")
    return K.cluster_recommend(fb, a, _BLEND_W, N, S.feedback(spark, sf))


SVD_DIM = 20


def _reduced(spark, sf):
    """Vectors reduced to 20 dimensions, the input of all three methods."""
    red, _, _ = K.svd_reduce(_vec(spark, sf), SVD_DIM)
    return red.select("item_id", F.col("reduced").alias("features"))


def _model_assigns(spark, sf):
    v = _reduced(spark, sf)
    k = K.cluster_count(v.count())
    return {"kmeans": K.kmeans_assign(v, k, SEED, restarts=10),
            "gmm": K.gmm_assign(v, k, SEED, restarts=3),
            "hierarchical": K.hierarchical_assign(v, k, SEED)}


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    v = _reduced(spark, sf)
    a = K.kmeans_assign(v, K.cluster_count(v.count()), SEED)
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_items"))


@query("gmm_assign")
def gmm_assign(spark, sf):
    v = _reduced(spark, sf)
    a = K.gmm_assign(v, K.cluster_count(v.count()), SEED)
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_items"))


@query("hierarchical_assign")
def hierarchical_assign(spark, sf):
    """Bisecting k-means fitted on all rows."""
    v = _reduced(spark, sf)
    a = K.hierarchical_assign(v, K.cluster_count(v.count()), SEED)
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_items"))


@query("cluster_blend_recommend")
def cluster_blend_recommend(spark, sf):
    a = {m: d.select("item_id", F.col("cluster").cast("string").alias("cluster")) for m, d in _model_assigns(spark, sf).items()}
    return K.cluster_recommend(_fb_vec(spark, sf), a, {"kmeans": 0.4, "gmm": 0.3, "hierarchical": 0.3}, N, S.feedback(spark, sf))


# ------------------------------------------------------------------ interactions / CF
@query("index_ids", I.with_(I.INTERACTIONS) + """
SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_idx
FROM (SELECT DISTINCT item_id FROM interactions) t""")
def index_ids(spark, sf):
    return C.index_ids(S.interactions(spark, sf), "item_id", "item_idx")


@query("interaction_matrix", I.with_(I.INTERACTIONS) + "SELECT user_id, item_id, round(rating, 6) AS rating FROM interactions")
def interaction_matrix(spark, sf):
    return S.interactions(spark, sf).select("user_id", "item_id", r6("rating").alias("rating"))


@query("stratified_interactions", I.with_(I.CATALOG, I.INTERACTIONS) + f"""
, j AS (SELECT i.user_id, i.item_id, i.rating, c.genre FROM interactions i JOIN catalog c ON c.item_id = i.item_id),
g AS (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY {_h('user_id', 'genre')}, genre) AS gr
      FROM (SELECT DISTINCT user_id, genre FROM j) d),
gk AS (SELECT * FROM g WHERE gr <= 2 + {_hnum(_h('user_id'))} % 3),
k AS (SELECT j.*, row_number() OVER (PARTITION BY j.user_id, j.genre ORDER BY {_h('j.user_id', 'j.item_id')}, j.item_id) AS ir
      FROM j JOIN gk ON gk.user_id = j.user_id AND gk.genre = j.genre)
SELECT user_id, genre, item_id, round(rating, 6) AS rating FROM k WHERE ir <= 10 + {_hnum(_h('user_id', 'genre'))} % 21""")
def stratified_interactions(spark, sf):
    s = C.stratified_interactions(S.interactions(spark, sf), S.catalog(spark, sf), SEED)
    return s.select("user_id", "genre", "item_id", r6("rating").alias("rating"))


@query("uniform_interactions", I.with_(I.INTERACTIONS) + f"""
SELECT user_id, item_id, round(rating, 6) AS rating FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_h('user_id', 'item_id')}, item_id) AS ir FROM interactions) z
WHERE ir <= 50 + {_hnum(_h('user_id'))} % 150""")
def uniform_interactions(spark, sf):
    u = C.uniform_interactions(S.interactions(spark, sf), SEED)
    return u.select("user_id", "item_id", r6("rating").alias("rating"))


@query("override_user_row", I.with_(I.INTERACTIONS, I.FEEDBACK) + f"""
SELECT user_id, item_id, round(rating, 6) AS rating, 'interactions' AS source FROM interactions
WHERE user_id NOT IN (SELECT user_id FROM feedback)
UNION ALL
SELECT user_id, item_id, CAST(CASE WHEN label = 1 THEN {C.LIKE_RATING} ELSE {C.DISLIKE_RATING} END AS DOUBLE), 'feedback'
FROM feedback WHERE label <> 0""")
def override_user_row(spark, sf):
    """Customers with feedback replace their own interaction rows."""
    o = C.override_user_rows(S.interactions(spark, sf), S.feedback(spark, sf))
    return o.select("user_id", "item_id", r6("rating").alias("rating"), "source")


def _als(spark, sf):
    return C.als_train(S.interactions(spark, sf), rank=ALS_RANK, max_iter=ALS_ITER, seed=SEED)


@query("als_train")
def als_train(spark, sf):
    u, i = _als(spark, sf)
    size = F.first(F.size("x")).alias("rank")
    return u.agg(F.count(F.lit(1)).alias("n_factors"), size).unionByName(i.agg(F.count(F.lit(1)).alias("n_factors"), size))


@query("als_score")
def als_score(spark, sf):
    """Dot product of user and item factors for the observed pairs."""
    return C.als_score(_als(spark, sf), S.interactions(spark, sf))


# the stored 64-dimension vectors stand for fitted factors of both sides
_FACTORS = I.with_(I.VECTORS, I.INTERACTIONS)


def _stored_factors(spark, sf):
    v = _vec(spark, sf)
    return v.select(F.col("item_id").alias("user_id"), F.col("features").alias("x")), v.select("item_id", F.col("features").alias("x"), F.col("genre").cast("string").alias("genre"))


@query("als_score_fixed", _FACTORS + """
SELECT i.user_id, i.item_id, round(list_dot_product(u.features, v.features), 6) + 0.0 AS score
FROM interactions i JOIN vectors u ON u.item_id = i.user_id JOIN vectors v ON v.item_id = i.item_id""")
def als_score_fixed(spark, sf):
    """Scores of the observed pairs on stored factors."""
    u, i = _stored_factors(spark, sf)
    return C.als_score((u, i.drop("genre")), S.interactions(spark, sf)).withColumn("score", r6("score"))


@query("cf_topn_fixed", _FACTORS + f"""
SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT u.item_id AS user_id, v.item_id, round(list_dot_product(u.features, v.features), 6) + 0.0 AS score
    FROM vectors u CROSS JOIN vectors v
    WHERE v.genre <> u.genre AND NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.item_id AND i.item_id = v.item_id)) s) r
WHERE rank <= {N}""")
def cf_topn_fixed(spark, sf):
    """Top-n on stored factors without the pairs that interacted and without
    the genre of the user's own vector."""
    from tastemill.operators.mips import max_inner_product
    u, i = _stored_factors(spark, sf)
    own = i.select(F.col("item_id").alias("user_id"), "genre")
    return max_inner_product(u, i, N, S.interactions(spark, sf), own)


@query("cf_recommend")
def cf_recommend(spark, sf):
    """Pure CF: ALS top-n without the user's interacted items."""
    inter = S.interactions(spark, sf)
    return C.als_topn(_als(spark, sf), inter.select("user_id"), inter, N)


def mf_ratings(spark, sf, fb):
    """Interactions, with the pairs that have feedback rated by it."""
    return C.override_user_rows(S.interactions(spark, sf), fb, whole_rows=False)


@query("mf_recommend")
def mf_recommend(spark, sf):
    """Genre-aware CF: feedback overrides the interactions of its pairs, ALS
    masks rated items and fully disliked genres, takes 3n, then deals one
    item per genre per turn."""
    fb = S.feedback(spark, sf)
    cat = S.catalog(spark, sf)
    ratings = mf_ratings(spark, sf, fb)
    m = C.als_train(ratings, rank=ALS_RANK, max_iter=ALS_ITER, seed=SEED)
    fd = P.fully_disliked_genres(fb, cat)
    cands = C.als_topn(m, fb.select("user_id"), ratings, 3 * N, exclude_genres=fd, catalog=cat)
    return E.genre_round_robin(cands, cat, P.liked_genres(fb, cat), fd, N)


@query("mf_ratings", I.with_(I.INTERACTIONS, I.FEEDBACK) + f"""
SELECT user_id, item_id, round(rating, 6) AS rating, 'interactions' AS source FROM interactions i
WHERE NOT EXISTS (SELECT 1 FROM feedback f WHERE f.user_id = i.user_id AND f.item_id = i.item_id)
UNION ALL
SELECT user_id, item_id, CAST(CASE WHEN label = 1 THEN {C.LIKE_RATING} ELSE {C.DISLIKE_RATING} END AS DOUBLE), 'feedback'
FROM feedback WHERE label <> 0""")
def mf_ratings_query(spark, sf):
    """Both sources of the factor model."""
    o = mf_ratings(spark, sf, S.feedback(spark, sf))
    return o.select("user_id", "item_id", r6("rating").alias("rating"), "source")


_FRR_SQL = I.with_(I.CATALOG, I.FEEDBACK) + f"""
, lg AS (SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = 1),
dg AS (SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = -1),
fd AS (SELECT * FROM dg EXCEPT SELECT * FROM lg),
ng AS (SELECT count(DISTINCT genre) AS g FROM catalog),
users AS (SELECT DISTINCT user_id FROM feedback),
rel AS (SELECT u.user_id, (SELECT count(*) FROM fd WHERE fd.user_id = u.user_id) >= ng.g AS relax FROM users u, ng),
cand AS (SELECT r.user_id, c.item_id, c.genre, md5('{SEED}:' || CAST(c.item_id AS VARCHAR)) AS h,
                CASE WHEN lg.genre IS NULL THEN 0 ELSE 1 END AS is_liked
         FROM rel r CROSS JOIN catalog c
         LEFT JOIN lg ON lg.user_id = r.user_id AND lg.genre = c.genre
         WHERE (r.relax OR NOT EXISTS (SELECT 1 FROM fd WHERE fd.user_id = r.user_id AND fd.genre = c.genre))
           AND NOT EXISTS (SELECT 1 FROM feedback x WHERE x.user_id = r.user_id AND x.item_id = c.item_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, genre ORDER BY h, item_id) AS turn,
             min(h) OVER (PARTITION BY user_id, genre) AS first FROM cand)
SELECT user_id, item_id, genre, CAST(pos AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, is_liked DESC, first) AS pos FROM t) z
WHERE pos <= {N}"""


@query("fallback_round_robin", _FRR_SQL)
def fallback_round_robin(spark, sf):
    fb = S.feedback(spark, sf)
    cat = S.catalog(spark, sf)
    return C.fallback_round_robin(fb, cat, P.fully_disliked_genres(fb, cat), P.liked_genres(fb, cat), N, SEED)


@query("cf_fallback_random", I.with_(I.CATALOG, I.FEEDBACK) + f"""
, users AS (SELECT DISTINCT user_id FROM feedback),
cand AS (SELECT u.user_id, c.item_id, md5('{SEED}:' || CAST(c.item_id AS VARCHAR)) AS h FROM users u CROSS JOIN catalog c
         WHERE NOT EXISTS (SELECT 1 FROM feedback x WHERE x.user_id = u.user_id AND x.item_id = c.item_id))
SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, item_id) AS rank FROM cand) z WHERE rank <= {N}""")
def cf_fallback_random(spark, sf):
    fb = S.feedback(spark, sf)
    return C.random_unrated(fb, S.catalog(spark, sf), fb.select("user_id"), N, SEED)


@query("svd_reduce")
def svd_reduce(spark, sf):
    """Explained share per SVD component of the 64-d vectors (no centring)."""
    v = _vec(spark, sf)
    _, s, ratio = K.svd_reduce(v, 20)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, ratio))],
                                 "component int, singular_value double, explained double")


@query("svd_projection")
def svd_projection(spark, sf):
    """Vectors projected on the 20 leading right singular vectors."""
    out, _, _ = K.svd_reduce(_vec(spark, sf), 20)
    return out.select("item_id", "reduced")


_REP_COLS = ["price", "size", "n_orders", "avg_discount"]


def _rep_feats(spark, sf):
    from tastemill.operators.features import item_features
    f = item_features(S.catalog(spark, sf), _REP_COLS)
    return f.select("item_id", "genre", F.array(*_REP_COLS).alias("features"))


@query("cluster_representatives")
def cluster_representatives(spark, sf):
    """Cold-start picks: proportional genre quotas, one item per cluster of
    a k-means inside each genre, small genres whole, filled to 25."""
    from tastemill.operators import baselines as B
    cat = S.catalog(spark, sf)
    q = B.proportional_quota(cat, n=25).select("genre", "quota")
    return K.representatives(_rep_feats(spark, sf), 25, SEED, by="genre", quota=q)


@query("global_representatives")
def global_representatives(spark, sf):
    """No genre: k-means with k = n, one item per cluster."""
    return K.representatives(_rep_feats(spark, sf), 25, SEED)
