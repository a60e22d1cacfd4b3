"""Recommendation queries over the test tables (catalogue = part,
feedback = orders ⋈ lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6

from tastemill.operators import baselines as B
from tastemill.operators.features import item_features
from tastemill.plans import inputs as I
from tastemill.plans.registry import query
from tastemill.sources import tables as S

N = 15
SEED = 42
# pruned features: the price (a rating-like value) and the order count (popularity)
PRUNED_COLS = ["price", "n_orders"]


def _sq(a: str, b: str) -> str:
    return f"({a} - {b}) * ({a} - {b})"


_near = " + ".join(_sq(f"f.{c}", f"p.l_{c}") for c in PRUNED_COLS)
_far = " + ".join(_sq(f"f.{c}", f"p.d_{c}") for c in PRUNED_COLS)
_prof = ", ".join(f"avg(CASE WHEN fb.label = 1 THEN f.{c} END) AS l_{c}, "
                  f"avg(CASE WHEN fb.label = -1 THEN f.{c} END) AS d_{c}" for c in PRUNED_COLS)

PRUNED_SQL = I.with_(I.CATALOG, I.FEEDBACK, I.feats(PRUNED_COLS)) + f"""
, prof AS (
  SELECT fb.user_id, count_if(fb.label = 1) AS n_like, count_if(fb.label = -1) AS n_dislike, {_prof}
  FROM feedback fb JOIN feats f ON f.item_id = fb.item_id
  GROUP BY fb.user_id HAVING count_if(fb.label = 1) > 0),
sc AS (
  SELECT p.user_id, f.item_id,
         -({_near}) + CASE WHEN p.n_dislike > 0 THEN 0.5 * ({_far}) ELSE 0.0 END AS score
  FROM prof p CROSS JOIN feats f
  WHERE NOT EXISTS (SELECT 1 FROM feedback x WHERE x.user_id = p.user_id AND x.item_id = f.item_id))
SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rank
  FROM sc) t WHERE rank <= {N}"""


@query("pruned_recommend", PRUNED_SQL)
def pruned_recommend(spark, sf):
    feats = item_features(S.catalog(spark, sf), PRUNED_COLS)
    return B.pruned_recommend(S.feedback(spark, sf), feats, PRUNED_COLS, n=N)


GENRE_SQL = I.with_(I.CATALOG, I.FEEDBACK) + f"""
, users AS (SELECT DISTINCT user_id FROM feedback WHERE label = 1),
lg AS (SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id
       WHERE fb.label = 1),
cand AS (
  SELECT u.user_id, c.item_id, CASE WHEN lg.genre IS NOT NULL THEN 0 ELSE 1 END AS tier,
         md5('{SEED}:' || CAST(c.item_id AS VARCHAR)) AS h
  FROM users u CROSS JOIN catalog c
  LEFT JOIN lg ON lg.user_id = u.user_id AND lg.genre = c.genre
  WHERE NOT EXISTS (SELECT 1 FROM feedback x WHERE x.user_id = u.user_id AND x.item_id = c.item_id))
SELECT user_id, item_id, tier, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, h, item_id) AS rank FROM cand) t
WHERE rank <= {N}"""


@query("genre_based_recommend", GENRE_SQL)
def genre_based_recommend(spark, sf):
    return B.genre_based_recommend(S.feedback(spark, sf), S.catalog(spark, sf), n=N, seed=SEED)


POP_SQL = I.with_(I.CATALOG, I.FEEDBACK) + f"""
, thr AS (SELECT quantile_cont(n_orders, 0.8) AS t FROM catalog),
users AS (SELECT DISTINCT user_id FROM feedback),
cand AS (
  SELECT u.user_id, c.item_id, CASE WHEN c.n_orders >= thr.t THEN 0 ELSE 1 END AS tier,
         md5('{SEED}:' || CAST(c.item_id AS VARCHAR)) AS h
  FROM users u CROSS JOIN catalog c CROSS JOIN thr
  WHERE NOT EXISTS (SELECT 1 FROM feedback x WHERE x.user_id = u.user_id AND x.item_id = c.item_id))
SELECT user_id, item_id, tier, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, h, item_id) AS rank FROM cand) t
WHERE rank <= {N}"""


@query("popularity_recommend", POP_SQL)
def popularity_recommend(spark, sf):
    return B.popularity_recommend(S.feedback(spark, sf), S.catalog(spark, sf), "n_orders", n=N, seed=SEED)


THRESH_SQL = I.with_(I.CATALOG) + """
SELECT round(quantile_cont(n_orders, 0.8), 6) AS threshold,
       count_if(n_orders >= quantile_cont(n_orders, 0.8) OVER ()) AS n_popular FROM catalog"""

THRESH_SQL = I.with_(I.CATALOG) + """
, t AS (SELECT quantile_cont(n_orders, 0.8) AS thr FROM catalog)
SELECT round(t.thr, 6) AS threshold, CAST(count(*) AS BIGINT) AS n_popular
FROM catalog c, t WHERE c.n_orders >= t.thr GROUP BY t.thr"""


@query("popularity_threshold", THRESH_SQL)
def popularity_threshold(spark, sf):
    cat = S.catalog(spark, sf)
    t = B.popularity_threshold(cat, "n_orders", 0.8)
    return (cat.filter(F.col("n_orders") >= F.lit(t))
            .agg(F.count(F.lit(1)).alias("n_popular"))
            .select(r6(F.lit(t)).alias("threshold"), "n_popular"))


CS_N = 25
COLDSTART_SQL = I.with_(I.CATALOG) + f"""
, params AS (SELECT greatest(1, {CS_N} // count(DISTINCT genre)) AS per,
                    greatest(1, {CS_N} // count(DISTINCT genre)) // 2 AS half FROM catalog),
c AS (SELECT item_id, genre, md5('{SEED}:' || CAST(item_id AS VARCHAR)) AS h,
             row_number() OVER (PARTITION BY genre ORDER BY n_orders DESC, item_id) AS vr FROM catalog),
tv AS (SELECT item_id, genre, vr AS slot FROM c, params WHERE vr <= half),
rs AS (SELECT item_id, genre, row_number() OVER (PARTITION BY genre ORDER BY h, item_id) + half AS slot
       FROM c, params WHERE vr > half),
rnd AS (SELECT item_id, genre, slot FROM rs, params WHERE slot <= 2 * half),
sel AS (SELECT item_id, row_number() OVER (ORDER BY genre, slot) AS o FROM (
          SELECT * FROM tv UNION ALL SELECT * FROM rnd) u),
chosen AS (SELECT item_id, CAST(o AS DOUBLE) AS o, 0 AS tier FROM sel WHERE o <= {CS_N}),
extra AS (SELECT item_id, CAST(row_number() OVER (ORDER BY h, item_id) AS DOUBLE) AS o, 1 AS tier
          FROM (SELECT item_id, h FROM c ORDER BY h, item_id LIMIT {2 * CS_N}) x),
best AS (SELECT item_id, tier, o FROM (
           SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tier, o) AS k
           FROM (SELECT * FROM chosen UNION ALL SELECT * FROM extra) a) b WHERE k = 1)
SELECT item_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT item_id, row_number() OVER (ORDER BY tier, o, item_id) AS rank FROM best) z
WHERE rank <= {CS_N}"""


@query("coldstart_mix", COLDSTART_SQL)
def coldstart_mix(spark, sf):
    return B.coldstart_mix(S.catalog(spark, sf), n=CS_N, seed=SEED)


QUOTA_SQL = I.with_(I.CATALOG) + f"""
, cnt AS (SELECT genre, count(*) AS cnt FROM catalog GROUP BY genre),
q AS (SELECT genre, cnt, greatest(1, CAST(floor({CS_N} * (cnt / sum(cnt) OVER ())) AS INTEGER)) AS base FROM cnt),
q2 AS (SELECT *, sum(base) OVER () AS total,
              row_number() OVER (ORDER BY cnt DESC, genre) AS desc_rank,
              CASE WHEN base > 1 THEN row_number() OVER (
                 ORDER BY CASE WHEN base > 1 THEN 0 ELSE 1 END, cnt ASC, genre DESC) END AS asc_rank_elig
       FROM q)
SELECT genre, CAST(cnt AS BIGINT) AS n_items,
       CAST(CASE WHEN total < {CS_N} THEN base + CASE WHEN desc_rank <= {CS_N} - total THEN 1 ELSE 0 END
                 WHEN total > {CS_N} THEN base - CASE WHEN base > 1 AND asc_rank_elig <= total - {CS_N} THEN 1 ELSE 0 END
                 ELSE base END AS INTEGER) AS quota
FROM q2"""


@query("proportional_quota", QUOTA_SQL)
def proportional_quota(spark, sf):
    return B.proportional_quota(S.catalog(spark, sf), n=CS_N)


TOPUP_SQL = I.with_(I.CATALOG, I.FEEDBACK) + f"""
, chosen AS (SELECT user_id, item_id, CAST(r AS DOUBLE) AS o, 0 AS tier FROM (
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS r
    FROM feedback WHERE label = 1) c WHERE r <= 3),
users AS (SELECT DISTINCT user_id FROM chosen),
pool AS (SELECT item_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(item_id AS VARCHAR)), item_id) AS pos
         FROM catalog),
extra AS (SELECT u.user_id, p.item_id, CAST(p.pos AS DOUBLE) AS o, 1 AS tier FROM users u JOIN pool p ON p.pos <= 20),
best AS (SELECT user_id, item_id, tier, o FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY tier, o) AS k
    FROM (SELECT * FROM chosen UNION ALL SELECT * FROM extra) a) b WHERE k = 1)
SELECT user_id, item_id, tier, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, o, item_id) AS rank FROM best) z
WHERE rank <= 10"""


@query("top_up", TOPUP_SQL)
def top_up_q(spark, sf):
    """Short lists (each user's first three liked items) filled to ten with
    catalogue items in hash order, never repeating a chosen item."""
    from pyspark.sql import Window
    fb = S.feedback(spark, sf).filter(F.col("label") == 1)
    chosen = (fb.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("item_id")))
              .filter(F.col("rank") <= 3).select("user_id", "item_id", "rank"))
    return B.top_up(chosen, S.catalog(spark, sf).select("item_id"), 10, SEED)


def _disp(sql_name: str, sql: str) -> str:
    return f"""SELECT '{sql_name}' AS strategy, r.user_id, r.rank, r.item_id, c.title, c.subgenre AS artist, c.genre,
       round(c.price, 6) AS rating FROM ({sql}) r JOIN ({I.with_(I.CATALOG)} SELECT * FROM catalog) c ON c.item_id = r.item_id"""


@query("recs_display", _disp("genre", GENRE_SQL) + "\nUNION ALL\n" + _disp("popularity", POP_SQL))
def recs_display(spark, sf):
    """Two strategies side by side with display columns."""
    from tastemill.functions.core import r6
    cat = S.catalog(spark, sf).select("item_id", "title", F.col("subgenre").alias("artist"), "genre",
                                      r6("price").alias("rating"))
    fb = S.feedback(spark, sf)
    g = B.genre_based_recommend(fb, S.catalog(spark, sf), n=N, seed=SEED).withColumn("strategy", F.lit("genre"))
    p = B.popularity_recommend(fb, S.catalog(spark, sf), "n_orders", n=N, seed=SEED).withColumn("strategy", F.lit("popularity"))
    recs = g.unionByName(p).select("strategy", "user_id", "rank", "item_id")
    return recs.join(cat, "item_id").select("strategy", "user_id", "rank", "item_id", "title", "artist", "genre", "rating")
