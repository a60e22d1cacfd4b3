"""Feedback normalisation and per-user profiles.

Profiles are one ``groupBy(user_id)`` over feedback ⋈ item features with
conditional averages, so the hash aggregate combines map-side and a user
with a huge history costs one partial row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.core import safe_div

# ---- fixed values --------------------------------------------------------
# answer letter -> label: l = liked, d = disliked, n = neutral
FEEDBACK_CODES = {"l": 1, "d": -1, "n": 0}
# --------------------------------------------------------------------------


def normalize_feedback(raw: DataFrame, answer_col: str = "answer") -> tuple[DataFrame, DataFrame]:
    """l / d / n (any case, padded) → label 1 / -1 / 0.

    Returns (accepted, rejected); rejected keeps the raw rows.
    """
    a = F.lower(F.trim(F.col(answer_col)))
    lab = (F.when(a == "l", 1).when(a == "d", -1).when(a == "n", 0))
    tagged = raw.withColumn("label", lab)
    return (tagged.filter(F.col("label").isNotNull()),
            tagged.filter(F.col("label").isNull()).drop("label"))


def merge_feedback_rounds(*rounds: DataFrame) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def user_profile_mean(feedback: DataFrame, feats: DataFrame, cols: list[str]) -> DataFrame:
    """(user_id, n_like, n_dislike, like_<c>, dislike_<c>) per user."""
    j = feedback.select("user_id", "item_id", "label").join(feats.select("item_id", *cols), "item_id")
    aggs = [F.count_if(F.col("label") == 1).alias("n_like"),
            F.count_if(F.col("label") == -1).alias("n_dislike")]
    for c in cols:
        aggs.append(F.avg(F.when(F.col("label") == 1, F.col(c))).alias(f"like_{c}"))
        aggs.append(F.avg(F.when(F.col("label") == -1, F.col(c))).alias(f"dislike_{c}"))
    return j.groupBy("user_id").agg(*aggs)


def feature_importance(feedback: DataFrame, feats: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (user_id, feature, weight), weights summing to 1 per user.

    More than one like: w_f = 1/(var_pop_f(liked)+0.1), normalised; else all
    ones. With dislikes, w_f *= |mean_liked_f -
    mean_disliked_f| and renormalised. Stateless: every user starts from
    ones.
    """
    j = feedback.select("user_id", "item_id", "label").join(feats.select("item_id", *cols), "item_id")
    aggs = [F.count_if(F.col("label") == 1).alias("n_like"),
            F.count_if(F.col("label") == -1).alias("n_dislike")]
    for c in cols:
        liked = F.when(F.col("label") == 1, F.col(c))
        aggs += [F.var_pop(liked).alias(f"v_{c}"), F.avg(liked).alias(f"ml_{c}"),
                 F.avg(F.when(F.col("label") == -1, F.col(c))).alias(f"md_{c}")]
    prof = j.groupBy("user_id").agg(*aggs)
    stack = ", ".join(f"'{c}', `v_{c}`, `ml_{c}`, `md_{c}`" for c in cols)
    long = prof.selectExpr("user_id", "n_like", "n_dislike",
                           f"stack({len(cols)}, {stack}) as (feature, v, ml, md)")
    base = F.when(F.col("n_like") > 1, 1.0 / (F.col("v") + F.lit(0.1))).otherwise(F.lit(1.0))
    from pyspark.sql import Window
    w = Window.partitionBy("user_id")
    long = long.withColumn("w0", base).withColumn(
        "w1", F.when(F.col("n_like") > 1, safe_div(F.col("w0"), F.sum("w0").over(w))).otherwise(F.col("w0")))
    sep = F.abs(F.col("ml") - F.col("md"))
    long = long.withColumn(
        "w2", F.when(F.col("n_dislike") > 0, F.col("w1") * sep).otherwise(F.col("w1")))
    long = long.withColumn("weight", F.when(
        F.col("n_dislike") > 0, F.coalesce(safe_div(F.col("w2"), F.sum("w2").over(w)), F.col("w1"))
    ).otherwise(F.col("w1")))
    return long.select("user_id", "feature", "weight")


def liked_genres(feedback: DataFrame, catalog: DataFrame, genre_col: str = "genre") -> DataFrame:
    """Distinct (user_id, genre) over liked items."""
    return (feedback.filter(F.col("label") == 1).select("user_id", "item_id")
            .join(catalog.select("item_id", genre_col), "item_id")
            .select("user_id", F.col(genre_col).alias("genre")).distinct())


def disliked_genres(feedback: DataFrame, catalog: DataFrame, genre_col: str = "genre") -> DataFrame:
    return (feedback.filter(F.col("label") == -1).select("user_id", "item_id")
            .join(catalog.select("item_id", genre_col), "item_id")
            .select("user_id", F.col(genre_col).alias("genre")).distinct())


def fully_disliked_genres(feedback: DataFrame, catalog: DataFrame, genre_col: str = "genre") -> DataFrame:
    """Disliked genres minus liked genres, per user (anti join)."""
    return disliked_genres(feedback, catalog, genre_col).join(
        liked_genres(feedback, catalog, genre_col), ["user_id", "genre"], "left_anti")


def genre_distribution(items: DataFrame, catalog: DataFrame, by: list[str] | None = None,
                       genre_col: str = "genre") -> DataFrame:
    """Count of distinct items per genre (optionally per ``by``)."""
    by = by or []
    j = items.select(*by, "item_id").join(catalog.select("item_id", genre_col), "item_id")
    return j.groupBy(*by, F.col(genre_col).alias("genre")).agg(
        F.countDistinct("item_id").alias("n_items"))
