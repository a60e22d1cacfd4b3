"""Hygiene, projection, scalar/array and feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import parse_genres, r6, snippet
from tastemill.operators import features as X
from tastemill.operators import profiles as P
from tastemill.plans import inputs as I
from tastemill.plans.registry import query
from tastemill.sources import tables as S

FEATS = ["price", "size", "n_orders", "qty", "avg_price", "avg_discount"]
POLY = ["price", "size", "n_orders"]


def _cat(spark, sf):
    return S.catalog(spark, sf)


@query("scan_catalog", I.with_(I.CATALOG) + """
SELECT genre, CAST(count(*) AS BIGINT) AS n_items, round(sum(price), 6) AS sum_price,
       round(avg(n_orders), 6) AS avg_orders FROM catalog GROUP BY genre""")
def scan_catalog(spark, sf):
    return (_cat(spark, sf).groupBy("genre")
            .agg(F.count(F.lit(1)).alias("n_items"), r6(F.sum("price")).alias("sum_price"),
                 r6(F.avg("n_orders")).alias("avg_orders")))


# lineitem with holes made from its own values (the table itself has no null)
_HOLES_SQL = """holes AS (SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
  nullif(l_linestatus, 'O') AS l_linestatus) FROM lineitem)"""


def _holes(spark, sf):
    li = S.read_table(spark, sf, "lineitem")
    return li.withColumns({"l_discount": F.nullif(F.col("l_discount"), F.lit(0)), "l_tax": F.nullif(F.col("l_tax"), F.lit(0)),
                           "l_linestatus": F.nullif(F.col("l_linestatus"), F.lit("O"))})


@query("null_profile", f"""WITH {_HOLES_SQL}
SELECT 'l_orderkey' AS column_name, CAST(count_if(l_orderkey IS NULL) AS BIGINT) AS n_null FROM holes
UNION ALL SELECT 'l_partkey', count_if(l_partkey IS NULL) FROM holes
UNION ALL SELECT 'l_suppkey', count_if(l_suppkey IS NULL) FROM holes
UNION ALL SELECT 'l_linenumber', count_if(l_linenumber IS NULL) FROM holes
UNION ALL SELECT 'l_quantity', count_if(l_quantity IS NULL) FROM holes
UNION ALL SELECT 'l_extendedprice', count_if(l_extendedprice IS NULL) FROM holes
UNION ALL SELECT 'l_discount', count_if(l_discount IS NULL) FROM holes
UNION ALL SELECT 'l_tax', count_if(l_tax IS NULL) FROM holes
UNION ALL SELECT 'l_returnflag', count_if(l_returnflag IS NULL) FROM holes
UNION ALL SELECT 'l_linestatus', count_if(l_linestatus IS NULL) FROM holes
UNION ALL SELECT 'l_shipdate', count_if(l_shipdate IS NULL) FROM holes""")
def null_profile(spark, sf):
    return X.null_profile(_holes(spark, sf))


@query("load_audit", I.with_(I.CATALOG) + """
SELECT CAST(count(*) AS BIGINT) AS rows_before,
       CAST(count_if(n_orders IS NOT NULL AND title IS NOT NULL AND size <= 45) AS BIGINT) AS rows_after,
       CAST(count(*) - count_if(n_orders IS NOT NULL AND title IS NOT NULL AND size <= 45) AS BIGINT) AS rows_removed
FROM catalog""")
def load_audit(spark, sf):
    """Titles of the largest sizes are blanked, so there is something to drop."""
    cat = _cat(spark, sf)
    cat = cat.withColumn("title", F.when(F.col("size") <= 45, F.col("title")))
    return X.load_audit(cat, X.drop_null_keys(cat, ["title", "n_orders", "not_a_column"]))


@query("drop_any_null", f"""WITH {_HOLES_SQL}
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows FROM holes
WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL
  AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL
  AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_shipdate IS NOT NULL
GROUP BY l_returnflag""")
def drop_any_null(spark, sf):
    return (X.drop_any_null(_holes(spark, sf))
            .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows")))


@query("assign_item_id", """
SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS BIGINT) AS item_id
FROM customer""")
def assign_item_id(spark, sf):
    cust = S.read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return X.assign_item_id(cust, None, ["c_name", "c_custkey"]).select("c_custkey", "c_mktsegment", "item_id")


@query("dedupe_ids", """
SELECT l_partkey AS item_id, min_by(l_orderkey, l_orderkey * 1000 + l_linenumber) AS first_order,
       CAST(count(*) AS BIGINT) AS n_seen
FROM lineitem GROUP BY l_partkey""")
def dedupe_ids(spark, sf):
    li = S.read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("first_order"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("pos"))
    cnt = li.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_seen"))
    return X.dedupe_ids(li, "item_id", "pos").join(cnt, "item_id").select("item_id", "first_order", "n_seen")


@query("feature_projection", I.with_(I.CATALOG) + """
SELECT item_id, round(price, 6) AS price, round(size, 6) AS size, round(n_orders, 6) AS n_orders, round(qty, 6) AS qty,
       round(avg_price + 1e-9, 6) AS avg_price, round(avg_discount + 1e-9, 6) AS avg_discount FROM catalog""")
def feature_projection(spark, sf):
    cat = _cat(spark, sf)
    from tastemill.functions.core import pick_columns
    cols = pick_columns(cat, FEATS + ["vote_average", "popularity"])   # keep the ones that exist
    # averages of two-decimal values can sit exactly on a rounding tie; a
    # 1e-9 nudge (far below their spacing) makes both engines round alike
    nudge = {"avg_price", "avg_discount"}
    return cat.select("item_id", *[r6(F.col(c) + (1e-9 if c in nudge else 0.0)).alias(c) for c in cols])


@query("display_projection", I.with_(I.CATALOG) + """
SELECT item_id, title, coalesce(genre, 'Unknown') AS genre, subgenre AS artist,
       'Part' AS item_type, round(price, 6) AS rating FROM catalog""")
def display_projection(spark, sf):
    cat = _cat(spark, sf)
    return cat.select("item_id", "title", F.coalesce("genre", F.lit("Unknown")).alias("genre"),
                      F.col("subgenre").alias("artist"), F.lit("Part").alias("item_type"),
                      r6("price").alias("rating"))


@query("parse_genres", """
SELECT p_partkey AS item_id, string_split(trim(p_name), ' ') AS genres FROM part""")
def parse_genres_q(spark, sf):
    p = S.read_table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item_id"), parse_genres("p_name", " ").alias("genres"))


@query("genre_vocabulary", """
SELECT DISTINCT g AS genre FROM (SELECT unnest(string_split(p_name, ' ')) AS g FROM part) t WHERE g <> ''""")
def genre_vocabulary(spark, sf):
    return X.genre_vocabulary(_cat(spark, sf), "genres")


@query("multi_hot_genres")
def multi_hot_genres(spark, sf):
    cat = _cat(spark, sf)
    vocab = X.collect_vocabulary(X.genre_vocabulary(cat, "genres"))
    return X.multi_hot(cat.select("item_id", "genres"), "genres", vocab).drop("genres")


@query("multi_hot_sparse", """
WITH g AS (SELECT DISTINCT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS genre FROM part),
v AS (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS idx FROM (SELECT DISTINCT genre FROM g WHERE genre <> '') d)
SELECT p.p_partkey AS item_id, v.genre, CAST(v.idx AS BIGINT) AS idx, CAST(1 AS INTEGER) AS value
FROM part p LEFT JOIN g ON g.item_id = p.p_partkey JOIN v ON v.genre = g.genre""")
def multi_hot_sparse(spark, sf):
    """The sparse vectors, spelled out by joining the vocabulary back."""
    cat = _cat(spark, sf)
    index = X.vocabulary_index(X.genre_vocabulary(cat, "genres"))
    rows = X.multi_hot_sparse(cat, index).select("item_id", F.explode(F.arrays_zip("indices", "values")).alias("z"))
    return rows.select("item_id", F.col("z.indices").alias("idx"), F.col("z.values").alias("value")).join(index, "idx").select("item_id", "genre", "idx", "value")


@query("multi_hot_counts", """
SELECT g AS genre, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n_items
FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS g FROM part) t GROUP BY g""")
def multi_hot_counts(spark, sf):
    cat = _cat(spark, sf)
    vocab = X.collect_vocabulary(X.genre_vocabulary(cat, "genres"))
    mh = X.multi_hot(cat.select("item_id", "genres"), "genres", vocab)
    stack = ", ".join(f"'{g}', `genre_{g}`" for g in vocab)
    return (mh.agg(*[F.sum(f"genre_{g}").cast("bigint").alias(f"genre_{g}") for g in vocab])
            .selectExpr(f"stack({len(vocab)}, {stack}) as (genre, n_items)"))


@query("one_hot_label", """
SELECT p_partkey AS item_id,
       CAST(p_type = 'ECONOMY' AS INTEGER) AS genre_ECONOMY, CAST(p_type = 'LARGE' AS INTEGER) AS genre_LARGE,
       CAST(p_type = 'MEDIUM' AS INTEGER) AS genre_MEDIUM, CAST(p_type = 'PROMO' AS INTEGER) AS genre_PROMO,
       CAST(p_type = 'SMALL' AS INTEGER) AS genre_SMALL, CAST(p_type = 'STANDARD' AS INTEGER) AS genre_STANDARD
FROM part""")
def one_hot_label(spark, sf):
    cat = _cat(spark, sf)
    vals = X.collect_vocabulary(cat.select("genre").distinct(), "genre")
    return X.one_hot(cat.select("item_id", "genre"), "genre", vals).drop("genre")


@query("map_encode", I.with_(I.REGRESSION) + """
SELECT priority, CAST(count(*) AS BIGINT) AS n_rows FROM regression GROUP BY priority""")
def map_encode(spark, sf):
    return S.regression_rows(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n_rows"))


@query("primary_secondary_genre", """
SELECT p_partkey AS item_id, coalesce(string_split(p_name, ' ')[1], 'Unknown') AS primary_genre,
       coalesce(string_split(p_name, ' ')[2], string_split(p_name, ' ')[1], 'Unknown') AS secondary_genre
FROM part""")
def primary_secondary_genre(spark, sf):
    cat = _cat(spark, sf)
    a, b = X.primary_secondary("genres")
    return cat.select("item_id", a.alias("primary_genre"), b.alias("secondary_genre"))


@query("release_year", I.with_(I.CATALOG) + """
, y AS (SELECT item_id, CAST(year(first_ship) AS DOUBLE) AS yr FROM catalog),
m AS (SELECT median(yr) AS med FROM y),
f AS (SELECT item_id, coalesce(yr, m.med) AS yr FROM y, m),
s AS (SELECT avg(yr) AS a, stddev_pop(yr) AS sd FROM f)
SELECT item_id, round((yr - s.a) / (CASE WHEN s.sd = 0 OR s.sd IS NULL THEN 1.0 ELSE s.sd END), 6) AS release_year
FROM f, s""")
def release_year(spark, sf):
    cat = _cat(spark, sf).select("item_id", X.release_year("first_ship").alias("release_year"))
    z = X.standard_scale(X.impute(cat, ["release_year"], "median"), ["release_year"])
    return z.select("item_id", r6("release_year").alias("release_year"))


@query("overview_snippet", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS overview,
       length(CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END) AS n_chars
FROM documents""")
def overview_snippet(spark, sf):
    d = S.read_table(spark, sf, "documents")
    s = snippet("text")
    return d.select("doc_id", s.alias("overview"), F.length(s).alias("n_chars"))


@query("genre_string", """
SELECT p_partkey AS item_id, array_to_string(string_split(p_name, ' '), ', ') AS genre_string FROM part""")
def genre_string(spark, sf):
    return _cat(spark, sf).select("item_id", F.array_join("genres", ", ").alias("genre_string"))


@query("genre_overlap_filter", I.with_(I.CATALOG, I.FEEDBACK) + """
, lg AS (SELECT DISTINCT fb.user_id, g FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id,
         unnest(c.genres) AS t(g) WHERE fb.label = 1),
ig AS (SELECT DISTINCT c.item_id, g FROM catalog c, unnest(c.genres) AS t(g))
SELECT user_id, CAST(count(DISTINCT item_id) AS BIGINT) AS n_overlap
FROM lg JOIN ig ON ig.g = lg.g GROUP BY user_id""")
def genre_overlap_filter(spark, sf):
    """Items sharing at least one word-genre with a user's likes, counted
    per user. Items with the same genre set (signature) behave alike, and so
    do users with the same set of liked words: signatures are counted once,
    matched per distinct user set, and never joined item by item."""
    cat = _cat(spark, sf)
    fb = S.feedback(spark, sf)
    lg = (fb.filter("label = 1").join(cat.select("item_id", "genres"), "item_id")
          .select("user_id", F.explode("genres").alias("g")).distinct())
    sets = lg.groupBy("user_id").agg(F.sort_array(F.collect_set("g")).alias("liked"))   # at most a vocabulary long
    items = cat.groupBy("item_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("genres")))).alias("sig"))
    sigs = items.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    by_word = sigs.select("sig", "n", F.explode("sig").alias("g"))
    hits = (sets.select("liked").distinct().withColumn("g", F.explode("liked")).join(by_word, "g")
            .groupBy("liked", "sig").agg(F.first("n").alias("n"))
            .groupBy("liked").agg(F.sum("n").alias("n_overlap")))
    return sets.join(hits, "liked").select("user_id", F.col("n_overlap").cast("bigint").alias("n_overlap"))


@query("unrated_filter", I.with_(I.CATALOG, I.FEEDBACK) + """
, u AS (SELECT DISTINCT user_id FROM feedback)
SELECT u.user_id, CAST((SELECT count(*) FROM catalog) - count(DISTINCT f.item_id) AS BIGINT) AS n_unrated
FROM u JOIN feedback f ON f.user_id = u.user_id JOIN catalog c ON c.item_id = f.item_id GROUP BY u.user_id""")
def unrated_filter(spark, sf):
    """Unrated items per user as a count: |catalogue| - |rated ∩ catalogue|.
    The anti join itself is used inside every recommender; materialising
    users × unrated items here would be the product the engine avoids."""
    cat = _cat(spark, sf).select("item_id")
    n_items = cat.count()
    rated = S.feedback(spark, sf).select("user_id", "item_id").join(cat, "item_id", "left_semi")
    return rated.groupBy("user_id").agg((F.lit(n_items) - F.countDistinct("item_id")).cast("bigint").alias("n_unrated"))


@query("rated_lookup", I.with_(I.CATALOG, I.FEEDBACK) + """
SELECT c.genre, CAST(count(*) AS BIGINT) AS n_rated, CAST(count_if(f.label = 1) AS BIGINT) AS n_liked
FROM feedback f JOIN catalog c ON c.item_id = f.item_id GROUP BY c.genre""")
def rated_lookup(spark, sf):
    fb = S.feedback(spark, sf)
    cat = _cat(spark, sf)
    return (fb.join(cat.select("item_id", "genre"), "item_id")
            .groupBy("genre").agg(F.count(F.lit(1)).alias("n_rated"),
                                  F.count_if(F.col("label") == 1).alias("n_liked")))


# ------------------------------------------------------------- imputation / scaling
@query("impute_median", I.with_(I.CATALOG) + """
, m AS (SELECT median(n_orders) AS mo, median(qty) AS mq FROM catalog)
SELECT item_id, round(coalesce(n_orders, m.mo), 6) AS n_orders, round(coalesce(qty, m.mq), 6) AS qty
FROM catalog, m""")
def impute_median(spark, sf):
    c = X.impute(_cat(spark, sf).select("item_id", "n_orders", "qty"), ["n_orders", "qty"], "median")
    return c.select("item_id", r6("n_orders").alias("n_orders"), r6("qty").alias("qty"))


@query("impute_mean", I.with_(I.REGRESSION) + """
, m AS (SELECT avg(acctbal) AS a, avg(priority) AS p FROM regression)
SELECT order_id, round(coalesce(acctbal, m.a), 6) AS acctbal, round(coalesce(priority, m.p), 6) AS priority
FROM regression, m""")
def impute_mean(spark, sf):
    r = X.impute(S.regression_rows(spark, sf).select("order_id", "acctbal", "priority"),
                 ["acctbal", "priority"], "mean")
    return r.select("order_id", r6("acctbal").alias("acctbal"), r6("priority").alias("priority"))


@query("fill_zero", I.with_(I.CATALOG) + """
SELECT item_id, round(coalesce(avg_discount, 0.0) + 1e-9, 6) AS avg_discount FROM catalog""")
def fill_zero(spark, sf):
    c = X.fill_zero(_cat(spark, sf).select("item_id", "avg_discount"), ["avg_discount"])
    return c.select("item_id", r6(F.col("avg_discount") + 1e-9).alias("avg_discount"))


_zsel = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATS)


@query("standard_scale", I.with_(I.CATALOG, I.feats(FEATS)) + f"SELECT item_id, {_zsel} FROM feats")
def standard_scale(spark, sf):
    z = X.item_features(_cat(spark, sf), FEATS)
    return z.select("item_id", *[r6(c).alias(c) for c in FEATS])


@query("minmax_scale", I.with_(I.CATALOG) + """
, m AS (SELECT min(price) AS lp, max(price) AS hp, min(size) AS ls, max(size) AS hs FROM catalog)
SELECT item_id,
       round(CASE WHEN hp - lp = 0 THEN 0.0 ELSE (price - lp) / (hp - lp) END, 6) AS price,
       round(CASE WHEN hs - ls = 0 THEN 0.0 ELSE (size - ls) / (hs - ls) END, 6) AS size
FROM catalog, m""")
def minmax_scale(spark, sf):
    c = X.minmax_scale(_cat(spark, sf).select("item_id", "price", "size"), ["price", "size"])
    return c.select("item_id", r6("price").alias("price"), r6("size").alias("size"))


_pairs = [(a, b) for i, a in enumerate(POLY) for b in POLY[i:]]
_poly_sql = ", ".join(f"round(f.{a} * f.{b}, 6) + 0.0 AS {a}_{b}" for a, b in _pairs)


@query("poly2_features", I.with_(I.CATALOG, I.feats(POLY)) + f"SELECT f.item_id, {_poly_sql} FROM feats f")
def poly2_features(spark, sf):
    z = X.item_features(_cat(spark, sf), POLY)
    p, names = X.poly2_features(z, POLY)
    return p.select("item_id", *[r6(n).alias(n) for n in names])


@query("feature_assembly", I.with_(I.CATALOG, I.feats(POLY)) + f"""
SELECT f.item_id, list_transform([f.price, f.size, f.n_orders,
       {", ".join(f"f.{a} * f.{b}" for a, b in _pairs)},
       CASE WHEN f.genre = 'ECONOMY' THEN 1.0 ELSE 0.0 END, CASE WHEN f.genre = 'LARGE' THEN 1.0 ELSE 0.0 END,
       CASE WHEN f.genre = 'MEDIUM' THEN 1.0 ELSE 0.0 END, CASE WHEN f.genre = 'PROMO' THEN 1.0 ELSE 0.0 END,
       CASE WHEN f.genre = 'SMALL' THEN 1.0 ELSE 0.0 END, CASE WHEN f.genre = 'STANDARD' THEN 1.0 ELSE 0.0 END],
       lambda x: round(x, 6) + 0.0) AS features
FROM feats f""")
def feature_assembly(spark, sf):
    from tastemill.operators.assemble import assemble_item_vectors
    return assemble_item_vectors(_cat(spark, sf), POLY).select(
        "item_id", F.transform("features", lambda x: r6(x)).alias("features"))


# -------------------------------------------------------------------- feedback / profiles
@query("normalize_feedback", """
SELECT CASE WHEN lower(trim(a)) = 'l' THEN 1 WHEN lower(trim(a)) = 'd' THEN -1
            WHEN lower(trim(a)) = 'n' THEN 0 END AS label, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'maybe'
                  WHEN l_returnflag = 'A' THEN ' L' WHEN l_returnflag = 'R' THEN 'd ' ELSE 'n' END AS a
      FROM lineitem) t GROUP BY 1""")
def normalize_feedback(spark, sf):
    raw = S.read_table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "maybe").when(F.col("l_returnflag") == "A", " L")
        .when(F.col("l_returnflag") == "R", "d ").otherwise("n").alias("answer"))
    ok, bad = P.normalize_feedback(raw)
    return (ok.select("label").unionByName(bad.select(F.lit(None).cast("int").alias("label")))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")))


@query("merge_feedback_rounds", I.with_(I.FEEDBACK) + """
SELECT round_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(label = 1) AS BIGINT) AS n_liked
FROM feedback GROUP BY round_id""")
def merge_feedback_rounds(spark, sf):
    fb = S.feedback(spark, sf)
    rounds = [fb.filter(F.col("round_id") == y) for y in range(1992, 1999)]
    rest = fb.filter((F.col("round_id") < 1992) | (F.col("round_id") >= 1999))
    merged = P.merge_feedback_rounds(*rounds, rest)
    return merged.groupBy("round_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.count_if(F.col("label") == 1).alias("n_liked"))


_pm = ", ".join(f"round(avg(CASE WHEN fb.label = 1 THEN f.{c} END), 6) + 0.0 AS like_{c}, "
                f"round(avg(CASE WHEN fb.label = -1 THEN f.{c} END), 6) + 0.0 AS dislike_{c}" for c in POLY)


@query("user_profile_mean", I.with_(I.CATALOG, I.FEEDBACK, I.feats(POLY)) + f"""
SELECT fb.user_id, CAST(count_if(fb.label = 1) AS BIGINT) AS n_like, CAST(count_if(fb.label = -1) AS BIGINT) AS n_dislike, {_pm}
FROM feedback fb JOIN feats f ON f.item_id = fb.item_id GROUP BY fb.user_id""")
def user_profile_mean(spark, sf):
    z = X.item_features(_cat(spark, sf), POLY)
    p = P.user_profile_mean(S.feedback(spark, sf), z, POLY)
    return p.select("user_id", "n_like", "n_dislike",
                    *[r6(f"{k}_{c}").alias(f"{k}_{c}") for c in POLY for k in ("like", "dislike")])


def importance_ctes(cols: list[str]) -> str:
    """``importance(user_id, feature, weight)`` over ``feats`` as CTEs."""
    stack = " UNION ALL ".join(
        f"SELECT user_id, n_like, n_dislike, '{c}' AS feature, v_{c} AS v, ml_{c} AS ml, md_{c} AS md FROM imp_prof"
        for c in cols)
    aggs = ", ".join(f"var_pop(CASE WHEN fb.label = 1 THEN f.{c} END) AS v_{c}, "
                     f"avg(CASE WHEN fb.label = 1 THEN f.{c} END) AS ml_{c}, "
                     f"avg(CASE WHEN fb.label = -1 THEN f.{c} END) AS md_{c}" for c in cols)
    return f"""
, imp_prof AS (SELECT fb.user_id, count_if(fb.label = 1) AS n_like, count_if(fb.label = -1) AS n_dislike, {aggs}
           FROM feedback fb JOIN feats f ON f.item_id = fb.item_id GROUP BY fb.user_id),
imp_long AS ({stack}),
imp_w0 AS (SELECT *, CASE WHEN n_like > 1 THEN 1.0 / (v + 0.1) ELSE 1.0 END AS w0 FROM imp_long),
imp_w1 AS (SELECT *, CASE WHEN n_like > 1 THEN w0 / sum(w0) OVER (PARTITION BY user_id) ELSE w0 END AS w1 FROM imp_w0),
imp_w2 AS (SELECT *, CASE WHEN n_dislike > 0 THEN w1 * abs(ml - md) ELSE w1 END AS w2 FROM imp_w1),
importance AS (SELECT user_id, feature,
       CASE WHEN n_dislike > 0 THEN coalesce(w2 / nullif(sum(w2) OVER (PARTITION BY user_id), 0), w1)
            ELSE w1 END AS weight
FROM imp_w2)"""


IMPORTANCE_CTES = importance_ctes(POLY)
IMPORTANCE_RAW_SQL = I.with_(I.CATALOG, I.FEEDBACK, I.feats(POLY)) + IMPORTANCE_CTES + "\nSELECT * FROM importance"


@query("feature_importance", I.with_(I.CATALOG, I.FEEDBACK, I.feats(POLY)) + IMPORTANCE_CTES + """
SELECT user_id, feature, round(weight, 6) + 0.0 AS weight FROM importance""")
def feature_importance(spark, sf):
    z = X.item_features(_cat(spark, sf), POLY)
    w = P.feature_importance(S.feedback(spark, sf), z, POLY)
    return w.select("user_id", "feature", r6("weight").alias("weight"))


@query("liked_genres", I.with_(I.CATALOG, I.FEEDBACK) + """
SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = 1""")
def liked_genres(spark, sf):
    return P.liked_genres(S.feedback(spark, sf), _cat(spark, sf))


@query("fully_disliked_genres", I.with_(I.CATALOG, I.FEEDBACK) + """
SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = -1
EXCEPT
SELECT DISTINCT fb.user_id, c.genre FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id WHERE fb.label = 1""")
def fully_disliked_genres(spark, sf):
    return P.fully_disliked_genres(S.feedback(spark, sf), _cat(spark, sf))


@query("genre_distribution", I.with_(I.CATALOG, I.FEEDBACK) + """
SELECT c.genre, CAST(count(DISTINCT fb.item_id) AS BIGINT) AS n_items
FROM feedback fb JOIN catalog c ON c.item_id = fb.item_id GROUP BY c.genre""")
def genre_distribution(spark, sf):
    return P.genre_distribution(S.feedback(spark, sf), _cat(spark, sf))
