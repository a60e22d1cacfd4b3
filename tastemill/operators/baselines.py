"""Low-cost recommenders: pruned profile distance, genre-based and
popularity picks, top-up, cold-start selection and genre quotas.

"Random" picks follow one seeded hash order over items (``md5(seed:item)``),
shared by all users. That makes a user's pick an *ordered prefix* of a
per-genre list, so the pick is an equi-join on (genre, position) with
only ``n + rated`` positions per user and no users × items product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.selection import quantiles
from tastemill.functions.core import dense_positions, hash_key, r6, top_n
from tastemill.operators.knn import grid_topn
from tastemill.operators.profiles import liked_genres, user_profile_mean
from tastemill.session import materialize


# ------------------------------------------------------------------ pruned
def pruned_recommend(feedback: DataFrame, feats: DataFrame, cols: list[str],
                     n: int = 15, per_cell: int | None = None) -> DataFrame:
    """score = -‖x - mean_liked‖² + 0.5‖x - mean_disliked‖² (second term only
    with dislikes); rated items excluded; users without likes get nothing.

    The score equals -a‖x - t‖² + const with t = mean_liked (a = 1) or
    t = 2·mean_liked - mean_disliked (a = 0.5), so the top-n is the exact
    n-nearest-neighbour set of t, found by ``grid_topn``.
    """
    fb = feedback.select("user_id", "item_id", "label").persist()  # profiles and exclusions
    prof = user_profile_mean(fb, feats, cols).filter(F.col("n_like") > 0)
    has_d = F.col("n_dislike") > 0
    targets = prof.withColumns({
        f"t_{c}": F.when(has_d, 2.0 * F.col(f"like_{c}") - F.col(f"dislike_{c}"))
                   .otherwise(F.col(f"like_{c}")) for c in cols})

    def score() -> Column:
        near = None
        far = None
        for c in cols:
            a = (F.col(c) - F.col(f"like_{c}"))
            b = (F.col(c) - F.col(f"dislike_{c}"))
            near = a * a if near is None else near + a * a
            far = b * b if far is None else far + b * b
        return -near + F.when(has_d, 0.5 * far).otherwise(F.lit(0.0))

    out = grid_topn(targets, feats.select("item_id", *cols), cols, [f"t_{c}" for c in cols], n,
                    score, exclude=fb.select("user_id", "item_id"), per_cell=per_cell)
    fb.unpersist()
    return out


# ----------------------------------------------------------- ordered picks
def ranked_items(items: DataFrame, seed: int, group: str | None = None) -> DataFrame:
    """(group?, pos, item_id, h): 1-based position in the seeded hash order,
    per group if given."""
    cols = [group] if group else []
    base = items.select(*cols, "item_id").withColumn("h", hash_key(seed, "item_id"))
    return dense_positions(base, ["h", "item_id"], "pos", cols)


def prefix_pick(wants: DataFrame, ranked: DataFrame, group: str | None, salts: int = 8) -> DataFrame:
    """wants(user_id, group?, k) ⋈ ranked(group?, pos, item_id) on pos <= k,
    written as an equi-join on (group, pos) after exploding 1..k. Every user
    asks for the first positions, so the keys are salted by the asking row
    and the ranked list is copied ``salts`` times."""
    keys = ([group] if group else []) + ["pos", "_salt"]
    w = (wants.withColumn("_salt", F.pmod(F.xxhash64(*wants.columns), F.lit(salts)).cast("int"))
         .withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))))
    r = ranked.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return w.join(r, keys).drop("k", "_salt")


def rated_counts(feedback: DataFrame, catalog: DataFrame | None = None,
                 group: str | None = None) -> DataFrame:
    fb = feedback.select("user_id", "item_id")
    if group:
        fb = fb.join(catalog.select("item_id", group), "item_id")
        return fb.groupBy("user_id", group).agg(F.count(F.lit(1)).alias("n_rated"))
    return fb.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rated"))


def tiered_topn(cands: DataFrame, feedback: DataFrame, n: int) -> DataFrame:
    """cands(user_id, item_id, tier, h) → exclude rated, keep each item's best
    tier, order by (tier, h, item_id), first n per user."""
    c = cands.join(feedback.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    c = c.groupBy("user_id", "item_id").agg(F.min("tier").alias("tier"), F.first("h").alias("h"))
    return top_n(c, ["user_id"], [F.col("tier"), F.col("h"), F.col("item_id")], n).select(
        "user_id", "item_id", "tier", F.col("rank").cast("int"))


HEAD = 2            # positions looked at first, in multiples of the wanted items


def head_pick(wants: DataFrame, feedback: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, rank): the first ``n`` unrated items of each user who
    finds them among the first ``HEAD * n`` positions of ``ranked`` (one list
    for all) and within the ``k`` positions of ``wants(user_id, k)``. Users
    who don't, and the null user, are left out.

    The head is a list of ``HEAD * n`` items, so a user's rated part of it is
    one short array and no user × position rows are shuffled. An item that
    is listed twice counts at its first position."""
    head = ranked.where(F.col("pos") <= HEAD * n).groupBy("item_id").agg(F.min("pos").alias("pos"))
    head = materialize(head.where(F.col("item_id").isNotNull()), "head")       # HEAD * n rows
    null = ranked.where((F.col("pos") <= HEAD * n) & F.col("item_id").isNull()).agg(F.min("pos").alias("pos"))
    listed = head.select("pos").unionByName(null.where("pos IS NOT NULL")).agg(F.sort_array(F.collect_list("pos")).alias("listed"))
    seen = (feedback.select("user_id", "item_id").join(F.broadcast(head), "item_id")
            .groupBy("user_id").agg(F.collect_set("pos").alias("seen")))
    free = F.array_except(F.filter("listed", lambda p: p <= F.col("k")), F.coalesce("seen", F.array().cast("array<bigint>")))
    found = (wants.where(F.col("user_id").isNotNull()).join(seen, "user_id", "left").crossJoin(F.broadcast(listed))
             .withColumn("free", F.slice(free, 1, n)).where(F.size("free") == n))
    item_at = materialize(head.select("pos", "item_id").unionByName(null.where("pos IS NOT NULL").select("pos", F.lit(None).cast(head.schema["item_id"].dataType).alias("item_id"))), "head")
    return (found.select("user_id", F.posexplode("free").alias("rank", "pos")).join(F.broadcast(item_at), "pos")
            .select("user_id", "item_id", (F.col("rank") + 1).cast("int").alias("rank")))


def genre_head_pick(wants: DataFrame, feedback: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, rank): the first ``n`` unrated items, in the order of
    (h, item_id), over the genres of ``wants(user_id, genre, k)`` for each user
    who finds ``n`` among the first ``HEAD * n`` positions (and within ``k``)
    of every such genre in ``ranked(genre, pos, item_id, h)``. Users who
    don't, and the null user, are left out.

    Heads are numbered over all genres, so a user's share of them is an array
    of numbers that never leaves the user's row."""
    first = ranked.where(F.col("pos") <= HEAD * n).groupBy("genre", "item_id", "h").agg(F.min("pos").alias("pos"))
    head = materialize(first.withColumn("at", F.dense_rank().over(Window.orderBy("h", "item_id"))), "heads")    # HEAD * n rows a genre
    item_at = head.select("at", "item_id").distinct()
    seen = (feedback.select("user_id", "item_id").join(item_at, "item_id")
            .groupBy("user_id").agg(F.collect_set("at").alias("seen")))
    listed = materialize(head.groupBy("genre").agg(F.sort_array(F.collect_list(F.struct("pos", "at"))).alias("listed")), "listed")
    near = F.transform(F.filter("listed", lambda p: p["pos"] <= F.col("k")), lambda p: p["at"])
    free = F.slice(F.array_except(near, F.coalesce("seen", F.array().cast("array<int>"))), 1, n)
    found = (wants.where(F.col("user_id").isNotNull()).join(seen, "user_id", "left").join(listed, "genre")
             .select("user_id", free.alias("free")).groupBy("user_id")
             .agg(F.min(F.size("free")).alias("least"), F.flatten(F.collect_list("free")).alias("free")).where(F.col("least") == n))
    found = found.select("user_id", F.posexplode(F.slice(F.sort_array(F.array_distinct("free")), 1, n)).alias("rank", "at"))
    return found.join(item_at, "at").select("user_id", "item_id", (F.col("rank") + 1).cast("int").alias("rank"))


def genre_based_recommend(feedback: DataFrame, catalog: DataFrame, n: int = 15,
                          seed: int = 42, genre_col: str = "genre") -> DataFrame:
    """n unrated items sharing a liked genre (hash order), topped up with
    other unrated items (same order). Users without likes get nothing."""
    users = feedback.filter(F.col("label") == 1).select("user_id").distinct()
    lg = liked_genres(feedback, catalog, genre_col)
    per_g = rated_counts(feedback, catalog, genre_col).withColumnRenamed(genre_col, "genre")
    wants = materialize(lg.join(per_g, ["user_id", "genre"], "left")
                        .select("user_id", "genre", (F.lit(n) + F.coalesce(F.col("n_rated"), F.lit(0))).alias("k")), "wants")
    by_genre = materialize(ranked_items(catalog, seed, genre_col).withColumnRenamed(genre_col, "genre"), "by-genre")
    easy = materialize(genre_head_pick(wants, feedback, by_genre, n), "easy")
    done = easy.select("user_id").distinct()
    out = easy.select("user_id", "item_id", F.lit(0).alias("tier"), "rank")
    users = materialize(users.join(done, "user_id", "left_anti"), "wanting")
    if users.isEmpty():
        return out
    # the others: all positions they may need
    in_genre = prefix_pick(wants.join(done, "user_id", "left_anti"), by_genre, "genre") \
        .select("user_id", "item_id", "h", F.lit(0).alias("tier"))
    allr = rated_counts(feedback).join(users, "user_id", "left_semi")
    top_wants = allr.select("user_id", (F.lit(2 * n) + F.col("n_rated")).alias("k"))
    others = prefix_pick(top_wants, ranked_items(catalog, seed), None) \
        .select("user_id", "item_id", "h", F.lit(1).alias("tier"))
    return out.unionByName(tiered_topn(in_genre.unionByName(others), feedback, n))


def popularity_threshold(catalog: DataFrame, col: str, q: float = 0.8,
                         relative_error: float | None = None) -> float:
    """Value of ``col`` at quantile ``q`` (linear interpolation, exact by
    distributed selection; ``relative_error`` switches to percentile_approx)."""
    if relative_error is None:
        return quantiles(catalog, [col], q)[col]
    return catalog.agg(F.percentile_approx(col, q, int(1 / relative_error)).cast("double").alias("t")).first()["t"]


def popularity_recommend(feedback: DataFrame, catalog: DataFrame, pop_col: str,
                         n: int = 15, seed: int = 42, q: float = 0.8) -> DataFrame:
    """n unrated items with popularity ≥ the q-quantile (hash order),
    topped up with other unrated items. Every user in feedback."""
    t = popularity_threshold(catalog, pop_col, q)
    popular = materialize(ranked_items(catalog.filter(F.col(pop_col) >= F.lit(t)).select("item_id"), seed), "popular")
    rc = rated_counts(feedback).withColumn("k", F.lit(n) + F.col("n_rated"))
    easy = materialize(head_pick(rc, feedback, popular, n), "easy")
    done = easy.select("user_id").distinct()
    rc = materialize(rc.join(done, "user_id", "left_anti"), "wanting")
    out = easy.select("user_id", "item_id", F.lit(0).alias("tier"), "rank")
    if rc.isEmpty():
        return out
    # the others: all positions they may need
    tier0 = prefix_pick(rc.select("user_id", "k"), popular, None) \
        .select("user_id", "item_id", "h", F.lit(0).alias("tier"))
    wants1 = rc.select("user_id", (F.lit(2 * n) + F.col("n_rated")).alias("k"))
    tier1 = prefix_pick(wants1, ranked_items(catalog, seed), None) \
        .select("user_id", "item_id", "h", F.lit(1).alias("tier"))
    return out.unionByName(tiered_topn(tier0.unionByName(tier1), feedback, n))


def top_up(chosen: DataFrame, pool: DataFrame, n: int, seed: int = 42,
           by: str = "user_id") -> DataFrame:
    """Fill each short list in ``chosen(by, item_id, rank)`` to ``n`` with
    items of ``pool(item_id)`` not yet chosen, in hash order.

    Tier 0 keeps the chosen order; tier 1 is a prefix of the pool's hash
    order long enough to survive the exclusions (``2n`` positions).
    """
    have = chosen.select(by, "item_id", F.col("rank").cast("double").alias("o"), F.lit(0).alias("tier"))
    wants = chosen.groupBy(by).agg(F.lit(2 * n).alias("k"))
    extra = (prefix_pick(wants, ranked_items(pool, seed), None)
             .select(by, "item_id", F.col("pos").cast("double").alias("o"), F.lit(1).alias("tier")))
    allc = have.unionByName(extra).groupBy(by, "item_id").agg(
        F.min(F.struct("tier", "o")).alias("m"))
    return top_n(allc.select(by, "item_id", "m.tier", "m.o"), [by],
                 [F.col("tier"), F.col("o"), F.col("item_id")], n).select(
        by, "item_id", "tier", F.col("rank").cast("int"))


# --------------------------------------------------------------- cold start
def coldstart_mix(catalog: DataFrame, n: int = 25, seed: int = 42,
                  genre_col: str = "genre", votes_col: str = "n_orders") -> DataFrame:
    """Initial items to rate: per genre max(1, n // G) slots, half most-voted,
    half hash-random from the rest of the genre; cut or topped up to n.

    Each item counts in its own (primary) genre. Genres are served in
    name order; the cut to n keeps genre order, then slot order.
    """
    G = catalog.select(genre_col).distinct().count()
    per = max(1, n // max(G, 1))
    half = per // 2
    c = catalog.select("item_id", genre_col, votes_col).withColumn("h", hash_key(seed, "item_id"))
    wv = Window.partitionBy(genre_col).orderBy(F.col(votes_col).desc(), F.col("item_id"))
    c = c.withColumn("vr", F.row_number().over(wv))
    top_votes = c.filter(F.col("vr") <= half).withColumn("slot", F.col("vr"))
    rest = c.filter(F.col("vr") > half)
    wr = Window.partitionBy(genre_col).orderBy("h", "item_id")
    rnd = (rest.withColumn("_rr", F.row_number().over(wr)).filter(F.col("_rr") <= half)
           .withColumn("slot", F.col("_rr") + F.lit(half)).drop("_rr"))
    sel = top_votes.unionByName(rnd).select("item_id", genre_col, "slot")
    gw = Window.orderBy(genre_col, "slot")  # at most G * per rows: a bounded window
    sel = sel.withColumn("o", F.row_number().over(gw)).filter(F.col("o") <= n)
    chosen = sel.select("item_id", F.col("o").cast("double").alias("o"), F.lit(0).alias("tier"))
    # top-up pool: the first 2n items of the hash order (TakeOrderedAndProject,
    # a bounded top-k per partition), enough to survive the chosen ones
    extra = (c.select("item_id", "h").orderBy("h", "item_id").limit(2 * n)
             .withColumn("o", F.row_number().over(Window.orderBy("h", "item_id")).cast("double"))
             .select("item_id", "o", F.lit(1).alias("tier")))
    allc = chosen.unionByName(extra).groupBy("item_id").agg(F.min(F.struct("tier", "o")).alias("m"))
    out = allc.select("item_id", "m.tier", "m.o").withColumn(
        "rank", F.row_number().over(Window.orderBy("tier", "o", "item_id"))).filter(F.col("rank") <= n)
    return out.select("item_id", F.col("rank").cast("int"))


def proportional_quota(catalog: DataFrame, n: int = 25, genre_col: str = "genre") -> DataFrame:
    """Per genre max(1, floor(n * share)); if the total is short, +1 to the
    largest genres first; if over, -1 from the smallest genres with more
    than one slot. One pass, as in the loop it replaces."""
    cnt = catalog.groupBy(genre_col).agg(F.count(F.lit(1)).alias("cnt"))
    tot = Window.partitionBy()  # one row per genre: bounded
    q = cnt.withColumn("share", F.col("cnt") / F.sum("cnt").over(tot))
    q = q.withColumn("base", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("share")).cast("int")))
    q = q.withColumn("total", F.sum("base").over(tot))
    q = q.withColumn("desc_rank", F.row_number().over(Window.orderBy(F.col("cnt").desc(), F.col(genre_col))))
    elig = F.col("base") > 1
    q = q.withColumn("asc_rank_elig", F.when(elig, F.row_number().over(
        Window.orderBy((~elig).cast("int"), F.col("cnt").asc(), F.col(genre_col).desc()))))
    short = F.lit(n) - F.col("total")
    quota = (F.when(F.col("total") < n, F.col("base") + F.when(F.col("desc_rank") <= short, 1).otherwise(0))
             .when(F.col("total") > n, F.col("base") - F.when(
                 elig & (F.col("asc_rank_elig") <= -short), 1).otherwise(0))
             .otherwise(F.col("base")))
    return q.select(F.col(genre_col).alias("genre"), F.col("cnt").cast("bigint").alias("n_items"),
                    quota.cast("int").alias("quota"))
