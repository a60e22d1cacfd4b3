"""Clustering models and cluster-affinity scoring.

Fitting uses Spark ML estimators (KMeans with seeded restarts,
GaussianMixture, BisectingKMeans as the distributed stand-in for Ward).
Scoring is split from fitting so it can run on any assignment table.

Affinity scores are constant within a cluster (or within a combination
of clusters when several methods are blended), and ties are broken by
item id. A user's top-n is therefore a prefix, by item id, of the best
clusters: it is picked with the same (group, position) equi-join as the
baselines, and never forms users × items.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.functions.core import dense_positions, hash_key, top_n


def cluster_count(n_rows: int, per: int = 100, cap: int = 20, floor: int = 2) -> int:
    """k = min(cap, n // per), never below ``floor`` (the plain formula
    gives 0 for small inputs)."""
    return max(floor, min(cap, n_rows // per))


def training_sample(df: DataFrame, size: int, seed: int = 42, key: str = "item_id") -> DataFrame:
    """Deterministic sample without replacement: the first ``size`` rows of
    the seeded hash order (a bounded TakeOrderedAndProject)."""
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(size).drop("_h")


def _parallel(tasks, threads: int = 4) -> list:
    """Run independent fits as concurrent jobs (results in task order)."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=threads) as ex:
        return list(ex.map(lambda t: t(), tasks))


def _vec(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(col)))


def kmeans_assign(df: DataFrame, k: int, seed: int = 42, restarts: int = 10,
                  max_iter: int = 20) -> DataFrame:
    """Best of ``restarts`` seeded fits by training cost → (item_id, cluster)."""
    v = _vec(df).cache()
    # restarts are independent fits: run them as concurrent Spark jobs
    fits = _parallel([lambda r=r: KMeans(k=k, seed=seed + r, maxIter=max_iter, featuresCol="_v").fit(v)
                      for r in range(restarts)])
    best = min(fits, key=lambda m: (m.summary.trainingCost, fits.index(m)))
    out = best.transform(v).select("item_id", F.col("prediction").alias("cluster"))
    v.unpersist()
    return out


def gmm_assign(df: DataFrame, k: int, seed: int = 42, restarts: int = 3, max_iter: int = 50) -> DataFrame:
    v = _vec(df).cache()
    fits = _parallel([lambda r=r: GaussianMixture(k=k, seed=seed + r, maxIter=max_iter, featuresCol="_v").fit(v)
                      for r in range(restarts)])
    best = max(fits, key=lambda m: (m.summary.logLikelihood, -fits.index(m)))
    out = best.transform(v).select("item_id", F.col("prediction").alias("cluster"))
    v.unpersist()
    return out


def hierarchical_assign(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Top-down bisecting k-means: the distributed hierarchical method. It
    plays the role of Ward linkage but does not give the same clusters."""
    v = _vec(df)
    m = BisectingKMeans(k=k, seed=seed, featuresCol="_v").fit(v)
    return m.transform(v).select("item_id", F.col("prediction").alias("cluster"))


def cluster_centroids(df: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, centroid array<double>): mean vector per cluster."""
    j = df.select("item_id", "features").join(assign, "item_id")
    d = df.select(F.size("features").alias("d")).first()["d"]
    return j.groupBy("cluster").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(d)]).alias("centroid"))


def nearest_centroid(df: DataFrame, centroids: DataFrame, block: int = 4096) -> DataFrame:
    """Assign every row to the closest centroid (squared distance, ties to
    the lowest cluster id). Centroids are packed into one array row per
    ``block`` of them, broadcast to the rows (a block's size is bounded), and
    the best of each block is kept: a narrow map over ``df`` per block."""
    n = centroids.count()
    packed = centroids.withColumn("_b", F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-n // block)))))
    best = F.lit(None).cast("struct<d2:double,cluster:int>")
    out = df.withColumn("_best", best)
    for b in range(max(1, -(-n // block))):
        one = packed.where(F.col("_b") == b).agg(F.collect_list(F.struct("cluster", "centroid")).alias("_cs"))
        near = F.array_min(F.transform("_cs", lambda c: F.struct(
            F.aggregate(F.zip_with(F.col("features"), c["centroid"], lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                        lambda acc, x: acc + x).alias("d2"), c["cluster"].cast("int").alias("cluster"))))
        out = (out.crossJoin(F.broadcast(one)).withColumn("_best", F.least(F.coalesce("_best", near), F.coalesce(near, "_best")))
               .drop("_cs"))
    return out.select("item_id", F.col("_best.cluster").alias("cluster"), F.col("_best.d2").alias("d2"))


# ----------------------------------------------------------------- scoring
def cluster_scores(feedback: DataFrame, assign: DataFrame) -> DataFrame:
    """(user_id, cluster, score): share of the user's likes in the cluster;
    clusters holding any of the user's dislikes are skipped."""
    fb = feedback.select("user_id", "item_id", "label").join(assign, "item_id")
    per = fb.groupBy("user_id", "cluster").agg(
        F.count_if(F.col("label") == 1).alias("n_like"), F.count_if(F.col("label") == -1).alias("n_dis"))
    tot = F.sum("n_like").over(Window.partitionBy("user_id"))
    return (per.withColumn("score", F.col("n_like") / F.nullif(tot, F.lit(0)))
            .filter((F.col("n_dis") == 0) & (F.col("n_like") > 0)).select("user_id", "cluster", "score"))


def _group_positions(assign_wide: DataFrame, keys: list[str]) -> DataFrame:
    return dense_positions(assign_wide, ["item_id"], "pos", keys)


COMBOS = 1_000_000          # cluster combinations that all tasks get at most


def best_combos(scored: DataFrame, rated: DataFrame, combos: DataFrame, methods: list[str], n: int) -> DataFrame:
    """``user_id``, ``combo``, ``score``, ``depth``: a user's combinations from
    the best sum down to the one with which ``n`` + rated items are reached,
    ties of that sum included. ``scored`` (``user_id``, ``method``,
    ``cluster``, ``s``) is one row per liked cluster, so a user's list is
    bounded by the number of clusters."""
    import numpy as np
    import pandas as pd

    spark = scored.sparkSession
    rows = combos.orderBy("combo").toPandas()               # checked size
    codes, names = [], []
    for m in methods:
        code, name = pd.factorize(rows[f"c_{m}"])
        codes.append(code)
        names.append({v: i for i, v in enumerate(name)})
    held = spark.sparkContext.broadcast((rows["combo"].to_numpy(), rows["size"].to_numpy(), codes, names))
    lists = scored.groupBy("user_id").agg(F.collect_list(F.struct("method", "cluster", "s")).alias("liked")).join(rated, "user_id")
    kind = lists.schema["user_id"].dataType.simpleString()

    def walk(batches):
        combo, size, code, name = held.value
        for frame in batches:
            out = []
            for user, liked, n_rated in zip(frame["user_id"], frame["liked"], frame["n_rated"]):
                part = [np.zeros(len(x)) for x in name]
                for one in liked:
                    at = name[one["method"]].get(one["cluster"])
                    if at is not None:
                        part[one["method"]][at] = one["s"]
                total = np.zeros(len(combo))
                for p, c in zip(part, code):
                    total = total + p[c]
                some = np.flatnonzero(total > 0)
                some = some[np.argsort(-total[some], kind="stable")]
                shown, need = np.floor(total[some] * 1e6 + 0.5), n + n_rated
                enough = np.searchsorted(np.cumsum(size[some]), need)
                if enough < len(some):
                    some = some[shown >= shown[enough]]
                out.append(pd.DataFrame({"user_id": user, "combo": combo[some], "score": total[some], "depth": np.minimum(size[some], need)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return lists.select("user_id", "liked", "n_rated").mapInPandas(walk, f"user_id {kind}, combo bigint, score double, depth int")


def cluster_recommend(feedback: DataFrame, assigns: dict[str, DataFrame], weights: dict[str, float],
                      n: int, users: DataFrame | None = None) -> DataFrame:
    """Blend of per-method cluster scores: score(item) = Σ w_m · s_m(cluster_m(item)).

    Items with the same cluster combination share a score, and a user's best
    sums are walked down only until ``n`` + rated items are reached; of each
    such combination the first ``n`` + rated items by id can matter.
    Combinations with no scored part score 0 and fill the list by item id,
    also for users (of ``users``) without any feedback on these items. Rated
    items are excluded (anti join). Returns (user_id, item_id, score, rank).
    """
    from tastemill.session import materialize
    methods = list(assigns)
    wide = None
    for m in methods:
        a = assigns[m].select("item_id", F.col("cluster").cast("string").alias(f"c_{m}"))
        wide = a if wide is None else wide.join(a, "item_id")
    wide = materialize(wide, "cluster-assign")          # items-sized; every later step reads it
    keys = [f"c_{m}" for m in methods]
    combos = wide.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("size"))
    combos = materialize(combos.withColumn("combo", F.monotonically_increasing_id()), "combos")
    if combos.count() > COMBOS:
        raise ValueError(f"over {COMBOS} cluster combinations; use fewer clusters")
    of_item = wide.join(combos.drop("size"), keys).select("item_id", "combo")
    pos = _group_positions(of_item, ["combo"])
    fb = feedback.select("user_id", "item_id", "label").persist()
    who = fb.select("user_id") if users is None else users.select("user_id").unionByName(fb.select("user_id"))
    counts = fb.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rated"))
    rated = materialize(who.distinct().join(counts, "user_id", "left").fillna(0, ["n_rated"]), "rated-counts")
    scored = None
    for i, m in enumerate(methods):
        sc = cluster_scores(fb, wide.select("item_id", F.col(f"c_{m}").alias("cluster")))
        sc = sc.select("user_id", F.lit(i).alias("method"), "cluster", (F.col("score") * weights[m]).alias("s"))
        scored = sc if scored is None else scored.unionByName(sc)
    picked = best_combos(scored, rated, combos, methods, n)
    wants = picked.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    cand = wants.join(pos, ["combo", "pos"]).select("user_id", "item_id", "score")
    # zero-score fill: the first 2(n + rated) items by id cover any shortfall
    gpos = dense_positions(wide.select("item_id"), ["item_id"]).withColumn("g", F.lit(0))
    fill_w = rated.withColumn("g", F.lit(0)).withColumn(
        "pos", F.explode(F.sequence(F.lit(1), (2 * (F.lit(n) + F.col("n_rated"))).cast("int"))))
    fill = fill_w.join(gpos, ["g", "pos"]).select("user_id", "item_id", F.lit(0.0).alias("score"))
    allc = (cand.unionByName(fill).groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
            .join(fb.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"))
    out = top_n(allc.withColumn("score", r6("score")), ["user_id"], [F.col("score").desc(), F.col("item_id")], n)
    res = materialize(out.select("user_id", "item_id", "score", F.col("rank").cast("int")), "cluster-recs")
    fb.unpersist()
    return res


# ------------------------------------------------------------ reduction / representatives
def gram_matrix(df: DataFrame, col: str):
    """Sum of x xᵀ over the rows as a d × d array: partial sums per partition
    in Arrow batches, added up by position on the executors."""
    import numpy as np
    import pandas as pd

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[col].to_numpy()).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "g": total.ravel()})

    sums = df.select(col).mapInPandas(partial, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    d = int(round(len(sums) ** 0.5))
    out = np.zeros(d * d)
    for r in sums:
        out[r["i"]] = r["g"]
    return out.reshape(d, d)


def svd_reduce(df: DataFrame, k: int = 20, col: str = "features"):
    """Truncated SVD without centring: a distributed Gram matrix, then a
    local eigen-decomposition of a d × d matrix.

    Returns (projected DataFrame with ``reduced`` array<double>, singular
    values, explained ratio per component = s_j² / ‖X‖_F²). The k × d
    basis is bounded by the feature count and is inlined into the
    projection. With d <= k the input is returned unchanged."""
    import numpy as np
    d = df.select(F.size(col).alias("d")).first()["d"]
    if d <= k:
        return df.withColumn("reduced", F.col(col)), [], []
    gram = gram_matrix(df, col)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    s = [float(x) for x in np.sqrt(np.maximum(values[order], 0.0))]
    V = vectors[:, order]                    # d × k
    V = V * np.where(V[np.abs(V).argmax(axis=0), np.arange(V.shape[1])] < 0, -1.0, 1.0)   # a fixed sign
    total = float(np.trace(gram))
    comps = []
    for j in range(V.shape[1]):
        vj = F.array(*[F.lit(float(x)) for x in V[:, j]])
        comps.append(F.aggregate(F.zip_with(F.col(col), vj, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x))
    out = df.withColumn("reduced", F.array(*comps))
    return out, s, [x * x / total for x in s]


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def kmeans_within(df: DataFrame, by: str, quota: DataFrame, seed: int = 42, rounds: int = 10) -> DataFrame:
    """k-means inside every group at once, with k = the group's ``quota``:
    (by, item_id, h, cluster). Lloyd's rounds as grouped averages over all
    groups; the centroids (the sum of the quotas, a few rows) are broadcast.
    First centroids: the group's first items in hash order."""
    from tastemill.session import materialize
    rows = materialize(df.join(F.broadcast(quota.select(by, "quota")), by).withColumn("h", hash_key(seed, "item_id")), "rep-rows")
    d = rows.select(F.size("features").alias("d")).first()["d"]
    # constant bound first (a partial top-k), then the group's own
    most = quota.agg(F.max("quota")).first()[0]
    first = rows.withColumn("c", F.row_number().over(Window.partitionBy(by).orderBy("h", "item_id"))).where(F.col("c") <= most)
    cents = first.where(F.col("c") <= F.col("quota")).select(by, F.col("c").alias("cluster"), F.col("features").alias("centroid"))

    def assign(cents):
        packed = cents.groupBy(by).agg(F.collect_list(F.struct("cluster", "centroid")).alias("cs"))
        best = F.array_min(F.transform("cs", lambda c: F.struct(_distance2(F.col("features"), c["centroid"]).alias("d2"), c["cluster"].alias("cluster"))))
        return rows.join(F.broadcast(packed), by).withColumn("cluster", best["cluster"]).drop("cs")

    for _ in range(rounds):
        means = F.array(*[F.avg(F.col("features")[i]) for i in range(d)])
        cents = materialize(assign(cents).groupBy(by, "cluster").agg(means.alias("centroid")), "centroids")
    return assign(cents).select(by, "item_id", "h", "cluster")


def representatives(df: DataFrame, k: int, seed: int = 42, by: str | None = None,
                    quota: DataFrame | None = None) -> DataFrame:
    """Cold-start picks that cover the feature space.

    Without ``by``: one item per cluster of a k-means with ``k`` clusters.
    With ``by`` (a genre column) and ``quota(genre, quota)``: a genre no
    bigger than its quota is taken whole, in any other one item per cluster
    of a k-means inside the genre with k = quota; ``k`` is not used. Each
    cluster gives its first item in the seeded hash order. Empty clusters
    leave gaps, and the list is filled to the wanted number (``k``, or the
    sum of the quotas) with other items in hash order, as cluster -1."""
    keyed = df.withColumn("h", hash_key(seed, "item_id"))
    if not by:
        a = kmeans_assign(df, k, seed, restarts=1)
        chosen = keyed.join(a, "item_id").groupBy("cluster").agg(F.min(F.struct("h", "item_id")).alias("m")).select("m.item_id", "cluster")
        cols, want = ["item_id", "cluster"], k
    else:
        sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
        quota = quota.withColumnRenamed(quota.columns[0], by).join(sizes, by)
        whole = keyed.join(F.broadcast(quota.where(F.col("n") <= F.col("quota"))), by).select(by, "item_id", F.lit(0).alias("cluster"))
        inner = kmeans_within(df, by, quota.where(F.col("n") > F.col("quota")), seed)
        picked = inner.groupBy(by, "cluster").agg(F.min(F.struct("h", "item_id")).alias("m")).select(by, "m.item_id", "cluster")
        chosen = whole.unionByName(picked)
        cols, want = [by, "item_id", "cluster"], int(quota.agg(F.sum("quota")).first()[0])
    from tastemill.session import materialize
    chosen = materialize(chosen.select(*cols), "chosen")          # at most ``want`` rows
    gap = want - chosen.count()
    if gap <= 0:
        return chosen
    rest = keyed.join(F.broadcast(chosen.select("item_id")), "item_id", "left_anti").orderBy("h", "item_id").limit(gap)
    return chosen.unionByName(rest.withColumn("cluster", F.lit(-1)).select(*cols))
