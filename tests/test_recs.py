"""Recommenders on small fixtures: invariants and brute force."""

import hashlib

from pyspark.sql import functions as F

from tastemill.operators import baselines as B
from tastemill.operators import ensemble as E
from tastemill.operators import profiles as P


def _cat(spark):
    rows = [(i, "ABC"[i % 3], float(i)) for i in range(30)]
    return spark.createDataFrame(rows, "item_id long, genre string, n_orders double")


def _h(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


def test_genre_based_brute_force(spark):
    cat = _cat(spark)
    fb = spark.createDataFrame([(1, 0, 1), (1, 3, 1), (1, 1, -1), (2, 2, -1)],
                               "user_id long, item_id long, label int")
    got = B.genre_based_recommend(fb, cat, n=12, seed=42).collect()
    u1 = [r["item_id"] for r in sorted((r for r in got if r["user_id"] == 1), key=lambda r: r["rank"])]
    rated = {0, 3, 1}
    tier0 = sorted([i for i in range(30) if i % 3 == 0 and i not in rated], key=_h)
    tier1 = sorted([i for i in range(30) if i % 3 != 0 and i not in rated], key=_h)
    assert u1 == (tier0 + tier1)[:12]
    assert not any(r["user_id"] == 2 for r in got)          # no likes, no list


def test_popularity_excludes_rated_and_tops_up(spark):
    cat = _cat(spark)
    fb = spark.createDataFrame([(1, 29, 1), (1, 28, 1)], "user_id long, item_id long, label int")
    got = B.popularity_recommend(fb, cat, "n_orders", n=10, seed=42).collect()
    items = [r["item_id"] for r in got]
    assert len(items) == 10 and not {28, 29} & set(items)
    assert sum(1 for r in got if r["tier"] == 0) == 4      # 6 popular items (>= 0.8 quantile) minus 2 rated


def test_quota_branches(spark):
    cat = spark.createDataFrame([(i, "A" if i < 70 else ("B" if i < 95 else "C")) for i in range(100)],
                                "item_id long, genre string")
    for n in (2, 10, 25):
        q = {r["genre"]: r["quota"] for r in B.proportional_quota(cat, n=n).collect()}
        assert sum(q.values()) == max(n, 3) or n < 3


def test_coldstart_unique_and_complete(spark):
    cat = _cat(spark)
    got = B.coldstart_mix(cat, n=10, seed=42).collect()
    ids = [r["item_id"] for r in got]
    assert len(ids) == 10 and len(set(ids)) == 10


def test_importance_branches(spark):
    feats = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(6)], "item_id long, a double, b double")
    fb = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1), (3, 4, -1)],
                               "user_id long, item_id long, label int")
    w = {(r["user_id"], r["feature"]): r["weight"] for r in P.feature_importance(fb, feats, ["a", "b"]).collect()}
    assert w[(1, "a")] == 1.0 and w[(1, "b")] == 1.0            # one like: ones
    assert abs(w[(2, "a")] + w[(2, "b")] - 1) < 1e-12          # normalised
    assert abs(w[(3, "a")] - 0.5) < 1e-12                      # |1-0| vs |1-0|: equal split


def test_fully_disliked_keeps_mixed_genres(spark):
    cat = _cat(spark)
    fb = spark.createDataFrame([(1, 0, 1), (1, 3, -1), (1, 1, -1)], "user_id long, item_id long, label int")
    fd = {(r["user_id"], r["genre"]) for r in P.fully_disliked_genres(fb, cat).collect()}
    assert fd == {(1, "B")}


def test_ensemble_unequal_lists_and_failed_model(spark):
    recs = spark.createDataFrame(
        [(1, "m0", 0, 10, 1), (1, "m0", 0, 11, 2), (1, "m1", 1, 11, 1), (1, "m1", 1, 12, 2), (1, "m1", 1, 13, 3)],
        "user_id long, model string, model_idx int, item_id long, rank int")
    w = spark.createDataFrame([("m0", 0.5), ("m1", 0.3), ("m2", 0.2)], "model string, weight double")
    got = {r["item_id"]: r["score"] for r in E.ensemble_vote(recs, w, 10).collect()}
    assert abs(got[11] - (0.5 * 0.5 + 0.3 * 1.0)) < 1e-6
    assert abs(got[10] - 0.5) < 1e-6 and abs(got[13] - 0.3 * (1 - 2 / 3)) < 1e-6


def test_weight_replay_equals_iteration(spark):
    rr = spark.createDataFrame([(1, "a", r, ra) for r, ra in [(1, 0.5), (2, 0.8), (3, 0.4)]] +
                               [(1, "b", r, rb) for r, rb in [(1, 0.9), (2, 0.2), (3, 0.6)]],
                               "user_id long, model string, round int, rate double")
    w0 = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, weight double")
    got = {(r["model"], r["round"]): r["weight"] for r in E.weight_replay(rr, w0).collect()}
    wa, wb = 0.5, 0.5
    for rnd, (ra, rb) in enumerate([(0.5, 0.9), (0.8, 0.2), (0.4, 0.6)], start=1):
        wa, wb = wa * ra, wb * rb
        s = wa + wb
        wa, wb = wa / s, wb / s
        assert abs(got[("a", rnd)] - wa) < 1e-12 and abs(got[("b", rnd)] - wb) < 1e-12


def test_popularity_head_is_exact(spark, monkeypatch):
    """Few users go past the head of the list; rows are those of all positions."""
    cat = spark.createDataFrame([(i, float(i)) for i in range(400)] + [(399, 399.0), (None, 500.0)], "item_id long, n_orders double")
    order = sorted(range(320, 400), key=_h)
    rows = [(u, i, 1) for u in range(60) for i in range(400) if (i * 7 + u * 13) % 11 == 0] + [(99, i, 1) for i in order[:40]] + [(None, 5, 1)]
    fb = spark.createDataFrame(rows, "user_id long, item_id long, label int")
    asked, real = [], B.prefix_pick
    monkeypatch.setattr(B, "prefix_pick", lambda w, *a, **k: asked.append(w.count()) or real(w, *a, **k))
    take = lambda: sorted((str(tuple(r)) for r in B.popularity_recommend(fb, cat, "n_orders", n=5, seed=42).collect()))
    got = take()
    assert asked and max(asked) <= 3
    monkeypatch.setattr(B, "HEAD", 0)
    assert take() == got and len(got) == 62 * 5


def test_genre_heads_are_exact(spark, monkeypatch):
    """Few users go past the heads of their genres; rows are those of all positions."""
    cat = spark.createDataFrame([(i, "ABC"[i % 3]) for i in range(300)] + [(299, "A"), (None, "B"), (900, None)], "item_id long, genre string")
    order = sorted((i for i in range(300) if i % 3 == 0), key=_h)
    rows = [(u, i, 1 if (i + u) % 4 else -1) for u in range(60) for i in range(300) if (i * 7 + u * 13) % 23 == 0]
    rows += [(99, i, 1) for i in order[:30]] + [(98, 900, 1), (None, 5, 1), (97, 4, -1)]
    fb = spark.createDataFrame(rows, "user_id long, item_id long, label int")
    asked, real = [], B.prefix_pick
    monkeypatch.setattr(B, "prefix_pick", lambda w, *a, **k: asked.append(w.select("user_id").distinct().count()) or real(w, *a, **k))
    take = lambda: sorted((str(tuple(r)) for r in B.genre_based_recommend(fb, cat, n=5, seed=42).collect()))
    got = take()
    assert asked and max(asked) <= 4
    monkeypatch.setattr(B, "HEAD", 0)
    assert take() == got and len(got) >= 62 * 5
