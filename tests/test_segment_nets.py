"""Grouped net training: gradients, plateau rule, awkward rows, metrics by SQL."""

import duckdb
import numpy as np
import pytest

from tastemill.operators import segment_nets as N
from tastemill.plans import q_nets
from tests.conftest import SF


def test_gradient_by_differences():
    rng = np.random.RandomState(1)
    sizes = [3, 5, 4, 1]
    theta = rng.normal(size=N.parameter_count(sizes))
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    g, loss = N.gradient(theta, sizes, x, y)
    for i in rng.choice(len(theta), 20, replace=False):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, down = N.gradient(theta + step, sizes, x, y)[1], N.gradient(theta - step, sizes, x, y)[1]
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4 * max(1.0, abs(g[i]))
    assert loss > 0


def frame(spark, n=1200):
    """Two segments with opposite lines, one of them two thirds of the rows;
    ``same`` varies in one of them only."""
    rng = np.random.RandomState(0)
    rows = []
    for i in range(n):
        a, b = map(float, rng.normal(size=2))
        s = "big" if i % 3 else "small"
        rows.append((i, s, a, b, float(i % 2) if s == "big" else 1.0, 100 * (2 * a - b if s == "big" else b - 2 * a) + 7))
    return spark.createDataFrame(rows, "id long, segment string, a double, b double, same double, y double").repartition(4)


def fitted(df, **kw):
    return N.SegmentNets({"wide": (16, 8), "narrow": (4,)}, **{"max_iter": 300, "lr": 0.02, **kw}).fit(df, "segment", ["a", "b", "same"], "y")


def test_each_segment_has_its_own_nets(spark):
    df = frame(spark)
    nets = fitted(df)
    assert set(nets.nets) == {(s, m) for s in ("big", "small") for m in ("wide", "narrow")}
    assert nets.n_params("big", "wide") == N.parameter_count([3, 16, 8, 1])
    assert nets.n_params("small", "wide") == N.parameter_count([2, 16, 8, 1])      # the constant column is left out
    pred = nets.predict(df).toPandas()
    assert len(pred) == 2 * 1200
    for _, p in pred.groupby(["segment", "model"]):
        assert 1 - ((p.y - p.prediction) ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum() > 0.95
    assert any(net.done and len(net.history) < 300 for net in nets.nets.values())      # the plateau rule fires
    net = nets.nets["big", "wide"]
    assert {r for _, _, r in net.history} >= {0.02, 0.004}


def test_partitions_and_tree_do_not_change_the_result(spark, monkeypatch):
    one = fitted(frame(spark).coalesce(1), max_iter=5)
    monkeypatch.setattr(N, "TREE_FROM", 1)
    many = fitted(frame(spark), max_iter=5)
    for key in one.nets:
        assert np.allclose(one.nets[key].theta, many.nets[key].theta, atol=1e-8)


def test_awkward_rows(spark):
    df = frame(spark, 90)
    odd = spark.createDataFrame([(1000, None, 1.0, 1.0, 1.0, 5.0), (1001, "big", None, 1.0, None, 3.0), (1002, "big", 1.0, 1.0, 1.0, None),
                                 (1003, "one", 1.0, 1.0, 1.0, 4.0)], df.schema)
    both = df.union(odd)
    nets = fitted(both, max_iter=3)
    assert nets.scale["big"][0] == 61 and nets.nets["one", "wide"].sizes == [0, 16, 8, 1]
    got = {(r["id"], r["model"]): r["prediction"] for r in nets.predict(both).where("id >= 1000").collect()}
    assert set(got) == {(i, m) for i in (1001, 1002, 1003) for m in ("wide", "narrow")}
    assert all(v is not None and np.isfinite(v) for v in got.values())
    empty = fitted(df.limit(0), max_iter=3)
    assert empty.nets == {} and empty.predict(df).count() == 0


def test_too_many_segments(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_SEGMENTS", 1)
    with pytest.raises(ValueError, match="segments"):
        fitted(frame(spark, 30), max_iter=1)


def test_queries_against_sql_on_the_stored_predictions(spark):
    pred = q_nets.predictions(spark, SF)
    con = duckdb.connect()
    con.register("pred", pred.toPandas())
    want = con.execute("""SELECT segment, model, count(*) AS n, avg((target - prediction) ** 2) AS mse,
        1 - sum((target - prediction) ** 2) / (count(*) * var_pop(target)) AS r2, max(n_params) AS n_params, max(steps) AS steps
        FROM pred GROUP BY ALL ORDER BY ALL""").df()
    got = q_nets.segment_nets(spark, SF).toPandas().sort_values(["segment", "model"]).reset_index(drop=True)[list(want.columns)]
    assert len(want) == 10 and (got[["segment", "model", "n", "n_params", "steps"]] == want[["segment", "model", "n", "n_params", "steps"]]).all(axis=None)
    assert np.allclose(got[["mse", "r2"]], want[["mse", "r2"]])
    two = q_nets.segment_nets_comparison(spark, SF).toPandas().set_index("segment")
    by = want.set_index(["segment", "model"])
    for s, r in two.iterrows():
        full, pruned = by.loc[(s, "full")], by.loc[(s, "pruned")]
        assert np.isclose(r.mse_diff, full.mse - pruned.mse) and np.isclose(r.r2_diff, full.r2 - pruned.r2)
        assert r.reduction == full.n_params - pruned.n_params and np.isclose(r.reduction_pct, 100 * r.reduction / full.n_params, atol=1e-5)
    bins = con.execute("""WITH s AS (SELECT segment, min(target) AS lo, max(target) AS hi FROM pred GROUP BY segment)
        SELECT segment, model, CAST(least(floor((target - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS n,
               avg(target) AS mean_actual, avg(prediction) AS mean_pred
        FROM pred JOIN s USING (segment) GROUP BY ALL ORDER BY ALL""").df()
    got = q_nets.segment_nets_pred_vs_actual(spark, SF).toPandas().sort_values(["segment", "model", "bin"]).reset_index(drop=True)[list(bins.columns)]
    assert len(got) == len(bins) and (got[["bin", "n"]] == bins[["bin", "n"]]).all(axis=None)
    assert np.allclose(got[["mean_actual", "mean_pred"]], bins[["mean_actual", "mean_pred"]])


def test_driver_gets_one_gradient_per_net(spark):
    """Rows sent to the driver in a step don't grow with the number of tasks."""
    from pyspark.sql import functions as F

    from tastemill.operators.segment_nets import SUMS, summed
    for n_parts in (5, 40):
        def made(batches):
            import pandas as pd
            for _ in batches:
                yield pd.DataFrame([(s, "full", np.array([1.0, 2.0]).tobytes(), 0.5, 3) for s in "ab"], columns=["segment", "model", "g", "loss", "n"])
        tasks = spark.range(n_parts).repartitionByRange(n_parts, F.col("id")).mapInPandas(made, SUMS)
        rows = summed(tasks, n_parts).collect()
        k = tasks.count() // 2
        assert sorted(r["segment"] for r in rows) == ["a", "b"]
        assert all(list(np.frombuffer(r["g"])) == [k, 2.0 * k] and r["loss"] == 0.5 * k and r["n"] == 3 * k for r in rows)
