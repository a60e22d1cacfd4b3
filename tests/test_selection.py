"""Quantiles by distributed selection against sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import selection as S


def want(values, q):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    h = (len(v) - 1) * q
    lo = math.floor(h)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] if v[lo] == v[hi] else v[lo] + (h - lo) * (v[hi] - v[lo])


@pytest.mark.parametrize("q", [0.0, 0.5, 0.8, 1.0])
def test_columns_of_many_shapes(spark, q):
    rng = np.random.RandomState(2)
    n = 3001
    cols = {"normal": rng.normal(size=n), "ties": rng.randint(0, 4, n).astype(float), "hot": np.where(rng.rand(n) < 0.4, 7.0, rng.normal(size=n)),
            "wide": rng.normal(size=n) * 10.0 ** rng.randint(-250, 250, n), "one": np.full(n, -3.5), "two": np.where(np.arange(n) % 2, 1.0, 2.0),
            "close": 1.0 + rng.randint(0, 50, n) * 2.0 ** -52, "ends": np.where(np.arange(n) < 3, np.inf, np.where(np.arange(n) < 6, -np.inf, rng.normal(size=n)))}
    rows = [[None if k % 7 == 0 and name == "normal" else (float("nan") if k % 11 == 0 and name == "ties" else float(v[k])) for name, v in cols.items()] for k in range(n)]
    names = [*cols, "none"]
    df = spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"`{c}` double" for c in names))
    got = S.quantiles(df, names, q, small=0)
    for k, c in enumerate(cols):
        if not (c == "ends" and q in (0.0, 1.0)):
            assert got[c] == pytest.approx(want([r[k] for r in rows], q), rel=1e-12), c
    assert got["none"] is None
    assert S.quantiles(df, ["hot"], q)["hot"] == pytest.approx(got["hot"], rel=1e-12)
    assert S.quantiles(df.limit(0), ["hot"], q, small=-1)["hot"] is None


def test_millions_of_distinct_values(spark):
    """No task holds more than one interval's bins."""
    n = 10_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n * 0.001).alias("v"))
    assert S.quantiles(df, ["v"], 0.5)["v"] == pytest.approx((n - 1) * 0.0005, rel=1e-12)
