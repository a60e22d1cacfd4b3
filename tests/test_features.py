import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tastemill.operators import features as X
from tastemill.operators.regression import check_no_leak, parameter_count


def test_constant_column_scaling(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "item_id long, c double")
    z = X.standard_scale(df, ["c"]).collect()
    m = X.minmax_scale(df, ["c"]).collect()
    assert all(r["c"] == 0.0 for r in z) and all(r["c"] == 0.0 for r in m)


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "item_id long, c double")
    z = [r["c"] for r in X.standard_scale(df, ["c"]).orderBy("item_id").collect()]
    assert abs(sum(z)) < 1e-12 and abs(sum(v * v for v in z) / 4 - 1) < 1e-12


def test_median_and_mean_fill(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 10.0), (4, 2.0)], "item_id long, c double")
    med = {r["item_id"]: r["c"] for r in X.impute(df, ["c"], "median").collect()}
    mean = {r["item_id"]: r["c"] for r in X.impute(df, ["c"], "mean").collect()}
    assert med[2] == 2.0 and abs(mean[2] - 13.0 / 3) < 1e-12


def test_null_keys_and_audit(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "id long, title string")
    kept = X.drop_null_keys(df, ["id", "title", "missing"])
    a = X.load_audit(df, kept).first()
    assert (a["rows_before"], a["rows_after"], a["rows_removed"]) == (3, 1, 2)


def test_poly2_order(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    p, names = X.poly2_features(df, ["a", "b"])
    r = p.first()
    assert names == ["a_a", "a_b", "b_b"] and (r["a_a"], r["a_b"], r["b_b"]) == (4.0, 6.0, 9.0)


def test_assign_item_id_dense(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(57)], "name string")
    ids = sorted((r["name"], r["item_id"]) for r in X.assign_item_id(df, None, ["name"]).collect())
    assert [i for _, i in ids] == list(range(57))


def test_parameter_counts_and_leak_guard():
    assert parameter_count([12, 100, 50, 1]) == 6401 and parameter_count([12, 50, 25, 1]) == 1951
    assert parameter_count([6, 20, 10, 1]) == 361 and parameter_count([22, 100, 50, 1]) == 7401
    with pytest.raises(ValueError):
        check_no_leak(["a", "target"], "target")


def test_numbering_with_payload_at_size(spark):
    """400,000 rows, a payload column, one group with most rows: numbers are
    dense and follow the order."""
    from tastemill.functions.core import dense_positions
    df = spark.range(400_000, numPartitions=16).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("k"), F.rand(3).alias("payload"), "id")
    got = X.assign_item_id(df, None, ["k"])
    assert got.agg(F.count_distinct("item_id"), F.min("item_id"), F.max("item_id")).first() == (400_000, 0, 399_999)
    w = Window.partitionBy("g").orderBy("k")
    pos = dense_positions(df, ["k"], "pos", ["g"]).withColumn("want", F.row_number().over(w))
    assert pos.where("pos <> want").count() == 0 and pos.count() == 400_000
    plain = dense_positions(df, ["k"]).withColumn("want", F.row_number().over(Window.orderBy("k")))
    assert plain.where("pos <> want").count() == 0


def test_numbering_of_ties_and_nulls(spark):
    from tastemill.functions.core import dense_positions
    df = spark.createDataFrame([(None, 1)] * 5 + [("a", 1)] * 3 + [("a", None)], "g string, o int")
    got = dense_positions(df, ["o"], "pos", ["g"]).collect()
    assert sorted(r["pos"] for r in got if r["g"] is None) == [1, 2, 3, 4, 5]
    assert sorted(r["pos"] for r in got if r["g"] == "a") == [1, 2, 3, 4]
    assert dense_positions(df.limit(0), ["o"], "pos", ["g"]).count() == 0
