"""Sparse 0/1 vectors over a vocabulary of any size."""

from pyspark.sql import functions as F

from tastemill.operators import features as X

SCHEMA = "item_id long, genres array<string>"


def test_equal_to_the_columns(spark):
    rows = [(1, ["b", "a", "a"]), (2, None), (3, []), (4, ["c", None, ""]), (5, ["b"]), (6, ["b"])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = X.vocabulary_index(X.genre_vocabulary(df))
    assert {r["genre"]: r["idx"] for r in index.collect()} == {"a": 0, "b": 1, "c": 2}
    wide = {r["item_id"]: [r["genre_a"] or 0, r["genre_b"] or 0, r["genre_c"] or 0] for r in X.multi_hot(df, "genres", ["a", "b", "c"]).collect()}
    got = X.multi_hot_sparse(df, index).collect()
    assert {r["item_id"]: [int(i in r["indices"]) for i in range(3)] for r in got} == wide
    assert all(r["indices"] == sorted(r["indices"]) and r["values"] == [1] * len(r["indices"]) for r in got) and len(got) == 6


def test_wide_vocabulary(spark):
    """20,000 words, one of them in every list."""
    words = F.array(F.lit("hot"), F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("w"), (F.col("id") * 7 + 3) % 19999))
    df = spark.range(19999).select(F.col("id").alias("item_id"), words.alias("genres"))
    index = X.vocabulary_index(X.genre_vocabulary(df))
    assert index.agg(F.count("*"), F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()[:] == (20000, 0, 19999, 20000)
    got = X.multi_hot_sparse(df, index)
    want = df.select("item_id", F.explode(F.array_distinct("genres")).alias("genre")).join(index, "genre").select("item_id", "idx")
    flat = got.select("item_id", F.explode("indices").alias("idx"))
    assert got.count() == 19999 and flat.exceptAll(want).isEmpty() and want.exceptAll(flat).isEmpty()


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert X.multi_hot_sparse(df, X.vocabulary_index(X.genre_vocabulary(df))).count() == 0
