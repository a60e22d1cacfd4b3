import hashlib

from pyspark.sql import functions as F

from tastemill.functions.core import hash_key, parse_genres, r6, snippet, split_bucket


def test_parse_genres_branches(spark):
    rows = [('[{"id": 1, "name": "Drama"}, {"id": 2, "name": "Crime"}]',), ("Action Science Fiction",),
            (None,), ("[]",), ("[broken",)]
    df = spark.createDataFrame(rows, "g string").select(parse_genres("g").alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got == [["Drama", "Crime"], ["Action", "Science", "Fiction"], ["Unknown"], [], ["[broken"]]


def test_hash_key_is_plain_md5(spark):
    df = spark.createDataFrame([(7,)], "item_id long").select(hash_key(42, "item_id").alias("h"))
    assert df.first()["h"] == hashlib.md5(b"42:7").hexdigest()


def test_split_bucket_stable_range(spark):
    df = spark.range(1000).select(split_bucket(42, "id").alias("b"))
    bs = [r["b"] for r in df.collect()]
    assert min(bs) >= 0 and max(bs) < 100
    h = hashlib.md5(b"42:5").hexdigest()
    assert bs[5] == int(h[:8], 16) % 100


def test_snippet_and_rounding(spark):
    df = spark.createDataFrame([("x" * 250,), ("short",)], "t string").select(snippet("t").alias("s"))
    s = [r["s"] for r in df.collect()]
    assert len(s[0]) == 200 and s[0].endswith("...") and s[1] == "short"
    v = spark.createDataFrame([(-1e-9,), (7.7e-6,), (-7.7e-6,)], "x double").select(r6("x").alias("y"))
    ys = [r["y"] for r in v.collect()]
    assert str(ys[0]) == "0.0" and ys[1] == 8e-6 and ys[2] == -8e-6
