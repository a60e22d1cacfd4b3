import os
import tempfile

import pytest

from pyspark.sql import types as T

from tastemill.sources.tables import scan_catalog_csv, write_recs


def test_csv_scan_checks_files(spark):
    d = tempfile.mkdtemp(prefix="tm-csv-")
    os.makedirs(f"{d}/a")
    with open(f"{d}/a/movies.csv", "w") as f:
        f.write("id,title,vote_average\n" + "".join(f"{i},t{i},{i % 10}\n" for i in range(150)))
    with open(f"{d}/small.csv", "w") as f:
        f.write("id,title,vote_average\n" + "".join(f"{i},s{i},1\n" for i in range(20)))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
                           T.StructField("vote_average", T.DoubleType())])
    df = scan_catalog_csv(spark, [d], schema, min_rows=100, required="title")
    assert df.count() == 150
    # the header decides, not the position
    with open(f"{d}/0.csv", "w") as f:
        f.write("a,b\n" + "".join(f"{i},x{i}\n" for i in range(150)))
    assert scan_catalog_csv(spark, [f"{d}/0.csv", d], schema, min_rows=100, required="title").where("title = 't7'").count() == 1
    with open(f"{d}/1.csv", "w") as f:
        f.write("vote_average,extra,title\n" + "".join(f"{i % 10},x,t{i}\n" for i in range(120)))
    by_name = scan_catalog_csv(spark, [f"{d}/1.csv"], schema, min_rows=100, required="title")
    assert by_name.columns == ["id", "title", "vote_average"] and by_name.where("id IS NULL AND vote_average = 3 AND title = 't3'").count() == 1
    with pytest.raises(ValueError):
        scan_catalog_csv(spark, [f"{d}/0.csv"], schema, min_rows=100, required="title")


def test_recs_sink_partitioned(spark):
    d = tempfile.mkdtemp(prefix="tm-sink-")
    recs = spark.createDataFrame([(1, 10, 0.5, 1, "pruned"), (1, 11, 0.4, 2, "pruned"), (2, 10, 0.9, 1, "genre")],
                                 "user_id long, item_id long, score double, rank int, model string")
    write_recs(recs, f"{d}/recs")
    back = spark.read.parquet(f"{d}/recs")
    assert {"model=genre", "model=pruned"} <= set(os.listdir(f"{d}/recs")) and back.count() == 3
    assert back.filter("model = 'pruned'").count() == 2
