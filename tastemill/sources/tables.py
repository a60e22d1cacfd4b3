"""Sources: raw parquet/CSV scans and the engine inputs derived from them.

The engine works on a small set of logical inputs (``catalog``,
``feedback``, ``vectors``, ``interactions``, ``runs``, ``regression``,
``corpus``, ``turns``, ``rule_texts``). This module derives each one from
the test tables with plain joins and aggregates; the SQL twins live in
``tastemill.plans.inputs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must stay equal for comparable results) ----------------
# event type -> component name of the energy ledger (the five model names)
COMPONENT_OF_EVENT = {
    "purchase": "Content-based Model",
    "signup": "Clustering Model",
    "click": "Matrix Factorization Model",
    "view": "Pure Collaborative Filtering Model",
    "error": "Deep Learning Model",
}
# event type -> implicit rating
RATING_OF_EVENT = {"purchase": 5.0, "signup": 4.0, "click": 3.0, "view": 1.0, "error": -3.0}
# order priority -> code (map_encode; anything else becomes NULL)
PRIORITY_CODE = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the test set. Column pruning and filters
    written downstream reach the scan (ReadSchema / PushedFilters).

    A file with a single row group is read by one task, which would leave
    all map-side work before the first shuffle on one core. When the scan
    has fewer partitions than the cluster's parallelism it is spread
    round-robin (a no-op for large inputs, which already split)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    par = spark.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def csv_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files below ``paths``, in the order of the paths, then by name."""
    out = []
    for p in paths:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("path").orderBy("path")
        out += [r["path"] for r in found.collect()]
    return out


def scan_catalog_csv(spark: SparkSession, paths: list[str], schema: T.StructType,
                     min_rows: int = 0, required: str | None = None) -> DataFrame:
    """The first catalogue file that fits: its header holds ``required`` and
    it has more than ``min_rows`` rows. ``paths`` is a short list of
    candidate files or folders, tried in order.

    Columns are taken by name from the file's own header and cast to
    ``schema`` (missing ones are null); values that don't cast are null."""
    for path in csv_files(spark, paths):
        df = spark.read.option("header", True).csv(path)       # reads the header only
        names = {c.strip().lower(): c for c in df.columns}
        if required is not None and required.lower() not in names:
            continue
        cols = [F.expr(f"try_cast(`{names[f.name.lower()]}` AS {f.dataType.simpleString()})").alias(f.name) if f.name.lower() in names
                else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        out = df.select(*cols)
        if out.count() > min_rows:
            return out
    raise ValueError(f"no file below {paths} has a column {required!r} and more than {min_rows} rows")


_DERIVED: dict = {}


def _derived(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Engine inputs (catalogue, feedback, …) are derived tables: each is
    written once per application and source folder under the shared
    checkpoint folder and read back by every later query, instead of
    re-joining lineitem and orders in every plan that needs them."""
    from tastemill.session import materialize, sweep
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _DERIVED:
        df = build()
        # spread over the cluster's parallelism so readers get that many
        # files (AQE may coalesce a small result into a single file)
        df = df.repartition(spark.sparkContext.defaultParallelism, df.columns[0])
        _DERIVED[key] = materialize(df, f"input-{name}")
        sweep(spark)            # the shuffles behind it aren't read again
    return _DERIVED[key]


def _map_expr(mapping: dict, col: str) -> F.Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[F.col(col)]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "catalog", lambda: _catalog(spark, sf_dir))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """catalog(item_id, title, genre, subgenre, genres, price, size,
    n_orders, qty, avg_price, avg_discount, first_ship).

    part ⋈ per-part lineitem aggregates (partial aggregation before the
    shuffle; the join is on the aggregated side, one row per part).
    """
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy(F.col("l_partkey").alias("item_id"))
          .agg(F.count(F.lit(1)).alias("n_orders"),
               F.sum("l_quantity").alias("qty"),
               F.avg("l_extendedprice").alias("avg_price"),
               F.avg("l_discount").alias("avg_discount"),
               F.min("l_shipdate").alias("first_ship")))
    p = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("genre"), F.col("p_brand").alias("subgenre"),
        F.split(F.col("p_name"), " ").alias("genres"),
        F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return (p.join(li, "item_id", "left")
            .withColumn("n_orders", F.col("n_orders").cast("double")))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "feedback", lambda: _feedback(spark, sf_dir))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feedback(user_id, item_id, label, round_id): orders ⋈ lineitem.

    label -1 when any line of the (customer, part) pair was returned
    ('R'), else 1; round_id = year of the first order of the pair.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
            .agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_r"),
                 F.year(F.min("o_orderdate")).alias("round_id"))
            .select("user_id", "item_id",
                    F.when(F.col("_r") == 1, -1).otherwise(1).alias("label"), "round_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors(item_id, features array<double>, genre int) from embeddings."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    F.col("label").alias("genre"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "interactions", lambda: _interactions(spark, sf_dir))


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interactions(user_id, item_id, rating): events rated by type and
    summed per pair (duplicates add up, as a sparse-matrix build does)."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.select("user_id",
                      F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                      _map_expr(RATING_OF_EVENT, "event_type").alias("rating"))
            .filter(F.col("item_id").isNotNull() & F.col("rating").isNotNull())
            .groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs(run_id, component, seq, duration_s) from events."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id"),
                     _map_expr(COMPONENT_OF_EVENT, "event_type").alias("component"),
                     F.col("event_id").alias("seq"), F.col("ts"),
                     F.col("value").alias("duration_s"))


def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "regression_rows", lambda: _regression_rows(spark, sf_dir))


def _regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regression(order_id, segment, n_lines, sum_qty, avg_discount,
    avg_tax, acctbal, priority, target)."""
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).cast("double").alias("n_lines"),
               F.sum("l_quantity").alias("sum_qty"),
               F.avg("l_discount").alias("avg_discount"),
               F.avg("l_tax").alias("avg_tax")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = (o.join(li, o.o_orderkey == li.l_orderkey, "inner")
         .join(c, o.o_custkey == c.c_custkey, "inner"))
    return j.select(F.col("o_orderkey").alias("order_id"), F.col("c_mktsegment").alias("segment"),
                    "n_lines", "sum_qty", "avg_discount", "avg_tax",
                    F.col("c_acctbal").alias("acctbal"),
                    _map_expr(PRIORITY_CODE, "o_orderpriority").cast("double").alias("priority"),
                    F.col("o_totalprice").alias("target"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("author"), "text")


def write_recs(recs: DataFrame, path: str, model_col: str = "model") -> None:
    """Sink: recommendations as parquet, partitioned by model, each model's
    rows clustered by user so later per-user reads touch few files."""
    (recs.repartition(model_col, "user_id").sortWithinPartitions(model_col, "user_id", "rank")
     .write.mode("overwrite").partitionBy(model_col).parquet(path))
