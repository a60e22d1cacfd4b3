"""Connected components by alternating large-star and small-star steps.

Each round maps edges to the smallest neighbour with one aggregation and one
join per step and writes the edge table to the shared folder, so lineage is
cut and lost executors cost one round at most. A hot node is a hot join key
of a plain join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    return (both.join(low, F.col("u") == F.col("k")).where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    linked = e.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("k", "m")).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """One round over ``edges`` (a, b): other edges with the same components,
    fewer steps deep, in a written table."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    return materialize(_small_star(_large_star(e)).toDF("a", "b"), "edges")


def nearest_labels(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: a smaller node that it is connected with. Equal
    labels mean one component; different ones needn't mean two."""
    return edges.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> ``node``, ``label``: the smallest node of its
    component, for every node but the smallest itself. No edge, no rows."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
        old, e = e, materialize(_small_star(_large_star(e)), "edges")
        discard(old)
