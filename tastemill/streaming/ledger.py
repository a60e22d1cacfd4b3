"""Structured Streaming forms of the energy ledger and the feedback loop.

Streams are read with the file source (schema taken from the batch
table, never inferred per file), aggregated in ``update`` mode (the daily
timing drops old state by a watermark; the other two keep a row per key),
and written with ``foreachBatch`` to
an append-only upsert log under the checkpoint folder. Reading the log
keeps the latest version of each key (highest batch id), which is the
final table. ``Trigger.AvailableNow`` processes what is there and stops,
so the same code serves a backfill and a continuous job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.operators import energy as G
from tastemill.session import ensure_checkpoint_dir
from tastemill.sources.tables import COMPONENT_OF_EVENT, _map_expr


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """File stream over the table: over its own folder, or, if the table is
    one file, over that file beside the others. The schema comes from the
    batch table."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1)
    if all(f.rsplit("/", 1)[-1] == f"{name}.parquet" for f in batch.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir.rstrip("/"))
    return stream.parquet(path)


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_stream(spark, sf_dir, "events")


def run_to_table(stream: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """Run ``stream`` to completion (AvailableNow) into an upsert log and
    return the compacted table (latest row per key)."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tag = f"{name}-{uuid.uuid4().hex}"
    sink, ckpt = f"{base}/streams/{tag}/data", f"{base}/streams/{tag}/checkpoint"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (stream.writeStream.outputMode(mode).foreachBatch(upsert)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    log = spark.read.parquet(sink)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_batch")


def stream_daily_timing(spark: SparkSession, sf_dir: str, watermark: str = "1 day") -> DataFrame:
    """Seconds and runs per (day, component), event-time windows."""
    ev = _events_stream(spark, sf_dir)
    runs = ev.select(_map_expr(COMPONENT_OF_EVENT, "event_type").alias("component"),
                     F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration_s"))
    agg = (runs.withWatermark("ts", watermark)
           .groupBy(F.window("ts", "1 day").alias("w"), "component")
           .agg(F.sum("duration_s").alias("seconds"), F.count(F.lit(1)).alias("n_runs")))
    out = run_to_table(agg, ["w", "component"], "daily-timing")
    return out.select(F.to_date(F.col("w.start")).alias("day"), "component", "seconds", "n_runs")


def stream_component_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write per (run, component) kept as streaming state
    (``max_by`` on the sequence number), then priced in watts."""
    ev = _events_stream(spark, sf_dir)
    runs = ev.select(F.col("user_id").alias("run_id"),
                     _map_expr(COMPONENT_OF_EVENT, "event_type").alias("component"),
                     F.col("event_id").alias("seq"), F.col("value").alias("duration_s"))
    last = runs.groupBy("run_id", "component").agg(F.max_by("duration_s", "seq").alias("duration_s"))
    out = run_to_table(last, ["run_id", "component"], "component-energy")
    return out.select("run_id", "component", "duration_s",
                      (G.component_power(F.col("component")) * F.col("duration_s") / 3600.0).alias("energy_wh"))


def stream_feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user feedback tallies updated as order lines arrive: likes,
    dislikes and the smoothed success rate (success+1)/(total+2)."""
    li = _table_stream(spark, sf_dir, "lineitem")
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select("o_orderkey", "o_custkey")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)          # stream-static join
    agg = j.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("success"))
    out = run_to_table(agg, ["user_id"], "feedback-weights")
    return out.select("user_id", "total", "success",
                      ((F.col("success") + 1.0) / (F.col("total") + 2.0)).alias("rate"))
