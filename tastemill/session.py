"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "tastemill",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    ``master`` is only set for local runs; on a cluster the launcher
    decides. Shuffle partitions default to Spark's own value unless given.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, creating a local one only
    when the session has none (tests, single-machine runs).

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is
    read from the session and never overridden.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    local = tempfile.mkdtemp(prefix="tastemill-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def materialize(df, name: str = "t", by: str | None = None):
    """Write ``df`` once as parquet under the session's checkpoint folder
    and return a DataFrame reading it back.

    This cuts lineage like ``checkpoint()`` but computes ``df`` only once
    (an eager RDD checkpoint computes it twice unless cached), and the
    files live in the shared folder, so they survive lost executors.
    ``by`` names a column of few values: its folders are read one by one.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    if by:
        df.write.mode("overwrite").partitionBy(by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(*tables) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more
    (all that was made from them is written itself)."""
    for df in tables:
        spark = df.sparkSession
        base = ensure_checkpoint_dir(spark).rstrip("/") + "/tables/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/tables/{folder.rsplit('/', 1)[-1]}" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now: it
    does so when the driver collects its garbage, which long loops of small
    jobs seldom cause (``spark.cleaner.periodicGC.interval`` is half an hour)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
