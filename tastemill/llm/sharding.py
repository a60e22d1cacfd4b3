"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a few bits each, the cells are numbered
along a Hilbert curve, the rows are sorted by that number and the sorted run
is cut into shards. Neighbouring cells keep company, so each shard covers
small ranges of several dimensions at once and its file can be skipped by a
filter on any of them (``shard_ranges`` gives the ranges, ``write_shards`` the
files).

Law ``rows``: of N sorted rows, row r (from 0) goes to shard
floor(r * shards / N), so counts differ by one at most. Ranks come from one
range-partitioned, sorted table that is written to the shared checkpoint
folder: a partition's row counts, summed over the partitions before it, are
the only thing beyond the row itself that a rank needs. No window covers all
rows. Equal keys, a third of all rows even, are split by the scan position,
the last sort key.

Edge cases: null dimensions have cell 0; a null text has no bytes (size 1,
crc32 of nothing, 0); repeated rows are rows of their own; an empty table
gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from tastemill.llm.textbuf import table
from tastemill.session import materialize

BITS = 6
SHARDS = 16


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position along the Hilbert curve of cells given by one coordinate
    array per dimension: Gray-code the bit planes from the top, rotating and
    reflecting the remaining lower bits, then interleave."""
    x = [a.astype(np.int64) for a in axes]
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:                    # undo the excess of each plane
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):        # Gray code over the dimensions
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x = [v ^ turn for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> b) & 1)
    return out


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """Hilbert number of integer cell columns (each below 2**bits)."""

    @arrow_udf("bigint")
    def run(cols: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in cols:
            yield pa.array(hilbert_index([np.asarray(c) for c in batch], bits))

    return run(*[F.coalesce(c.cast("bigint"), F.lit(0)) for c in cells])


def log_cell(col: Column, bits: int = BITS) -> Column:
    """Cell of a size: quarter powers of two, from 1 up to 2**16 and beyond."""
    return F.least(F.lit((1 << bits) - 1), F.floor(4 * F.log2(F.greatest(col, F.lit(1)).cast("double")))).cast("bigint")


def label_cell(col: Column, bits: int = BITS) -> Column:
    """Cell of a label: a hash, so equal labels share a cell."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(col.cast("string")), F.lit(1 << bits)))


def number_cell(col: Column, low, high, bits: int = BITS) -> Column:
    """Cell of a number between the table's ``low`` and ``high``."""
    width = max(1.0, (high or 0) - (low or 0) + 1.0)
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((col - F.lit(low or 0)) / F.lit(width) * (1 << bits)))).cast("bigint")


def assign(rows: DataFrame, cells: list[Column], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` (narrow: ids and metadata, no texts) with ``hilbert``,
    ``shard`` and ``slot``. ``ties`` orders rows of one cell."""
    spark = rows.sparkSession
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("hilbert", hilbert(cells, bits)).withColumn("_scan", F.monotonically_increasing_id())
    order = ["hilbert", *ties, "_scan"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id holds the partition above bit 33 and the row's place below it
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_scan"), "hilbert")
    part = F.shiftright("_at", 33)
    sums = placed.groupBy(part.alias("_part")).count()
    before = sums.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"),
                         F.sum("count").over(Window.partitionBy()).alias("_all"))   # one row per partition
    ranked = (placed.withColumn("_part", part).join(F.broadcast(before), "_part")
              .withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)))
    shard = F.expr(f"(_rank * {shards}) div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return (ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - first)
            .drop("_part", "_at", "_before", "_all", "_rank"))


def shard_ranges(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard: row count and the range of each dimension, for pruning."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One folder per shard below ``path``, rows in slot order within each
    file; several tasks may write one shard."""
    narrow = assigned.select(id_col, "shard", "slot").dropDuplicates([id_col])
    (docs.join(narrow, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    none = F.lit("").cast("binary")
    narrow = docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), none)).alias("text_crc32"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cells = [label_cell(F.col("lang")), label_cell(F.col("source")), log_cell(F.col("size")), number_cell(F.col("doc_id"), low, high)]
    done = assign(narrow, cells, ["text_crc32", "doc_id"])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "hilbert")
