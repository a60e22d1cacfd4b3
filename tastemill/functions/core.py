"""Column expressions shared by all operators.

Randomness is replaced by a hash order: ``md5('<seed>:<key>')``. It is
stable under repartitioning and the same string in Spark and DuckDB, so
every "random pick" can be checked by SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """md5 of ``'<seed>:<c1>:<c2>…'``; order by it for a seeded shuffle."""
    parts: list[Column] = [F.lit(f"{seed}")]
    for c in cols:
        parts += [F.lit(":"), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.md5(F.concat(*parts))


def split_bucket(seed: int | str, key: str | Column, buckets: int = 100) -> Column:
    """0..buckets-1 from the first 32 bits of the hash key (train/test split)."""
    h = hash_key(seed, key)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (ANSI mode raises otherwise)."""
    return num / F.nullif(den, F.lit(0))


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round half away from zero on the scaled double, the way DuckDB's
    ``round`` does. Spark's ``round`` goes through BigDecimal and costs
    ~0.7 µs per row; this stays in primitive arithmetic. ``+ 0.0`` turns
    a negative zero into zero."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    m = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(m) + F.lit(0.5)) / F.lit(m) + F.lit(0.0)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows per ``by`` group.

    ``row_number() <= n`` is planned as a WindowGroupLimit, so each
    partition keeps only ``n`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def parse_genres(c: str | Column, delimiter: str = r"\s+") -> Column:
    """Genre text → array<string>, per row.

    A JSON list of ``{"name": …}`` gives the names; any other non-empty
    text is split on ``delimiter``; NULL or blank gives ``['Unknown']``.
    An empty JSON list stays empty.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    as_json = F.from_json(t, "array<struct<name:string>>")
    names = F.transform(as_json, lambda s: s["name"])
    plain = F.split(t, delimiter)
    return (F.when(c.isNull() | (t == ""), F.array(F.lit("Unknown")))
            .when(t.startswith("[") & as_json.isNotNull(), names)
            .otherwise(plain))


def snippet(c: str | Column, limit: int = 200, keep: int = 197) -> Column:
    """Text longer than ``limit`` characters → first ``keep`` + '...'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def pick_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Columns of ``wanted`` that exist in ``df``, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def placed_in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ``order``, written once, with ``_rank`` (0-based, over all rows).

    Rows are range-partitioned and sorted by ``order``; ties, a third of
    all rows even, are split by the scan position. The layout is written to
    the checkpoint folder, so the row counts of the partitions and the rows
    themselves come from one and the same dealing. A rank is the row's
    place in its partition plus the sizes of all earlier partitions (one
    row per partition, summed by a small window and broadcast)."""
    from tastemill.session import materialize
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*order, "_scan"]
    dealt = (df.withColumn("_scan", F.monotonically_increasing_id())
             .repartitionByRange(n, *by).sortWithinPartitions(*by))
    # the id holds the partition above bit 33 and the place in it below
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_scan"), "placed")
    placed = placed.withColumn("_pid", F.shiftright("_at", 33))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = sizes.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_before"))
    return (placed.join(F.broadcast(before), "_pid")
            .withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_pid", "_before", "_at"))


def dense_positions(df: DataFrame, order: list[str], out: str = "pos",
                    group: list[str] | None = None) -> DataFrame:
    """1-based position in ``order`` (within each ``group`` if given),
    without a one-task window even when one group holds most rows: the
    rank over (group, order) less the first rank of the group."""
    group = group or []
    ranked = placed_in_order(df, [*group, *order])
    if not group:
        return ranked.withColumn(out, F.col("_rank") + 1).drop("_rank")
    starts = ranked.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min("_rank").alias("_first"))
    on = None
    for g in group:
        c = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        on = c if on is None else on & c
    return (ranked.join(starts, on).withColumn(out, F.col("_rank") - F.col("_first") + 1)
            .drop("_rank", "_first", *[f"_g_{g}" for g in group]))
