"""Row hygiene, imputation, scaling and feature engineering.

Statistics (median, mean, std, min, max) are computed in ONE aggregate
per call and come back as a single row (size bounded by the number of
columns), then applied as literals inside codegen'd projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.core import dense_positions, placed_in_order, safe_div
from tastemill.operators.selection import quantiles


# ---------------------------------------------------------------- hygiene
def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows where any existing key column is NULL."""
    keys = [k for k in keys if k in df.columns]
    return df.na.drop(subset=keys) if keys else df


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null) for every column, from one aggregate."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return df.agg(*aggs).selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, n_null)")


def load_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_before, rows_after, rows_removed in one aggregate over a tagged union."""
    tagged = (before.select(F.lit(1).alias("_b"), F.lit(0).alias("_a"))
              .unionByName(after.select(F.lit(0).alias("_b"), F.lit(1).alias("_a"))))
    return (tagged.agg(F.sum("_b").cast("bigint").alias("rows_before"),
                       F.sum("_a").cast("bigint").alias("rows_after"))
            .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after")))


def assign_item_id(df: DataFrame, id_col: str | None, order_cols: list[str],
                   out: str = "item_id") -> DataFrame:
    """Use ``id_col`` as the key when present, else a dense 0-based number
    in ``order_cols`` order (no single-task window; other columns ride
    along)."""
    if id_col and id_col in df.columns:
        return df.withColumn(out, F.col(id_col))
    return placed_in_order(df, order_cols).withColumn(out, F.col("_rank").cast("bigint")).drop("_rank")


def dedupe_ids(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Keep the first occurrence (smallest ``pos``) of every key: a
    ``min_by`` hash aggregate, so a key repeated a million times is
    combined map-side."""
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(pos)).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


# ------------------------------------------------------------ imputation
def column_stats(df: DataFrame, cols: list[str], stats: list[str],
                 relative_error: float | None = None) -> dict:
    """{(stat, col): value} from one aggregate. ``median`` is exact, by
    distributed selection, unless ``relative_error`` is given (then
    ``percentile_approx``)."""
    if "median" in stats and relative_error is None:
        rest = [s for s in stats if s != "median"]
        found = column_stats(df, cols, rest) if rest else {}
        return found | {("median", c): v for c, v in quantiles(df, cols, 0.5).items()}
    aggs = []
    for c in cols:
        for s in stats:
            if s == "median":
                e = F.percentile_approx(c, 0.5, int(1 / relative_error))
            elif s == "mean":
                e = F.avg(c)
            elif s == "std_pop":
                e = F.stddev_pop(c)
            elif s == "min":
                e = F.min(c)
            elif s == "max":
                e = F.max(c)
            else:
                raise ValueError(s)
            aggs.append(e.cast("double").alias(f"{s}__{c}"))
    row = df.agg(*aggs).first()
    return {(s, c): row[f"{s}__{c}"] for c in cols for s in stats}


def impute(df: DataFrame, cols: list[str], strategy: str = "median",
           relative_error: float | None = None) -> DataFrame:
    """Fill NULLs of numeric ``cols`` with the column median or mean."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    st = column_stats(df, cols, [strategy], relative_error)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(st[(strategy, c)]))
                           for c in cols})


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.fill(0.0, subset=[c for c in cols if c in df.columns])


# --------------------------------------------------------------- scaling
def zscore_expr(c: str, mean: float, sd: float) -> Column:
    """(x - mean) / sd with the population std; sd 0 or NULL divides by 1."""
    sd = 1.0 if (sd is None or sd == 0.0) else sd
    return (F.col(c) - F.lit(mean)) / F.lit(sd)


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Z-score ``cols`` in place (population std). ``fit_on`` fits the
    statistics on another frame (e.g. the training rows only)."""
    st = column_stats(fit_on if fit_on is not None else df, cols, ["mean", "std_pop"])
    return df.withColumns({c: zscore_expr(c, st[("mean", c)], st[("std_pop", c)]) for c in cols})


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    st = column_stats(df, cols, ["min", "max"])
    out = {}
    for c in cols:
        lo, hi = st[("min", c)], st[("max", c)]
        rng = (hi - lo) if (hi is not None and lo is not None) else None
        out[c] = (F.lit(0.0) if not rng else (F.col(c) - F.lit(lo)) / F.lit(rng))
    return df.withColumns(out)


def poly2_features(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """All products x_i * x_j for i <= j, named ``a_b``, after the originals."""
    names, exprs = [], {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            n = f"{a}_{b}"
            names.append(n)
            exprs[n] = F.col(a) * F.col(b)
    return df.withColumns(exprs), names


# ------------------------------------------------------- categorical
def genre_vocabulary(df: DataFrame, genres_col: str = "genres") -> DataFrame:
    """Distinct non-empty genres over all rows (one shuffle, partial distinct)."""
    return (df.select(F.explode(genres_col).alias("genre"))
            .filter((F.col("genre").isNotNull()) & (F.col("genre") != ""))
            .distinct())


def collect_vocabulary(vocab: DataFrame, col: str = "genre", max_size: int = 4096) -> list:
    """Sorted vocabulary as a Python list, with its size checked first: it
    becomes one column per entry, so it must stay small."""
    n = vocab.count()
    if n > max_size:
        raise ValueError(f"vocabulary of {n} entries exceeds {max_size}; use a sparse encoding")
    return [r[0] for r in vocab.orderBy(col).collect()]


def multi_hot(df: DataFrame, genres_col: str, vocab: list[str], prefix: str = "genre_") -> DataFrame:
    """0/1 column per vocabulary entry: array_contains(genres, g)."""
    return df.withColumns({f"{prefix}{g}": F.array_contains(genres_col, g).cast("int") for g in vocab})


def vocabulary_index(vocab: DataFrame, col: str = "genre") -> DataFrame:
    """(col, idx): 0-based place of every entry in ascending order, numbered
    without collecting the vocabulary or sorting it in one task."""
    return dense_positions(vocab.select(col), [col], "idx").withColumn("idx", F.col("idx") - 1)


def multi_hot_sparse(df: DataFrame, index: DataFrame, genres_col: str = "genres", key: str = "item_id") -> DataFrame:
    """(key, indices array<bigint>, values array<int>): the ones of ``multi_hot``
    as ascending places in a vocabulary of any size, joined and not inlined.
    Words outside the vocabulary, nulls and repeats in a list add nothing; a
    list that is null or empty gives empty arrays. Rows of one ``key`` are one."""
    word = index.columns[0]
    pairs = df.select(key, F.explode(genres_col).alias(word)).distinct().join(index, word)
    ones = pairs.groupBy(key).agg(F.sort_array(F.collect_set("idx")).alias("indices"))
    out = df.select(key).distinct().join(ones, key, "left")
    empty = F.array().cast("array<bigint>")
    return out.withColumn("indices", F.coalesce("indices", empty)).withColumn("values", F.transform("indices", lambda _: F.lit(1)))


def one_hot(df: DataFrame, col: str, values: list[str], prefix: str = "genre_") -> DataFrame:
    return df.withColumns({f"{prefix}{v}": (F.col(col) == F.lit(v)).cast("int") for v in values})


def map_encode(col: str, mapping: dict) -> Column:
    """Fixed value → number; anything unmapped is NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[F.col(col)]


def primary_secondary(genres_col: str = "genres") -> tuple[Column, Column]:
    g = F.col(genres_col)
    first = F.get(g, 0)
    second = F.get(g, 1)
    return (F.coalesce(first, F.lit("Unknown")),
            F.coalesce(second, first, F.lit("Unknown")))


def release_year(date_col: str) -> Column:
    """Year of a date/timestamp/text column; unparseable text is NULL."""
    return F.year(F.try_to_timestamp(F.col(date_col).cast("string"))).cast("double")


# -------------------------------------------------------- catalogue table
def item_features(catalog: DataFrame, cols: list[str], materialize_result: bool = True) -> DataFrame:
    """(item_id, genre, genres, <cols> z-scored): median-fill then z-score,
    both from one aggregate each. The result (one row per item) is written
    once to the checkpoint folder, because every recommender reads it
    several times (statistics, profiles, candidate joins)."""
    from tastemill.session import materialize
    cols = [c for c in cols if c in catalog.columns]
    base = catalog.select("item_id", "genre", "genres", *[F.col(c).cast("double").alias(c) for c in cols])
    if not materialize_result:
        return standard_scale(impute(base, cols, "median"), cols)
    base = base.persist()   # catalogue-sized; read by two statistics passes and the write
    out = materialize(standard_scale(impute(base, cols, "median"), cols), "item-features")
    base.unpersist()
    return out
