"""Feature assembly: originals + pairwise products + genre dummies into
one array<double> per item. Only declared numeric columns and declared
dummies enter; the type check is done on the schema at plan time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.operators import features as X

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def numeric_columns(df: DataFrame, cols: list[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if c in types and isinstance(types[c], NUMERIC)]


def assemble_item_vectors(catalog: DataFrame, cols: list[str], genre_col: str = "genre") -> DataFrame:
    """(item_id, genre, features array<double>): z-scored ``cols``, their
    products (i <= j) and one 0/1 entry per genre, in that order."""
    cols = numeric_columns(catalog, cols)
    z = X.item_features(catalog, cols)
    z, prods = X.poly2_features(z, cols)
    vocab = X.collect_vocabulary(catalog.select(genre_col).distinct(), genre_col)
    dummies = [(F.col(genre_col) == F.lit(g)).cast("double") for g in vocab]
    return z.select("item_id", genre_col,
                    F.array(*[F.col(c) for c in cols + prods], *dummies).alias("features"))
