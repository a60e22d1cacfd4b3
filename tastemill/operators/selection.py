"""Exact quantiles of large columns by distributed selection.

A histogram pass counts the values of the current interval in ``BINS`` bins
(map-side combined: one row per bin and task) with each bin's smallest and
largest value. The bin that holds the wanted rank is the next interval, so an
interval shrinks by ``BINS`` a pass and a bin of one repeated value ends the
search. No task ever holds a column's distinct values. All columns share the
passes. Nulls and NaN don't count; a column without values has no quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
SMALL = 100_000          # rows that one task may sort; the built-in percentile then takes one pass


def quantiles(df: DataFrame, cols: list[str], q: float, small: int = SMALL) -> dict[str, float | None]:
    """{column: value at quantile ``q``}, linearly interpolated."""
    values = df.select([F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    values = values.select([F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(cols))])
    ends = values.agg(F.count(F.lit(1)).alias("n"), *[f(f"c{i}").alias(f"{n}{i}") for i in range(len(cols)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    if ends["n"] <= small:
        row = values.agg(*[F.percentile(f"c{i}", q).alias(f"q{i}") for i in range(len(cols))]).first()
        return {c: row[f"q{i}"] for i, c in enumerate(cols)}
    out: dict[str, float | None] = {c: None for c in cols}
    # column -> (interval, values before it, values in it, smallest value behind it)
    open_ = {i: (ends[f"lo{i}"], ends[f"hi{i}"], 0, ends[f"n{i}"], None) for i in range(len(cols)) if ends[f"n{i}"]}
    rank = {i: math.floor((ends[f"n{i}"] - 1) * q) for i in open_}
    part = {i: (ends[f"n{i}"] - 1) * q - rank[i] for i in open_}
    while open_:
        for i in [i for i, (lo, hi, *_) in open_.items() if lo == hi]:
            lo, _, before, held, behind = open_.pop(i)
            up = lo if rank[i] + 1 < before + held or behind is None else behind
            out[cols[i]] = float(lo) + part[i] * (float(up) - float(lo))
        if not open_:
            break
        cells = []
        for i, (lo, hi, *_) in open_.items():
            width = hi / BINS - lo / BINS
            at = F.least(F.floor((F.col(f"c{i}") - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1)) if 0 < width < math.inf else F.when(F.col(f"c{i}") == F.lit(lo), 0).when(F.col(f"c{i}") == F.lit(hi), 2).otherwise(1)
            cells.append(F.when(F.col(f"c{i}").between(lo, hi), F.struct(F.lit(i).alias("i"), at.cast("int").alias("bin"), F.col(f"c{i}").alias("v"))))
        one = values.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
        rows = one.groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "lo").collect()      # BINS a column at most
        for i, (_, _, before, _, behind) in list(open_.items()):
            mine = [r for r in rows if r["i"] == i]
            for k, r in enumerate(mine):
                if rank[i] < before + r["n"]:
                    open_[i] = (r["lo"], r["hi"], before, r["n"], mine[k + 1]["lo"] if k + 1 < len(mine) else behind)
                    break
                before += r["n"]
    return out
