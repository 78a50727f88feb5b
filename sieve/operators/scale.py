"""Scaling and quantile bands by one aggregate of the table (an unpartitioned window would gather all rows in a task)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-8
SMALL = 2_000_000
_ACCURACY = 10_000


def _value_at(df: DataFrame, col: str, place: int, n: int):
    """The value at a place (from 0) of the ascending order of a column without nulls, by closing in on it with approximate quantiles."""
    rows = df
    while n > SMALL:
        share = place / (n - 1)
        lo, hi = rows.agg(F.percentile_approx(col, [max(0.0, share - 0.002), min(1.0, share + 0.002)], _ACCURACY).alias("q")).first()["q"]
        below, inside = (F.col(col) < F.lit(lo)), F.col(col).between(F.lit(lo), F.lit(hi))
        counts = rows.agg(F.count_if(below).alias("below"), F.count_if(inside).alias("inside")).first()
        if lo == hi or not 0 <= place - counts["below"] < counts["inside"] or counts["inside"] == n:
            break
        rows, place, n = rows.where(inside), place - counts["below"], counts["inside"]
    # values and how often each is there: at most SMALL, or few ones that are very frequent
    many = rows.groupBy(col).agg(F.count("*").alias("_c")).withColumn("_up_to", F.sum("_c").over(Window.orderBy(col)))
    return many.where(F.col("_up_to") > place).orderBy(col).first()[col]


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact, linearly interpolated quantiles of the values that aren't null.

    ``percentile`` gathers all distinct values in one task; above ``SMALL`` rows only those near the quantile are ranked.
    """
    rows = df.select(F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull())
    n = rows.count()
    if n <= SMALL:
        found = rows.agg(*[F.percentile(col, F.lit(q)).alias(f"q{i}") for i, q in enumerate(shares)]).first()
        return list(found)
    out = []
    for q in shares:
        at = q * (n - 1)
        lo, hi = math.floor(at), math.ceil(at)
        a = _value_at(rows, col, lo, n)
        b = a if hi == lo else _value_at(rows, col, hi, n)
        out.append(a if a == b else (hi - at) * a + (at - lo) * b)
    return out


def minmax(df: DataFrame, **columns: str) -> DataFrame:
    """Adds new = min-max scaled old for each new=old; a constant column gives 0, null stays null.

    The bounds (two numbers a column) are computed at once, so that scaling again doesn't repeat what stands before.
    """
    bounds = df.agg(*[f(o).cast("double").alias(f"_{k}_{n}") for n, o in columns.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = df
    for new, old in columns.items():
        lo, hi = bounds[f"_lo_{new}"], bounds[f"_hi_{new}"]
        flat = lo is None or hi - lo < FLAT
        scaled = F.lit(0.0) if flat else (F.col(old).cast("double") - F.lit(lo)) / F.lit(hi - lo)
        out = out.withColumn(new, F.when(F.col(old).isNotNull(), scaled))
    return out


def quantile_band(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows with col between two linearly interpolated quantiles, both included; the order of the quantiles doesn't matter."""
    low, high = sorted((min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)))
    low, high = quantiles(df, col, [low, high])
    return df.where(F.col(col).between(F.lit(low), F.lit(high)))


def quantile_floor(df: DataFrame, col: str, cut: float) -> DataFrame:
    """Drops rows below the quantile ``cut`` if 0 < cut < 0.5, unless that leaves none."""
    if not 0 < cut < 0.5:
        return df
    kept = df.where(F.col(col) >= F.lit(quantiles(df, col, [cut])[0]))
    return df if kept.isEmpty() else kept


def median(df: DataFrame, col: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(quantiles(df, col, [0.5])[0],)], "median double")
