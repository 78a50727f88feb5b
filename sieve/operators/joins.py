"""Joins by row id: optional features, aligned scores, overlays and remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_features(df: DataFrame, features: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows, with the features of those that have any."""
    return df.join(features, id_col, "left")


def aligned(df: DataFrame, scores: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows with their score; an error if a row has none."""
    missing = df.join(scores.select(id_col), id_col, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"rows without a score: {[r[id_col] for r in missing]} and maybe more")
    return df.join(scores, id_col)


def overlay(df: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows with ``selected``."""
    marks = chosen.select(id_col).distinct().withColumn("_m", F.lit(True))
    return df.join(marks, id_col, "left").withColumn("selected", F.coalesce("_m", F.lit(False))).drop("_m")


def remaining(df: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(chosen.select(id_col), id_col, "left_anti")


def dedup_first(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Of rows with the same key the one with the least id: an aggregate with map-side combining, no window over a hot key."""
    rest = [c for c in df.columns if c not in (key, id_col)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("_r") if rest else F.lit(0).alias("_r"), F.min(id_col).alias(id_col))
    return first.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
