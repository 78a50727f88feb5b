"""Shares of a budget for groups, and selections under them.

A quota table has one row a group (groups are labels or clusters: few), so windows over it are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import topk
from .topk import top_k, top_per_group


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """(group, n) without null groups."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))


def equal_quota(counts: DataFrame, group: str, k: int) -> DataFrame:
    """k // C each, and one more for the first k % C groups in ascending order."""
    ranked = counts.withColumn("_rn", F.row_number().over(Window.orderBy(group))).withColumn("_c", F.count("*").over(Window.partitionBy()))
    extra = F.when(F.col("_rn") <= F.lit(k) % F.col("_c"), 1).otherwise(0)
    return ranked.select(group, "n", (F.floor(F.lit(k) / F.col("_c")) + extra).cast("long").alias("_quota"))


def largest_remainder_quota(counts: DataFrame, group: str, k: int) -> DataFrame:
    """floor(share * k) each; what is left goes to the greatest fractional parts, ties to the first group."""
    raw = counts.withColumn("_raw", F.lit(float(k)) * F.col("n") / F.sum("n").over(Window.partitionBy()))
    raw = raw.withColumn("_base", F.floor("_raw").cast("long"))
    left = F.lit(k) - F.sum("_base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.round(F.col("_raw") - F.col("_base"), 9).desc(), F.col(group)))
    raw = raw.withColumn("_left", left).withColumn("_rank", rank)
    return raw.select(group, "n", (F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("_quota"))


def share_quota(counts: DataFrame, group: str, k: int, fill: bool = False) -> DataFrame:
    """max(1, half-even round of share * k) each, cut off at k in ascending order of groups; ``fill`` tops up a shortfall by size."""
    share = F.bround(F.round(F.lit(float(k)) * F.col("n") / F.sum("n").over(Window.partitionBy()), 9), 0).cast("long")
    q = counts.withColumn("_want", F.least(F.greatest(share, F.lit(1)), F.col("n")))
    before = F.coalesce(F.sum("_want").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    q = q.withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_want"), F.lit(k) - before)).cast("long"))
    if not fill:
        return q.select(group, "n", "_quota")
    q = q.withColumn("_short", F.lit(k) - F.sum("_quota").over(Window.partitionBy())).withColumn("_room", F.col("n") - F.col("_quota"))
    earlier = F.coalesce(F.sum("_room").over(Window.orderBy(F.col("n").desc(), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return q.select(group, "n", (F.col("_quota") + F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_short") - earlier))).cast("long").alias("_quota"))


def quota_then_best(df: DataFrame, group: str, quotas: DataFrame, k: int, score: Column, ties: list[str]) -> DataFrame:
    """Each group's quota of its best rows, topped up to k with the best rows that are left, whatever their group."""
    n = df.count()
    if n > topk.SMALL:
        chosen = shared.settled(top_per_group(df, group, quotas.select(group, "_quota"), score, ties, large=True))
        short = k - chosen.count()
        if short <= 0:
            return top_k(chosen, k, score, ties)
        rest = df.join(chosen.select(*ties), ties, "left_anti")
        return chosen.unionByName(top_k(rest, short, score, ties))
    # one pass: rows inside their group's quota first, then all by score
    rank = F.row_number().over(Window.partitionBy(group).orderBy(score.desc_nulls_last(), *ties))
    ranked = df.withColumn("_rn", rank).join(quotas.select(group, "_quota"), group, "left")
    inside = F.coalesce(F.col("_rn") <= F.col("_quota"), F.lit(False))
    best = ranked.withColumn("_in", inside).orderBy(F.col("_in").desc(), score.desc_nulls_last(), *ties).limit(k)
    return best.select(*df.columns)
