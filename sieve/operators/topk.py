"""Exact top-k of a whole table or of groups, without sorting what can't be in it.

A plain sort sends the k best rows of everything to one task, and a plain window sends a whole group there.  Above
``SMALL`` rows the score's approximate quantiles bracket the k-th best of each group instead: rows above the bracket are taken as they
stand, rows below go, and those inside are bracketed again, by the columns that break ties where their scores are equal,
until they are few enough to be ranked.  Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..sources import shared

SMALL = 2_000_000
_ACCURACY = 10_000


def _order(score: Column, descending: bool, ties: list[Column]) -> list[Column]:
    return [score.desc_nulls_last() if descending else score.asc_nulls_last(), *ties]


def top_k(df: DataFrame, k: int, score: Column, ties: list[str], descending: bool = True, n: int | None = None) -> DataFrame:
    """The k best rows by score (null last), ties by the columns ``ties`` ascending."""
    if k <= 0:
        return df.limit(0)
    n = df.count() if n is None else n
    if k >= n:
        return df
    if n <= SMALL:
        return df.orderBy(*_order(score, descending, [F.col(t).asc() for t in ties])).limit(k)
    quotas = df.sparkSession.range(1).select(F.lit(0).alias("_g"), F.lit(k).cast("long").alias("_quota"))
    return top_per_group(df.withColumn("_g", F.lit(0)), "_g", quotas, score, ties, descending, large=True).drop("_g")


def _number(df: DataFrame, column: str) -> Column | None:
    """A double in the order of a column up to ties: the number, or the first six bytes of a string."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(column), "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double")
    return None


def top_per_group(df: DataFrame, group: str, quotas: DataFrame, score: Column, ties: list[str], descending: bool = True, large: bool | None = None) -> DataFrame:
    """The best rows of each group; ``quotas`` has (group, _quota), one row a group."""
    order = [F.col(t).asc() for t in ties]
    if large is None:
        large = df.count() > SMALL
    if not large:
        w = Window.partitionBy(group).orderBy(*_order(score, descending, order))
        ranked = df.withColumn("_rn", F.row_number().over(w))
        return ranked.join(quotas, group).where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")
    worst = F.lit(float("-inf"))
    keys = [F.coalesce((score if descending else -score).cast("double"), worst)]  # the greater the better, null the worst
    # null ids stand first among ties
    keys += [F.coalesce(-x, F.lit(float("inf"))) for t in ties if (x := _number(df, t)) is not None]
    names = [f"_k{i}" for i in range(len(keys))]
    rest = df.select("*", *[k.alias(name) for k, name in zip(keys, names)])
    quotas = quotas.select(group, "_quota", F.lit(0).alias("_level"))
    sure, before = [], None
    while True:
        # a group of level i is bracketed by its key i, as its keys before are all equal
        placed = rest.join(shared.small(shared.settled(quotas)), group)
        own = F.array(*names)[F.col("_level")]
        cuts = placed.withColumn("_v", own).groupBy(group, "_quota", "_level")
        cuts = cuts.agg(F.count("*").alias("_n"), F.percentile_approx("_v", [i / 1000 for i in range(1001)], _ACCURACY).alias("_q"))
        # the k-th best lies between the quantiles beside its share, with a step more for what they are off
        share = 1000 * (1 - F.col("_quota") / F.col("_n"))
        lower = F.least(F.greatest(F.floor(share).cast("int") - 1, F.lit(0)), F.lit(1000))
        upper = F.greatest(F.least(F.ceil(share).cast("int") + 1, F.lit(1000)), F.lit(0))
        cuts = cuts.select(group, "_quota", "_level", F.col("_q")[lower].alias("_lo"), F.when(F.ceil(share) + 1 > 1000, F.lit(float("inf"))).otherwise(F.col("_q")[upper]).alias("_hi"))
        cuts = shared.settled(cuts)
        placed = rest.join(shared.small(cuts), group).withColumn("_v", own)
        best = placed.where(F.col("_v") > F.col("_hi")).select(*df.columns)
        between = shared.settled(placed.where((F.col("_v") <= F.col("_hi")) & (F.col("_v") >= F.col("_lo"))).drop("_quota", "_level", "_lo", "_hi"))
        counts = best.groupBy(group).agg(F.count("*").alias("_sure"))
        spread = between.groupBy(group).agg((F.min("_v") == F.max("_v")).alias("_flat"))
        quotas = cuts.join(counts, group, "left").join(spread, group)
        quotas = shared.settled(quotas.select(group, (F.col("_quota") - F.coalesce("_sure", F.lit(0))).alias("_quota"), (F.col("_level") + F.col("_flat").cast("int")).alias("_level")))
        sure.append(best)
        rest = between.drop("_v")
        levels = quotas.agg(F.max("_level").alias("most"), F.sum("_level").alias("all")).first()
        now = rest.count(), levels["all"]
        if now[0] <= SMALL or levels["most"] is None or levels["most"] >= len(keys) or now == before:
            break
        before = now
    w = Window.partitionBy(group).orderBy(F.col(names[0]).desc(), *order)
    out = rest.withColumn("_rn", F.row_number().over(w)).join(quotas, group).where(F.col("_rn") <= F.col("_quota")).select(*df.columns)
    for part in sure:
        out = out.unionByName(part)
    return out
