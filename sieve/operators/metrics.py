"""Classification metrics as aggregates of (label, prediction) rows; ratios without a denominator are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary(df: DataFrame, label: str = "label", predicted: str = "predicted", positive: int = 1) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class."""
    y, p = F.col(label) == positive, F.col(predicted) == positive
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(F.col(label) == F.col(predicted)).alias("ok"), F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(ratio(F.col("ok"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class, with rows ``accuracy``, ``macro`` and ``weighted``."""
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    true = pairs.select(F.col("y").alias("class"), "n", F.lit(0).alias("pred"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    pred = pairs.select(F.col("p").alias("class"), F.lit(0).alias("n"), F.col("n").alias("pred"), F.lit(0).alias("hit"))
    c = true.unionByName(pred).groupBy("class").agg(F.sum("n").alias("support"), F.sum("pred").alias("pred"), F.sum("hit").alias("hit"))
    per = c.select("class", ratio(F.col("hit"), F.col("pred")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("pred") + F.col("support")).alias("f1"), F.col("support").cast("long").alias("support"))
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted").alias("class"), *[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    ok = c.agg(ratio(F.sum("hit"), F.sum("support")).alias("a"), F.sum("support").cast("long").alias("support"))
    accuracy = ok.select(F.lit("accuracy").alias("class"), *[F.col("a").alias(n) for n in names], "support")
    return per.unionByName(accuracy).unionByName(macro).unionByName(weighted)
