"""Corpus statistics: lengths, vocabulary, labels, histograms, per split and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import order_key

QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def with_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("char_len", T.char_len(F.col(text_col))).withColumn("word_len", T.word_len(F.col(text_col)))


def summary(col: str) -> list:
    """Aggregates of a length column: extremes, mean, sample deviation, quantiles."""
    return [
        F.min(col).alias(f"{col}_min"),
        F.max(col).alias(f"{col}_max"),
        F.avg(col).alias(f"{col}_mean"),
        F.stddev_samp(col).alias(f"{col}_std"),
        *[F.percentile(col, F.lit(q)).alias(f"{col}_{name}") for name, q in QUANTILES.items()],
    ]


def lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    return with_lengths(df, text_col).agg(F.count("*").alias("n_examples"), *summary("char_len"), *summary("word_len"))


def by_split(df: DataFrame, text_col: str = "text", split: str = "split") -> DataFrame:
    """Length statistics and vocabulary of each split and of all together (``overall``)."""
    stats = with_lengths(df, text_col).rollup(split).agg(F.grouping(split).alias("_all"), F.count("*").alias("n_examples"), *summary("char_len"), *summary("word_len"))
    stats = stats.withColumn("split", F.when(F.col("_all") == 1, "overall").otherwise(F.col(split))).drop("_all")
    # the vocabulary from distinct (split, token) pairs, so each token moves once a split
    pairs = df.select(split, F.explode(T.tokens(F.col(text_col))).alias("token")).distinct()
    vocab = pairs.groupBy(split).agg(F.count("*").alias("vocab_size")).unionByName(pairs.select("token").distinct().agg(F.lit("overall").alias(split), F.count("*").alias("vocab_size")))
    return stats.join(F.broadcast(vocab.withColumnRenamed(split, "split")), "split", "left").withColumn("vocab_size", F.coalesce("vocab_size", F.lit(0)))


def label_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share of each label, null among them."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("_t")).alias("frac"))


def vocabulary_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    words = df.select(F.explode(T.tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("vocab_size"))


def top_tokens(df: DataFrame, n: int = 30, text_col: str = "text") -> DataFrame:
    words = df.select(F.explode(T.tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.orderBy(F.desc("n"), "token").limit(n)


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """(bin from 1, lo, hi, n) of equal bins between the extremes, the last closed; empty bins have 0; a constant column has one bin."""
    bounds = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.floor((F.col(col) - F.col("_lo")) / width) + 1, F.lit(bins))).cast("int")
    counts = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(bounds))
    frame = frame.select("bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("lo"), (F.col("_lo") + F.col("bin") * width).alias("hi"))
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(df: DataFrame, col: str, group: str = "label") -> DataFrame:
    """Quartiles of each group, and the farthest values within 1.5 interquartile ranges."""
    q = df.groupBy(group).agg(F.count("*").alias("n"), *[F.percentile(col, F.lit(p)).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    bounds = q.select(F.col(group).alias("_g"), (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi"))
    near = df.join(F.broadcast(bounds), F.col(group).eqNullSafe(F.col("_g"))).where(F.col(col).between(F.col("_lo"), F.col("_hi")))
    whiskers = near.groupBy("_g").agg(F.min(col).alias("whisker_low"), F.max(col).alias("whisker_high"))
    return q.join(F.broadcast(whiskers), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def summary_table(df: DataFrame, labels: list[int], label: str = "label", split: str = "split", text_col: str = "text") -> DataFrame:
    """One wide row a split and one overall: rows, share of each label (null where the split has none), mean length."""
    rows = with_lengths(df, text_col)

    def wide(frame: DataFrame, name) -> DataFrame:
        shares = [F.when(F.count_if(F.col(label) == x) > 0, F.count_if(F.col(label) == x) / F.count("*")).alias(f"label_frac_{x}") for x in labels]
        return frame.groupBy(name.alias("split")).agg(F.count("*").alias("n_examples"), *shares, F.avg("word_len").alias("word_len_mean"))

    return wide(rows, F.col(split)).unionByName(wide(rows, F.lit("overall")), allowMissingColumns=True)


def subset_stats(df: DataFrame, label: str = "label", text_col: str = "text") -> DataFrame:
    """Size, rows of label 1 and 0, mean words of a chosen subset."""
    return with_lengths(df, text_col).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_1"), F.count_if(F.col(label) == 0).alias("n_0"), F.avg("word_len").alias("avg_words"))


def readability_means(df: DataFrame, text_col: str = "text", sample: int | None = None, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Mean readability of all rows, or of ``sample`` random ones."""
    if sample is not None:
        df = df.orderBy(order_key(seed, id_col), id_col).limit(sample)
    t = F.col(text_col)
    return df.agg(
        F.count("*").alias("n"),
        F.avg(T.flesch_reading_ease(t)).alias("flesch_reading_ease"),
        F.avg(T.smog_index(t)).alias("smog_index"),
        F.avg(T.flesch_kincaid_grade(t)).alias("flesch_kincaid_grade"),
    )
