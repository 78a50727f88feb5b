"""Scores per row: language-model perplexity, class probabilities, entropy, early-training error, word-piece ratio.

Each has a deterministic relational default that stands in for a model; a table of scores from a real model
(id, score) serves in its place wherever a score is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..sources import shared

COMMON = 100_000


def occurrences(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row for each token of each text, with the columns ``keep``."""
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")
    return df.select(*keep, F.explode(words).alias("token")).where(F.col("token") != "")


def looked_up(own: DataFrame, words: DataFrame, how: str = "inner") -> DataFrame:
    """Occurrences joined with a settled table by token; ``words`` has the count ``n``.

    A small table is broadcast.  Of a larger one the ``COMMON`` most frequent tokens are, as every text holds them, and only the other occurrences move.
    """
    table = shared.small(words, "token")
    if table is not words:
        return own.join(table, "token", how)
    common = F.broadcast(words.orderBy(F.desc("n"), "token").limit(COMMON))
    rare = own.join(common.select("token"), "token", "left_anti")
    return own.join(common, "token").unionByName(rare.join(words, "token", how))


def unigram_perplexity(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pppl): exp of the mean negative log-probability under the corpus' own add-1 unigram model; null for blank texts."""
    own = occurrences(df, text_col, id_col)
    vocab = shared.settled(own.groupBy("token").agg(F.count("*").alias("n")))
    size = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("types")).first()
    logp = F.log((F.col("n") + 1) / F.lit(float(size["all"] + size["types"])))
    per_row = looked_up(own, vocab).groupBy(id_col).agg(F.avg(logp).alias("_mean"))
    return df.select(id_col).join(per_row, id_col, "left").select(id_col, F.exp(-F.col("_mean")).alias("pppl"))


def _snapshots(train: DataFrame, df: DataFrame, id_col: str, text_col: str, label_col: str, parts: list) -> DataFrame:
    """(id, p0, p1, ...): the probability of label 1 under naive Bayes trained on each part, a condition on the rows of ``train``.

    One scan counts the tokens for all parts and one scan scores for all parts.
    """
    marks = [f"_in{t}" for t in range(len(parts))]
    marked = train.select(label_col, text_col, *[p.alias(m) for p, m in zip(parts, marks)])
    of = [(F.col(label_col) == 1, "n1"), (F.col(label_col) == 0, "n0"), (F.lit(True), "m")]
    words = occurrences(marked, text_col, label_col, *marks).groupBy("token")
    words = shared.settled(words.agg(F.count("*").alias("n"), *[F.count_if(F.col(m) & is_).alias(f"{name}_{t}") for t, m in enumerate(marks) for is_, name in of]))
    sums = words.agg(*[x for t in range(len(parts)) for x in (F.sum(f"n1_{t}").alias(f"s1_{t}"), F.sum(f"n0_{t}").alias(f"s0_{t}"), F.count_if(F.col(f"m_{t}") > 0).alias(f"types_{t}"))]).first()
    priors = marked.agg(*[F.log((F.count_if(F.col(m) & (F.col(label_col) == 1)) + 1) / (F.count_if(F.col(m) & (F.col(label_col) == 0)) + 1)).alias(m) for m in marks]).first()
    ratios = []
    for t in range(len(parts)):
        s1, s0, types = (float(sums[f"{x}_{t}"] or 0) for x in ("s1", "s0", "types"))
        more = [F.log((F.coalesce(f"{x}_{t}", F.lit(0)) + 1) / F.lit(max(1.0, s + types))) for x, s in (("n1", s1), ("n0", s0))]
        ratios.append(F.avg(more[0] - more[1]).alias(f"_r{t}"))
    per_row = looked_up(occurrences(df, text_col, id_col), words, "left").groupBy(id_col).agg(*ratios, F.count("*").alias("_n"))
    logits = [F.coalesce(F.col(f"_r{t}") + F.lit(priors[m]) / F.col("_n"), F.lit(priors[m])) for t, m in enumerate(marks)]
    return df.select(id_col).join(per_row, id_col, "left").select(id_col, *[(1 / (1 + F.exp(-x))).alias(f"p{t}") for t, x in enumerate(logits)])


def naive_bayes(train: DataFrame, df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(id, p1): probability of label 1 by add-1 multinomial naive Bayes; the log ratio is divided by the tokens before the sigmoid.

    Without that division long texts saturate.  A row without tokens gets the prior.
    """
    return _snapshots(train, df, id_col, text_col, label_col, [F.lit(True)]).select(id_col, F.col("p0").alias("p1"))


def binary_entropy(p1: str = "p1"):
    """Natural-log entropy of (1 - p1, p1)."""
    p = F.col(p1)
    return F.greatest(F.lit(0.0), -(p * F.log(p + 1e-12) + (1 - p) * F.log(1 - p + 1e-12)))


def fold(id_col: str, seed: int = 42, folds: int = 4):
    """Fold of a row by its order key: 0 to folds - 1."""
    return F.floor(F.conv(F.substring(order_key(seed, id_col), 1, 8), 16, 10).cast("double") / (2**32 / folds)).cast("int")


def el2n_scores(df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label", snapshots: int = 4, seed: int = 42, visited: float = 1.0) -> DataFrame:
    """(id, el2n): mean error of naive Bayes snapshots trained on growing shares of the rows, in the order of their keys.

    Stands for the error early in training.  ``visited`` < 1 scores only that share of the rows; the others get 0.
    """
    p = _snapshots(df, df, id_col, text_col, label_col, [fold(id_col, seed, snapshots) < t for t in range(1, snapshots + 1)])
    errors = [F.sqrt(F.lit(2.0)) * F.abs(F.col(label_col) - F.col(f"p{t}")) for t in range(snapshots)]
    mean = p.join(df.select(id_col, label_col), id_col).select(id_col, (sum(errors[1:], errors[0]) / snapshots).alias("el2n"))
    if visited < 1:
        mean = mean.join(df.where(fold(id_col, seed, 1000) < int(1000 * visited)).select(id_col), id_col, "left_semi")
    return df.select(id_col).join(mean, id_col, "left").select(id_col, F.coalesce("el2n", F.lit(0.0)).alias("el2n"))


def wordpiece_ratio(df: DataFrame, id_col: str = "id", text_col: str = "text", vocabulary: int = 2000, max_length: int | None = 512) -> DataFrame:
    """(id, wp_ratio): pieces with two special tokens, at most ``max_length`` (None: no cap), over words; 0 without words.

    A word among the corpus' ``vocabulary`` commonest ones is one piece, another one has a piece for every four characters.
    """
    own = occurrences(df, text_col, id_col)
    common = own.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(vocabulary).select("token", F.lit(1).alias("_known"))
    pieces = F.when(F.col("_known") == 1, 1).otherwise(F.ceil(F.length("token") / 4))
    per_row = own.join(F.broadcast(common), "token", "left").groupBy(id_col).agg(F.sum(pieces).alias("_pieces"), F.count("*").alias("_words"))
    count = F.col("_pieces") + 2
    ratio = (count if max_length is None else F.least(count, F.lit(max_length))) / F.col("_words")
    return df.select(id_col).join(per_row, id_col, "left").select(id_col, F.coalesce(ratio, F.lit(0.0)).alias("wp_ratio"))
