"""Selection strategies: given scored rows and a budget k, the rows to train on.  Ties go to the lowest id everywhere.

A strategy reads its scores several times (bounds, counts, choice): pass a stored table, or ``settled`` scores, so that they are computed once.

``SELECTORS`` maps names to functions (df, k, **params) -> chosen rows with all columns of df.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import budget, key_number, order_key
from ..sources import shared
from . import greedy
from .quota import equal_quota, group_counts, largest_remainder_quota, quota_then_best, share_quota
from .scale import minmax, quantile_band, quantile_floor, quantiles
from .topk import top_k, top_per_group


def random(df: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """k rows without replacement, by order key."""
    keyed = df.withColumn("_key", order_key(seed, id_col))
    return top_k(keyed, k, key_number(F.col("_key")), ["_key", id_col], descending=False).drop("_key")


def full(df: DataFrame, k: int | None = None) -> DataFrame:
    """All rows, whatever the budget."""
    return df


def by_score(df: DataFrame, k: int, score: str, keep: str = "high", q_low: float = 0.2, q_high: float = 0.8, id_col: str = "id", seed: int = 42) -> DataFrame:
    """The k highest or lowest scores, or k random rows of the band between two quantiles (the whole band if it has no more)."""
    if keep in ("high", "low"):
        return top_k(df, k, F.col(score), [id_col], descending=keep == "high")
    if keep != "middle":
        raise ValueError("keep must be high, low or middle")
    return random(quantile_band(df, score, q_low, q_high), k, id_col, seed)


def perplexity(
    df: DataFrame, k: int, ppl: str = "pppl", p_low: float = 0.3, p_high: float = 0.7, use_quality: bool = True, length_weight: float = 0.2, ttr_weight: float = 0.2,
    readability_weight: float = 0.1, normalize: bool = True, readability_col: str | None = None, id_col: str = "id",
) -> DataFrame:
    """Rows in a perplexity band, the best by a weighted sum of short length, type-token ratio and (if a column is named) readability.

    Parts are scaled within the band.  Without ``use_quality`` the first k rows of the band by id.
    """
    band = quantile_band(df, ppl, p_low, p_high)
    if not use_quality:
        return top_k(band, k, F.lit(0.0), [id_col])
    parts = [("_len", -F.col("token_count"), length_weight), ("_ttr", F.col("type_token_ratio"), ttr_weight)]
    if readability_col:
        parts.append(("_read", F.col(readability_col), readability_weight))
    for name, col, _ in parts:
        band = band.withColumn(name, col.cast("double"))
    if normalize:
        band = minmax(band, **{name + "s": name for name, _, _ in parts})
    total = sum(F.col(name + "s" * normalize) * w for name, _, w in parts)
    scored = band.withColumn("_score", F.round(total, 12))
    return top_k(scored, k, F.col("_score"), [id_col]).select(*df.columns)


def datadiet(df: DataFrame, k: int, score: str = "el2n", id_col: str = "id") -> DataFrame:
    """The k greatest early-training errors."""
    return top_k(df, k, F.col(score), [id_col])


def llm_quality(df: DataFrame, k: int, score: str = "p_clear", label: str = "label", id_col: str = "id") -> DataFrame:
    """Equal quotas for the labels, the clearest rows of each; topped up with the clearest of the rest."""
    return quota_then_best(df, label, equal_quota(group_counts(df, label), label, k), k, F.col(score), [id_col])


def stratified(df: DataFrame, k: int, score: str, label: str = "label", id_col: str = "id") -> DataFrame:
    """Quotas in proportion to the labels (largest remainder), best scores first, null last; topped up to k."""
    return quota_then_best(df, label, largest_remainder_quota(group_counts(df, label), label, k), k, F.col(score), [id_col])


def stratified_frac(df: DataFrame, frac: float, score: str, label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """``stratified`` for max(1, half-even share of the rows), in shuffled order."""
    chosen = stratified(df, budget(df.count(), frac, "half_even"), score, label, id_col)
    return chosen.orderBy(order_key(seed, id_col))


def kmeans_quota(df: DataFrame, k: int, cluster: str = "cluster", id_col: str = "id", seed: int = 42, fill: bool = False) -> DataFrame:
    """Random rows of each cluster, as many as its share of the budget."""
    quotas = share_quota(group_counts(df, cluster), cluster, k, fill).select(cluster, "_quota")
    keyed = df.withColumn("_key", order_key(seed, id_col))
    return top_per_group(keyed, cluster, quotas, key_number(F.col("_key")), ["_key", id_col], descending=False).drop("_key")


def kcenter(df: DataFrame, k: int, vec: str = "v", id_col: str = "id", start_id: int | None = None, seed: int = 42) -> DataFrame:
    chosen = greedy.k_center(df, k, vec, id_col, start_id, seed)
    return df.join(chosen.select(id_col), id_col, "left_semi")


def herding(df: DataFrame, k: int, vec: str = "v", id_col: str = "id", variant: str = "residual") -> DataFrame:
    chosen = greedy.herding(df, k, vec, id_col, variant)
    return df.join(chosen.select(id_col), id_col, "left_semi")


def hybrid_scores(df: DataFrame, ppl: str = "pppl", readability: str = "flesch_reading_ease", cluster: str = "cluster", importance: str = "median_ppl", entropy: str = "entropy", alpha=(0.4, 0.4, 0.2)) -> DataFrame:
    """Adds q, i, d and qdi: quality (perplexity, readability), importance (entropy or closeness to the median perplexity) and rarity of the cluster."""
    if importance not in ("median_ppl", "entropy"):
        raise ValueError("importance must be median_ppl or entropy")
    columns = df.columns
    sizes = shared.settled(df.groupBy(cluster).agg((1.0 / F.count("*")).alias("_rare")))
    out = df.withColumn("_lp", F.log1p(F.col(ppl))).join(shared.small(sizes), cluster)
    if importance == "median_ppl":
        out = out.withColumn("_imp", F.abs(F.col("_lp") - F.lit(quantiles(out, "_lp", [0.5])[0])))
    else:
        out = out.withColumn("_imp", F.col(entropy))
    out = minmax(out, _a="_lp", _b=readability, _i="_imp", d="_rare")
    out = out.withColumn("_q", 0.7 * (1 - F.col("_a")) + 0.3 * F.col("_b"))
    out = minmax(out, q="_q").withColumn("i", 1 - F.col("_i") if importance == "median_ppl" else F.col("_i"))
    out = out.withColumn("_s", alpha[0] * F.col("q") + alpha[1] * F.col("i") + alpha[2] * F.col("d"))
    return minmax(out, qdi="_s").select(*columns, "q", "i", "d", "qdi")


def hybrid(df: DataFrame, k: int, label: str = "label", id_col: str = "id", quality_cut: float = 0.1, **params) -> DataFrame:
    """Quality, diversity and importance together: rows under a quality quantile go, then label quotas by the joint score, topped up."""
    scored = shared.settled(hybrid_scores(df, **params).withColumn("qdi", F.round("qdi", 12)).withColumn("q", F.round("q", 12)))
    left = quantile_floor(scored, "q", quality_cut)
    if left.count() <= k:
        return left
    return quota_then_best(left, label, largest_remainder_quota(group_counts(left, label), label, k), k, F.col("qdi"), [id_col])


def examples_per_class(df: DataFrame, n: int, label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """n random rows of each label."""
    quotas = group_counts(df, label).select(label, F.lit(n).cast("long").alias("_quota"))
    keyed = df.withColumn("_key", order_key(seed, id_col))
    return top_per_group(keyed, label, quotas, key_number(F.col("_key")), ["_key", id_col], descending=False).drop("_key")


def stratified_split(df: DataFrame, test: float, label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """Adds ``part``: ``test`` for a share of each label (largest remainder of the half-even total), else ``train``."""
    k = budget(df.count(), test, "half_even")
    quotas = largest_remainder_quota(group_counts(df, label), label, k).select(label, "_quota")
    keyed = df.withColumn("_key", order_key(seed, id_col))
    chosen = top_per_group(keyed, label, quotas, key_number(F.col("_key")), ["_key", id_col], descending=False)
    mark = chosen.select(id_col, F.lit("test").alias("_part"))
    return df.join(mark, id_col, "left").withColumn("part", F.coalesce("_part", F.lit("train"))).drop("_part")


SELECTORS = {
    "random": random,
    "full": full,
    "kcenter": kcenter,
    "kmeans": kmeans_quota,
    "herding": herding,
    "predictive_entropy": lambda df, k, score="entropy", keep="middle", **p: by_score(df, k, score, keep, **p),
    "wordpiece_ratio": lambda df, k, score="wp_ratio", keep="middle", **p: by_score(df, k, score, keep, **p),
    "perplexity": perplexity,
    "datadiet": datadiet,
    "llm_quality": llm_quality,
    "hybrid_qdi": hybrid,
    "stratified": stratified,
}
#: other names that users know
ALIASES = {"entropy": "predictive_entropy", "llm_clarity": "llm_quality", "el2n": "datadiet", "hybrid": "hybrid_qdi"}


def select(name: str, df: DataFrame, k: int, **params) -> DataFrame:
    """The rows chosen by a registered strategy."""
    name = ALIASES.get(name, name)
    if name not in SELECTORS:
        raise KeyError(f"unknown strategy {name}; there are {sorted(SELECTORS)}")
    return SELECTORS[name](df, k, **params)
