"""Text features as Column expressions, and the two sequential ones (MTLD, MATTR) as Arrow-batched functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SPLIT = re.compile(r"[ \t\n\x0b\f\r]+")


def tokens(text: Column) -> Column:
    """White-space tokens; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def word_len(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def char_len(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def avg_word_len(text: Column) -> Column:
    words = tokens(text)
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return total / F.greatest(F.size(words), F.lit(1))


def ttr(text: Column) -> Column:
    """Distinct over all tokens; 0 under two tokens."""
    words = tokens(text)
    return F.when(F.size(words) < 2, F.lit(0.0)).otherwise(F.size(F.array_distinct(words)) / F.size(words))


def syllables(text: Column) -> Column:
    """Vowel groups: a documented substitute for a dictionary of syllables."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[aeiouyáéíóúàèìòùâêîôûäëïöü]+")).cast("long")


def sentences(text: Column) -> Column:
    """Runs of sentence ends, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]+"))).cast("long")


def _ratios(text: Column) -> tuple[Column, Column]:
    words = F.greatest(word_len(text), F.lit(1))
    return words / sentences(text), syllables(text) / words


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def flesch_reading_ease(text: Column) -> Column:
    per_sentence, per_word = _ratios(text)
    return F.when(blank(text), F.lit(0.0)).otherwise(F.lit(206.835) - 1.015 * per_sentence - 84.6 * per_word)


def flesch_kincaid_grade(text: Column) -> Column:
    per_sentence, per_word = _ratios(text)
    return F.when(blank(text), F.lit(0.0)).otherwise(0.39 * per_sentence + 11.8 * per_word - 15.59)


def polysyllables(text: Column) -> Column:
    """Tokens with three vowel groups or more."""
    return F.size(F.filter(tokens(text), lambda w: syllables(w) >= 3)).cast("long")


def smog_index(text: Column) -> Column:
    return F.when(blank(text), F.lit(0.0)).otherwise(1.043 * F.sqrt(polysyllables(text) * 30 / sentences(text)) + 3.1291)


def _words(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split(text or "") if w]


def _mattr(words: list[str], window: int) -> float:
    """Mean type-token ratio of all windows: a token counts in those windows that hold no earlier equal one."""
    n = len(words)
    if n < window or n < 2:
        return 0.0
    last: dict[str, int] = {}
    prev = np.empty(n, np.int64)
    for i, w in enumerate(words):
        prev[i] = last.get(w, -1)
        last[w] = i
    at = np.arange(n)
    first = np.maximum(prev + 1, np.maximum(at - window + 1, 0))
    return float(np.maximum(np.minimum(at, n - window) - first + 1, 0).sum() / (window * (n - window + 1)))


def _mtld(words: list[str], threshold: float) -> float:
    def one_way(seq) -> float:
        factors, types, count = 0.0, set(), 0
        for w in seq:
            count += 1
            types.add(w)
            if len(types) / count <= threshold:
                factors += 1
                types, count = set(), 0
        if count:
            factors += (1 - len(types) / count) / (1 - threshold)
        return len(words) / factors if factors else float(len(words))

    return (one_way(words) + one_way(words[::-1])) / 2 if len(words) > 1 else 0.0


def mattr(window: int = 25):
    """Moving-average type-token ratio; 0 for texts of fewer tokens than the window."""

    @F.pandas_udf(DoubleType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _mattr(_words(t), window)).astype("float64")

    return run


def mtld(threshold: float = 0.72, least: int = 0):
    """Measure of textual lexical diversity, mean of both directions; 0 under two tokens, and under ``least`` tokens."""

    @F.pandas_udf(DoubleType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _mtld(w, threshold) if len(w := _words(t)) >= least else 0.0).astype("float64")

    return run


def text_metrics(df, id_col: str, text_col: str, window: int = 25, short_text_policy: str = "zero_all"):
    """Nine metrics per row.  ``zero_all``: texts shorter than the window have 0 for all three diversity metrics; ``per_metric``: only for MATTR."""
    if short_text_policy not in ("zero_all", "per_metric"):
        raise ValueError("short_text_policy must be zero_all or per_metric")
    t = F.col(text_col)
    least = window if short_text_policy == "zero_all" else 0
    short = F.size(tokens(t)) < least
    return df.select(
        F.col(id_col),
        word_len(t).cast("double").alias("token_count"),
        char_len(t).cast("double").alias("char_count"),
        F.when(short, F.lit(0.0)).otherwise(ttr(t)).alias("type_token_ratio"),
        mtld(least=least)(t).alias("mtld"),
        mattr(window)(t).alias("mattr"),
        avg_word_len(t).alias("avg_word_len"),
        flesch_reading_ease(t).alias("flesch_reading_ease"),
        syllables(t).cast("int").alias("syllable_count"),
        sentences(t).cast("int").alias("sentence_count"),
    )
