"""Deterministic order keys and budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, id_col: str) -> Column:
    """Pseudo-random sort key of a row; depends on seed and id only, not on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def key_number(key: Column) -> Column:
    """The first 48 bits of an order key as a double: the same order up to ties."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double")


def budget(n: int, frac: float, mode: str = "floor", least: int = 1) -> int:
    """Rows to choose of n: ``floor`` truncates, ``half_even`` rounds; at least ``least`` (and never more than n)."""
    if mode not in ("floor", "half_even"):
        raise ValueError("mode must be floor or half_even")
    k = int(n * frac) if mode == "floor" else int(round(n * frac))
    return max(0, min(n, max(least, k)))


def pct_tag(frac: float) -> str:
    """Tag of a budget in names of outputs, as p10 for a tenth."""
    return f"p{int(round(frac * 100)):02d}"
