"""Greedy coverage: choices that depend on all earlier ones.

Up to ``EXACT`` numbers (rows times dimensions) one Arrow kernel on an executor makes the choice.  Beyond that the same choice comes from
distributed passes.  k-center's passes give the ``POOL`` rows farthest from the picks so far; as distances only fall, picks are taken from
these rows as long as the farthest of them ranks before the last one of the pool did, and then the next pass follows.  Herding
keeps its residual on the driver and finds each pick by one pass.  All arithmetic is in double; ties go to the lowest id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.vectors import dot, mean_vector
from ..sources import shared

EXACT = 20_000_000
POOL = 4096
SALTS = 64


def _matrix(pdf: pd.DataFrame, id_col: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(id_col)
    return pdf[id_col].to_numpy(), np.array(pdf[vec].tolist(), np.float64).reshape(len(pdf), -1)


def k_center_picks(x: np.ndarray, k: int, start: int) -> tuple[list[int], list[float]]:
    """Rows picked and their distance to the rows picked before (infinite for the first)."""
    n = len(x)
    picks, radius = [start], [float("inf")]
    near = np.sqrt(((x - x[start]) ** 2).sum(1))
    near[start] = -1
    while len(picks) < min(k, n):
        i = int(near.argmax())
        picks.append(i)
        radius.append(float(near[i]))
        near = np.where(near < 0, near, np.minimum(near, np.sqrt(((x - x[i]) ** 2).sum(1))))
        near[i] = -1
    return picks, radius


def herding_picks(x: np.ndarray, k: int, variant: str) -> list[int]:
    """``residual``: picks are taken off the mean once each; ``classic``: the mean is added anew after each pick."""
    mean = x.mean(0)
    left, free, picks = mean.copy(), np.ones(len(x), bool), []
    while len(picks) < min(k, len(x)):
        score = np.where(free, np.round(x @ left, 12), -np.inf)
        i = int(score.argmax())
        picks.append(i)
        free[i] = False
        left = left - x[i] + (mean if variant == "classic" else 0)
    return picks


def _start(ids: np.ndarray, start_id, seed: int) -> int:
    import hashlib

    if start_id is not None and (ids == start_id).any():
        return int(np.flatnonzero(ids == start_id)[0])
    return min(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i]))


def _size(df: DataFrame, vec: str) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    return row["n"], max(1, row["d"] or 1)


def _in_one(rows: DataFrame, pick, schema: str) -> DataFrame:
    """A kernel over all of a table of bounded size, on one executor."""
    return rows.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(lambda pdf: pick(pdf.drop(columns="_all")), schema)


def _distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - center) ** 2).sum(1))


def _farthest(picked: np.ndarray, centers: np.ndarray):
    """Rows (id, v, near) of each task that are farthest from the centers, the picked rows left out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def best(ids, x, near):
        order = np.lexsort((ids, np.where(np.isnan(near), -np.inf, -near)))[:POOL]  # as argmax has it, not-a-number is the greatest
        return ids[order], x[order], near[order]

    def run(batches):
        held = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            free = ~np.isin(ids, picked)
            if not free.any():
                continue
            ids = ids[free]
            if len(pc.list_value_length(batch.column(1)).unique()) > 1:
                raise ValueError("vectors differ in length")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(free), -1)[free]
            near = np.full(len(x), np.inf)
            for c in centers:
                near = np.minimum(near, _distances(x, c))
            if held is not None:
                ids, x, near = (np.concatenate(y) for y in zip(held, (ids, x, near)))
            held = best(ids, x, near)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(list(held[1]), pa.list_(pa.float64())), pa.array(held[2])], names=["id", "v", "near"])

    return run


def _k_center_by_passes(rows: DataFrame, k: int, start_id, seed: int) -> DataFrame:
    """The picks of ``k_center_picks`` over a table of any size; the driver holds the picks and one pool."""
    first = rows.where(F.col("id") == F.lit(start_id)).first() if start_id is not None else None
    first = first or rows.orderBy(order_key(seed, "id"), "id").first()
    ids, centers, radius = [first["id"]], [np.array(first["v"], np.float64)], [float("inf")]
    while len(ids) < k:
        farthest = _farthest(np.array(ids), np.array(centers))
        pool = rows.select(F.col("id").cast("long"), "v").mapInArrow(farthest, "id long, v array<double>, near double").orderBy(F.desc("near"), "id").limit(POOL).collect()
        if not pool:
            break
        last = (-pool[-1]["near"], pool[-1]["id"])  # no row outside the pool ranks before this one, now or later
        pool.sort(key=lambda r: r["id"])
        own, x, near = np.array([r["id"] for r in pool]), np.array([r["v"] for r in pool], np.float64), np.array([r["near"] for r in pool])
        whole, before = len(pool) < POOL, len(ids)
        while len(ids) < k:
            i = int(near.argmax())
            if near[i] < 0 or not (whole or len(ids) == before or (-near[i], own[i]) <= last):
                break
            ids.append(int(own[i]))
            centers.append(x[i])
            radius.append(float(near[i]))
            near = np.where(near < 0, near, np.minimum(near, _distances(x, x[i])))
            near[i] = -1
    return rows.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), radius)), "id long, step int, radius double")


def k_center(df: DataFrame, k: int, vec: str = "v", id_col: str = "id", start_id=None, seed: int = 42, exact: int = EXACT) -> DataFrame:
    """(id, step, radius): up to k distinct rows, each the farthest from those before."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null")
    schema = "id long, v array<double>, step int, radius double"
    if k <= 0:
        return rows.limit(0).selectExpr("id", "0 as step", "0d as radius").withColumnRenamed("id", id_col)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = _matrix(pdf[["id", "v"]], "id", "v")
        at, radius = k_center_picks(x, k, _start(ids, start_id, seed))
        return pd.DataFrame({"id": ids[at], "v": list(x[at]), "step": np.arange(len(at), dtype="int32"), "radius": radius})

    n, d = _size(rows, "v")
    if n * d > exact:
        return _k_center_by_passes(rows, min(k, n), start_id, seed).withColumnRenamed("id", id_col)
    return _in_one(rows, pick, schema).select(F.col("id").alias(id_col), "step", "radius")


def herding(df: DataFrame, k: int, vec: str = "v", id_col: str = "id", variant: str = "residual", exact: int = EXACT) -> DataFrame:
    """(id, step): up to k distinct rows, each with the greatest dot product with what the picks leave of the mean."""
    if variant not in ("residual", "classic"):
        raise ValueError("variant must be residual or classic")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null")
    if k <= 0:
        return rows.limit(0).selectExpr("id", "0 as step").withColumnRenamed("id", id_col)
    n, d = _size(rows, "v")
    if n * d <= exact:

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, x = _matrix(pdf, "id", "v")
            at = herding_picks(x, k, variant)
            return pd.DataFrame({"id": ids[at], "step": np.arange(len(at), dtype="int32")})

        return _in_one(rows, pick, "id long, step int").withColumnRenamed("id", id_col)
    mean = np.array([r["value"] for r in mean_vector(rows, "v").orderBy("pos").collect()])  # d numbers
    left, picked = mean.copy(), []
    spark = df.sparkSession
    for _ in range(min(k, n)):
        done = spark.createDataFrame([(i,) for i in picked], "id long")
        target = F.array(*[F.lit(float(x)) for x in left])
        best = rows.join(F.broadcast(done), "id", "left_anti").orderBy(F.round(dot(F.col("v"), target), 12).desc(), "id").first()
        picked.append(best["id"])
        left = left - np.array(best["v"]) + (mean if variant == "classic" else 0)
    return spark.createDataFrame(list(zip(picked, range(len(picked)))), "id long, step int").withColumnRenamed("id", id_col)


# ---- edit distance ---------------------------------------------------------------------------


def edit_distances(center: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distance of one string to many, in characters; codes: a row of code points each, padded."""
    m = codes.shape[1]
    previous = np.tile(np.arange(m + 1, dtype=np.int32), (len(codes), 1))
    steps = np.arange(m + 1, dtype=np.int32)
    for i, ch in enumerate(center, 1):
        least = np.empty_like(previous)
        least[:, 0] = i
        least[:, 1:] = np.minimum(previous[:, 1:] + 1, previous[:, :-1] + (codes != ord(ch)))
        # insertions along a row: a running minimum of value less place
        previous = np.minimum.accumulate(least - steps, 1) + steps
    return previous[np.arange(len(codes)), lengths]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    codes = np.full((len(texts), max(1, lengths.max(initial=0))), -1, np.int32)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return codes, lengths


def edit_distance_picks(texts: list[str], k: int, start: int) -> list[int]:
    """Farthest-point choice by normalised edit distance; ends early where the farthest is picked already or equal."""
    codes, lengths = _codes(texts)

    def to(i: int) -> np.ndarray:
        return edit_distances(texts[i], codes, lengths) / np.maximum(np.maximum(lengths, lengths[i]), 1)

    picks, near = [start], to(start)
    while len(picks) < min(k, len(texts)):
        i = int(near.argmax())
        if i in picks or near[i] <= 0:
            break
        picks.append(i)
        near = np.minimum(near, to(i))
    return picks


def diverse_texts(df: DataFrame, target_frac: float = 0.1, max_pool: int = 5000, id_col: str = "id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, step): a subset of round(target_frac * n) rows spread out by edit distance, of a random pool of at most ``max_pool`` rows.

    The pool is returned as it is where it has no more rows than wanted.  The pool bound is part of the operator.
    """
    from .selectors import random

    n = df.count()
    target = max(1, int(round(target_frac * n))) if n else 0
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pool = random(rows, max_pool, "id", seed) if n > max_pool else rows
    if min(n, max_pool) <= target:
        return pool.select(F.col("id").alias(id_col), F.lit(-1).alias("step"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        at = edit_distance_picks(pdf["t"].tolist(), target, _start(ids, None, seed))
        return pd.DataFrame({"id": ids[at], "step": np.arange(len(at), dtype="int32")})

    return _in_one(pool, pick, "id long, step int").withColumnRenamed("id", id_col)


def uniqueness(df: DataFrame, peers: int = 200, label: str = "label", id_col: str = "id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, label, min_lev_dist): least edit distance to the label's sampled peers, the row itself left out; 0 without peers.

    Each label's peers are its first ``peers`` rows by order key, so rows meet at most ``peers`` others, not their whole label.  The peers of
    all labels are broadcast if their measured size allows; else both sides meet by label and salt, so a label's rows are ``SALTS`` groups.
    """
    from .selectors import examples_per_class

    sample = examples_per_class(df.select(id_col, label, text_col), peers, label, id_col, seed).select(F.col(label).alias("_l"), F.col(id_col).alias("_p"), F.col(text_col).alias("_t"))
    rows = df.select(id_col, label, text_col).repartition(F.xxhash64(id_col))  # spread before the costly part
    sample = shared.settled(sample)
    near = shared.small(sample, "_t")
    meet = (F.col(label) == F.col("_l")) & (F.col(id_col) != F.col("_p"))
    if near is sample:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        near = sample.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        meet = meet & (F.col("_salt") == F.col("_s"))
    pairs = rows.join(near, meet, "left")
    return pairs.groupBy(id_col, label).agg(F.coalesce(F.min(F.when(F.col("_p").isNotNull(), F.levenshtein(F.coalesce(text_col, F.lit("")), F.coalesce("_t", F.lit(""))))), F.lit(0)).alias("min_lev_dist"))


def start_row(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """The row greedy choices start from by default."""
    return df.orderBy(order_key(seed, id_col), id_col).limit(1)
