"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas see it as a variable."""
    return F.transform(F.array(value), body)[0]


def softmax(v: Column) -> Column:
    def shifted(x: Column) -> Column:
        return _bind(F.array_max(x), lambda top: F.transform(x, lambda e: F.exp(e - top)))

    def scaled(z: Column) -> Column:
        return _bind(total(z), lambda t: F.transform(z, lambda e: e / t))

    return _bind(doubles(v), lambda x: _bind(shifted(x), scaled))


def argmax(v: Column) -> Column:
    """Place of the first greatest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def entropy(p: Column) -> Column:
    """Natural-log entropy of a probability vector, never below 0."""
    return F.greatest(F.lit(0.0), -total(F.transform(doubles(p), lambda x: x * F.log(x + 1e-12))))


def el2n(label: Column, p: Column, classes: int) -> Column:
    """Length of the error vector: one-hot label less probabilities."""
    return l2(one_hot(label, classes), p)


def mean_vector(df, col: str):
    """One row (pos, value) for each place of the vectors' mean; map-side combined."""
    return df.select(F.posexplode(doubles(F.col(col))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("value"))
