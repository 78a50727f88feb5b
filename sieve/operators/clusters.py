"""Operators on pyspark.ml models: clusters, projections, a student of a judge, and a text classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selectors import random


def with_clusters(df: DataFrame, n_clusters: int = 128, vec: str = "v", id_col: str = "id", max_points: int | None = None, seed: int = 42) -> DataFrame:
    """Adds ``cluster``: k-means fitted on all rows, or on ``max_points`` random ones where that is given, and applied to all; one cluster for tables no larger than n_clusters."""
    n = df.count()
    if n <= n_clusters:
        return df.withColumn("cluster", F.lit(0))
    points = df.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))
    sample = random(points.select(id_col, "_x"), max_points, id_col, seed) if max_points is not None and n > max_points else points
    model = KMeans(k=n_clusters, seed=seed, featuresCol="_x", predictionCol="cluster", maxIter=10).fit(sample)
    return model.transform(points).drop("_x")


def projection(df: DataFrame, vec: str = "v", id_col: str = "id") -> DataFrame:
    """(id, x, y): the first two principal components, in place of a non-linear map."""
    points = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    out = PCA(k=2, inputCol="_x", outputCol="_p").fit(points).transform(points).withColumn("_a", vector_to_array("_p"))
    return out.select(id_col, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))


def text_pipeline(label: str = "label", text_col: str = "text", features: int = 1 << 14, max_iter: int = 20) -> Pipeline:
    """Tokens, hashed counts, inverse document frequency, logistic regression: the classifier trained on a chosen subset."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\s+", toLowercase=True),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol=label, predictionCol="_p", maxIter=max_iter, regParam=0.01),
        ]
    )


def embed(df: DataFrame, dim: int = 16, id_col: str = "id", text_col: str = "text", features: int = 1 << 10) -> DataFrame:
    """(id, v): hashed counts projected to ``dim`` components; stands in for a sentence encoder."""
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    steps = [RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\s+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_i"), PCA(k=dim, inputCol="_i", outputCol="_p")]
    return Pipeline(stages=steps).fit(rows).transform(rows).select(id_col, vector_to_array("_p").alias("v"))


def student(vectors: DataFrame, judged: DataFrame, vec: str = "v", id_col: str = "id", verdict: str = "verdict") -> DataFrame:
    """(id, p0, p1, p2, pred) for all rows: a multinomial regression that learns a judge's verdicts from few of them."""
    points = vectors.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    train = points.join(judged.select(id_col, F.col(verdict).cast("double").alias("_y")), id_col)
    if train.select("_y").distinct().count() < 3:
        raise ValueError("the judged rows need all three verdicts")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", family="multinomial", maxIter=50).fit(train)
    out = model.transform(points).withColumn("_a", vector_to_array("probability"))
    return out.select(id_col, *[F.col("_a")[i].alias(f"p{i}") for i in range(3)], F.col("_p").cast("long").alias("pred"))
