"""Reading corpora and writing manifests, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import pct_tag

MANIFEST = "id long, text string, label int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def resolve_text_col(df: DataFrame) -> str:
    """``text``, or ``sentence`` in its place."""
    for name in ("text", "sentence"):
        if name in df.columns:
            return name
    raise ValueError(f"no text column (text or sentence) among {df.columns}")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A corpus as (id, text, label) from Parquet, CSV (quoted, with line breaks in texts) or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        df = reader.format(fmt).load(path)
    text = resolve_text_col(df)
    return df if text == "text" else df.withColumnRenamed(text, "text")


def from_rows(spark: SparkSession, rows, schema: str = MANIFEST) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    """Parquet, CSV with header, or JSON lines; an earlier table of that path is replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def manifest_path(root: str, strategy: str, frac: float, seed: int) -> str:
    return f"{root}/{strategy}_{pct_tag(frac)}_seed{seed}"


def write_manifest(df: DataFrame, root: str, strategy: str, frac: float, seed: int, fmt: str = "csv") -> str:
    """The chosen rows (id, text, label) under a name of strategy, budget and seed."""
    path = manifest_path(root, strategy, frac, seed)
    write_table(df.select("id", "text", "label"), path, fmt)
    return path


def json_document(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus (id, text, split); splits by the last digit of the id: 0 validation, 1 test, else train."""
    digit = F.pmod(F.col("doc_id"), F.lit(10))
    split = F.when(digit == 0, "validation").when(digit == 1, "test").otherwise("train")
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", split.alias("split"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled corpus (id, text, label, split); label: quality."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return documents(spark, folder).join(labels, "id").select("id", "text", "label", "split")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector corpus (id, v, label)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def results_table(spark: SparkSession) -> DataFrame:
    """Published accuracy and times of the strategies at a tenth of the corpus (fixed values)."""
    rows = [
        ("full", 0.819, 0.822, 1280, 0),
        ("random", 0.747, 0.746, 48, 0),
        ("wordpiece_ratio", 0.783, 0.787, 48, 13),
        ("perplexity", 0.749, 0.742, 48, 4700),
        ("llm_quality", 0.781, 0.778, 48, 4787),
        ("kcenter", 0.774, 0.768, 48, 560),
        ("herding", 0.763, 0.768, 48, 120),
        ("datadiet", 0.642, 0.596, 48, 20),
        ("hybrid_qdi", 0.792, 0.789, 48, 4920),
    ]
    return spark.createDataFrame(rows, "method string, accuracy double, f1 double, train_time_sec int, select_time_sec int")
