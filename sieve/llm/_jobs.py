"""Shared storage of intermediate tables, and unique integer keys."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager


def shared_folder(spark) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it isn't set, as in tests, a local session gets one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def materialise(df, name: str):
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Have Spark delete shuffle files that no table needs any more; it does so when the driver collects garbage, which a quiet driver puts off."""
    gc.collect()
    for _ in range(2):
        time.sleep(1)  # the listeners of the last job hold its plan for a moment
        spark._jvm.System.gc()


@contextmanager
def small_batches(spark, rows: int = 256):
    """Jobs started inside hand Python at most so many rows at a time: for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unique_keys(df, id_col: str, text_col: str, key: str):
    """The rows with a column ``key`` of distinct non-null longs in the order of (id, text); the id itself where it serves.

    Null ids come last.  Other ids than distinct integers get the row's place in that order, from a written table.
    """
    from pyspark.sql import functions as F

    if df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        n = df.agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("d")).first()
        if n["n"] == n["d"]:
            return df.withColumn(key, F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(F.col(text_col)), F.col(text_col)]
    return materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "keyed")
