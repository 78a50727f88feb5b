"""Written intermediate tables: what is read more than once is computed once, and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as strings, of a table that may be broadcast.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share.  Where it isn't set, as in tests, a local session gets one; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        path = context.getCheckpointDir().get()
    return path.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, text: str | None = None) -> DataFrame:
    """A settled table with a broadcast hint if its rows, and the bytes of its column ``text``, are few enough; else as it is."""
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    row = df.agg(F.count("*").alias("n"), size.alias("b")).first()
    return F.broadcast(df) if row["n"] <= BROADCAST_ROWS and (row["b"] or 0) <= BROADCAST_BYTES else df
