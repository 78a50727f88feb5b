"""Running external models over rows: scorers, embedders and judges as plain functions on batches.

A client is a factory called once in a Python worker; it returns a function from a list of texts to a list of results.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import parse_json


def score_rows(df: DataFrame, factory: Callable[[], Callable], result: str = "score double", id_col: str = "id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """(id, result): the client's result for each text, in batches of ``batch``."""
    name, kind = result.split(" ", 1)
    id_type = df.schema[id_col].dataType.simpleString()
    arrow = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "int": pa.int32()}[kind]

    def run(batches):
        client = factory()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(client(part.column(1).to_pylist()), arrow)], names=[id_col, name])

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, {name} {kind}")


def with_retries(call: Callable[[str], str], retries: int = 3, pause: float = 2.0, sleep=time.sleep) -> Callable[[str], str | None]:
    """The call with waits of pause, 2 * pause, ... after failures; None when all attempts fail."""

    def run(text: str) -> str | None:
        for attempt in range(1, retries + 1):
            try:
                return call(text)
            except Exception:
                if attempt < retries:
                    sleep(pause * attempt)
        return None

    return run


def annotations(df: DataFrame, answers: DataFrame, id_col: str = "id", answer: str = "response") -> DataFrame:
    """Rows with the three scores and explanations parsed from an answer; scores null and explanations empty where it is unusable."""
    parsed = answers.select(id_col, parse_json(F.col(answer)).alias("_j"))
    out = df.join(parsed, id_col, "left")
    for a in ("quality", "diversity", "importance"):
        out = out.withColumn(f"{a}_score", F.col("_j")[a]["score"]).withColumn(f"{a}_expl", F.coalesce(F.col("_j")[a]["explanation"], F.lit("")))
    return out.drop("_j")


