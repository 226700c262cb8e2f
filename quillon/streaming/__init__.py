"""The same operators under Structured Streaming: decoding holds no state, so it runs unchanged on streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import Options, decode


def stream_ndjson(spark: SparkSession, path: str, kind: Any, options: Options | None = None, mode: str = "permissive") -> DataFrame:
    """A stream of the lines of files that arrive in a folder, decoded: ``document``, ``value``, ``error``."""
    lines = spark.readStream.format("text").load(path).select(F.col("value").alias("document")).filter(F.trim("document") != "")
    return decode(lines, "document", kind, options, mode=mode)
