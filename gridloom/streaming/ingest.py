"""Incremental ingest: streams of entries folded into a stored tensor, and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import is_nonzero


def entries(stream: DataFrame, coords: list[str], value: str, value_type: str = "f64") -> DataFrame:
    """A stream's rows as entries (d0, d1, ..., val), zeros dropped."""
    named = stream.select(*(F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(coords)), F.col(value).alias("val"))
    return named.where(is_nonzero(F.col("val"), value_type))


def append_entries(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append entries to Parquet files, exactly once, and end when the available input is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_degrees(stream: DataFrame, dim: int = 0) -> DataFrame:
    """Entries per coordinate so far, a stateful aggregation for update or complete output."""
    return stream.groupBy(F.col(f"d{dim}").alias("pos")).agg(F.count("*").alias("n"))
