"""Array columns: prefix sums in about linear time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 256


def _running(values: Column, start: Column) -> Column:
    """Exclusive running sums of an array from a start; an array that grows step by step, so for short ones."""
    zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def with_prefix(df: DataFrame, values: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: exclusive prefix sums of an array column of longs (null for null).

    Blocks of ``width`` elements are summed, the blocks' sums run on, and each block runs on from its own start.
    """
    size = F.size(values)
    at = F.when(size > 0, F.sequence(F.lit(0), F.call_function("div", size - 1, F.lit(width)).cast("int")))
    df = df.withColumn("_blocks", F.transform(at, lambda i: F.slice(F.col(values), i * width + 1, F.lit(width))))
    df = df.withColumn("_sums", F.transform("_blocks", lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)))
    df = df.withColumn("_starts", _running(F.col("_sums"), F.lit(0).cast("long")))
    out = F.flatten(F.zip_with("_blocks", "_starts", _running))
    return df.withColumn(name, F.when(size > 0, out).otherwise(F.when(size == 0, F.array().cast("array<bigint>")))).drop("_blocks", "_sums", "_starts")
