"""Encoding statistics of integer arrays: byte width, shift by the minimum, block sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import encode_size

ITEM_BYTES = 8  # a sketch item
MOST_BITS = 63


def width_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min_value, max_value, width (bytes an item), shifted (whether the minimum is subtracted), bytes.

    The minimum is subtracted only if that saves a byte an item.
    """
    s = df.agg(F.count(value).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    plain, less = encode_size(F.col("max_value")), encode_size(F.col("max_value") - F.col("min_value"))
    return s.withColumn("shifted", less < plain).withColumn("width", F.when(less < plain, less).otherwise(plain)).withColumn("bytes", F.col("n") * F.col("width"))


def sketch_costs(df: DataFrame, idx: str, value: str, bits: list[int] | None = None) -> DataFrame:
    """Cost by number of sketch bits: (bits, blocks, width, bytes, encodable).

    With b bits, blocks of 2**b neighbours store their first value and each item its
    difference to it; the width follows from the largest last-minus-first of a block. A block
    whose last value is below its first cannot be encoded. All candidate bits are evaluated in
    one pass: the finest blocks are aggregated once, coarser ones from these.
    """
    top = df.agg(F.max(idx)).first()[0]
    candidates = bits or [b for b in range(1, MOST_BITS + 1) if top is None or (1 << (b - 1)) <= max(1, top)]
    least = min(candidates)
    fine = df.groupBy(F.shiftright(F.col(idx), least).alias("_b")).agg(F.min_by(value, idx).alias("_first"), F.max_by(value, idx).alias("_last"), F.count("*").alias("_n"))
    each = fine.withColumn("bits", F.explode(F.array(*(F.lit(b) for b in candidates))))
    block = F.call_function("div", F.col("_b"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits") - least))
    coarse = each.groupBy("bits", block.alias("_c")).agg(F.min_by("_first", "_b").alias("_first"), F.max_by("_last", "_b").alias("_last"), F.sum("_n").alias("_n"))
    out = coarse.groupBy("bits").agg(F.count("*").alias("blocks"), F.max(F.col("_last") - F.col("_first")).alias("_d"), F.min(F.col("_last") >= F.col("_first")).alias("encodable"), F.sum("_n").alias("_n"))
    width = encode_size(F.greatest("_d", F.lit(0)))
    return out.select(F.col("bits").cast("long").alias("bits"), "blocks", width.alias("width"), (F.col("_n") * width + F.col("blocks") * ITEM_BYTES).alias("bytes"), "encodable")


def best_encoding(df: DataFrame, idx: str, value: str) -> DataFrame:
    """One row (bits, width, bytes): the cheapest encoding, 0 bits for none; ties go to fewer bits."""
    plain = width_stats(df, value).select(F.lit(0).cast("long").alias("bits"), "width", "bytes")
    sketch = sketch_costs(df, idx, value).where("encodable").select("bits", "width", "bytes")
    best = plain.union(sketch).agg(F.min_by(F.struct("bits", "width", "bytes"), F.struct("bytes", "bits")).alias("b"))
    return best.select("b.*")


def decode(delta: Column, first: Column, minimum: Column) -> Column:
    """An item's value from its stored difference, its block's first value and the shift."""
    return delta + F.coalesce(first, F.lit(0)) + F.coalesce(minimum, F.lit(0))


def append(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """Array ``b`` after array ``a``: its places go on from a's last. Minimum and maximum follow from :func:`width_stats`."""
    ahead = a.agg(F.max(idx) + 1).first()[0] or 0
    return a.unionByName(b.withColumn(idx, F.col(idx) + ahead))


def sketched(df: DataFrame, idx: str, value: str, bits: int) -> DataFrame:
    """Items as they are stored with ``bits`` sketch bits: (idx, block, first, delta), delta to the block's first value."""
    block = F.shiftright(F.col(idx), bits)
    first = df.groupBy(block.alias("block")).agg(F.min_by(value, idx).alias("first"))
    return df.withColumn("block", block).join(first, "block").select(idx, "block", "first", (F.col(value) - F.col("first")).alias("delta"))


def increment(df: DataFrame, key: str, by: str = "n") -> DataFrame:
    """Increments summed by position."""
    return df.groupBy(key).agg(F.sum(by).alias(by))
