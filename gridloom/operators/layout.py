"""Storage layout: changing the index dimension, histograms, offsets, ranges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from ..tensor import CooTensor
from .access import with_ordinal


def reindex(t: CooTensor, order: tuple[int, ...] | None = None, partitions: int | None = None) -> CooTensor:
    """The same entries laid out in another storage order (default: the first two dimensions swapped).

    Rows are range-partitioned on the whole new order, so a hot index position is spread over
    several partitions, and sorted within; Spark spills what does not fit.
    """
    meta = t.meta.with_index_dim_changed() if order is None else replace(t.meta, order=order)
    keys = meta.storage_coords
    laid = t.df.repartitionByRange(partitions, *keys) if partitions else t.df.repartitionByRange(*keys)
    return CooTensor(laid.sortWithinPartitions(*keys), meta)


def histogram(t: CooTensor, dim: int) -> DataFrame:
    """Stored entries per coordinate of a dimension, zeros included: (pos, n)."""
    counts = t.df.groupBy(F.col(f"d{dim}").alias("pos")).agg(F.count("*").alias("n"))
    every = t.df.sparkSession.range(t.meta.shape[dim]).select(F.col("id").alias("pos"))
    return every.join(counts, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))


def running_sum(df: DataFrame, key: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Exclusive prefix sum of ``value`` along an integer ``key``, in blocks of ``width`` keys.

    Blocks are summed first, only the blocks' totals meet in one window. The input is used
    twice, so it should be a table and not a plan over the entries.
    """
    block = F.call_function("div", F.col(key), F.lit(width))
    cut_ = df.withColumn("_b", block)
    totals = cut_.groupBy("_b").agg(F.sum(value).alias("_t"))
    ahead = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return cut_.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(ahead, "_b").withColumn(name, (F.col("_ahead") + F.col("_own")).cast("long")).drop("_b", "_own", "_ahead")


def offsets(t: CooTensor, dim: int | None = None) -> DataFrame:
    """Offsets of a compressed index: (pos, start) for 0 up to the last non-empty position plus one."""
    dim = t.meta.index_dim if dim is None else dim
    counts = cut(t.df.groupBy(F.col(f"d{dim}").alias("pos")).agg(F.count("*").alias("n")), "counts")
    end = counts.agg(F.max("pos")).first()[0]
    every = t.df.sparkSession.range(1 if end is None else end + 2).select(F.col("id").alias("pos"))
    filled = every.join(counts, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))
    return running_sum(filled, "pos", "n", "start").select("pos", "start")


def positions(t: CooTensor, dim: int | None = None) -> DataFrame:
    """Where each entry goes in the layout indexed by ``dim``: coordinates and ``at``, its ordinal there."""
    dim = t.meta.non_index_dim if dim is None else dim
    other = [f"d{i}" for i in t.meta.order[:-1] if i != dim]
    return with_ordinal(t.df.select(*t.meta.coords), [f"d{dim}", *other], "at")


# Ranges


def equal_width(spark: SparkSession, n: int, k: int) -> DataFrame:
    """At most ``k`` ranges of ceil(n / k) positions: (range_id, min_pos, max_pos), max excluded."""
    width = -(-n // k) if n else 1
    count = -(-n // width)
    return spark.range(count).select(F.col("id").alias("range_id"), (F.col("id") * width).alias("min_pos"), F.least((F.col("id") + 1) * width, F.lit(n)).cast("long").alias("max_pos"))


def clone_range(spark: SparkSession, k: int, max_pos: int, min_pos: int = 0) -> DataFrame:
    """``k`` equal ranges."""
    return spark.range(k).select(F.col("id").alias("range_id"), F.lit(min_pos).cast("long").alias("min_pos"), F.lit(max_pos).cast("long").alias("max_pos"))


def nnz_balanced(t: CooTensor, k: int) -> DataFrame:
    """Ranges of index positions with about nnz / k entries each: (range_id, min_pos, max_pos, nnz).

    A position belongs to the range in which its first entry's ordinal falls; empty ranges are left out.
    """
    counts = cut(t.df.groupBy(F.col(f"d{t.meta.index_dim}").alias("pos")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    summed = running_sum(counts, "pos", "n", "start")
    bucket = F.call_function("div", F.col("start") * k, F.lit(max(1, total)))
    return summed.groupBy(bucket.cast("long").alias("range_id")).agg(F.min("pos").alias("min_pos"), (F.max("pos") + 1).alias("max_pos"), F.sum("n").alias("nnz"))


def nnz_greedy(t: CooTensor, k: int) -> DataFrame:
    """At most ``k`` ranges of index positions: (range_id, min_pos, max_pos, nnz).

    Each range goes on while it holds at most ceil(nnz / k) entries, but has one position at least; the k-th
    takes the rest. A boundary depends on the one before, so the driver looks up k of them in the table of offsets.
    """
    if k < 1:
        raise ValueError("one range at least")
    spark = t.df.sparkSession
    table = cut(offsets(t), "offsets")
    end, total = table.agg(F.max("pos"), F.max("start")).first()
    if not total:
        return spark.createDataFrame([(0, 0, 0, 0)], "range_id long, min_pos long, max_pos long, nnz long")
    most, out, pos, before = -(-total // k), [], 0, 0
    while pos < end and len(out) < k - 1:
        far, held, one = table.where(F.col("pos") > pos).agg(F.max(F.when(F.col("start") <= before + most, F.col("pos"))), F.max(F.when(F.col("start") <= before + most, F.col("start"))), F.min("start")).first()
        new, ahead = (far, held) if far is not None else (pos + 1, one)
        out.append((len(out), pos, new, ahead - before))
        pos, before = new, ahead
    if pos < end:
        out.append((len(out), pos, end, total - before))
    return spark.createDataFrame(out, "range_id long, min_pos long, max_pos long, nnz long")


def max_ranges(nnz: int, most_per_range: int, cap: int) -> int:
    """min(ceil(nnz / most_per_range), cap), at least 1."""
    return max(1, min(-(-nnz // most_per_range), cap))


def partition_ranges(df: DataFrame, key: str) -> DataFrame:
    """What each partition holds: (part, min_pos, max_pos, nnz)."""
    return df.groupBy(F.spark_partition_id().cast("long").alias("part")).agg(F.min(key).alias("min_pos"), (F.max(key) + 1).alias("max_pos"), F.count("*").alias("nnz"))


def range_offsets(ranges: DataFrame) -> DataFrame:
    """Exclusive running sum of range sizes: adds ``offset``."""
    return running_sum(cut(ranges, "ranges"), "range_id", "nnz", "offset")


def bucket_of(pos: Column, n: int, k: int) -> Column:
    """The equal-width range of a position."""
    return F.call_function("div", pos, F.lit(max(1, -(-n // k)))).cast("long")
