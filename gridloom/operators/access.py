"""Point access, ordinals and traversal."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from ..tensor import CooTensor


def lookup(t: CooTensor, probes: DataFrame, coords: list[str] | None = None, depth: int = 0) -> DataFrame:
    """``probes`` with ``val``: the value at each probe's coordinates, 0 where nothing is stored, out of range included.

    A pattern reads as 1. One left join; repeated probes give repeated rows.
    """
    coords = coords or t.meta.coords
    val = F.lit(1.0) if t.is_pattern else F.get("vals", F.lit(depth))
    stored = t.df.select(*(F.col(d).alias(f"_{d}") for d in t.meta.coords), val.alias("_val"))
    on = [F.col(c) == F.col(f"_{d}") for c, d in zip(coords, t.meta.coords, strict=True)]
    zero = F.lit(0).cast(stored.schema["_val"].dataType) if t.meta.value_type not in ("c32", "c64") else F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).cast(stored.schema["_val"].dataType)
    return probes.join(stored, on, "left").select(*probes.columns, F.coalesce("_val", zero).alias("val"))


def value_at(t: CooTensor, pos: tuple[int, ...], depth: int = 0):
    """The value at one coordinate; filters reach the scan."""
    cond = F.lit(True)
    for c, p in zip(t.meta.coords, pos, strict=True):
        cond = cond & (F.col(c) == p)
    row = t.df.where(cond).first()
    if row is None:
        return 0
    return 1 if t.is_pattern else row["vals"][depth]


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of columns that make rows unique, without a single-task sort.

    Rows are range-partitioned and sorted, written with their place in their partition, and each
    partition's first number is a running sum over one row per partition.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("_part", before.alias("_first"))
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + place).drop("_part", "_first", "_at")


def ordinals(t: CooTensor) -> DataFrame:
    """Every stored value with its place in the flat data array: idx, coordinates, depth, val.

    Depth values of a coordinate are neighbours.
    """
    rows = with_ordinal(t.df, t.meta.storage_coords)
    if t.is_pattern:
        return rows.select(F.col("ordinal").alias("idx"), *t.meta.coords, F.lit(0).alias("depth"), F.lit(1.0).alias("val"))
    return rows.select("ordinal", *t.meta.coords, F.posexplode("vals").alias("depth", "val")).select((F.col("ordinal") * t.meta.depths + F.col("depth")).alias("idx"), *t.meta.coords, "depth", "val")


def at_ordinals(t: CooTensor, idx: Iterable[int]) -> DataFrame:
    """The flat array's elements at given places."""
    return ordinals(t).where(F.col("idx").isin(list(idx)))


def index_slice(t: CooTensor, index_pos: int) -> DataFrame:
    """The stored entries at one position of the index dimension; empty past the end."""
    return t.df.where(F.col(f"d{t.meta.index_dim}") == index_pos)


def index_pos_end(t: CooTensor) -> Column:
    """Aggregate: the last non-empty index position plus one; 0 for an empty tensor."""
    return F.coalesce(F.max(f"d{t.meta.index_dim}") + 1, F.lit(0)).alias("index_pos_end")


def position_lines(t: CooTensor) -> DataFrame:
    """One line of blank-separated coordinates per stored entry."""
    return t.df.select(F.concat_ws(" ", *t.meta.coords).alias("line"))


def for_each(t: CooTensor, func, schema: str) -> DataFrame:
    """Apply a function from and to iterators of pandas frames to all entries."""
    return t.df.mapInPandas(func, schema)


def take_while(t: CooTensor, condition: Column) -> DataFrame:
    """Entries in storage order before the first that fails ``condition``."""
    rows = with_ordinal(t.df, t.meta.storage_coords)
    stop = rows.where(~F.coalesce(condition, F.lit(False))).agg(F.min("ordinal")).first()[0]
    return (rows if stop is None else rows.where(F.col("ordinal") < stop)).drop("ordinal")
