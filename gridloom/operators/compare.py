"""Equality of tensors and descriptions of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, spread
from ..tensor import CooTensor
from .access import with_ordinal
from .encode import best_encoding, width_stats
from .layout import offsets


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side`` (left or right)."""
    cols = a.columns
    both = cut(a.withColumn("_times", F.lit(1)).union(b.select(cols).withColumn("_times", F.lit(-1))), "sides")
    keys = [c for c, t in a.dtypes if t in ("bigint", "int")]
    dealt = spread(both, both.count(), *keys) if keys else both
    more = dealt.groupBy(*cols).agg(F.sum("_times").alias("_times")).where("_times <> 0")
    side = F.when(F.col("_times") > 0, "left").otherwise("right")
    return more.select(*cols, F.explode(F.array_repeat(side, F.abs("_times").cast("int"))).alias("side"))


def equal(a: CooTensor, b: CooTensor) -> bool:
    """Same type, values, shape, order and entries."""
    if replace(a.meta, nnz=None) != replace(b.meta, nnz=None) or a.df.columns != b.df.columns or a.df.dtypes != b.df.dtypes:
        return False
    return differences(a.df, b.df).isEmpty()


def describe(t: CooTensor, most: int = 10, encodings: bool = False) -> str:
    """Type, shape, order, entries and the first coordinates and values in storage order.

    With ``encodings``, also the cheapest encoding of the index offsets and of the positions.
    """
    m = t.meta
    lines = [f"type: {m.matrix_type.long_name}", f"data type: {m.value_type}", f"shape: {list(m.shape)}", f"order: {list(m.order)}", f"nnz: {t.count()}"]
    placed = with_ordinal(t.df, m.storage_coords)
    if encodings and m.non_depth_dims > 1:
        for name, df, idx, value in (("index", offsets(t), "pos", "start"), ("positions", placed, "ordinal", f"d{m.non_index_dim}")):
            b, w = best_encoding(df, idx, value).first(), width_stats(df, value).first()
            lines.append(f"{name}: {w['n']} items from {w['min_value']} to {w['max_value']}, sketch bits {b['bits']}, {b['width']} bytes an item, {b['bytes']} bytes")
    rows = placed.where(F.col("ordinal") < most).orderBy("ordinal").collect()
    more = ", ..." if lines and len(rows) == most else ""
    for c in m.storage_coords:
        lines.append(f"{c}: [{', '.join(str(r[c]) for r in rows)}{more}]")
    if not t.is_pattern:
        lines.append(f"data: [{', '.join(str(v) for r in rows for v in r['vals'])}{more}]")
    return "\n".join(lines)
