"""A sparse tensor: a coordinate DataFrame with its metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meta import VALUE_TYPES, MatrixType, TensorMeta


@dataclass(frozen=True)
class CooTensor:
    """Columns d0, d1, ... (0-based longs) and ``vals`` (array of depth values; absent for patterns).

    Row order means nothing; storage order and layout are metadata.
    """

    df: DataFrame
    meta: TensorMeta

    @property
    def is_pattern(self) -> bool:
        return "vals" not in self.df.columns

    @property
    def scalar(self) -> DataFrame:
        """Coordinates and ``val``, the first depth value (1 for a pattern)."""
        val = F.lit(1.0) if self.is_pattern else F.element_at("vals", 1)
        return self.df.select(*self.meta.coords, val.alias("val"))

    def count(self) -> int:
        """Stored entries (coordinates, not depth values)."""
        return self.df.count()


def from_columns(df: DataFrame, coords: list[str], values: list[str], shape: tuple[int, ...] | None = None, order: tuple[int, ...] | None = None) -> CooTensor:
    """A tensor from a table's coordinate and value columns; the default order puts the last dimension of two first.

    Without a shape, each dimension reaches to its largest coordinate.
    """
    n = len(coords)
    named = df.select(*(F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(coords)), *([F.array(*(F.col(v) for v in values)).alias("vals")] if values else []))
    if shape is None:
        top = named.agg(*(F.max(f"d{i}") for i in range(n))).first()
        shape = (*((x + 1 if x is not None else 0) for x in top), max(1, len(values)))
    if order is None:
        order = (1, 0, 2) if n == 2 else tuple(range(n + 1))
    kind = "f64"
    if values:
        element = named.schema["vals"].dataType.elementType
        kind = next((k for k, t in VALUE_TYPES.items() if t == element), "f64")
        if kind == "f64":
            named = named.withColumn("vals", F.col("vals").cast("array<double>"))
    tag = "CPG" if not values else {"i64": "CIG", "c32": "CCG", "c64": "CCG"}.get(kind, "CRG")
    return CooTensor(named, TensorMeta(MatrixType(tag), kind, shape, order))
