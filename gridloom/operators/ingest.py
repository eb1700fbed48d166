"""Building tensors: zero drop, duplicate checks, bounds checks, symmetric expansion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complex_conj, complex_of, is_nonzero
from ..meta import MatrixType
from ..tensor import CooTensor


def drop_zeros(t: CooTensor) -> CooTensor:
    """Without the entries whose depth values are all zero; entries with any other value stay whole, patterns as they are."""
    if t.is_pattern:
        return t
    return replace(t, df=t.df.where(F.exists("vals", lambda v: is_nonzero(v, t.meta.value_type))))


def duplicates(df: DataFrame, coords: list[str]) -> DataFrame:
    """Coordinates that occur more than once, with their count ``n``."""
    return df.groupBy(*coords).agg(F.count("*").alias("n")).where("n > 1")


def out_of_bounds(t: CooTensor) -> DataFrame:
    """Entries with a null or negative coordinate or one beyond the shape."""
    bad = F.lit(False)
    for i, c in enumerate(t.meta.coords):
        bad = bad | F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= t.meta.shape[i])
    return t.df.where(bad)


def validate(t: CooTensor) -> CooTensor:
    """The tensor with its zeros dropped and nnz counted; ValueError for coordinates out of bounds or repeated."""
    if (row := out_of_bounds(t).first()) is not None:
        raise ValueError(f"coordinate out of bounds: {row}")
    t = drop_zeros(t)
    if (row := duplicates(t.df, t.meta.coords).first()) is not None:
        raise ValueError(f"repeated coordinate: {row}")
    return replace(t, meta=replace(t.meta, nnz=t.df.count()))


def expand_symmetric(t: CooTensor) -> CooTensor:
    """Both halves of a symmetric, skew or Hermitian matrix of which one is stored; others as they are."""
    kind = t.meta.matrix_type
    if not kind.is_symmetric or t.meta.non_depth_dims != 2:
        return t
    values = []
    if not t.is_pattern:
        turn = {"skew-symmetric": _negate(t.meta.value_type), "Hermitian": complex_conj}.get(kind.symmetry, lambda v: v)
        values = [F.transform("vals", turn).alias("vals")]
    mirror = t.df.where("d0 <> d1").select(F.col("d1").alias("d0"), F.col("d0").alias("d1"), *values)
    mirror = mirror.select([F.col(c).cast(t.df.schema[c].dataType) for c in t.df.columns])
    general = MatrixType.of(kind.layout, kind.field, "general")
    return CooTensor(t.df.union(mirror), replace(t.meta, matrix_type=general, nnz=None))


def _negate(value_type: str):
    if value_type in ("c32", "c64"):
        return lambda v: complex_of(-v["re"], -v["im"])
    return lambda v: -v
