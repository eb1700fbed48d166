"""Sparse matrix times vector, the step below PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import CooTensor


def spmv(t: CooTensor, x: DataFrame, pos: str = "pos", val: str = "val") -> DataFrame:
    """A x as rows (pos, val), rows of A without entries left out; ``x`` has a row per column position.

    One equi-join on the column and one aggregation by row, partial before the shuffle.
    """
    v = x.select(F.col(pos).alias("d1"), F.col(val).alias("_x"))
    return t.scalar.join(v, "d1").groupBy(F.col("d0").alias("pos")).agg(F.sum(F.col("val") * F.col("_x")).alias("val"))
