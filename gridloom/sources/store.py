"""Tensors as Parquet with a metadata sidecar, and a reader that tells formats by their names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_mtx_extension
from ..meta import TensorMeta
from ..operators.layout import reindex
from ..tensor import CooTensor
from .mtx import read_meta as read_mtx_meta
from .mtx import read_mtx
from .prm import read_prm, read_prm_meta

SIDECAR = "_meta"


def write_tensor(t: CooTensor, path: str, partitions: int | None = None) -> TensorMeta:
    """Write range-partitioned and sorted in storage order, so that row groups have narrow coordinate ranges."""
    laid = reindex(t, t.meta.order, partitions)
    laid.df.write.mode("overwrite").parquet(f"{path}/data")
    spark = t.df.sparkSession
    meta = replace(t.meta, nnz=spark.read.parquet(f"{path}/data").count())
    spark.createDataFrame([(meta.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{SIDECAR}")
    return meta


def read_meta(spark: SparkSession, path: str) -> TensorMeta:
    """Metadata of a Matrix Market, ``.prm`` or Parquet tensor, from its header or sidecar."""
    if has_mtx_extension(path):
        return read_mtx_meta(spark, path)
    if path.endswith(".prm"):
        return read_prm_meta(path)
    return TensorMeta.from_json(spark.read.text(f"{path}/{SIDECAR}").first()[0])


def read_tensor(spark: SparkSession, path: str, hint: str = "auto") -> CooTensor:
    """A tensor of any of the formats. Parquet is read lazily, with pruned columns and pushed filters."""
    if has_mtx_extension(path):
        return read_mtx(spark, path, hint)
    if path.endswith(".prm"):
        return read_prm(spark, path)
    return CooTensor(spark.read.parquet(f"{path}/data"), read_meta(spark, path))


def convert(spark: SparkSession, source: str, target: str, index_dim: int | None = None, hint: str = "auto") -> TensorMeta:
    """Read any format and write Parquet, laid out by the given index dimension (default: the file's)."""
    t = read_tensor(spark, source, hint)
    if index_dim is not None and index_dim != t.meta.index_dim:
        rest = [d for d in t.meta.order if d != index_dim]
        t = CooTensor(t.df.select(*(F.col(c) for c in t.df.columns)), replace(t.meta, order=(index_dim, *rest)))
    return write_tensor(t, target)
