"""Shared working storage: where intermediate tables go, and cutting lineage.

Executors and the driver share no local folders, so every intermediate table is
written below the folder that the cluster names in ``spark.checkpoint.dir``. Only
where that setting is absent and everything runs in one process (a laptop) a temporary folder is made.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 500_000
_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python mappers can import it there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"gridloom/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as a URI or path without a trailing slash.

    Raises RuntimeError where the setting is absent and executors are processes of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="gridloom-")
    return _FALLBACK[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage but the files, so a lost executor costs a re-read
    and not a recomputation; unlike a local checkpoint it survives any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession, rows: int) -> int | None:
    """Partitions of about TASK_ROWS rows; None where as many tasks as there are cores get no more than that."""
    cores = spark.sparkContext.defaultParallelism
    return None if rows <= TASK_ROWS * cores else -(-rows // TASK_ROWS)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of so many rows, dealt by ``keys`` ahead of an aggregation by them and others.

    Adaptive execution would gather its partitions to as many as there are cores, and a task's table would grow with the input.
    """
    n = parts_of(df.sparkSession, rows)
    return df if n is None else df.repartition(n, *keys)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut`."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/gridloom-" in f}:
        delete_path(df.sparkSession, path)
