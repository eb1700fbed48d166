"""Command line: ``python -m gridloom.cli {convert,describe,pagerank,components} ...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.compare import describe
from .plans.components import component_sizes, connected_components
from .plans.pagerank import pagerank, top_k
from .sources.prm import write_prm
from .sources.store import convert, read_tensor


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="read .mtx, .prm or Parquet and write Parquet or .prm")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--layout", choices=("csc", "csr"), help="index dimension of the output")
    c.add_argument("--data-type-hint", choices=("auto", "f32", "f64"), default="auto")
    d = sub.add_parser("describe", help="print metadata and the first items")
    d.add_argument("source")
    d.add_argument("--max-items", type=int, default=10)
    d.add_argument("--encodings", action="store_true", help="also print how the index and positions encode")
    r = sub.add_parser("pagerank", help="rank the pages of a matrix read as links row -> column")
    r.add_argument("source")
    r.add_argument("--damping-factor", type=float, default=0.85)
    r.add_argument("--max-iterations", type=int, default=100)
    r.add_argument("--max-residual", type=float, default=1e-6)
    r.add_argument("--print-top-k", type=int, default=100)
    r.add_argument("--update-score-in-place", action="store_true")
    k = sub.add_parser("components", help="weakly connected components of a matrix read as links")
    k.add_argument("source")
    k.add_argument("--max-iterations", type=int, default=200)
    k.add_argument("--print-first-k", type=int, default=-1)
    return p


def links(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    t = read_tensor(spark, path)
    return t.df.select(F.col("d0").alias("src"), F.col("d1").alias("dst")), t.meta.max_dim_size


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    began = time.perf_counter()
    if a.command == "convert":
        if a.target.endswith(".prm"):
            write_prm(read_tensor(spark, a.source, a.data_type_hint), a.target)
        else:
            convert(spark, a.source, a.target, {None: None, "csr": 0, "csc": 1}[a.layout], a.data_type_hint)
        print(f"convert_time_ms,{(time.perf_counter() - began) * 1000:.0f}")
    elif a.command == "describe":
        print(describe(read_tensor(spark, a.source), a.max_items, a.encodings))
    elif a.command == "pagerank":
        edges, n = links(spark, a.source)
        r = pagerank(edges, n, a.damping_factor, a.max_iterations, a.max_residual, "gauss_seidel" if a.update_score_in_place else "jacobi")
        print(f"pagerank_time_ms,{(time.perf_counter() - began) * 1000:.0f}\nresidual,{r.residual}\niterations,{r.iterations}\n# Page,Score")
        for row in top_k(r.scores, a.print_top_k).toLocalIterator():
            print(f"{row['page']},{row['score']:.6g}")
    else:
        edges, n = links(spark, a.source)
        r = connected_components(edges, n, "star", a.max_iterations)
        print(f"components_time_ms,{(time.perf_counter() - began) * 1000:.0f}\niterations,{r.iterations}\nconverged,{str(r.converged).lower()}\nconnected_components,{component_sizes(r.labels).count()}\n# Node,ComponentId")
        rows = r.labels.orderBy("node")
        for row in (rows if a.print_first_k < 0 else rows.limit(a.print_first_k)).toLocalIterator():
            print(f"{row['node']},{row['component']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
