"""PageRank over an edge list.

score = (1 - d) / N + d * sum over in-neighbours of score / out-degree. Mass of pages
without out-links is not spread and scores are not normalised. With ``freeze_tail`` pages after the last one with an
in-link keep their first score.

An iteration is one join of edges and scores divided by out-degree and one aggregation by
page, partial before its shuffle, that takes the arriving shares and the old state together. While
the scores are small enough (counted, BROADCAST_NODES) they are broadcast and edges do not move; beyond
that edges are partitioned by source once, and sources with over HEAVY links are dealt to
several partitions with their score repeated for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.access import with_ordinal
from ..storage import cut, ship
from .bsp import Program, run

BROADCAST_NODES = 1_000_000
HEAVY = 1_000_000
SWEEP_STEP = 1 << 20  # links that a sweep takes at once


@dataclass
class Ranked:
    """scores (page, score), the last residual and the number of iterations."""

    scores: DataFrame
    residual: float
    iterations: int


def out_degrees(edges: DataFrame) -> DataFrame:
    """(src, degree): stored links per source; sources without links have no row."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


class _Jacobi(Program):
    def __init__(self, edges: DataFrame, num_nodes: int, damping: float, max_residual: float, freeze_tail: bool):
        self.n, self.damping, self.max_residual = num_nodes, damping, max_residual
        spark = edges.sparkSession
        links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).persist(StorageLevel.MEMORY_AND_DISK)
        self.degrees = cut(out_degrees(links), "degrees")
        top = links.agg(F.max("dst")).first()[0] if freeze_tail else num_nodes - 1
        self.top = -1 if top is None else top
        self.small = num_nodes <= BROADCAST_NODES
        self.held = [links]
        if self.small:
            self.edges = links
        else:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            heavy = self.degrees.where(F.col("degree") > HEAVY).select("src", F.ceil(F.col("degree") / HEAVY).alias("lanes"))
            lane = F.when(F.col("lanes").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("dst"), F.col("lanes"))).cast("int").alias("lane")
            self.edges = links.join(heavy, "src", "left").select("src", "dst", lane).repartition(parts, "src", "lane").persist(StorageLevel.MEMORY_AND_DISK)
            self.held.append(self.edges)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()

    def init(self) -> DataFrame:
        spark = self.degrees.sparkSession
        pages = spark.range(self.n).select(F.col("id").alias("page"))
        rows = pages.join(self.degrees.withColumnRenamed("src", "page"), "page", "left")
        return rows.select("page", F.greatest(F.coalesce("degree", F.lit(1)), F.lit(1)).alias("degree"), F.lit(1.0 / self.n).alias("score"), F.lit(0.0).alias("change"))

    def step(self, state: DataFrame) -> DataFrame:
        share = state.select(F.col("page").alias("src"), (F.col("score") / F.col("degree")).alias("share"), "degree")
        if self.small:
            joined = self.edges.join(F.broadcast(share.select("src", "share")), "src")
        else:
            lanes = F.when(F.col("degree") > HEAVY, F.ceil(F.col("degree") / HEAVY)).otherwise(F.lit(1))
            spread = share.select("src", "share", F.explode(F.sequence(F.lit(0), lanes.cast("int") - 1)).alias("lane"))
            joined = self.edges.join(spread, ["src", "lane"])
        # Shares and the old state meet in one aggregation, so the state is not shuffled for a join of its own.
        none = F.lit(None)
        arrived = joined.select(F.col("dst").alias("page"), "share", none.cast("long").alias("degree"), none.cast("double").alias("score"))
        old = state.select("page", none.cast("double").alias("share"), "degree", "score")
        met = arrived.union(old).groupBy("page").agg(F.sum("share").alias("s"), F.max("degree").alias("degree"), F.max("score").alias("score")).where("degree is not null")
        new = (1 - self.damping) / self.n + self.damping * F.coalesce("s", F.lit(0.0))
        kept = F.when(F.col("page") <= self.top, new).otherwise(F.col("score"))
        return met.select("page", "degree", kept.alias("score"), F.abs(kept - F.col("score")).alias("change"))

    def metrics(self) -> dict[str, Column]:
        return {"residual": F.sum("change")}

    def stop(self, iteration: int, metrics: dict) -> bool:
        return metrics["residual"] <= self.max_residual


def _packed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in the order of their ordinals, a batch as one row: sources and, run by run, destinations."""
    for batch in batches:
        src, dst, at = (batch[c].to_numpy() for c in ("src", "dst", "ordinal"))
        cuts = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # a batch may go over from one file to another
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            to, n = np.unique(dst[lo:hi], return_counts=True)
            row = {"start": int(at[lo]), "src": src[lo:hi].astype("<i4" if src.max() < 1 << 31 else "<i8").tobytes(), "n": int(hi - lo), "dst": to.tobytes(), "times": n.astype("<i8").tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("start", pa.int64()), ("src", pa.binary()), ("n", pa.int64()), ("dst", pa.binary()), ("times", pa.binary())]))


def _runs(src: np.ndarray, at: np.ndarray, top: int) -> list[int]:
    """Where sweeps may break: pages of a run have no links to later pages of it, so they can be scored together; nor are their links over SWEEP_STEP, but a page's own."""
    out, begin = [0], 0
    for lo in range(0, top, 1 << 16):
        hi = min(top, lo + (1 << 16))
        behind = np.full(hi - lo, -1, np.int64)
        for p in range(lo, hi):
            a, b = at[p], at[p + 1]
            if b > a:  # sources are in order: the last one before the page
                k = a + np.searchsorted(src[a:b], p)
                behind[p - lo] = src[k - 1] if k > a else -1
        for p, x in enumerate(behind.tolist(), lo):
            if x >= begin or (at[p + 1] - at[begin] > SWEEP_STEP and p > begin):
                out.append(p)
                begin = p
    return [*out, top] if top else [0]


def _sweeps(edges: DataFrame, n: int, damping: float, most: int, max_residual: float, freeze_tail: bool) -> Ranked:
    """In-place sweeps in ascending page order: sequential by definition, so one task does them.

    It gets the links sorted and packed and keeps 4 bytes a link (8 over 2**31 pages) and some 60 a page, whatever their number.
    """
    spark = edges.sparkSession
    ordered = with_ordinal(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), ["dst", "src"])
    total = ordered.count()
    wide = np.int32 if n <= 1 << 31 else np.int64

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, at = np.empty(total, wide), np.zeros(n + 1, np.int64)
        for batch in batches:
            for start, raw, k, dst, times in zip(*(batch[c] for c in ("start", "src", "n", "dst", "times")), strict=True):
                k, start = k.as_py(), start.as_py()
                src[start : start + k] = np.frombuffer(raw.as_buffer(), f"<i{len(raw.as_buffer()) // k}")
                at[np.frombuffer(dst.as_buffer(), np.int64) + 1] += np.frombuffer(times.as_buffer(), np.int64)
        linked = np.flatnonzero(at)
        top = (int(linked[-1]) if len(linked) else 0) if freeze_tail else n
        at = np.cumsum(at)
        degree = np.zeros(n, np.int64)
        for lo in range(0, total, SWEEP_STEP):
            pages, times = np.unique(src[lo : lo + SWEEP_STEP], return_counts=True)
            degree[pages] += times
        degree = np.maximum(degree, 1)
        runs = _runs(src, at, top)
        share, residual, i = 1.0 / n / degree, np.inf, 0
        while i < most and residual > max_residual:
            residual, i = 0.0, i + 1
            for p, q in zip(runs, runs[1:], strict=False):
                a, b = at[p], at[q]
                if q == p + 1:
                    got = share[src[a:b]].sum()
                else:
                    got, full = np.zeros(q - p), np.flatnonzero(at[p + 1 : q + 1] > at[p:q])
                    if len(full):
                        got[full] = np.add.reduceat(share[src[a:b]], at[p:q][full] - a)
                new = (1 - damping) / n + damping * got
                residual += float(np.abs(new - share[p:q] * degree[p:q]).sum())
                share[p:q] = new / degree[p:q]
        for lo in range(0, n, 1 << 16):
            hi = min(n, lo + (1 << 16))
            yield pa.RecordBatch.from_pydict({"page": np.arange(lo, hi), "score": share[lo:hi] * degree[lo:hi], "residual": np.full(hi - lo, residual), "iterations": np.full(hi - lo, i)})

    if not total:
        scores = spark.range(n).select(F.col("id").alias("page"), F.lit(1.0 / n).alias("score"))
        return Ranked(scores, 0.0, 1)
    ship(spark)
    packed = cut(ordered.mapInArrow(_packed_links, "start long, src binary, n long, dst binary, times binary"), "links")
    out = cut(packed.repartition(1).mapInArrow(sweep, "page long, score double, residual double, iterations long"), "sweeps")
    first = out.first()
    return Ranked(out.select("page", "score"), first["residual"], first["iterations"])


def pagerank(edges: DataFrame, num_nodes: int, damping: float = 0.85, max_iterations: int = 100, max_residual: float = 1e-6, mode: str = "jacobi", freeze_tail: bool = True) -> Ranked:
    """Scores of pages 0 .. num_nodes - 1 from links (src, dst); repeated links count each time.

    ``mode`` is jacobi (distributed) or gauss_seidel (in-place sweeps, one task). Ends when
    the L1 change of an iteration is at most ``max_residual``.
    """
    if num_nodes < 1:
        raise ValueError("a graph has one node at least")
    if mode == "gauss_seidel":
        return _sweeps(edges, num_nodes, damping, max_iterations, max_residual, freeze_tail)
    if mode != "jacobi":
        raise ValueError(f"unknown mode {mode!r}")
    program = _Jacobi(edges, num_nodes, damping, max_residual, freeze_tail)
    try:
        r = run(program, max_iterations)
    finally:
        program.release()
    return Ranked(r.state.select("page", "score"), r.history[-1]["residual"] if r.history else float("inf"), r.iterations)


def top_k(scores: DataFrame, k: int = 100) -> DataFrame:
    """The k pages with the highest scores, ties by lower page; all of them for k < 0."""
    ranked = scores.orderBy(F.desc("score"), F.asc("page"))
    return ranked if k < 0 else ranked.limit(k)
