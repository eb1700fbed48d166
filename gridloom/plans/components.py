"""Weakly connected components of a graph with nodes 0 .. num_nodes - 1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop_table, parts_of
from .bsp import Program, run
from .star import star_rounds

HEAVY = 500_000


@dataclass
class Labelled:
    """labels (node, component) with the least node id as component; sweeps or rounds made, and whether they settled.

    ``propagations`` are the labels that the last sweep changed: 0 once settled; None for rounds that did not settle.
    """

    labels: DataFrame
    iterations: int
    converged: bool
    propagations: int | None

    @property
    def components(self) -> Column:
        """The number of components, as an aggregate over ``labels``.

        Once settled each has one node of its own id, so no table of components is kept.
        """
        return F.count_if(F.col("node") == F.col("component")) if self.converged else F.count_distinct("component")


class _MinLabel(Program):
    """Labels along links, both ways.

    Partitions are dealt by the number of rows, not by adaptive execution, so a task's memory does not grow with them.
    Links are dealt by source once; a sweep streams them past a hash table of its partition's moved labels, then deals
    what arrives by node. Nodes with over HEAVY links are dealt to lanes in both.
    """

    def __init__(self, edges: DataFrame, num_nodes: int):
        spark = edges.sparkSession
        ends = edges.select(F.least("src", "dst").cast("long").alias("u"), F.greatest("src", "dst").cast("long").alias("v")).where("u <> v")
        self.n, self.given = num_nodes, cut(ends, "links")
        self.parts = parts_of(spark, 2 * self.given.count() + num_nodes) or spark.sparkContext.defaultParallelism
        pairs = self.given.repartition(self.parts, "u", "v").distinct()
        ways = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
        self.links = pairs.select(F.inline(ways)).repartition(self.parts, "src").persist(StorageLevel.DISK_ONLY)
        degrees = self.links.groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") > HEAVY)
        self.heavy = cut(degrees.select("src", F.ceil(F.col("degree") / HEAVY).cast("int").alias("lanes")), "heavy")
        self.laned = self.heavy.count() > 0
        if self.laned:
            to = self.heavy.select(F.col("src").alias("dst"), F.col("lanes").alias("dst_lanes"))
            lane = lambda lanes, other: F.coalesce(F.pmod(F.xxhash64(other), F.col(lanes)), F.lit(0)).cast("int")
            dealt = self.links.join(F.broadcast(self.heavy), "src", "left").join(F.broadcast(to), "dst", "left").select("src", "dst", lane("lanes", "dst").alias("lane"), lane("dst_lanes", "src").alias("dst_lane"))
            plain, self.links = self.links, dealt.repartition(self.parts, "src", "lane").persist(StorageLevel.DISK_ONLY)
            self.links.count()
            plain.unpersist()

    def release(self) -> None:
        self.links.unpersist()
        drop_table(self.given)
        drop_table(self.heavy)

    def init(self) -> DataFrame:
        return self.given.sparkSession.range(self.n).select(F.col("id").alias("node"), F.col("id").alias("component"), F.lit(True).alias("moved"))

    def step(self, state: DataFrame) -> DataFrame:
        # A label that did not move was heard before.
        told = state.where("moved").select(F.col("node").alias("src"), F.col("component").alias("heard"))
        if self.laned:
            lanes = F.sequence(F.lit(0), F.coalesce("lanes", F.lit(1)) - 1)
            told = told.join(F.broadcast(self.heavy), "src", "left").select("src", "heard", F.explode(lanes).alias("lane"))
            joined = self.links.join(told.repartition(self.parts, "src", "lane").hint("shuffle_hash"), ["src", "lane"])
            arrived = joined.select(F.col("dst").alias("node"), "dst_lane", "heard").repartition(self.parts, "node", "dst_lane").groupBy("node", "dst_lane").agg(F.min("heard").alias("heard"))
        else:
            arrived = self.links.join(told.repartition(self.parts, "src").hint("shuffle_hash"), "src").select(F.col("dst").alias("node"), "heard")
        none = F.lit(None).cast("long")
        rows = arrived.select("node", "heard", none.alias("component")).union(state.select("node", none.alias("heard"), "component"))
        met = rows.repartition(self.parts, "node").groupBy("node").agg(F.min("heard").alias("heard"), F.max("component").alias("component")).where("component is not null")
        new = F.least("heard", "component")
        return met.select("node", new.alias("component"), (new < F.col("component")).alias("moved"))

    def metrics(self) -> dict[str, Column]:
        return {"propagations": F.sum(F.col("moved").cast("long"))}

    def stop(self, iteration: int, metrics: dict) -> bool:
        return not metrics["propagations"]


def connected_components(edges: DataFrame, num_nodes: int, method: str = "star", max_iterations: int = 100) -> Labelled:
    """Component of every node, isolated ones included.

    ``star`` contracts neighbourhoods and needs logarithmically many rounds; ``min_label`` passes
    labels along links and needs as many sweeps as the longest shortest path, capped
    by ``max_iterations``. Settled labels are the same.
    """
    if method == "min_label":
        program = _MinLabel(edges, num_nodes)
        try:
            r = run(program, max_iterations)
        finally:
            program.release()
        changed = (r.history[-1]["propagations"] or 0) if r.history else None
        return Labelled(r.state.select("node", "component"), r.iterations, changed == 0, changed)
    if method != "star":
        raise ValueError(f"unknown method {method!r}")
    nodes = edges.sparkSession.range(num_nodes).select(F.col("id").alias("node"))
    found = star_rounds(edges, "src", "dst", max_iterations)
    labels = nodes.join(found.labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return Labelled(labels, found.rounds, found.converged, 0 if found.converged else None)


def num_components(labels: DataFrame) -> int:
    return labels.select("component").distinct().count()


def component_sizes(labels: DataFrame) -> DataFrame:
    """(component, size)."""
    return labels.groupBy("component").agg(F.count("*").alias("size"))
