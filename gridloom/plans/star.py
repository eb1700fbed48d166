"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014): both
steps rewire edges towards the smallest node of a neighbourhood, so that each
component ends as one star around its smallest node. The number of rounds grows
with the logarithm of the component size and not with its diameter.

A step is an aggregation (least neighbour of each node) joined back to the edges. A hub's
edges are partial rows in the aggregation; in the join they would be one partition, and the
aggregated side's partitioning would keep adaptive execution from splitting it. The join
is therefore on an expression of the node, for which Spark shuffles both sides anew, and
such partitions are split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import cut, delete_path, drop_table, fresh_path


@dataclass
class Starred:
    """labels (node, component) of the touched nodes, the number of rounds, and whether the last changed nothing."""

    labels: DataFrame
    rounds: int
    converged: bool


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with m, their u's least; both sides are shuffled, so that skew is split."""
    key = F.bitwise_not("u")
    return edges.withColumn("k", key).join(least.select(key.alias("k"), "m"), "k").drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def star_rounds(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> Starred:
    """Components of an undirected edge list: one row (node, component) per touched node.

    ``component`` is the least node reachable. Self-loops give a node its own
    component; rows with a null end are ignored; an empty list gives no rows. The
    edge list of each round is a table in the shared folder; the driver sees a count
    and a checksum only. After ``max_rounds`` rounds the labels are what was reached.
    """
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    touched = cut(pairs.distinct(), "edges")
    now, last, old, converged, n = touched.where("u <> v"), None, None, False, 0
    spark = edges.sparkSession
    while n < max_rounds and not converged:
        n += 1
        step, seen, path = _small_star(_large_star(now)), Observation(), fresh_path(spark, "star")
        # The count and the checksum are taken while the round is written.
        step.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")).write.parquet(path)
        now, mark = spark.read.schema(step.schema).parquet(path), (seen.get["n"], seen.get["mark"])
        if old is not None:
            delete_path(spark, old)
        old, converged, last = path, mark == last, mark
    nodes = touched.select(F.col("u").alias("node")).union(touched.select(F.col("v").alias("node"))).distinct()
    labels = cut(nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    drop_table(touched)
    if old is not None:
        delete_path(spark, old)
    return Starred(labels, n, converged)


def star_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> DataFrame:
    """The labels of :func:`star_rounds`; RuntimeError if they did not settle in ``max_rounds`` rounds."""
    found = star_rounds(edges, u, v, max_rounds)
    if not found.converged:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return found.labels
