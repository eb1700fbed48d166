"""A driver loop for iterative programs: each superstep is one Spark job.

A program gives an initial state and a step that returns the next state with metric
columns. A step's state is written to the shared folder, which cuts lineage, and its metrics
are observed during that write, so an iteration needs no second job. Of earlier states only the last is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation

from ..storage import delete_path, fresh_path


class Program:
    """Hooks of an iterative program; subclasses set what they need."""

    def init(self) -> DataFrame:
        """The state before the first superstep."""
        raise NotImplementedError

    def step(self, state: DataFrame) -> DataFrame:
        """The next state."""
        raise NotImplementedError

    def metrics(self) -> dict[str, Column]:
        """Aggregates over the next state that ``stop`` looks at."""
        return {}

    def stop(self, iteration: int, metrics: dict) -> bool:
        """Whether to end after this superstep; by default after the first."""
        return True


@dataclass
class Result:
    """The last state, the number of supersteps and the metrics of each."""

    state: DataFrame
    iterations: int
    history: list[dict] = field(default_factory=list)


def _settle(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, dict, str]:
    spark = df.sparkSession
    path = fresh_path(spark, "state")
    if metrics:
        seen = Observation()
        df.observe(seen, *(c.alias(k) for k, c in metrics.items())).write.parquet(path)
        found = seen.get
    else:
        df.write.parquet(path)
        found = {}
    return spark.read.schema(df.schema).parquet(path), found, path


def run(program: Program, max_iterations: int) -> Result:
    """Supersteps until ``stop`` or ``max_iterations``."""
    state, _, path = _settle(program.init(), {})
    history: list[dict] = []
    for i in range(1, max_iterations + 1):
        new, found, written = _settle(program.step(state), program.metrics())
        delete_path(new.sparkSession, path)
        state, path = new, written
        history.append(found)
        if program.stop(i, found):
            break
    return Result(state, len(history), history)
