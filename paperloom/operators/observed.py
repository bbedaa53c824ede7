"""Counts of a plan's stages from its own run: no stage is computed again to be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Marks stages of a plan with metrics; after an action on it, ``rows`` gives what each has seen.

    Metrics are aggregates (counts, sums, minima) that Spark gathers while rows pass by. A retried task counts once;
    a stage that a plan uses twice without a shuffle or a written table between is seen twice.
    """

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """df as it is, with n_rows and these metrics observed."""
        if any(stage == s for s, _ in self.seen):
            raise ValueError(f"two stages are named {stage}")
        watch = Observation()
        self.seen.append((stage, watch))
        return df.observe(watch, F.count(F.lit(1)).alias("n_rows"), *[m.alias(n) for n, m in metrics.items()])

    def rows(self, spark: SparkSession) -> DataFrame:
        """stage, metric, value (long; null for an empty sum), in order of the marks; waits for the first action."""
        found = [(i, s, m, None if v is None else int(v)) for i, (s, w) in enumerate(self.seen) for m, v in w.get.items()]
        return spark.createDataFrame(found, "place long, stage string, metric string, value long")
