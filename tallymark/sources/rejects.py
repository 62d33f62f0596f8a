"""Counts of the rows that a reader leaves out, taken by the job that uses the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Rejects:
    """Collects observed counts by reason.

    Pass it to a reader, run one action over the reader's rows (a write, say), then ask for the counts: they come from that
    action, so nothing is read twice. The action has to use all rows; where it is a shuffle whose lost part is computed
    again, rows of that part may count again.
    """

    def __init__(self) -> None:
        self._observed: list[Observation] = []

    def watch(self, df: DataFrame, **reasons: Column) -> DataFrame:
        """The same rows; counts those for which a condition holds. `lit(True)` counts all."""
        observation = Observation()
        self._observed.append(observation)
        return df.observe(observation, *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in reasons.items()])

    def counts(self) -> dict[str, int]:
        return {name: n for o in self._observed for name, n in o.get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.counts().items()), "reason STRING, n LONG")
