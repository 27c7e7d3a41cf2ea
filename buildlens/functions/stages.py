"""Times and row counts of the stages of a job, as a table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.scratch import written


class Stages:
    """Writes each stage's result, and notes how many rows it has and how long it took. Rows are counted while they are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.done = spark, []

    def run(self, name: str, df: DataFrame) -> DataFrame:
        seen, began = Observation(f"{name}-{len(self.done)}"), time.perf_counter()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.done.append((len(self.done), name, int(seen.get["rows"]), int(1000 * (time.perf_counter() - began))))
        return out

    def table(self) -> DataFrame:
        """place, stage, rows, ms."""
        return self.spark.createDataFrame(self.done, "place int, stage string, rows long, ms long")
