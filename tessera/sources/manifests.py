"""Manifests of staged uploads: what was staged, loaded and chunked, as a table that outlives the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("staged", "loaded", "chunked", "payload")


class Manifest:
    """Entries (JSON strings) by state under a path; putting a state replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _check(self, state: str) -> str:
        if state not in STATES:
            raise ValueError(f"unknown state {state}; one of {STATES}")
        return f"{self.path}/{state}"

    def put(self, state: str, entries: DataFrame) -> None:
        """Entries are rows of any columns; each is kept as JSON with its place in the order of these."""
        entries.select(F.to_json(F.struct("*")).alias("entry")).write.mode("overwrite").parquet(self._check(state))

    def get(self, state: str, schema: str) -> DataFrame:
        """Entries of a state; none if it was never put or was cleared."""
        path = self._check(state)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema("entry string").parquet(path).select(F.from_json("entry", schema).alias("e")).select("e.*")

    def clear(self, state: str | None = None) -> None:
        for s in [state] if state else STATES:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self._check(s))
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
