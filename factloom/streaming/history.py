"""Run records as a stream: an append-only history that drops repeated ids, and the current runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RUN = "kind string, run_id string, generated_at timestamp, selected long, cached long, failed long"


def run_stream(spark: SparkSession, folder: str, schema: str = RUN) -> DataFrame:
    """New JSON records of a folder."""
    return spark.readStream.schema(schema).json(folder)


def deduplicated(runs: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each run once, within the lateness."""
    return runs.withWatermark("generated_at", lateness).dropDuplicatesWithinWatermark(["kind", "run_id"])


def windowed_counts(events: DataFrame, time: str, window: str, lateness: str, *by: str) -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def append_history(runs: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, all that is there and no more."""
    return runs.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current_runs(history: DataFrame) -> DataFrame:
    """The last run of each kind."""
    return history.groupBy("kind").agg(F.max_by(F.struct("run_id", "generated_at", "selected", "cached", "failed"), F.struct("generated_at", "run_id")).alias("r")).select("kind", "r.*")
