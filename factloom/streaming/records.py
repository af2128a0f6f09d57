"""Run records with a moving current, from a stream whose batches may come again.

Below a root stand three tables. ``history`` holds each batch in a folder of its
own, ``current`` the last run of each kind after each batch, ``ledger`` a row for
each batch that is whole. A batch writes its folders anew, whatever an earlier try
left there, and its ledger row last: readers see batches with a row alone, and a
batch that has one isn't written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.runs import hit_rate
from factloom.streaming.history import RUN, current_runs

LEDGER = "batch long, added long, known long"
CURRENT = "kind string, run_id string, generated_at timestamp, selected long, cached long, failed long"


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")


def prepare(spark: SparkSession, root: str) -> None:
    """The ledger, empty, unless it is there."""
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch, added, known) of whole batches."""
    return _table(spark, root, "ledger", LEDGER)


def _of_whole(spark: SparkSession, root: str, name: str, schema: str, last_only: bool = False) -> DataFrame:
    batches = sorted(r["batch"] for r in committed(spark, root).select("batch").collect())  # a row for each batch
    batches = batches[-1:] if last_only else batches
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{name}/{b}" for b in batches])


def history(spark: SparkSession, root: str) -> DataFrame:
    """All runs of whole batches, each once."""
    return _of_whole(spark, root, "history", RUN)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The last run of each kind, as of the last whole batch."""
    return _of_whole(spark, root, "current", CURRENT, last_only=True)


def write_batch(runs: DataFrame, batch: int, root: str, after: Callable[[str], None] = lambda step: None) -> None:
    """One batch: runs that the history hasn't, the current ones, then the ledger row. ``after`` is called with each step that is done."""
    spark = runs.sparkSession
    if not committed(spark, root).filter(F.col("batch") == batch).isEmpty():
        return
    known = history(spark, root)
    once = F.row_number().over(Window.partitionBy("kind", "run_id").orderBy(F.desc("generated_at")))
    new = runs.withColumn("_n", once).filter("_n = 1").drop("_n").join(known.select("kind", "run_id"), ["kind", "run_id"], "left_anti")
    names = known.columns
    new.select(*names).write.mode("overwrite").parquet(f"{root}/history/{batch}")
    after("history")
    added = spark.read.schema(RUN).parquet(f"{root}/history/{batch}")
    now = current_runs(current(spark, root).select(*names).unionByName(added))
    now.write.mode("overwrite").parquet(f"{root}/current/{batch}")
    after("current")
    counts = added.agg(F.lit(batch).cast("long").alias("batch"), F.count("*").alias("added")).crossJoin(runs.agg(F.count("*").alias("n")))  # one row each
    counts.select("batch", "added", (F.col("n") - F.col("added")).alias("known")).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    after("ledger")


def record(stream: DataFrame, root: str, checkpoint: str, after: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Records a stream of runs, all that is there and no more."""
    prepare(stream.sparkSession, root)
    return stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, root, after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, root: str) -> DataFrame:
    """(kind, runs, failed_runs, selected, cached, cache_hit_rate, last_run_id): what the history adds up to."""
    runs = history(spark, root)
    out = runs.groupBy("kind").agg(
        F.count("*").alias("runs"), F.count_if(F.col("failed") > 0).alias("failed_runs"), F.sum("selected").alias("selected"), F.sum("cached").alias("cached"),
        F.max_by("run_id", F.struct("generated_at", "run_id")).alias("last_run_id"),
    )
    return out.withColumn("cache_hit_rate", hit_rate(F.col("cached"), F.col("selected")))
