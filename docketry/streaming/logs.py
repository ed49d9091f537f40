"""The append-only run log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.sources.sinks import LOG_SCHEMA
from docketry.streaming.progress import query_id


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New log entries as they are appended."""
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def runs_per_day(log: DataFrame) -> DataFrame:
    """Applied and planned runs per day and action, from the log rows that have landed.

    The stream lands every row; days are counted from the landed table, so the
    last days are there too and a late row only changes its own day.
    """
    return (
        log.groupBy(F.window("time", "1 day").alias("day"), "action")
        .agg(F.count(F.lit(1)).alias("runs"), F.count_if("applied").alias("applied"))
        .select(F.col("day.start").alias("day"), "action", "runs", "applied")
    )


def keep_totals(log: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Runs per day and action as they grow: a new log file costs its own rows.

    The running totals are the query's state. A micro-batch writes the totals that changed into a folder of its own,
    named by the query's id and the batch, which a repeated batch replaces.
    """
    spark = log.sparkSession
    totals = log.groupBy(F.window("time", "1 day").alias("day"), "action").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("applied").alias("applied")
    ).select(F.col("day.start").alias("day"), "action", "runs", "applied")

    def write(batch: DataFrame, batch_id: int) -> None:
        run = query_id(batch.sparkSession, checkpoint)
        batch.withColumn("written", F.current_timestamp()).write.mode("overwrite").parquet(f"{store}/run={run}/batch_id={batch_id}")

    query = (
        totals.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_totals(spark: SparkSession, store: str) -> DataFrame:
    """The newest totals of every day and action, of the query that wrote last; one that starts over counts anew."""
    rows = spark.read.schema("day timestamp, action string, runs long, applied long, written timestamp, run string, batch_id long").parquet(store)
    last = rows.agg(F.max_by("run", "written").alias("run"))
    newest = rows.join(last, "run", "left_semi").groupBy("day", "action").agg(F.max(F.struct("batch_id", "runs", "applied")).alias("m"))
    return newest.select("day", "action", "m.runs", "m.applied")
