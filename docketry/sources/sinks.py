"""Append-only logs and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "time timestamp, action string, applied boolean, user string, result string"


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to a log of JSON lines; earlier files are never touched."""
    entries.select("time", "action", "applied", "user", "result").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def write_report(report: DataFrame, path: str, run_date: Column) -> None:
    """One folder per run date, so a reader of one run reads one folder."""
    report.withColumn("run_date", run_date).write.mode("append").partitionBy("run_date").json(path)


def read_report(spark: SparkSession, path: str, schema: str, run_date: str) -> DataFrame:
    read = spark.read.schema(schema + ", run_date date").json(path)
    return read.filter(F.col("run_date") == F.to_date(F.lit(run_date))).drop("run_date")
