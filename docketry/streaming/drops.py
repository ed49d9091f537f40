"""Files dropped into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry import fixed_values as fv
from docketry.sources.files import base_name, extension


def accepted_files(spark: SparkSession, folder: str, extensions: list[str] = fv.DROP_EXTENSIONS) -> DataFrame:
    """Stream of newly landed files with an accepted extension.

    The checkpoint of the writing query remembers what was handled, so files
    left from before a restart are simply the next ones. Only metadata is read.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    landed = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return landed.select(
        "path", base_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("ext"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
    ).filter(~F.startswith("filename", F.lit(".")))


def rejected_files(spark: SparkSession, folder: str, extensions: list[str] = fv.DROP_EXTENSIONS) -> DataFrame:
    """Batch listing of files with any other extension."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = extension(F.col("path"))
    return listed.filter(~ext.isin(*["." + e for e in extensions])).select(
        base_name(F.col("path")).alias("filename"), ext.alias("ext"), F.col("length").alias("size_bytes")
    )


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Handle everything that has landed, write it as parquet, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query
