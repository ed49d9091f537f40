"""Tables kept in buckets of their key: a change reads and rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from docketry.session import cut_lineage

BUCKETS = 64
_PRESENT = "row_is_present"  # false in the one row a bucket always has, so that an emptied bucket is replaced too


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int").alias("bucket")


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int, written: list[int]) -> None:
    spark = rows.sparkSession
    placed = rows.select("*", bucket_of(keys, buckets), F.lit(True).alias(_PRESENT))
    marks = spark.createDataFrame([(b,) for b in written], "bucket int").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields], "bucket", F.lit(False).alias(_PRESENT)
    )
    every = placed.unionByName(marks).repartition(max(1, len(written)), "bucket")
    every.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write a new table; every bucket gets a folder."""
    _write(rows, path, keys, buckets, list(range(buckets)))


def read_keyed(spark: SparkSession, path: str, schema: StructType, only: list[int] | None = None) -> DataFrame:
    """The rows of the table, or of some of its buckets; other folders are not opened."""
    shape = StructType([*schema.fields, StructField(_PRESENT, BooleanType()), StructField("bucket", IntegerType())])
    held = spark.read.schema(shape).parquet(path)
    if only is not None:
        held = held.filter(F.col("bucket").isin(*only))
    return held.filter(_PRESENT).select(*schema.names)


def rewrite(
    spark: SparkSession, path: str, schema: StructType, keys: list[str], changed: list[DataFrame], change: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> list[int]:
    """Replace the buckets of the keys in ``changed`` by ``change`` of their rows, and return their numbers.

    ``changed`` holds the columns ``keys`` of all rows that may change or be added. The new rows are written to the
    shared folder first, so the buckets can be replaced while they are the source. A
    row that would land in another bucket stops the job before anything is replaced.
    """
    touched = sorted({r.bucket for df in changed for r in df.select(bucket_of(keys, buckets)).distinct().collect()})  # at most ``buckets``
    if not touched:
        return []
    rows = cut_lineage(change(read_keyed(spark, path, schema, touched)).select(*schema.names))
    if not rows.where(~bucket_of(keys, buckets).isin(*touched)).isEmpty():
        raise ValueError("a changed row has a key of a bucket that the changes do not name")
    _write(rows, path, keys, buckets, touched)
    return touched
