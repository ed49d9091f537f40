"""Table access."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the tables the registered queries read.
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def run_query(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run ``sql`` with every ``{name}`` replaced by the DataFrame of that name."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(sql, **tables)


def row_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Rows per table, -1 for a table that cannot be opened."""
    counted = []
    for name in names:
        try:
            rows = table(spark, folder, name).agg(F.count(F.lit(1)).alias("n_rows"))
        except AnalysisException:
            rows = spark.range(1).select(F.lit(-1).cast("long").alias("n_rows"))
        counted.append(rows.select(F.lit(name).alias("table_name"), "n_rows"))
    out = counted[0]
    for rows in counted[1:]:
        out = out.unionByName(rows)
    return out
