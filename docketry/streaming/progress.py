"""What a query keeps in its checkpoint."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query: a new checkpoint at the same path has another."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
