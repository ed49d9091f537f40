import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents with extra columns that clash with names the operators use."""

    def make(rows, extra=True):
        full = [(i, t, "en" if len(r) < 1 else r[0], "s" if len(r) < 2 else r[1], len(t or "")) for i, t, *r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "kept", "size", "row", "sha", "unit", "t", "label", "hashes", "score", "shard", "members", "quality", "digest", "w", "rate"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make

