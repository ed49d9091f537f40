"""How two growing sides meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the data, so that it is never copied to every task.

    Rows made by exploding texts are many times larger than the file sizes the
    optimizer estimates from; left alone it may copy such a side. A sort-merge
    join shuffles it instead, and adaptive execution splits a hot key.
    """
    return df.hint("merge")
