"""Numbering, running sums and neighbours in very large groups.

A window over one hot key runs in a single task. These operators cut every
group into ordered chunks, work inside the chunks in parallel, and carry the
chunk totals (one row per chunk) across. ``chunk`` is a column that never
decreases along the order; ties in it must be whole, which any function of the
leading order column gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage

_CHUNK = "__chunk"


def _per_key(keys: list[str]):
    """Chunk rows are few; without keys they are ordered in one small partition."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(_CHUNK)


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, chunk: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, excluding the row itself."""
    cut = df.withColumn(_CHUNK, chunk).withColumn("__value", value)
    before = (
        cut.groupBy(*keys, _CHUNK)
        .agg(F.sum("__value").alias("__sum"))
        .withColumn(
            "__base",
            F.coalesce(F.sum("__sum").over(_per_key(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("__sum")
    )
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .join(before, [*keys, _CHUNK])
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop(_CHUNK, "__value", "__inside", "__base")
    )


def position(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, out: str) -> DataFrame:
    """Place of every row in its group, from 1. ``order`` must be total."""
    cut = df.withColumn(_CHUNK, chunk)
    before = (
        cut.groupBy(*keys, _CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__base",
            F.coalesce(F.sum("__n").over(_per_key(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("__n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, _CHUNK).orderBy(*order))
    return (
        cut.withColumn("__inside", inside)
        .join(before, [*keys, _CHUNK])
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop(_CHUNK, "__inside", "__base")
    )


def position_of_all(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Place of every row in the order of the whole table, from 1. ``order`` must be total.

    Rows are dealt out by ranges of the order and numbered inside each range;
    the rows of the ranges before, one number per task, are carried across. The
    sorted table is written once, since sampled ranges may differ between runs.
    """
    sorted_rows = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    )
    task = F.shiftright("__mid", 33)
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sorted_rows.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    bases = ranges.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range
    joined = sorted_rows.withColumn("__task", task).join(F.broadcast(bases), "__task")
    return joined.withColumn(out, F.col("__base") + inside + 1).drop("__mid", "__task", "__base")


def next_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, out: str
) -> DataFrame:
    """``value`` of the following row of the group, null on the last row."""
    cut = df.withColumn(_CHUNK, chunk)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    first = F.min(F.struct(*order, F.col(value).alias("__v")))
    following = (
        cut.groupBy(*keys, _CHUNK)
        .agg(first.alias("__first"))
        .withColumn("__next", F.lead("__first").over(_per_key(keys))["__v"])
        .drop("__first")
    )
    last = F.lead(F.lit(True)).over(inside).isNull()
    return (
        cut.withColumn("__inside", F.lead(value).over(inside))
        .withColumn("__last", last)
        .join(following, [*keys, _CHUNK])
        .withColumn(out, F.when(F.col("__last"), F.col("__next")).otherwise(F.col("__inside")))
        .drop(_CHUNK, "__inside", "__last", "__next")
    )


def islands(df: DataFrame, keys: list[str], number: str, gap: int, out: str) -> DataFrame:
    """Number the runs of ``number`` whose neighbours are at most ``gap`` apart.

    For groups that come from one document row, which bounds their size.
    """
    w = Window.partitionBy(*keys).orderBy(number)
    opens = F.when(F.col(number) - F.lag(number).over(w) <= gap, 0).otherwise(1)
    marked = df.withColumn("__opens", opens)
    return marked.withColumn(out, F.sum("__opens").over(w)).drop("__opens")


def ranges(df: DataFrame, keys: list[str], number: str, out: str = "ranges") -> DataFrame:
    """Consecutive numbers written as ``a-b``, single ones as ``a``, one text per group."""
    runs = (
        islands(df.select(*keys, number).distinct(), keys, number, 1, "__run")
        .groupBy(*keys, "__run")
        .agg(F.min(number).alias("a"), F.max(number).alias("b"))
    )
    written = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(
        F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    )
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", written.alias("t")))).alias("r"))
    return listed.select(*keys, F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias(out))
