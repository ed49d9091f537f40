"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD_PATTERN, unused, written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words, as a fraction of whole numbers
MOST = 2  # times a source's words
SEED = 17


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """Words wanted of every source: ``source, source_size, target, rate``.

    ``sized`` has ``source`` and ``size``. Sources in code point order, null last,
    take the weights in turn and share ``share`` of all words; a source stops at
    ``most`` times its words, and what it leaves is shared by the others. Sources are
    filled in the order in which they reach their limit, so the ones at their limit
    come first and one pass of running sums settles all. All comparisons are on whole
    numbers. One row per source, so the running sums see only as many rows as there
    are sources. A source without words gets rate 0.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.array(*[F.lit(w) for w in weights])
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(named))
        .withColumn("w", F.element_at(n, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy((F.col("source_size") * most / F.col("w")), "place")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole, up, down = F.sum("source_size").over(everything), share[0], share[1]
    filled = (
        sources.withColumn("wanted", whole * up)
        .withColumn("left_words", F.col("wanted") - down * most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0)))
        .withColumn("stops", down * most * F.col("source_size") * F.col("left_w") <= F.col("w") * F.col("left_words"))
    )
    stopped = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(0)).over(everything)
    rest = (
        filled.withColumn("rest_words", F.col("wanted") - down * most * stopped("source_size"))
        .withColumn("rest_w", F.sum("w").over(everything) - stopped("w"))
    )
    shared = (F.col("w") * F.col("rest_words")).cast("double") / (F.col("rest_w") * down).cast("double")
    target = F.when(F.col("stops"), (F.col("source_size") * most).cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rest.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def coin(id_column: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, id_column: Column, seed: int = SEED) -> Column:
    """Whole repetitions, plus one more with the probability of the fraction."""
    whole = F.floor(rate)
    return whole + F.when(coin(id_column, seed) < rate - whole, 1).otherwise(0)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **limits
) -> DataFrame:
    """What the mix takes of every row: ``doc_id, size, source_size, target, copies, taken``.

    A null text has no words; a null source is a source of its own; rows with equal
    ids get the same coin, repeated rows each count. Other columns are ignored, an
    empty table gives an empty plan. Sizes are counted once and kept; the table of
    sources is copied to the tasks only if it is as small as the optimizer's limit.
    """
    sized = written(_sized(docs, id_col, text_col, source_col), "sizes")
    targets = written(source_targets(sized, **limits), "targets")
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    taken = joined.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed).cast("long"))
    return taken.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **limits
) -> DataFrame:
    """The mix itself: every row of ``docs``, with its columns, as often as the plan takes it.

    Null texts, null sources, equal ids and repeated rows as in ``mix_plan``; an empty table gives an empty mix.
    """
    out = docs.columns
    of_source, rate, copy = (unused(docs, name) for name in ("rated_source", "rate_of_source", "copy"))
    sized = _sized(docs, id_col, text_col, source_col).select("source", "size")
    rates = written(source_targets(sized, **limits), "targets").select(F.col("source").alias(of_source), F.col("rate").alias(rate))
    joined = docs.join(rates, docs[source_col].eqNullSafe(F.col(of_source)))
    n = copies(F.col(rate), docs[id_col], seed).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n))).select(*[docs[c] for c in out])
