"""Shards cut along a Hilbert curve through metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import written

BITS = 5  # of every dimension; a cell is one of 2 ** (bits * dimensions)


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place along the Hilbert curve of a cell whose coordinates have ``bits`` bits each.

    Skilling's transposition: from the highest bit down, a coordinate with the bit set
    inverts the lower bits of the first coordinate, one without swaps them; a Gray
    decoding follows, and the bits are read out in turn.
    """
    n = len(coordinates)
    state = F.array(*[c.cast("long") for c in coordinates])
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(k).alias("k")) for q in range(bits - 1, 0, -1) for k in range(n)])

    def turn(x: Column, step: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), step["q"])
        low = bit - 1
        own, head = F.get(x, step["k"]), F.get(x, F.lit(0))
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        flipped = F.transform(x, lambda v, i: F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(
            x, lambda v, i: F.when((i == 0) | (i == step["k"]), v.bitwiseXOR(swap)).otherwise(v)
        )
        same = F.when(step["k"] == 0, x).otherwise(swapped)
        return F.when(own.bitwiseAND(bit) != 0, flipped).otherwise(same)

    turned = F.aggregate(steps, state, turn)
    gray = F.transform(turned, lambda v, i: F.aggregate(F.slice(turned, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))

    def settle(x: Column) -> Column:
        tail = F.get(x, F.lit(n - 1))
        correction = F.aggregate(
            F.sequence(F.lit(bits - 1), F.lit(1)) if bits > 1 else F.array().cast("array<int>"),
            F.lit(0).cast("long"),
            lambda t, q: F.when(
                tail.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), q)) != 0,
                t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), q) - 1),
            ).otherwise(t),
        )
        return F.transform(x, lambda v: v.bitwiseXOR(correction))

    reads = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(k).alias("k")) for q in range(bits - 1, -1, -1) for k in range(n)])
    # a one-element array carries the settled coordinates through, so they are worked out once
    return F.element_at(
        F.transform(
            F.transform(F.array(gray), settle),
            lambda x: F.aggregate(
                reads, F.lit(0).cast("long"),
                lambda out, r: out * 2 + F.call_function("shiftright", F.get(x, r["k"]), r["q"]).bitwiseAND(F.lit(1).cast("long")),
            ),
        ),
        1,
    )


def ranked(rows: DataFrame, name: str, tasks: int) -> DataFrame:
    """``value, ordinal`` of every distinct value of a text column: how many rows of the table lie before it.

    The order is that of whole values. Counts per value are sorted in ranges, and every range adds the rows of those before it.
    """
    counted = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sorted_counts = written(
        counted.repartitionByRange(tasks, "value").sortWithinPartitions("value").withColumn("task", F.spark_partition_id()), "values"
    )
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sorted_counts.groupBy("task").agg(F.sum("n").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("task").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    placed = sorted_counts.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(bases), "task")
    return written(placed.select("value", (F.col("base") + F.col("lower")).cast("double").alias("ordinal")), "ordinals")


def cut_points(df: DataFrame, names: list[str], bits: int) -> list[list[float]]:
    """Equal-share limits of every column, at most ``2 ** bits - 1`` each, from all rows."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(c, shares, 1 << (bits + 5)).alias(c) for c in names]).first()
    return [sorted(set(row[c] or [])) for c in names]


def cell(column: Column, limits: list[float]) -> Column:
    """How many limits lie at or below the value; nulls take cell 0."""
    hits = [F.when(column >= F.lit(x), 1).otherwise(0) for x in limits]
    return reduce(lambda a, b: a + b, hits, F.lit(0)).cast("long")


def hilbert_shards(
    docs: DataFrame, shards: int = 40, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang", "size"), overhead: int = 16,
) -> DataFrame:
    """Cut the documents, sorted along the curve, into ``shards`` runs of equal row counts.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``. ``size``
    is the text's UTF-8 bytes plus ``overhead`` and can be used as a dimension. Every
    dimension is cut at its own quantiles into ``2 ** bits`` cells, so a file's range in
    each dimension is narrow. Text dimensions go by the order of their whole values, weighted by rows; the table of
    distinct values is copied to the tasks only if it is as small as the optimizer's limit. Ties along the curve are ordered by text hash and id, so
    equal texts of a cell are neighbours. Null metadata shares the first cell, a null
    text has no bytes and the hash of an empty text; repeated rows each take a slot, an
    empty table gives no rows, columns not named are ignored.

    Texts never move: the sort shuffles ids, sizes and hashes. The sorted rows are
    written once, because sampled ranges may differ between two runs; places follow
    from the rows per range, of which there are as many as tasks.
    """
    own = {"size": (F.octet_length(F.coalesce(docs[text_col], F.lit(""))) + overhead).cast("long")}
    kinds = dict(docs.dtypes)
    names = [f"m{k}" for k in range(len(dimensions))]
    taken = [own["size"].cast("double") if d == "size" else docs[d] if kinds[d] == "string" else docs[d].cast("double") for d in dimensions]
    rows = written(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"), own["size"].alias("size"),
            F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
            *[c.alias(n) for n, c in zip(names, taken, strict=True)],
        ),
        "measures",
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name in [n for n, kind in rows.dtypes if n in names and kind == "string"]:
        values = ranked(rows, name, tasks).withColumnRenamed("value", name)
        rows = rows.join(values, name, "left").drop(name).withColumnRenamed("ordinal", name)
    limits = cut_points(rows, names, bits)
    curve = hilbert_index([cell(F.col(n), x) for n, x in zip(names, limits, strict=True)], bits)
    ordered = written(
        rows.select("doc_id", "size", "text_crc32", curve.alias("curve"))
        .repartitionByRange(tasks, "curve", "text_crc32", "doc_id", F.rand(7))
        .sortWithinPartitions("curve", "text_crc32", "doc_id")
        .withColumn("at", F.monotonically_increasing_id()),
        "ordered",
    )
    task, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = (
        ordered.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
        .select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(everything).alias("total"))
    )
    # one row per range partition
    placed = ordered.withColumn("task", task).join(F.broadcast(ranges), "task").withColumn("place", F.col("base") + inside)
    shard = F.expr(f"(place * {shards}) div total")
    opens = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - opens).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder per shard, in curve order.

    Meant for ids that are unique and not null; others would meet every slot of their id.
    """
    places = plan.select(F.col("doc_id").alias("__id"), "shard", F.col("slot").alias("__slot"))
    joined = docs.drop("shard").join(places, docs[id_col] == F.col("__id")).drop("__id")
    joined.repartition("shard").sortWithinPartitions("shard", "__slot").drop("__slot").write.partitionBy("shard").parquet(path)
