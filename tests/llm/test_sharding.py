import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from docketry.llm import sharding


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_once_and_moves_one_step(spark, n, bits):
    cells = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{k} long" for k in range(n)))
    rows = df.select("*", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("i")).collect()
    path = {r.i: tuple(r)[:n] for r in rows}
    assert sorted(path) == list(range(1 << (bits * n)))
    for k in range(len(path) - 1):
        assert sum(abs(a - b) for a, b in zip(path[k], path[k + 1], strict=True)) == 1


ROWS = [(k, "t" * (k * 37 % 901), ("en", "de", None)[k % 3], (None if k % 13 == 0 else f"src{k % 9}")) for k in range(1003)] + [
    (2000, None), (2001, "é" * 200_000), (None, "x"), (5, "dup"), (5, "dup"), (5, "dup"),
]


def check(rows, out, shards):
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows) and set(sizes) <= set(range(shards))
    counts = [sizes.get(k, 0) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == k) == list(range(n))
    expect = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == expect
    assert all(r.law == "rows" and r.grown_shard is None for r in out)


def test_rows_are_cut_evenly(documents):
    docs = documents(ROWS, extra=False).withColumn("shard", F.lit("x")).withColumn("curve", F.lit("x"))
    out = sharding.hilbert_shards(docs).collect()
    check(ROWS, out, 40)
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in out)


def test_few_rows_and_none(documents):
    check(ROWS[:7], sharding.hilbert_shards(documents(ROWS[:7])).collect(), 40)
    assert sharding.hilbert_shards(documents([])).count() == 0


@pytest.mark.parametrize("prefix", ["", "common_crawl_", "https://a.very.long.common.prefix/of/all/sources/"])
def test_files_hold_narrow_ranges(documents, spark, tmp_path, prefix):
    rows = [(k, "t" * (k * 37 % 901), "en", f"{prefix}src{k % 16:02d}") for k in range(2000)]
    docs = documents(rows)
    sharding.write_shards(docs, sharding.hilbert_shards(docs, shards=16, dimensions=("source", "size")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000
    spread = back.groupBy("shard").agg(F.countDistinct("source").alias("n")).agg(F.avg("n")).first()[0]
    assert spread <= 9  # of 16 sources; a cut at random has all of them


def test_values_are_ranked_whole_and_by_rows(spark):
    values = ["b"] * 5 + ["abc" * 40 + "y"] * 3 + ["abc" * 40 + "x"] * 2 + ["é"] + [None] * 4 + [""]
    rows = spark.createDataFrame([(v,) for v in values], "s string").repartition(3)
    order = sorted((v for v in values if v is not None), key=lambda v: v.encode())
    assert {r.value: r.ordinal for r in sharding.ranked(rows, "s", 3).collect()} == {v: order.index(v) for v in order}


def test_cells_are_equal_shares(documents):
    """Cut points against the sorted values themselves."""
    rows = [(k, "t" * (k * k % 977), "en", "s") for k in range(1000)]
    sizes = sorted(len(t) + 16.0 for _, t, *_ in rows)
    frame = documents(rows, extra=False).select((F.length("text") + 16).cast("double").alias("m"))
    limits = sharding.cut_points(frame, ["m"], 3)[0]
    assert len(limits) == 7
    ties = max(Counter(sizes).values())
    for k, x in enumerate(limits):  # the quantiles' rank error is one in 256, and equal sizes stay together
        assert abs(sum(s < x for s in sizes) - 125 * (k + 1)) <= 1000 / 256 + ties
    cells = frame.select("m", sharding.cell(F.col("m"), limits).alias("c")).collect()
    assert all(r.c == sum(x <= r.m for x in limits) for r in cells)
