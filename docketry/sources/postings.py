"""Posting tables: which texts hold a run of characters, so that a search opens a few buckets and not the corpus."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BUCKETS = 256
SALTS = 8  # files that a bucket is spread over
RUNS_AT_ONCE = 1_000_000  # runs of texts that are gathered before they are passed on, about


def _bucket(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def grams_of(phrase: str, size: int = GRAM) -> list[str]:
    """The distinct runs of ``size`` characters of a phrase; none if it is shorter."""
    return sorted({phrase[k : k + size] for k in range(len(phrase) - size + 1)})


def _held_runs(texts: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """``gram, held``: the distinct runs of the texts, each with the keys of a stretch of texts that hold it.

    A text is read once from its start; a substring by its place would count its characters from the start for every run.
    """
    plain = texts.filter(F.length(text) >= size).select(F.struct(*keys).alias("own"), F.col(text).alias("t"))

    def packed(own: pa.Array, held: dict[str, list[int]]) -> pa.RecordBatch:
        limits = pa.array(accumulate(map(len, held.values()), initial=0), pa.int32())
        rows = own.take(pa.array([k for at in held.values() for k in at], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.ListArray.from_arrays(limits, rows)], ["gram", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = defaultdict(list), 0
            for k, t in enumerate(batch.column(1)):
                whole = t.as_py()
                runs = {whole[i : i + size] for i in range(len(whole) - size + 1)}
                for gram in runs:
                    held[gram].append(k)
                n += len(runs)
                if n >= RUNS_AT_ONCE:
                    yield packed(batch.column(0), held)
                    held, n = defaultdict(list), 0
            if held:
                yield packed(batch.column(0), held)

    return plain.mapInArrow(run, f"gram string, held array<{plain.schema['own'].dataType.simpleString()}>")


def write_postings(texts: DataFrame, keys: list[str], text: str, path: str, size: int = GRAM, buckets: int = BUCKETS) -> None:
    """Rows ``(gram, held)``, filed by the run: every distinct run of ``size`` characters with the keys of texts that hold it.

    Null and short texts have none. A run has a row for every stretch of texts that were read together, and
    a frequent run's rows are dealt over several files.
    """
    filed = _held_runs(texts, keys, text, size).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filed.repartition(tasks, "bucket", F.pmod(F.xxhash64(F.get("held", F.lit(0))), F.lit(SALTS)))
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def holding(spark: SparkSession, path: str, keys: list[str], phrase: str, size: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """Keys of the texts that hold all runs of ``phrase``; whether they hold the phrase itself is still to be checked."""
    wanted = grams_of(phrase, size)
    if not wanted:
        raise ValueError(f"a phrase needs {size} characters to be looked up; search the texts for a shorter one")
    rows = spark.read.parquet(path).filter(F.col("bucket").isin(*sorted({_bucket(g, buckets) for g in wanted})) & F.col("gram").isin(*wanted))
    each = rows.select("gram", F.explode("held").alias("own")).select("gram", "own.*")
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select(*keys)


def texts_with(spark: SparkSession, path: str, texts: DataFrame, keys: list[str], text: str, phrase: str, **how) -> DataFrame:
    """The rows of ``texts`` that hold ``phrase``: candidates from the postings, then the exact check."""
    candidates = holding(spark, path, keys, phrase, **how)
    return texts.join(candidates, keys, "left_semi").filter(F.contains(F.col(text), F.lit(phrase)))
