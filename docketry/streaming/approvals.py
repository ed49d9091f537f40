"""Single-use approvals as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from docketry import fixed_values as fv
from docketry.operators.joining import shuffled
from docketry.streaming.progress import query_id

LEDGER_BUCKETS = 64


def applied_tokens(
    previews: DataFrame, applies: DataFrame, minutes: int = fv.TOKEN_MINUTES, lateness: str = "1 hour"
) -> DataFrame:
    """Tokens that were applied within their life, each once.

    Watermarks on both sides bound the join state: a preview is kept for its
    life plus the lateness, and the once-only state for the lateness.
    """
    p = previews.select(F.col("token").alias("p_token"), F.col("ts").alias("issued")).withWatermark("issued", lateness)
    a = applies.select("apply_id", "token", F.col("ts").alias("applied_at")).withWatermark("applied_at", lateness)
    joined = a.join(
        p,
        (F.col("token") == F.col("p_token"))
        & (F.col("applied_at") >= F.col("issued"))
        & (F.col("applied_at") <= F.col("issued") + F.expr(f"interval {minutes} minutes")),
    )
    # Only one event time may reach the deduplication, so the preview's time goes on as a plain value.
    plain = F.timestamp_micros(F.unix_micros("issued")).alias("issued")
    return joined.select("token", plain, "applied_at").dropDuplicatesWithinWatermark(["token"])


def applies_with_previews(
    previews: DataFrame, applies: DataFrame, minutes: int = fv.TOKEN_MINUTES, lateness: str = "1 hour"
) -> DataFrame:
    """Every apply with the time of the preview it meets; null for expired and unknown ones.

    The outer rows appear once the watermark shows that no preview can come.
    """
    p = previews.select(F.col("token").alias("p_token"), F.col("ts").alias("issued")).withWatermark("issued", lateness)
    a = applies.select("apply_id", "token", F.col("ts").alias("applied_at")).withWatermark("applied_at", lateness)
    return a.join(
        p,
        (F.col("token") == F.col("p_token"))
        & (F.col("applied_at") >= F.col("issued"))
        & (F.col("applied_at") <= F.col("issued") + F.expr(f"interval {minutes} minutes")),
        "left_outer",
    ).select("apply_id", "token", "applied_at", "issued")


ROCKS_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """State that grows with the tokens is kept in the RocksDB store; queries started inside use it, others keep what is set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _millis(micros: int) -> int:
    """The millisecond that ends at ``micros`` or after it, in which timers are set."""
    return -(-micros // 1000)


TOKEN_BUCKETS = 1024
TOKEN_STATE = "tokens array<string>, issued array<long>, spent array<boolean>, waiting array<struct<at:long,apply_id:long,token:string>>"


def _token_outcomes(minutes: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """Judges the tokens of one bucket: when each was issued, whether it is spent, and the applies that still wait for the watermark.

    An apply is judged when the watermark has passed it, so that everything earlier is there and it
    is taken in its order; one without a time at once. What stays is a time and a mark for each token that was issued, since it may be applied
    at any time after. A bucket's state comes and goes with its rows, once a batch, not in a call a token.
    """
    life = minutes * 60_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, times, marks, waiting = state.get if state.exists else ([], [], [], [])
        issued, spent = dict(zip(tokens, times, strict=True)), {t for t, used in zip(tokens, marks, strict=True) if used}
        every = [(w[0], w[1], w[2]) for w in waiting]
        out = []
        if not state.hasTimedOut:
            for frame in frames:
                for token, at, apply_id, timed, applies in zip(*(frame[c].tolist() for c in ("token", "at", "apply_id", "timed", "applies")), strict=True):
                    if applies and timed:
                        every.append((at, apply_id, token))
                    elif applies:
                        out.append((apply_id, token, None, "unknown or used"))
                    elif timed and at < issued.get(token, at + 1):
                        issued[token] = at
        until, rest = state.getCurrentWatermarkMs(), []
        for at, apply_id, token in sorted(every, key=lambda w: w[:2]):
            if _millis(at) > until:
                rest.append((at, apply_id, token))
                continue
            outcome = "unknown or used"
            if token in issued and at >= issued[token] and token not in spent:
                outcome = "applied" if at <= issued[token] + life else "expired"
                spent.add(token)
            out.append((apply_id, token, at, outcome))
        if issued or rest:
            state.update((list(issued), list(issued.values()), [t in spent for t in issued], rest))
            if rest:
                state.setTimeoutTimestamp(_millis(rest[0][0]))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["apply_id", "token", "at", "outcome"])
            yield frame.astype({"at": "Int64"})

    return run


def apply_outcomes(
    previews: DataFrame, applies: DataFrame, minutes: int = fv.TOKEN_MINUTES, lateness: str = "1 hour", buckets: int = TOKEN_BUCKETS
) -> DataFrame:
    """Every apply once, as ``applied``, ``expired`` or ``unknown or used``: the stream of ``ledger.judged_applies``.

    ``previews(token, ts)``, ``applies(apply_id, token, ts)`` as streams. An apply comes out when the watermark has passed
    it; rows later than ``lateness`` are not judged. Tokens share ``buckets`` states, which a query keeps from its start
    on; a batch reads and writes those of its own tokens. Start the query inside ``timed_state``.
    """
    none = F.lit(None).cast("long").alias("apply_id")
    rows = previews.select("token", "ts", none).unionByName(applies.select("token", "ts", F.col("apply_id").cast("long").alias("apply_id")))
    timed = rows.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    # nulls would make the columns floating ones in pandas
    plain = timed.select(
        F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket"), "token", "ts", F.coalesce("at", F.lit(0)).alias("at"),
        F.coalesce("apply_id", F.lit(0)).alias("apply_id"), F.col("at").isNotNull().alias("timed"), F.col("apply_id").isNotNull().alias("applies"),
    )
    judged = plain.groupBy("bucket").applyInPandasWithState(
        _token_outcomes(minutes), "apply_id long, token string, at long, outcome string", TOKEN_STATE, "append", "EventTimeTimeout"
    )
    return judged.select("apply_id", "token", F.timestamp_micros("at").alias("ts"), "outcome")


LEDGER_SHAPE = "code_a string, code_b string, doc_id long, units array<int>, ts timestamp, confirm_id long"


def record_confirms(confirms: DataFrame, issued: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Write the first confirmation of every issued code pair to ``ledger``; reuse is refused for good.

    A code may come back at any time, so what was used is kept in a table and
    not in stream state. Each micro-batch reduces its codes to their first use,
    drops those that any other batch of any run recorded, and writes one folder
    named by run and batch: a batch that runs again replaces its own folder and
    no other. The run is the id that the query keeps in its checkpoint, so a query that starts over, at the same
    path too, never replaces what an earlier one recorded. Codes are filed in buckets, and a batch
    reads only the buckets of its own codes. Queries that run at the same moment may both write a code;
    ``recorded_confirms`` counts the first.
    """
    spark = confirms.sparkSession
    known = issued.select("code_a", "code_b", "doc_id", "units")
    bucket = F.pmod(F.crc32(F.col("code_a").cast("binary")), F.lit(LEDGER_BUCKETS)).cast("int")
    # so that there is something to read from the start; written by whoever comes first
    spark.createDataFrame([], LEDGER_SHAPE + ", bucket int").write.mode("ignore").partitionBy("bucket").parquet(f"{ledger}/run=none/batch_id=-1")

    def record(batch: DataFrame, batch_id: int) -> None:
        run = query_id(batch.sparkSession, checkpoint)
        first = batch.groupBy("code_a", "code_b").agg(F.min(F.struct("ts", "confirm_id")).alias("m")).select("code_a", "code_b", "m.*")
        first = first.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS
        used = batch.sparkSession.read.schema(LEDGER_SHAPE + ", run string, batch_id long, bucket int").parquet(ledger)
        others = used.filter(F.col("bucket").isin(*touched) & ~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
        fresh = first.join(known, ["code_a", "code_b"]).join(
            shuffled(others.select("code_a", "code_b")), ["code_a", "code_b"], "left_anti"
        )
        columns = ["code_a", "code_b", "doc_id", "units", "ts", "confirm_id", "bucket"]
        fresh.select(*columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{ledger}/run={run}/batch_id={batch_id}")

    query = (
        confirms.writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def recorded_confirms(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's code pairs, each once: of one that two queries wrote at the same moment the first use counts."""
    rows = spark.read.schema(LEDGER_SHAPE + ", run string, batch_id long, bucket int").parquet(ledger)
    rest = ["doc_id", "units"]
    first = rows.groupBy("code_a", "code_b").agg(F.min(F.struct("ts", "confirm_id", "run", "batch_id", *rest)).alias("m"))
    return first.select("code_a", "code_b", *[f"m.{c}" for c in (*rest, "ts", "confirm_id")])
