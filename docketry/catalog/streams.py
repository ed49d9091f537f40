"""Streaming jobs, each run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.catalog.joins import READING, reading_tables
from docketry.catalog.sources import _log_entries
from docketry.operators import ledger
from docketry.session import scratch_path
from docketry.sources import sinks
from docketry.sources.tables import table
from docketry.streaming import approvals, drops, logs


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream; the pattern fits a single file and a folder of that name alike."""
    schema = table(spark, d, "events").schema
    read = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def x1_file_drop(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "upload")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    for ext, langs in (("plg", ["en"]), ("skl", ["fr"]), ("zip", ["de", "es"])):
        docs.filter(F.col("lang").isin(*langs)).select("doc_id").write.mode("append").option("extension", ext).csv(root)
    out = scratch_path(spark, "landed")
    drops.drain(drops.accepted_files(spark, root, ["plg", "skl"]), out, scratch_path(spark, "landed-progress"))
    taken = spark.read.parquet(out).select("ext", "size_bytes", F.lit("accepted").alias("outcome"))
    left = drops.rejected_files(spark, root, ["plg", "skl"]).select("ext", "size_bytes", F.lit("rejected").alias("outcome"))
    return taken.unionByName(left).groupBy("ext", "outcome").agg(F.sum("size_bytes").alias("size_bytes"))


def _previews(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'view'").select(F.col("event_id").cast("string").alias("token"), "ts")


def _applies(events: DataFrame) -> DataFrame:
    """Every other event applies the token of an event shortly before it."""
    token = F.col("event_id") - 1 - F.col("event_id") % 4
    return events.filter("event_type <> 'view'").select(F.col("event_id").alias("apply_id"), token.cast("string").alias("token"), "ts")


def x2_apply_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ledger.judged_applies(_previews(e), _applies(e)).select("apply_id", "token", "outcome")


def x2_applied_tokens(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "applied")
    stream = approvals.applied_tokens(_previews(_event_stream(spark, d)), _applies(_event_stream(spark, d)))
    drops.drain(stream, out, scratch_path(spark, "applied-progress"))
    return spark.read.parquet(out).select("token", "issued")


def x2_applies_with_previews(spark: SparkSession, d: str) -> DataFrame:
    """Every apply as a stream row, with its preview or without.

    Rows without one come out once no preview can follow.
    """
    out = scratch_path(spark, "applies-with-previews")
    drops.drain(approvals.applies_with_previews(*_ended_streams(spark, d)), out, scratch_path(spark, "applies-progress"))
    return spark.read.parquet(out).filter("token <> ''").select("apply_id", "token", "issued")


def x2_outcome_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every apply judged in the stream, as ``x2_apply_outcomes`` judges it in a batch."""
    out = scratch_path(spark, "apply-outcomes")
    with approvals.timed_state(spark):
        drops.drain(approvals.apply_outcomes(*_ended_streams(spark, d)), out, scratch_path(spark, "outcomes-progress"))
    return spark.read.parquet(out).filter("token <> ''").select("apply_id", "token", "outcome")


def _ended_streams(spark: SparkSession, d: str) -> list[DataFrame]:
    """Previews and applies; a last row long after all others, with an empty token, ends the wait for what may follow."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = []
    for name, rows, ends in (("previews", _previews(events), {"token": ""}), ("applies", _applies(events), {"token": "", "apply_id": -1})):
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        last = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"))
        last.select(*[F.lit(ends[c]).cast(rows.schema[c].dataType).alias(c) if c in ends else F.col(c) for c in rows.columns]).write.mode("append").parquet(path)
        parts.append(spark.readStream.schema(rows.schema).parquet(path))
    return parts


def x3_confirm_outcomes(spark: SparkSession, d: str) -> DataFrame:
    _, issued, confirms = reading_tables(spark, d)
    return ledger.judged_confirms(issued, confirms).select("confirm_id", "code_a", "outcome")


def x3_recorded_confirms(spark: SparkSession, d: str) -> DataFrame:
    _, issued, _ = reading_tables(spark, d)
    events = _event_stream(spark, d)
    ten = F.get_json_object("props", "$.k").cast("int") % 5
    code = lambda tail: F.substring(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), ten.cast("string"), F.lit(tail))), 1, 6)
    wrong = F.col("event_type") == "error"
    confirms = events.select(
        F.col("event_id").alias("confirm_id"), "ts", code("a").alias("code_a"),
        F.when(wrong, F.reverse(code("b"))).otherwise(code("b")).alias("code_b"),
    )
    path = scratch_path(spark, "confirms")
    approvals.record_confirms(confirms, issued, path, scratch_path(spark, "confirms-progress"))
    return approvals.recorded_confirms(spark, path).select("doc_id", "code_a", "confirm_id", F.size("units").alias("units"))


def x4_log_stream(spark: SparkSession, d: str) -> DataFrame:
    log = scratch_path(spark, "runlog")
    entries = _log_entries(spark, d)
    sinks.append_log(entries.filter("applied"), log)
    sinks.append_log(entries.filter("not applied"), log)
    out = scratch_path(spark, "landed-log")
    drops.drain(logs.log_stream(spark, log), out, scratch_path(spark, "landed-log-progress"))
    return logs.runs_per_day(spark.read.parquet(out))


def x4_running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Two drains in turn: the second reads the rows that were appended in between."""
    log, store, progress = (scratch_path(spark, n) for n in ("runlog", "totals", "totals-progress"))
    entries = _log_entries(spark, d)
    for part in ("applied", "not applied"):
        sinks.append_log(entries.filter(part), log)
        logs.keep_totals(logs.log_stream(spark, log), store, progress)
    return logs.read_totals(spark, store)


QUERIES = {
    f.__name__: f
    for f in (x1_file_drop, x2_apply_outcomes, x2_applied_tokens, x2_applies_with_previews, x2_outcome_stream, x3_confirm_outcomes, x3_recorded_confirms, x4_log_stream, x4_running_totals)
}

_TOKENS = """
p AS (SELECT CAST(event_id AS VARCHAR) AS token, ts FROM events WHERE event_type = 'view'),
a AS (SELECT event_id AS apply_id, CAST(event_id - 1 - event_id % 4 AS VARCHAR) AS token, ts FROM events WHERE event_type <> 'view'),
j AS (SELECT a.*, p.ts AS issued, row_number() OVER (PARTITION BY a.token ORDER BY a.ts, a.apply_id) AS r FROM a LEFT JOIN p ON a.token = p.token AND a.ts >= p.ts)
"""

ORACLE = {
    "x1_file_drop": """
        SELECT CASE lang WHEN 'en' THEN '.plg' WHEN 'fr' THEN '.skl' ELSE '.zip' END AS ext,
               CASE WHEN lang IN ('en', 'fr') THEN 'accepted' ELSE 'rejected' END AS outcome, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS size_bytes
        FROM documents GROUP BY ALL""",
    "x2_apply_outcomes": f"""
        WITH {_TOKENS} SELECT apply_id, token, CASE WHEN issued IS NULL OR r > 1 THEN 'unknown or used'
               WHEN ts <= issued + INTERVAL 15 MINUTE THEN 'applied' ELSE 'expired' END AS outcome FROM j""",
    "x2_outcome_stream": f"""
        WITH {_TOKENS} SELECT apply_id, token, CASE WHEN issued IS NULL OR r > 1 THEN 'unknown or used'
               WHEN ts <= issued + INTERVAL 15 MINUTE THEN 'applied' ELSE 'expired' END AS outcome FROM j""",
    "x2_applied_tokens": f"WITH {_TOKENS} SELECT token, issued FROM j WHERE r = 1 AND issued IS NOT NULL AND ts <= issued + INTERVAL 15 MINUTE",
    "x2_applies_with_previews": f"""
        WITH {_TOKENS} SELECT a.apply_id, a.token, p.ts AS issued FROM a LEFT JOIN p ON a.token = p.token AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 15 MINUTE""",
    "x3_confirm_outcomes": f"""
        WITH {READING}, r AS (SELECT *, row_number() OVER (PARTITION BY code_a, code_b ORDER BY ts, confirm_id) AS r FROM confirms)
        SELECT confirm_id, r.code_a, CASE WHEN NOT EXISTS (SELECT 1 FROM issued i WHERE i.code_a = r.code_a AND i.code_b = r.code_b) THEN 'mismatch'
               WHEN r = 1 THEN 'accepted' ELSE 'reused' END AS outcome FROM r""",
    "x3_recorded_confirms": f"""
        WITH {READING}, f AS (SELECT code_a, code_b, arg_min(confirm_id, (ts, confirm_id)) AS confirm_id FROM confirms GROUP BY ALL),
        n AS (SELECT doc_key AS doc_id, pos // 10 AS ten, count(*) AS units FROM lines GROUP BY ALL)
        SELECT i.doc_id, i.code_a, confirm_id, CAST(units AS INTEGER) AS units FROM issued i JOIN f ON i.code_a = f.code_a AND i.code_b = f.code_b
        JOIN n ON n.doc_id = i.doc_id AND n.ten = i.ten""",
    "x4_log_stream": """
        WITH g AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type AS action, count(*) AS runs, count(*) FILTER (value > 50) AS applied
                   FROM events GROUP BY ALL)
        SELECT * FROM g""",
}
ORACLE["x4_running_totals"] = ORACLE["x4_log_stream"]
