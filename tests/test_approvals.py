"""Approvals as streams: how their state is kept."""

import datetime as dt
import random

from docketry.operators import ledger
from docketry.streaming import approvals, drops

SHAPES = {"p": "token string, ts timestamp", "a": "apply_id long, token string, ts timestamp"}


def drained(spark, folder, previews, applies, **options):
    for name, rows in (("p", previews), ("a", applies)):
        spark.createDataFrame(rows, SHAPES[name]).write.mode("append").parquet(f"{folder}/{name}")
    streams = [spark.readStream.schema(SHAPES[n]).parquet(f"{folder}/{n}") for n in ("p", "a")]
    with approvals.timed_state(spark):
        query = drops.drain(approvals.apply_outcomes(*streams, **options), f"{folder}/out", f"{folder}/progress")
    return query, spark.read.parquet(f"{folder}/out").filter("apply_id >= 0")


def test_tokens_share_states(spark, tmp_path):
    """A state for each token makes a call of each; three states hold two hundred tokens here, null included."""
    rng = random.Random(2)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(4000))
    previews = [(f"t{k % 150}", at()) for k in range(180)] + [(None, at())]
    applies = [(2**53 + 1 + k, f"t{rng.randrange(200)}", at()) for k in range(400)] + [(1, None, at())]
    end = dt.datetime(2025, 1, 1)
    query, got = drained(spark, str(tmp_path), [*previews, ("", end)], [*applies, (-1, "", end)], buckets=3)
    want = ledger.judged_applies(
        *[spark.createDataFrame([r for r in rows if r[-2] is not None], SHAPES[n]) for n, rows in (("p", previews), ("a", applies))]
    )
    rows = {(r.apply_id, r.token, r.ts, r.outcome) for r in got.collect()}
    assert {r for r in rows if r[1] is not None} == {(r.apply_id, r.token, r.ts, r.outcome) for r in want.collect()}
    assert len(rows) == 401
    assert {s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]} <= {0, 1, 2, 3}
