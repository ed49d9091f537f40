"""Keyed tables, postings, file profiles and running totals."""

import datetime as dt
import glob
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docketry.operators import changes, profiling
from docketry.sources import keyed, postings, sinks
from docketry.streaming import logs


def files_by_bucket(path):
    return {b: sorted(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{path}/bucket=*")}


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(k, f"n{k}") for k in range(200)], "id long, name string")
    keyed.create_keyed(base, path, ["id"], 16)
    before = files_by_bucket(path)
    asked = spark.createDataFrame(
        [("update", "7", {"name": "seven"}, 1), ("delete", "9", None, 2), ("insert", "500", {"name": "new"}, 3), ("update", "999", {"name": "gone"}, 4)],
        "op string, key string, set map<string,string>, seq long",
    )
    touched = keyed.rewrite(spark, path, base.schema, ["id"], [asked.select(F.col("key").alias("id"))], lambda rows: changes.apply_changes(rows, asked, "id"), 16)
    assert 1 <= len(touched) <= 4
    after = files_by_bucket(path)
    changed = {int(b.rsplit("=", 1)[1]) for b in before if before[b] != after[b]}
    assert changed == set(touched) and set(before) == set(after)
    got = {r.id: r.name for r in keyed.read_keyed(spark, path, base.schema).collect()}
    want = {k: f"n{k}" for k in range(200)} | {7: "seven", 500: "new"}
    del want[9]
    assert got == want
    plan = keyed.read_keyed(spark, path, base.schema, touched)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_an_emptied_bucket_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    keyed.create_keyed(base, path, ["id"], 4)
    for _ in range(2):
        keyed.rewrite(spark, path, base.schema, ["id"], [base.select("id")], lambda rows: rows.filter("name = 'c'"), 4)
        assert [(r.id, r.name) for r in keyed.read_keyed(spark, path, base.schema).collect()] == [(None, "c")]
    assert keyed.rewrite(spark, path, base.schema, ["id"], [base.select("id").limit(0)], lambda rows: rows, 4) == []


def test_a_row_of_another_bucket_stops_the_change(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(k, "a") for k in range(50)], "id long, name string")
    keyed.create_keyed(base, path, ["id"], 16)
    one = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(ValueError):
        keyed.rewrite(spark, path, base.schema, ["id"], [one], lambda rows: rows.withColumn("id", F.col("id") + 1), 16)
    assert keyed.read_keyed(spark, path, base.schema).count() == 50


def test_absent_rows_are_added_to_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(k, "a") for k in range(20)], "id long, name string")
    more = spark.createDataFrame([(5, "x"), (40, "z"), (40, "y")], "id long, name string")
    keyed.create_keyed(base, path, ["id"])
    keyed.rewrite(spark, path, base.schema, ["id"], [more.select("id")], lambda rows: changes.append_absent(rows, more, ["id"]))
    got = sorted((r.id, r.name) for r in keyed.read_keyed(spark, path, base.schema).collect())
    assert got == sorted([(k, "a") for k in range(20)] + [(40, "y")])


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("abcא ") for _ in range(rng.randint(0, 60)))) for k in range(300)] + [(900, None), (901, ""), (902, "ab"), (903, "abc" * 5000)]
    df = spark.createDataFrame(texts, "id long, body string").repartition(3)
    path = str(tmp_path / "p")
    postings.write_postings(df, ["id"], "body", path, buckets=16)
    for phrase in ("abc", "a bא", "abcabc", "cab a", "zzz", "bbbbbbbb"):
        got = {r.id for r in postings.texts_with(spark, path, df, ["id"], "body", phrase, buckets=16).collect()}
        assert got == {k for k, t in texts if t and phrase in t}
    with pytest.raises(ValueError):
        postings.holding(spark, path, ["id"], "ab")
    plan = postings.holding(spark, path, ["id"], "abc", buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(gram,abc)" in plan


def test_only_new_files_are_profiled(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "store")
    rows = lambda a, b: spark.range(a, b).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 100).alias("v"), F.lit("x").alias("path"))
    rows(0, 4000).coalesce(1).write.parquet(path)
    assert profiling.profile_new_files(spark, path, store) == 1
    assert profiling.profile_new_files(spark, path, store) == 0
    rows(4000, 6000).coalesce(1).write.mode("append").parquet(path)
    assert profiling.profile_new_files(spark, path, store) == 1
    got = {r.column: r for r in profiling.merged_profile(spark, path, store).collect()}
    assert {c: (r.n_rows, r.filled) for c, r in got.items()} == {"id": (6000, 6000), "v": (6000, 4500), "path": (6000, 6000)}
    assert abs(got["id"].about_distinct - 6000) < 300 and got["v"].about_distinct == 75 and got["path"].about_distinct == 1


def test_a_new_log_file_costs_its_own_rows(spark, tmp_path):
    log, store, progress = (str(tmp_path / n) for n in ("log", "store", "progress"))
    entry = lambda day, action, applied: (dt.datetime(2024, 1, day, 10), action, applied, "u", "r")
    sinks.append_log(spark.createDataFrame([entry(1, "a", True), entry(1, "a", False), entry(2, "b", True)], sinks.LOG_SCHEMA), log)
    logs.keep_totals(logs.log_stream(spark, log), store, progress)
    sinks.append_log(spark.createDataFrame([entry(1, "a", True)], sinks.LOG_SCHEMA).coalesce(1), log)
    second = logs.keep_totals(logs.log_stream(spark, log), store, progress)
    assert sum(p["numInputRows"] for p in second.recentProgress) == 1
    got = {(r.day.day, r.action): (r.runs, r.applied) for r in logs.read_totals(spark, store).collect()}
    assert got == {(1, "a"): (3, 2), (2, "b"): (1, 1)}
    logs.keep_totals(logs.log_stream(spark, log), store, str(tmp_path / "over"))  # starts over: counts everything once more
    assert {(r.day.day, r.action): (r.runs, r.applied) for r in logs.read_totals(spark, store).collect()} == got


def test_long_texts_are_posted_in_one_pass(spark, tmp_path):
    """A text of 200,000 characters beyond ASCII; counting places from its start for every run took minutes."""
    body = "".join(chr(0x5D0 + (k * k + k // 7) % 300) for k in range(200_000))
    df = spark.createDataFrame([(1, body), (2, body[:50]), (2, body[50:99])], "id long, body string")
    path = str(tmp_path / "p")
    started = time.monotonic()
    postings.write_postings(df, ["id"], "body", path)
    assert time.monotonic() - started < 30
    for phrase, want in ((body[90_000:90_020], {1}), (body[10:14], {1, 2}), ("zzz", set())):
        assert want <= {r.id for r in postings.texts_with(spark, path, df, ["id"], "body", phrase).collect()}
