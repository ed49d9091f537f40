"""Ledger, references, ordering, rules, sources and streams."""

import datetime as dt
import difflib
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry import session
from docketry.functions import dates, patterns, rules, text
from docketry.operators import cases, changes, holdings, ledger, matching, ordered, quality, rulebooks
from docketry.sources import files, pages
from docketry.streaming import approvals, drops


# --- reading ledger ---------------------------------------------------------

@pytest.fixture(scope="module")
def reading(spark):
    units = [("d1", 1, "text", "a"), ("d1", 2, "text", "b"), ("d2", 1, "vision", ""), ("d3", 1, "text", "x" * 20000), ("d3", 2, "text", "y" * 20000)]
    issued = [("a1", "b1", "d1", [1, 2]), ("a3", "b3", "d3", [1, 2])]
    return (
        spark.createDataFrame(units, "doc_id string, n int, kind string, text string"),
        spark.createDataFrame(issued, "code_a string, code_b string, doc_id string, units array<int>"),
    )


def confirms(spark, rows):
    return spark.createDataFrame(
        [(i, a, b, dt.datetime(2024, 1, 1, 0, i)) for i, (a, b) in enumerate(rows)], "confirm_id int, code_a string, code_b string, ts timestamp"
    )


def gate(spark, reading, rows, vision=None):
    units, issued = reading
    notes = spark.createDataFrame(vision, "doc_id string, n int, text string") if vision else None
    return {r["doc_id"]: (r["passes"], r["missing"]) for r in ledger.coverage(ledger.read_units(units, issued, confirms(spark, rows), notes)).collect()}


def test_wrong_code_marks_nothing(spark, reading):
    assert gate(spark, reading, [("a1", "xx")])["d1"] == (False, "1-2")


def test_right_code_and_vision_note_pass(spark, reading):
    got = gate(spark, reading, [("a1", "b1"), ("a3", "b3")], [("d2", 1, "a scanned letter from the employer, 2019")])
    assert got == {"d1": (True, None), "d2": (True, None), "d3": (True, None)}


def test_short_note_and_note_on_text_do_not_count(spark, reading):
    got = gate(spark, reading, [], [("d2", 1, "short"), ("d1", 1, "a long enough note about a page with text")])
    assert not got["d2"][0] and got["d1"] == (False, "1-2")


def test_reuse_and_mismatch(spark, reading):
    rows = ledger.judged_confirms(reading[1], confirms(spark, [("a1", "b1"), ("a1", "b1"), ("a1", "zz")])).orderBy("confirm_id").collect()
    assert [r["outcome"] for r in rows] == ["accepted", "reused", "mismatch"]


def test_too_long_and_outside_ranges_are_refused(spark, reading):
    shows = spark.createDataFrame([(1, "d3", 1, 2), (2, "d3", 1, 1), (3, "d1", 1, 9)], "show_id int, doc_id string, first int, last int")
    got = {r["show_id"]: r["refused"] for r in ledger.refused_shows(shows, reading[0]).collect()}
    assert got == {1: "too long", 2: None, 3: "bad range"}


# --- references and labels --------------------------------------------------

def test_appendix_references(spark):
    lines = ["מצ\"ב ומסומן נספח א'", "ראו נספח 2 וכן בנספח ג'", "ומסומנת ד'", "תוכן העניינים עמ' 5"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, text string")
    hits = df.select("pos", F.explode(patterns.first_per_reference(patterns.appendix_references(F.col("text")))).alias("h")).select("pos", "h.*")
    got = {(r["pos"], r["ref_id"]): (r["family"], r["context"]) for r in hits.collect()}
    assert {k: v[0] for k, v in got.items()} == {(0, "א'"): "A", (1, "2"): "A", (1, "ג'"): "A", (2, "ד'"): "B"}
    assert got[(1, "2")][1] == lines[1]
    used = hits.select(F.lit("d").alias("doc"), "ref_id")
    declared = spark.createDataFrame([("d", "א'"), ("d", "2"), ("d", "ה'")], "doc string, ref_id string")
    sides = {r["ref_id"]: r["side"] for r in matching.reconcile(used, declared, ["doc"], "ref_id").collect()}
    assert sides == {"א'": "matched", "2": "matched", "ג'": "orphaned", "ד'": "orphaned", "ה'": "missing"}


def test_labels_both_ways(spark):
    rows = [(i, s) for i in (0, 14, 29, 30) for s in ("hebrew", "arabic")]
    df = spark.createDataFrame(rows, "i int, s string").withColumn("label", patterns.appendix_label(F.col("i"), F.col("s")))
    got = df.withColumn("back", patterns.appendix_index(F.col("label"), F.col("s"))).collect()
    assert {(r["i"], r["s"]): r["label"] for r in got}[(14, "hebrew")] == "טו'"
    assert all(r["back"] == (r["i"] if r["label"] else None) for r in got)
    assert [r["label"] for r in got if r["i"] == 30] == [None, "31"]


def test_numbering_tie_goes_to_letters(spark):
    df = spark.createDataFrame([("נספח א' נספח 1",), ("נספח 1 נספח 2 נספח ב'",)], "t string")
    assert [r[0] for r in df.select(patterns.numbering_style(F.col("t"))).collect()] == ["hebrew", "arabic"]


# --- similarity -------------------------------------------------------------

@pytest.mark.parametrize("metric", ["edit", "blocks"])
def test_similarity_join_loses_no_partner(spark, metric):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 60))) for _ in range(60)]

    def noisy(t):
        out = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 5))):
            out[rng.randrange(len(out))] = rng.choice("abcdxyz")
        return "".join(out)

    other = [noisy(t) for t in base]
    a = spark.createDataFrame([("k", i, t) for i, t in enumerate(base)], "k string, row int, text string")
    b = spark.createDataFrame([("k", i, t) for i, t in enumerate(other)], "k string, row int, text string")
    got = {(r["row"], r["other"]) for r in matching.similar_pairs(a, b, ["k"], 0.8, metric).collect()}

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    def score(x, y):
        return difflib.SequenceMatcher(None, x, y).ratio() if metric == "blocks" else 1 - edits(x, y) / max(len(x), len(y))

    want = {(i, j) for i, x in enumerate(base) for j, y in enumerate(other) if score(x, y) >= 0.8}
    assert got == want and want


def test_status_similarity(spark):
    df = spark.createDataFrame([("ממתין לדיון", "המתנה לדיון"), ("סגור", "סגור!"), ("", "x"), ("בטיפול משרד", "בטיפול")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[1:] == [1.0, 0.0, 0.85] and 0.3 < got[0] < 1


# --- ordered work -----------------------------------------------------------

def test_hot_group_numbering(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 50), i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    order, chunk = [F.col("t"), F.col("id")], F.floor(F.col("t") / 5)
    placed = ordered.position(df, ["k"], order, chunk, "n")
    placed = ordered.running_total(placed, ["k"], order, F.col("v"), chunk, "s")
    got = {r["id"]: r for r in ordered.next_value(placed, ["k"], ["t", "id"], "v", chunk, "nv").collect()}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total = 0
        for n, r in enumerate(group):
            row = got[r[2]]
            following = group[n + 1][3] if n + 1 < len(group) else None
            assert (row["n"], row["s"], row["nv"]) == (n + 1, total, following)
            total += r[3]


def test_islands_partition_the_input(spark):
    rows = [("d", n) for n in (1, 2, 3, 7, 9, 10)]
    df = spark.createDataFrame(rows, "d string, n int")
    assert ordered.ranges(df, ["d"], "n").first()["ranges"] == "1-3, 7, 9-10"


def instructions_model(paragraphs):
    found, opened, parts = [], None, []
    for i, t in enumerate(paragraphs):
        if opened is None:
            rest = t
            while "<" in rest:
                body, sep, tail = rest[rest.index("<") + 1 :].partition(">")
                if not sep:
                    break
                if body:
                    found.append((i, i, body.strip()))
                rest = tail
            if t.count("<") > t.count(">") and ">" not in t[t.rfind("<"):]:
                opened, parts = i, [t[t.rfind("<") + 1 :]]
        elif ">" in t:
            found.append((opened, i, " ".join([*parts, t.split(">")[0]]).strip()))
            opened = None
        else:
            parts.append(t)
    return sorted(found)


def test_instruction_blocks(spark):
    rng = random.Random(8)
    docs = {d: ["".join(rng.choice(["a", "b ", "<", ">", "c"]) for _ in range(rng.randint(1, 7))).replace("<<", "<").replace("<>", "") for _ in range(9)] for d in range(40)}
    docs |= {90: [], 91: ["<a", "b"], 92: ["x", "<a", "b>", "<c", "d"], 93: ["a>b", "<q> <r", "> <s", "t>"]}
    got = {}
    for r in quality.instruction_blocks(spark.createDataFrame(list(docs.items()), "doc_key int, paras array<string>")).collect():
        got.setdefault(r["doc_key"], []).append((r["first_pos"], r["last_pos"], r["instruction"]))
    assert {d: sorted(got.get(d, [])) for d in docs} == {d: instructions_model(ps) for d, ps in docs.items()}


# --- sources ----------------------------------------------------------------

def test_units_keep_the_text(spark):
    rng = random.Random(1)
    texts = ["\n".join("x" * rng.choice([0, 5, 40, 99, 100, 101, 230]) for _ in range(30)) for _ in range(8)] + ["", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in pages.unit_table(df, "doc_id", "text", 100).orderBy("doc_id", "n").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, t in enumerate(texts):
        assert "".join(got[i]).replace("\n", "") == t.replace("\n", "")
        assert all(len(u) <= 101 for u in got[i])
    assert got[8] == [""]


def test_marked_units_and_pages(spark):
    t = "cover\n=== עמוד 1 ===\none\n=== עמוד 2 ===\ntwo\n"
    df = spark.createDataFrame([(1, t)], "doc_id int, text string")
    assert [r["text"] for r in pages.unit_table(df, "doc_id", "text").orderBy("n").collect()] == ["cover\n=== עמוד 1 ===\none", "=== עמוד 2 ===\ntwo"]
    marked = spark.createDataFrame([("x===== PAGE 2 =====b===== PAGE 1 =====a===== PAGE 2 =====c",), ("plain",)], "t string")
    got = [[(p["page"], p["text"]) for p in r[0]] for r in marked.select(pages.pages_by_marker(F.col("t"))).collect()]
    assert got == [[(1, "a"), (2, "c")], [(1, "plain")]]


def test_files_keys_and_drops(spark, tmp_path):
    root = tmp_path / "up"
    (root / "_x" / "__pycache__").mkdir(parents=True)
    for name in ("a.plugin", "b.skill", "c.zip", "sub d.plugin"):
        (root / name).write_text(name)
    (root / "_x" / "__pycache__" / "e.plugin").write_text("hidden")
    listed = files.list_files(spark, str(root), [".plugin"]).collect()
    assert sorted(r["rel_path"] for r in listed) == ["a.plugin", "sub d.plugin"] or sorted(r["filename"] for r in listed)[0] == "a.plugin"
    keyed = spark.createDataFrame([("x/מסמך: 1.pdf",)], "p string").select(files.document_key(F.col("p"), short=True)).first()[0]
    assert keyed.startswith("מסמך_ 1__") and len(keyed.split("__")[1]) == 6
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    drops.drain(drops.accepted_files(spark, str(root)), out, progress)
    (root / "late.skill").write_text("late")
    drops.drain(drops.accepted_files(spark, str(root)), out, progress)
    landed = sorted(r["filename"] for r in spark.read.parquet(out).collect() if r["filename"] != "e.plugin")
    assert landed == ["a.plugin", "b.skill", "late.skill", "sub d.plugin"] or landed == ["a.plugin", "b.skill", "late.skill", "sub%20d.plugin"]
    assert [r["filename"] for r in drops.rejected_files(spark, str(root)).collect()] == ["c.zip"]


def test_code_reuse_is_refused_across_batches(spark, tmp_path):
    schema = "confirm_id long, code_a string, code_b string, ts timestamp"
    folder = str(tmp_path / "in")
    issued = spark.createDataFrame([("a", "b", 1, [1, 2])], "code_a string, code_b string, doc_id long, units array<int>")
    out, progress = str(tmp_path / "ledger"), str(tmp_path / "progress")
    for i, day in ((1, 1), (2, 20)):
        spark.createDataFrame([(i, "a", "b", dt.datetime(2024, 1, day)), (10 + i, "a", "x", dt.datetime(2024, 1, day))], schema).write.mode("append").parquet(folder)
        approvals.record_confirms(spark.readStream.schema(schema).parquet(folder), issued, out, progress)
    assert [r["confirm_id"] for r in spark.read.parquet(out).collect()] == [1]


def test_token_lives_fifteen_minutes(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    previews = spark.createDataFrame([("t", at(0)), ("u", at(0))], "token string, ts timestamp")
    applies = spark.createDataFrame([(1, "t", at(15)), (2, "t", at(16)), (3, "u", at(16)), (4, "u", at(17)), (5, "v", at(1))], "apply_id int, token string, ts timestamp")
    got = {r["apply_id"]: r["outcome"] for r in ledger.judged_applies(previews, applies).collect()}
    assert got == {1: "applied", 2: "unknown or used", 3: "expired", 4: "unknown or used", 5: "unknown or used"}


def test_shared_folder_comes_from_the_session(spark):
    def fake(named, current, master):
        held = SimpleNamespace(get=lambda key, default=None: named)
        context = SimpleNamespace(getConf=lambda: held, getCheckpointDir=lambda: current, master=master)
        return SimpleNamespace(conf=held, sparkContext=context)

    assert session.shared_folder(fake("hdfs://c/shared", None, "yarn")) == "hdfs://c/shared"
    assert session.shared_folder(fake(None, "s3a://b/x", "yarn")) == "s3a://b/x"
    with pytest.raises(RuntimeError):
        session.shared_folder(fake(None, None, "yarn"))
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    cut = session.cut_lineage(spark.range(10))
    assert cut.count() == 10 and "Range" not in cut._jdf.queryExecution().toString()


# --- rules ------------------------------------------------------------------

def test_fee_caps(spark):
    rows = [
        (1, "claim_only", "3000.00", None, None, None),
        (2, "claim_only", "1000.00", 30, 12, None),
        (3, "claim_work_injury_9_19", "0.00", None, None, "10000.00"),
        (4, "mystery", "5.00", None, None, None),
        (5, "severe_disability", "100.00", None, None, None),
        (6, "mobility_loan", "100.00", None, None, None),
        (7, "claim_only", "2000.00", None, None, None),
        (7, "claim_only", "1000.00", None, None, None),
        (8, "claim_only", "3000.00", None, None, None),
        (8, "mobility_loan", "3000.00", None, None, None),
    ]
    claims = spark.createDataFrame(rows, "event_id int, service string, monthly string, eligible_months int, months_to_pension int, grant string")
    got = {r["event_id"]: r for r in rulebooks.fee_caps(claims).collect()}
    money = lambda r: (str(r["cap_with_fee"]), str(r["cap_without_fee"]))
    assert money(got[1]) == ("19411.00", "22050.00")
    assert money(got[2]) == ("3152.00", "1470.00")
    assert money(got[3]) == ("2261.00", "1400.00")
    assert got[4]["cap_with_fee"] is None and got[4]["uncovered"]
    assert money(got[5]) == ("1922.00", "1922.00") and money(got[6]) == ("961.00", "961.00")
    assert money(got[7]) == money(got[1])  # two claims of one event: one base, one opening fee
    assert got[8]["mixed"] and got[8]["cap_with_fee"] is None and got[8]["service"] is None and not got[8]["uncovered"]


def test_rubric_reports_missing_items(spark):
    rows = [(1, i, fv.RUBRIC_MAX_POINTS[i]) for i in fv.RUBRIC_MAX_POINTS] + [(2, "sleep", 1), (2, "social", 9)]
    got = {r["subject"]: r for r in rulebooks.rubric_scores(spark.createDataFrame(rows, "subject int, item string, points int")).collect()}
    assert (got[1]["total"], got[1]["percent"], got[1]["missing_items"], got[1]["to_next_band"]) == (31, 100, 0, None)
    assert (got[2]["total"], got[2]["percent"], got[2]["missing_items"], got[2]["to_next_band"]) == (1, 0, 12, 9)


def test_citations_not_read_are_not_clean(spark):
    decisions = spark.createDataFrame([(i,) for i in range(4)], "decision int")
    citers = spark.createDataFrame([(0, 1, "יושם"), (1, 1, None), (1, 2, "יושם"), (2, 1, "נדחה"), (2, 2, None)], "decision int, citer int, treatment string")
    got = {r["decision"]: (r["citations_count"], r["negative_treatment"]) for r in holdings.citation_status(decisions, citers, ["נדחה", "צומצם"]).collect()}
    assert got == {0: (1, "no"), 1: (2, "unknown"), 2: (2, "yes"), 3: (0, "unknown")}


def test_dates_and_times(spark):
    df = spark.createDataFrame([("15.03.2024", "9:05"), ("5/3/2024", "23:59"), ("15/03/24", "x"), ("soon", None)], "d string, t string")
    got = df.select(dates.parse_written_date(F.col("d")), dates.parse_date(F.col("d")), dates.parse_time_minutes(F.col("t"))).collect()
    assert [str(r[0]) for r in got] == ["2024-03-15", "2024-03-05", "2024-03-15", "None"]
    assert [str(r[1]) for r in got[:2]] == ["None", "2024-03-05"]
    assert [r[2] for r in got] == [545, 1439, None, None]


def test_instruction_labels(spark):
    df = spark.createDataFrame([("נסח מחדש והרחב",), ("תוסיף משפט",), ("הפנה לסעיף 3",), ("שלום",)], "t string")
    got = [r[0] for r in df.select(rules.classify_instruction(F.col("t"))).collect()]
    assert got == [fv.INSTRUCTION_LABELS[k] for k in ("rewrite_expand", "add", "move", "other")]


def test_plan_and_application_share_changes(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, tag string")
    rows = [("update", "t", "1", {"tag": "z"}, 1), ("delete", "t", "2", {}, 2), ("insert", "t", "9", {"name": "n"}, 3)]
    ch = spark.createDataFrame(rows, "op string, table_name string, key string, set map<string,string>, seq long")
    assert [r["plan"] for r in changes.change_plan(ch).collect()] == ["UPDATE t SET tag=z WHERE key=1", "DELETE FROM t WHERE key=2", "INSERT t : name=n"]
    assert sorted(map(tuple, changes.apply_changes(base, ch, "id").collect()), key=str) == [(1, "a", "z"), (9, "n", None)]


@pytest.mark.parametrize(
    "steps,rows",
    [
        ([("update", "1", {"a": "x"}), ("update", "1", {"b": "y"})], [(1, "x", "y"), (2, "p", "q")]),
        ([("insert", "9", {"a": "x", "b": "z"}), ("update", "9", {"b": "y"})], [(1, "m", "n"), (2, "p", "q"), (9, "x", "y")]),
        ([("update", "9", {"a": "x"})], [(1, "m", "n"), (2, "p", "q")]),
        ([("update", "9", {"a": "x"}), ("insert", "9", {"b": "z"})], [(1, "m", "n"), (2, "p", "q"), (9, None, "z")]),
        ([("delete", "1", {}), ("update", "1", {"a": "x"})], [(2, "p", "q")]),
        ([("delete", "1", {}), ("insert", "1", {"a": "x"}), ("update", "2", {"a": None})], [(1, "x", None), (2, None, "q")]),
        ([("insert", "9", {"a": "x"}), ("delete", "9", {}), ("update", "1", {"a": "x"}), ("delete", "2", {})], [(1, "x", "n")]),
    ],
)
def test_changes_are_applied_in_turn(spark, steps, rows):
    base = spark.createDataFrame([(1, "m", "n"), (2, "p", "q")], "id int, a string, b string")
    ch = spark.createDataFrame([(op, k, v, i) for i, (op, k, v) in enumerate(steps)], "op string, key string, set map<string,string>, seq int")
    assert sorted(map(tuple, changes.apply_changes(base, ch, "id").collect())) == rows


def test_append_absent_takes_the_smallest(spark):
    have = spark.createDataFrame([(1, "x")], "k int, v string")
    more = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (3, None)], "k int, v string")
    assert sorted(map(tuple, changes.append_absent(have, more, ["k"]).collect()), key=str) == [(1, "x"), (2, "b"), (3, None)]


# --- fixed tables, flags, stages ---------------------------------------------

def test_calls_without_a_start_begin_now(spark):
    rows = [(1, 15, None, None), (2, 15, None, 100), (3, 52, None, 100), (4, 14, None, None), (5, 7, None, None), (6, 200, 5, None), (7, 999, None, None)]
    requests = spark.createDataFrame(rows, "request_id int, kind int, kind_group int, start_minutes int").selectExpr(
        "*", "cast(null as date) as day", "cast(null as int) as end_minutes", "cast(null as decimal(18,2)) as amount"
    )
    got = {r["request_id"]: r for r in cases.event_rows(requests, "17", F.lit(615)).collect()}
    assert [got[k]["start_minutes"] for k in range(1, 8)] == [615, 100, 615, fv.EVENT_START, fv.TASK_START, fv.EVENT_START, None]
    assert got[7]["rejected"] and got[6]["row_type"] == "cal" and got[1]["alarm_minutes"] == 605


def test_only_a_sub_folder_has_a_parent_to_follow(spark):
    rows = [(1, None, "root", 24), (2, 1, "sub", 77), (3, 2, "subsub", 77), (4, 2, "own case", 24), (5, 99, "lost parent", 77)]
    chain = cases.folder_chain(spark.createDataFrame(rows, "case_id int, parent_id int, subject string, kind int"))
    assert {r["case_id"]: (r["root_id"], r["depth"], r["path"]) for r in chain.collect()} == {
        1: (1, 0, []), 2: (1, 1, ["sub"]), 3: (1, 2, ["sub", "subsub"]), 4: (4, 0, []), 5: (5, 0, []),
    }


def test_stage_catalog_marks_the_current_one(spark):
    known = spark.createDataFrame([(1, 22, 10), (2, 22, None), (3, 5, 11)], "case_id int, kind int, current_flow_id int")
    flow = spark.createDataFrame([(10, "b"), (11, "a")], "flow_id int, node_id string")
    got = cases.stage_catalog(known, flow, {22: [("a", "first"), ("b", "second")]}).collect()
    assert sorted((r["case_id"], r["node_id"], r["is_current"]) for r in got) == [(1, "a", False), (1, "b", True), (2, "a", False), (2, "b", False)]


def test_only_the_holding_that_was_hit_is_negative(spark):
    held = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "holding_id int, decision int")
    citers = spark.createDataFrame([(7, 1, "נדחה", 1), (7, 2, "יושם", 2), (8, 3, "נדחה", None)], "decision int, citer int, treatment string, holding_id int")
    got = {r["holding_id"]: (r["checked"], r["negative_treatment"]) for r in holdings.holding_flags(held, citers).collect()}
    assert got == {1: (True, "yes"), 2: (True, "no"), 3: (True, "unknown"), 4: (False, "unknown")}


def test_classes_conflicts_and_folders(spark):
    df = spark.createDataFrame([("כתב ערר",), ("כתב ערר ופרוטוקול",), ("סתם",)], "t string")
    scores = rules.rule_scores(F.col("t"), {c: {p: 1 for p in ps} for c, ps in fv.DOCUMENT_CLASSES.items()})
    label = rules.best_class(scores)
    got = df.select(label, rules.class_state(scores), rules.target_folder(label, fv.CLASS_FOLDERS)).collect()
    assert [tuple(r) for r in got] == [("מסמכי ערר", "found", "מסמכי ערר"), ("unknown", "conflict", None), ("unknown", "no hit", None)]


def test_template_one_may_name_a_court(spark):
    df = spark.createDataFrame([(1,), (2,)], "t int")
    got = [r[0] for r in df.select(rules.question_violations(F.lit("מה קבע בית המשפט העליון?"), F.col("t"), ["בית המשפט העליון"])).collect()]
    assert got == [[], ["names_court"]]


def test_scattered_terms_are_a_metric(spark):
    rows = [("d", i, False, "סעיף 5 וגם סעיף 62" if i in (0, 9) else "מלל") for i in range(10)] + [("e", 0, False, "סעיף 5")]
    got = quality.writing_metrics(spark.createDataFrame(rows, "doc_key string, pos int, is_heading boolean, text string")).filter("metric = 'scattered'")
    assert {r["doc_key"]: (r["value"], r["within"]) for r in got.collect()} == {"d": (1, True), "e": (0, True)}


def test_unknown_status_comes_with_suggestions(spark):
    requests = spark.createDataFrame([(1, "set", 5, "open case"), (2, "set", 5, "zzz"), (3, "set", 5, "opened case")], "request_id int, action string, case_id int, text string")
    known = spark.createDataFrame([(5, 24, None)], "case_id int, kind int, close_date date")
    uses = spark.createDataFrame([], "status string, n long")
    got = {r["request_id"]: (r["refused"], r["suggestions"]) for r in changes.judge_status_requests(requests, known, ["opened case", "paused"], uses).collect()}
    assert got == {1: ("status unknown", "opened case"), 2: ("status unknown", None), 3: (None, None)}


def test_a_far_range_is_not_unfolded(spark):
    units = spark.createDataFrame([("d", n, "x" * 10) for n in range(1, 6)], "doc_id string, n int, text string")
    shows = spark.createDataFrame([(1, "d", 1, 5), (2, "d", 3, 2_000_000_000), (3, "gone", 1, 1), (4, "d", 0, 2)], "show_id int, doc_id string, first int, last int")
    got = {r["show_id"]: r["refused"] for r in ledger.refused_shows(shows, units).collect()}
    assert got == {1: None, 2: "bad range", 3: "bad range", 4: "bad range"}


def test_a_used_code_stays_used_after_a_restart(spark, tmp_path):
    issued = spark.createDataFrame([("a", "b", 1, [1]), ("c", "d", 2, [1])], "code_a string, code_b string, doc_id long, units array<int>")
    shape = "confirm_id long, code_a string, code_b string, ts timestamp"
    source, book = str(tmp_path / "in"), str(tmp_path / "ledger")

    def land(rows):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(source)

    def run(name):
        approvals.record_confirms(spark.readStream.schema(shape).parquet(source), issued, book, str(tmp_path / name))
        return sorted((r["code_a"], r["confirm_id"]) for r in spark.read.parquet(book).collect())

    land([(1, "a", "b", dt.datetime(2024, 1, 1, 9))])
    assert run("first") == [("a", 1)]
    land([(2, "a", "b", dt.datetime(2024, 1, 2, 9)), (3, "c", "d", dt.datetime(2024, 1, 2, 9)), (4, "c", "x", dt.datetime(2024, 1, 2, 9))])
    assert run("second") == [("a", 1), ("c", 3)]  # a new checkpoint reads everything again
    assert run("first") == [("a", 1), ("c", 3)]


def test_a_checkpoint_that_starts_over_at_its_path_replaces_nothing(spark, tmp_path):
    issued = spark.createDataFrame([("a", "b", 1, [1]), ("c", "d", 2, [1])], "code_a string, code_b string, doc_id long, units array<int>")
    shape = "confirm_id long, code_a string, code_b string, ts timestamp"
    source, book, progress = (str(tmp_path / x) for x in ("in", "ledger", "progress"))

    def run():
        approvals.record_confirms(spark.readStream.schema(shape).parquet(source), issued, book, progress)
        return sorted((r["code_a"], r["confirm_id"]) for r in approvals.recorded_confirms(spark, book).collect())

    spark.createDataFrame([(1, "a", "b", dt.datetime(2024, 1, 1, 9))], shape).write.parquet(source)
    assert run() == [("a", 1)]
    (tmp_path / "progress").rename(tmp_path / "moved")
    source = str(tmp_path / "later")
    spark.createDataFrame([(2, "a", "b", dt.datetime(2024, 1, 2, 9)), (3, "c", "d", dt.datetime(2024, 1, 2, 9))], shape).write.parquet(source)
    assert run() == [("a", 1), ("c", 3)]


def test_a_code_written_by_two_queries_counts_once(spark, tmp_path):
    shape = approvals.LEDGER_SHAPE + ", bucket int"
    for run, confirm, hour in (("x", 5, 9), ("y", 4, 10)):
        rows = [("a", "b", 1, [1], dt.datetime(2024, 1, 1, hour), confirm, 3)]
        spark.createDataFrame(rows, shape).write.partitionBy("bucket").parquet(f"{tmp_path}/run={run}/batch_id=0")
    assert [r["confirm_id"] for r in approvals.recorded_confirms(spark, str(tmp_path)).collect()] == [5]


def test_outcomes_of_the_stream_are_those_of_the_batch(spark, tmp_path):
    """In two drains: late previews, several applies of a token, applies before the preview, unknown and expired tokens."""
    rng = random.Random(6)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m, microseconds=rng.randrange(10**6))
    previews = [(f"t{k}", at(rng.randrange(600))) for k in range(40)] + [("t1", at(700))]
    applies = [(k, f"t{rng.randrange(50)}", at(rng.randrange(640))) for k in range(150)]
    end = dt.datetime(2025, 1, 1)
    shapes = {"p": "token string, ts timestamp", "a": "apply_id long, token string, ts timestamp"}
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    cut = sorted(ts for _, ts in previews)[20]
    for early in (True, False):
        for name, rows, last in (("p", previews, [("", end)]), ("a", applies, [(-1, "", end)])):
            part = [r for r in rows if (r[-1] <= cut) == early] + ([] if early else last)
            spark.createDataFrame(part, shapes[name]).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(shapes[n]).parquet(str(tmp_path / n)) for n in ("p", "a")]
        with approvals.timed_state(spark):
            drops.drain(approvals.apply_outcomes(*streams), out, progress)
    want = ledger.judged_applies(spark.createDataFrame(previews, shapes["p"]), spark.createDataFrame(applies, shapes["a"]))
    rows = spark.read.parquet(out).filter("apply_id >= 0")
    got = sorted((r.apply_id, r.token, r.outcome) for r in rows.collect())
    assert got == sorted((r.apply_id, r.token, r.outcome) for r in want.collect())
    assert {r[2] for r in got} == {"applied", "expired", "unknown or used"}


# --- work done once ---------------------------------------------------------

def test_a_class_is_scored_with_one_search_a_phrase(spark):
    """The scores stand once in an expression, however many classes are compared with the best."""
    from docketry.functions import rules
    scores = rules.rule_scores(F.col("t"), {c: {f"{c}{k}": 1 for k in range(2)} for c in "abc"})
    df = spark.createDataFrame([(1, "a0 a1 b0"), (2, "a0 b1"), (3, "x"), (4, None)], "id int, t string")
    got = df.select("id", rules.best_class(scores).alias("label"), rules.class_state(scores).alias("state"))
    assert sorted(got.collect()) == [(1, "a", "found"), (2, "unknown", "conflict"), (3, "unknown", "no hit"), (4, "unknown", "no hit")]
    for one in (rules.best_class(scores), rules.class_state(scores)):
        assert df.select(one)._jdf.queryExecution().optimizedPlan().toString().count("Contains(") == 6


def test_renamed_folders_are_not_copied_to_every_task(spark):
    acts = spark.createDataFrame([(1, "c:/a/b/x.pdf"), (2, "c:/z.pdf"), (3, None)], "act_id int, doc_path string")
    renames = spark.createDataFrame([("C:\\a", "/m"), ("c:/A/b", "/n")], "old_folder string, new_folder string")
    got = changes.rename_paths(acts, renames, "doc_path")
    assert sorted((r.act_id, r.new_path) for r in got.collect()) == [(1, "/n/x.pdf"), (2, "c:/z.pdf"), (3, None)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prefix" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "unit" in plan  # a common folder is no single task's


def test_leading_additions_work_out_two_keys_a_line(spark, tmp_path):
    from docketry.catalog.text import f10_leading_additions
    body = "Some line of words\n\nanother line"
    spark.createDataFrame([(1, body, "en", "s", 30), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = f10_leading_additions(spark, str(tmp_path))
    assert sorted(got.collect()) == [(1, 0, "In addition,", True), (1, 1, "Whatever", False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
