"""Planned changes to case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.windows import _case_pointers, _new_cases
from docketry.operators import changes
from docketry.session import scratch_path
from docketry.sources import keyed
from docketry.sources.tables import table


def _customer_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes to customers: purchases update, errors delete, sign-ups may insert."""
    e = table(spark, d, "events")
    target = F.when(F.col("event_type") == "signup", F.col("user_id") * 40).otherwise(F.col("user_id"))
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    values = F.when(op == "delete", F.create_map().cast("map<string,string>")).when(
        op == "insert", F.create_map(F.lit("c_name"), F.concat(F.lit("New "), F.col("event_id").cast("string")), F.lit("c_mktsegment"), F.lit("NEW"))
    ).otherwise(F.create_map(F.lit("c_mktsegment"), F.upper("event_type")))
    return e.select(
        op.alias("op"), F.lit("customer").alias("table_name"), target.cast("string").alias("key"), values.alias("set"), F.col("event_id").alias("seq")
    )


def u1_change_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.change_plan(_customer_changes(spark, d))


def u1_applied_changes(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return changes.apply_changes(base, _customer_changes(spark, d), "c_custkey")


def _delete_acts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    acts = inputs.acts(spark, d).select(
        "act_id", "kind", F.col("act_text").alias("text"), "due", F.col("case_id").cast("string").alias("sender"), F.lit(None).cast("string").alias("receiver")
    )
    asked = table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("act_id"), F.col("o_orderdate").alias("ts"))
    return changes.delete_acts(acts, asked, ["view", "click"], "clerk")


def u2_remaining_acts(spark: SparkSession, d: str) -> DataFrame:
    return _delete_acts(spark, d)["acts"].select("act_id", "kind")


def u2_delete_log(spark: SparkSession, d: str) -> DataFrame:
    return _delete_acts(spark, d)["audit"]


def u2_recycle_rows(spark: SparkSession, d: str) -> DataFrame:
    return _delete_acts(spark, d)["recycle"]


STATUSES = ["click", "view", "error", "closed", "signup now"]


def u3_status_requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("set", "close", "reopen", "add", "remove")]), (i % 5 + 1).cast("int"))
    text = F.when(i % 7 == 0, "closed").when(i % 11 == 0, "").when(i % 13 == 0, "errors").otherwise(F.col("event_type"))
    requests = e.select(i.alias("request_id"), action.alias("action"), F.col("user_id").alias("case_id"), text.alias("text"))
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 10 == 0, fv.SUBFOLDER_KIND).otherwise(24).alias("kind"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("2024-01-01").cast("date")).alias("close_date"),
    ).filter("case_id % 17 <> 0")
    uses = e.filter("event_type in ('click', 'purchase')").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return changes.judge_status_requests(requests, c, STATUSES, uses, "closed")


def u4_stage_deletes(spark: SparkSession, d: str) -> DataFrame:
    flow = inputs.flow(spark, d)
    requests = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("flow_id")
    )
    requests = requests.join(flow.select("flow_id", F.col("case_id").alias("owner")), "flow_id", "left").select(
        "request_id", F.when(F.col("request_id") % 2 == 0, F.coalesce("owner", "case_id")).otherwise(F.col("case_id")).alias("case_id"), "flow_id"
    )
    acts = table(spark, d, "part").select((F.col("p_partkey") * 6).alias("flow_id"))
    return changes.judge_flow_deletes(requests, flow, _case_pointers(spark, d), acts)


def u5_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("last"), F.col("p_brand").alias("first"))
    existing = table(spark, d, "part").filter("p_size > 40").select(F.col("p_name").alias("last"), F.col("p_brand").alias("first"))
    return changes.judge_new_names(requests, existing, ["last", "first"])


def u6_renamed_paths(spark: SparkSession, d: str) -> DataFrame:
    acts = inputs.acts(spark, d)
    renames = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(
        F.concat(F.lit("c:/office/TMPDOCS/"), F.col("c_custkey").cast("string")).alias("old_folder"),
        F.concat(F.lit("/archive/"), F.col("c_name")).alias("new_folder"),
    )
    return changes.rename_paths(acts, renames, "doc_path").select("act_id", "new_path")


def _case_requests(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    numbered = _new_cases(spark, d)
    kinds = F.array(*[F.lit(k) for k in (24, 22, 98, 7)])
    requests = numbered.select(
        "request_id", F.col("user_id").alias("customer_id"), F.concat(F.lit('Client "'), F.col("user_id").cast("string"), F.lit('"  Ltd/Co')).alias("full_name"),
        F.element_at(kinds, (F.col("request_id") % 4 + 1).cast("int")).alias("kind"), F.to_date("ts").alias("day"), "case_num", "case_num_sort",
    )
    return changes.new_case_rows(requests)


def u7_new_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = _case_requests(spark, d)
    cases = rows["case"].join(rows["flow"].select("case_id", "node_id", F.col("flow_id").alias("f")), "case_id")
    return cases.select(
        "case_num", "case_num_sort", "customer_id", "open_date", "kind", "node_id", "node_caption", "case_name",
        (F.col("f") == F.col("current_flow_id")).alias("flow_matches"),
    )


def u7_case_rows(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, df in _case_requests(spark, d).items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def u8_registry(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("topic"),
        F.lit("2023-01-01").cast("timestamp").alias("updated_at"), F.lit(1).cast("long").alias("use_count"), F.lit(None).cast("timestamp").alias("last_used"),
    )
    e = table(spark, d, "events")
    updates = e.filter("event_type = 'signup'").select(
        (F.col("user_id") * 20).alias("c_custkey"), "ts", F.lit(None).cast("string").alias("name"),
        F.when(F.col("value") > 20, F.col("props")).alias("topic"),
    )
    uses = e.filter("event_type <> 'signup'").select(F.col("user_id").alias("c_custkey"), "ts")
    return changes.merge_registry(registry, updates, uses, "c_custkey")


def u1_written_changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers in buckets of their key; the changes rewrite the buckets they touch."""
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    path, asked = scratch_path(spark, "customers"), _customer_changes(spark, d)
    keyed.create_keyed(base, path, ["c_custkey"])
    keyed.rewrite(
        spark, path, base.schema, ["c_custkey"], [asked.select(F.col("key").alias("c_custkey"))], lambda rows: changes.apply_changes(rows, asked, "c_custkey")
    )
    return keyed.read_keyed(spark, path, base.schema)


QUERIES = {
    f.__name__: f
    for f in (
        u1_change_plan, u1_applied_changes, u1_written_changes, u2_remaining_acts, u2_delete_log, u2_recycle_rows, u3_status_requests, u4_stage_deletes,
        u5_duplicate_names, u6_renamed_paths, u7_new_cases, u7_case_rows, u8_registry,
    )
}

_CHANGES = """
ch AS (SELECT event_id AS seq, event_type, CASE WHEN event_type = 'signup' THEN user_id * 40 ELSE user_id END AS key,
              CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op FROM events)
"""
_GONE = """
acts AS (SELECT event_id AS act_id, event_type AS kind, ts AS due, user_id AS sender FROM events),
asked AS (SELECT o_orderkey * 3 AS act_id, min(o_orderdate) AS ts FROM orders GROUP BY ALL)
"""
_REQUESTS = """
n AS (SELECT event_id AS request_id, user_id, CAST(ts AS DATE) AS day, ([24, 22, 98, 7])[CAST(event_id % 4 + 1 AS INTEGER)] AS kind,
             CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id) AS VARCHAR) AS case_num
      FROM events WHERE event_type = 'signup')
"""

ORACLE = {
    "u1_change_plan": f"""
        WITH {_CHANGES} SELECT op, 'customer' AS table_name, CAST(key AS VARCHAR) AS key,
          CASE op WHEN 'insert' THEN 'INSERT customer : c_mktsegment=NEW; c_name=New ' || seq
                  WHEN 'update' THEN 'UPDATE customer SET c_mktsegment=' || upper(event_type) || ' WHERE key=' || key
                  ELSE 'DELETE FROM customer WHERE key=' || key END AS plan FROM ch""",
    "u1_applied_changes": f"""
        WITH {_CHANGES}, keys AS (SELECT key FROM ch UNION SELECT c_custkey FROM customer),
        k AS (SELECT key, c_custkey IS NOT NULL AS base, c_name, c_mktsegment, c_nationkey FROM keys LEFT JOIN customer ON c_custkey = key),
        g AS (SELECT k.*, (SELECT max(seq) FROM ch WHERE ch.key = k.key AND op = 'delete') AS gone FROM k),
        b AS (SELECT g.*, base AND gone IS NULL AS stays,
                     (SELECT min(seq) FROM ch WHERE ch.key = g.key AND op = 'insert' AND seq > coalesce(gone, -1)) AS born FROM g),
        -- the row is there from the start or from its insert on; only changes from then on touch it
        e AS (SELECT b.*, CASE WHEN stays THEN -1 ELSE born END AS since FROM b WHERE stays OR born IS NOT NULL),
        t AS (SELECT e.key, arg_max(CASE op WHEN 'insert' THEN 'New ' || seq END, seq) FILTER (op = 'insert') AS name,
                     arg_max(CASE op WHEN 'insert' THEN 'NEW' ELSE upper(event_type) END, seq) AS segment
              FROM e JOIN ch ON ch.key = e.key AND op <> 'delete' AND seq >= since GROUP BY e.key)
        SELECT e.key AS c_custkey, coalesce(name, CASE WHEN stays THEN c_name END) AS c_name,
               coalesce(segment, CASE WHEN stays THEN c_mktsegment END) AS c_mktsegment, CASE WHEN stays THEN c_nationkey END AS c_nationkey
        FROM e LEFT JOIN t ON t.key = e.key""",
    "u2_remaining_acts": f"WITH {_GONE} SELECT act_id, kind FROM acts WHERE act_id NOT IN (SELECT act_id FROM asked)",
    "u2_delete_log": f"""
        WITH {_GONE} SELECT asked.ts AS del_date, kind AS del_type, kind || ', ' || strftime(due, '%d/%m/%Y') || ', ' || sender || ', ' AS del_notes,
               'clerk' AS del_user FROM acts JOIN asked USING (act_id)""",
    "u2_recycle_rows": f"WITH {_GONE} SELECT act_id FROM acts JOIN asked USING (act_id) WHERE kind IN ('view', 'click')",
    "u3_status_requests": """
        WITH q AS (SELECT event_id AS request_id, (['set', 'close', 'reopen', 'add', 'remove'])[CAST(event_id % 5 + 1 AS INTEGER)] AS action, user_id AS case_id,
                          CASE WHEN event_id % 7 = 0 THEN 'closed' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'errors' ELSE event_type END AS text FROM events),
        c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 10 = 0 THEN 77 ELSE 24 END AS kind, c_custkey % 4 = 0 AS shut FROM customer WHERE c_custkey % 17 <> 0),
        j AS (SELECT q.*, c.kind, c.shut, text IN ('click', 'view', 'error', 'closed', 'signup now') AS cat, text IN ('click', 'purchase') AS used,
                     text IN ('click', 'view', 'error', 'closed', 'signup now', 'errors', 'signup') AS alike FROM q LEFT JOIN c ON q.case_id = c.case_id)
        , d AS (SELECT request_id, action, case_id, text, CASE
          WHEN action IN ('set', 'close', 'reopen') AND kind IS NULL THEN 'no such case'
          WHEN action IN ('set', 'close', 'reopen') AND kind = 77 THEN 'sub-folders have no status'
          WHEN action IN ('set', 'add', 'remove') AND text = '' THEN 'text required'
          WHEN action = 'set' AND text = 'closed' THEN 'closing needs the close action'
          WHEN action = 'set' AND shut THEN 'case is closed'
          WHEN action = 'reopen' AND text = 'closed' THEN 'reopen with another status'
          WHEN action = 'set' AND NOT (cat OR used) THEN 'status unknown'
          WHEN action = 'reopen' AND text <> '' AND NOT (cat OR used) THEN 'status unknown'
          WHEN action = 'add' AND (cat OR used) THEN 'already exists'
          WHEN action = 'add' AND alike THEN 'similar statuses exist'
          WHEN action = 'remove' AND NOT cat THEN 'not in the catalog'
          WHEN action = 'remove' AND text = 'closed' THEN 'system status'
          WHEN action = 'remove' AND used THEN 'in use' END AS refused FROM j),
        n AS (SELECT text, name, string_split(text, ' ') AS a, string_split(name, ' ') AS b
              FROM (SELECT DISTINCT text FROM d WHERE text <> ''), (SELECT unnest(['click', 'view', 'error', 'closed', 'signup now']) AS name)),
        s AS (SELECT text, name, CASE WHEN text = name THEN 1.0::DOUBLE ELSE round_even(least(1.0::DOUBLE, greatest(
                len(list_filter(a, lambda w: list_contains(b, w))) / len(list_distinct(list_concat(a, b))),
                CASE WHEN contains(text, name) OR contains(name, text) THEN least(1.0::DOUBLE, least(length(text), length(name)) / greatest(length(text), length(name)) + 0.3::DOUBLE) ELSE 0.0 END,
                1 - levenshtein(text, name) / greatest(length(text), length(name)))), 2) END AS score FROM n),
        g AS (SELECT text, string_agg(name, '; ' ORDER BY score DESC, name) FILTER (score >= 0.5) AS near, string_agg(name, '; ' ORDER BY score DESC, name) FILTER (score >= 0.6) AS nearer
              FROM s GROUP BY text)
        SELECT request_id, action, case_id, d.text, refused,
               CASE refused WHEN 'status unknown' THEN near WHEN 'similar statuses exist' THEN nearer END AS suggestions FROM d LEFT JOIN g ON g.text = d.text""",
    "u4_stage_deletes": f"""
        WITH {inputs.FLOW}, p AS (SELECT case_id, CASE WHEN case_id % 4 = 0 THEN min(flow_id) ELSE max(flow_id) END AS cur FROM flow GROUP BY case_id),
        q AS (SELECT o_orderkey AS request_id, o_orderkey AS flow_id, f.case_id AS owner,
                     CASE WHEN o_orderkey % 2 = 0 THEN coalesce(f.case_id, o_custkey) ELSE o_custkey END AS case_id
              FROM orders LEFT JOIN flow f ON f.flow_id = o_orderkey)
        SELECT request_id, q.case_id, q.flow_id, CASE WHEN owner IS NULL THEN 'not found' WHEN owner <> q.case_id THEN 'another case'
               WHEN cur = q.flow_id THEN 'current stage' WHEN q.flow_id IN (SELECT p_partkey * 6 FROM part) THEN 'referenced' END AS refused
        FROM q LEFT JOIN p ON p.case_id = q.case_id""",
    "u5_duplicate_names": """
        WITH f AS (SELECT p_name, p_brand, min(p_partkey) AS k, max(p_size) > 40 AS taken FROM part GROUP BY ALL)
        SELECT p_partkey AS request_id, p_name AS last, p_brand AS first, CASE WHEN taken THEN 'exists' WHEN p_partkey <> k THEN 'twice in batch' END AS refused
        FROM part JOIN f USING (p_name, p_brand)""",
    "u6_renamed_paths": f"""
        WITH {inputs.ACTS} SELECT act_id, CASE WHEN c_custkey IS NULL THEN doc_path
               ELSE '/archive/' || c_name || substr(doc_path, length('C:/Office/tmpDocs/' || case_id) + 1) END AS new_path
        FROM acts LEFT JOIN customer ON c_custkey = case_id AND c_custkey % 3 = 0""",
    "u7_new_cases": f"""
        WITH {_REQUESTS} SELECT case_num, lpad(case_num, 8, '0') AS case_num_sort, user_id AS customer_id, day AS open_date, kind,
               CASE WHEN kind = 24 THEN 57 ELSE 38 END AS node_id, CASE WHEN kind = 24 THEN 'כללי' ELSE 'פתיחת תיק' END AS node_caption,
               'Client ' || user_id || ' Ltd Co' AS case_name, true AS flow_matches FROM n WHERE kind <> 7""",
    "u7_case_rows": f"""
        WITH {_REQUESTS}, g AS (SELECT count(*) FILTER (kind <> 7) AS good, count(*) FILTER (kind IN (22, 98)) AS torts, count(*) FILTER (kind = 7) AS bad FROM n)
        SELECT 'case' AS table_name, good AS n_rows FROM g UNION ALL SELECT 'flow', good FROM g UNION ALL SELECT 'detail', good FROM g
        UNION ALL SELECT 'values', torts * 4 FROM g UNION ALL SELECT 'rejected', bad FROM g""",
    "u8_registry": """
        WITH u AS (SELECT user_id * 20 AS k, max(ts) AS ts, arg_max(props, ts) FILTER (value > 20) AS topic FROM events WHERE event_type = 'signup' GROUP BY ALL),
        s AS (SELECT user_id AS k, count(*) AS n, max(ts) AS last FROM events WHERE event_type <> 'signup' GROUP BY ALL),
        m AS (SELECT coalesce(c_custkey, u.k) AS c_custkey, c_name AS name, coalesce(u.topic, c_mktsegment) AS topic,
                     greatest(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2023-01-01 00:00:00' END, u.ts) AS updated_at,
                     CASE WHEN c_custkey IS NOT NULL THEN 1 ELSE 0 END AS b FROM customer FULL JOIN u ON c_custkey = u.k)
        SELECT m.c_custkey, name, topic, updated_at, CAST(b + coalesce(n, 0) AS BIGINT) AS use_count, last AS last_used FROM m LEFT JOIN s ON s.k = m.c_custkey""",
}
ORACLE["u1_written_changes"] = ORACLE["u1_applied_changes"]
