"""Sources, sinks and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.catalog import inputs
from docketry.operators import profiling
from docketry.session import scratch_path
from docketry.sources import files, pages, sinks, tables, words
from docketry.sources.tables import table


def s1_file_discovery(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "drop")
    docs = table(spark, d, "documents").select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").text(root)
    listed = files.list_files(spark, root, [".txt"])
    folder = F.regexp_replace("rel_path", "/[^/]*$", "")
    return listed.groupBy(folder.alias("folder"), "ext").agg(F.sum("size_bytes").alias("size_bytes"))


def s2_document_keys(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", files.document_key(url).alias("doc_key"), files.document_key(url, short=True).alias("display_key")
    )


def s3_word_table(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "words")
    laid = inputs.words(spark, d)
    spoiled = laid.withColumn(
        "conf", F.when(F.col("conf") == 7, "n/a").when(F.col("conf") == 8, "").otherwise(F.format_string("%d.75", F.col("conf")))
    ).withColumn("page", F.when(F.col("conf") == "11.75", "x").otherwise(F.col("page").cast("string")))
    spoiled.select("doc_key", "seq", "page", "left", "top", "width", "height", "conf", "text").write.option("sep", "\t").option("header", True).csv(root)
    good, bad = words.read_words(spark, root)
    kept = good.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("accepted"), F.sum("conf").alias("conf_sum"), F.sum(F.length("text")).alias("chars")
    )
    lost = bad.groupBy("doc_key").agg(F.count(F.lit(1)).alias("rejected"))
    return kept.join(lost, "doc_key", "full").select(
        F.col("doc_key").cast("long").alias("doc_key"), F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"), "conf_sum", "chars",
    )


def s4_page_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text")
    fed = docs.withColumn("text", F.translate("text", "\n", "\f"))
    numbered = F.transform(F.split("text", "\n", -1), lambda t, i: F.format_string("===== PAGE %d =====\n%s", F.floor(i / 2) + 1, t))
    marked = docs.withColumn("text", F.concat(F.lit("cover\n"), F.array_join(numbered, "\n")))
    a = pages.explode_pages(fed, "doc_key", pages.pages_by_feed(F.col("text"))).withColumn("form", F.lit("feed"))
    b = pages.explode_pages(marked, "doc_key", pages.pages_by_marker(F.col("text"))).withColumn("form", F.lit("marker"))
    return a.unionByName(b).select("doc_key", "form", "page", F.trim(F.translate("text", "\n", "")).alias("text"))


def s5_reading_units(spark: SparkSession, d: str) -> DataFrame:
    units = pages.unit_table(table(spark, d, "documents"), "doc_id", "text", 400)
    return units.select("doc_id", "n", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def s6_page_slices(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), pages.pages_by_feed(F.translate("text", "\n", "\f")).alias("p"))
    cut = docs.select("doc_key", F.explode(pages.slice_pages(F.col("p"), 3, 9)).alias("s")).select("doc_key", "s.*")
    return cut.withColumn("header", pages.page_header(F.col("local_page"), F.col("source_page")))


S7_SQL = """
SELECT n.n_name AS nation, count(*) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n.n_name
"""


def s7_table_query(spark: SparkSession, d: str) -> DataFrame:
    return tables.run_query({n: table(spark, d, n) for n in ("orders", "customer", "nation")}, S7_SQL)


def _log_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("ts").alias("time"), F.col("event_type").alias("action"), (F.col("value") > 50).alias("applied"),
        F.col("user_id").cast("string").alias("user"), F.col("props").alias("result"),
    )


def s8_run_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "log")
    entries = _log_entries(spark, d)
    sinks.append_log(entries.filter("applied"), path)
    sinks.append_log(entries.filter("not applied"), path)
    return sinks.read_log(spark, path).groupBy("action").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("applied").alias("applied"), F.max("time").alias("last_run")
    )


def s9_report_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "report")
    orders = table(spark, d, "orders")
    report = orders.groupBy(F.to_date(F.date_trunc("year", "o_orderdate")).alias("y"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report(report.select("y", "o_orderpriority", "n"), path, F.col("y"))
    return sinks.read_report(spark, path, "o_orderpriority string, n bigint", "1997-01-01")


def c2_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.row_counts(spark, d, [*tables.TABLES, "no_such_table"])


PROFILED = ["customer", "orders", "documents"]


def c2_file_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and filled values of every column, added up from the profiles of the files."""
    parts = []
    for name in PROFILED:
        path, store = f"{d.rstrip('/')}/{name}.parquet", scratch_path(spark, f"profile-{name}")
        profiling.profile_new_files(spark, path, store)
        parts.append(profiling.merged_profile(spark, path, store).select(F.lit(name).alias("table_name"), "column", "n_rows", "filled"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PRIMARY_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id",
}
RELATIONS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def c3_inclusion_check(spark: SparkSession, d: str) -> DataFrame:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels"]
    held = {n: table(spark, d, n) for n in names}
    return profiling.inclusion_report(held, profiling.candidate_relations(held, PRIMARY_KEYS))


def c4_stored_files(spark: SparkSession, d: str) -> DataFrame:
    acts = inputs.acts(spark, d)
    present = acts.filter(F.col("kind") != "error").select("doc_path")
    return profiling.verify_stored_files(acts, present)


QUERIES = {
    f.__name__: f
    for f in (
        s1_file_discovery, s2_document_keys, s3_word_table, s4_page_split, s5_reading_units, s6_page_slices,
        s7_table_query, s8_run_log, s9_report_files, c2_row_counts, c2_file_profiles, c3_inclusion_check, c4_stored_files,
    )
}

ORACLE = {
    "s1_file_discovery": """
        SELECT 'source=' || source || '/lang=' || lang AS folder, '.txt' AS ext,
               CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes
        FROM documents GROUP BY ALL""",
    "s2_document_keys": r"""
        WITH b AS (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS base FROM pages),
        s AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(base, '^(.+)\.[^.]*$', '\1'),
                     '[^\p{L}\p{N}_ .()\-]', '_', 'g')) AS safe FROM b),
        k AS (SELECT page_id, CASE WHEN safe = '' THEN 'doc' ELSE safe END AS safe, sha1(url) AS h FROM s)
        SELECT page_id, safe || '__' || h AS doc_key, safe || '__' || substr(h, 1, 6) AS display_key FROM k""",
    "s3_word_table": f"""
        WITH {inputs.WORDS}
        SELECT doc_key, count(*) FILTER (conf NOT IN (7, 11)) AS accepted, count(*) FILTER (conf IN (7, 11)) AS rejected,
               CAST(sum(CASE WHEN conf = 8 THEN 0 WHEN conf < 0 THEN conf ELSE conf END) FILTER (conf NOT IN (7, 11)) AS BIGINT) AS conf_sum,
               CAST(sum(length(text)) FILTER (conf NOT IN (7, 11)) AS BIGINT) AS chars
        FROM words GROUP BY doc_key""",
    "s4_page_split": f"""
        WITH {inputs.LINES},
        m AS (SELECT doc_key, pos // 2 + 1 AS page, max(pos) AS pos FROM lines GROUP BY ALL)
        SELECT doc_key, 'feed' AS form, CAST(pos + 1 AS INTEGER) AS page, trim(text) AS text FROM lines
        UNION ALL
        SELECT doc_key, 'marker', CAST(m.page AS INTEGER), trim(l.text) FROM m JOIN lines l USING (doc_key, pos)""",
    "s5_reading_units": f"""
        WITH RECURSIVE {inputs.LINES},
        pieces AS (
          SELECT doc_key, pos, k, substr(text, k * 400 + 1, 400) AS t,
                 k < greatest(0, CAST(ceil(length(text) / 400.0) AS INTEGER) - 1) AS whole
          FROM (SELECT doc_key, pos, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 400.0) AS INTEGER)))) AS k FROM lines)),
        numbered AS (SELECT doc_key, t, whole, row_number() OVER (PARTITION BY doc_key ORDER BY pos, k) AS r FROM pieces),
        fold AS (
          SELECT doc_key, CAST(0 AS BIGINT) AS r, CAST('' AS VARCHAR) AS cur, CAST([] AS VARCHAR[]) AS done
          FROM (SELECT DISTINCT doc_key FROM numbered)
          UNION ALL
          SELECT f.doc_key, n.r,
                 CASE WHEN n.whole THEN (CASE WHEN length(f.cur) > 0 AND length(f.cur) + length(n.t) + 1 > 400 THEN '' ELSE f.cur END)
                      ELSE (CASE WHEN length(f.cur) > 0 AND length(f.cur) + length(n.t) + 1 > 400 THEN '' ELSE f.cur END) || n.t || chr(10) END,
                 list_concat(list_concat(CASE WHEN length(f.cur) > 0 AND length(f.cur) + length(n.t) + 1 > 400
                                  THEN [f.cur] ELSE CAST([] AS VARCHAR[]) END,
                             CASE WHEN n.whole THEN [n.t] ELSE CAST([] AS VARCHAR[]) END), CAST([] AS VARCHAR[]))
          FROM fold f JOIN numbered n ON n.doc_key = f.doc_key AND n.r = f.r + 1),
        last AS (SELECT doc_key, max(r) AS r FROM fold GROUP BY doc_key),
        outs AS (
          SELECT doc_key, r, generate_subscripts(done, 1) AS j, unnest(done) AS u FROM fold
          UNION ALL
          SELECT f.doc_key, f.r + 1, 1, f.cur FROM fold f JOIN last USING (doc_key, r) WHERE regexp_matches(f.cur, '\\S')),
        everyone AS (
          SELECT doc_key, r, j, u FROM outs
          UNION ALL
          SELECT doc_key, 0, 1, '' FROM last WHERE doc_key NOT IN (SELECT doc_key FROM outs))
        SELECT doc_key AS doc_id, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY r, j) AS INTEGER) AS n,
               CAST(length(u) AS INTEGER) AS chars, md5(u) AS digest FROM everyone""",
    "s6_page_slices": f"""
        WITH {inputs.LINES}
        SELECT doc_key, CAST(pos - 1 AS INTEGER) AS local_page, CAST(pos + 1 AS INTEGER) AS source_page, text,
               '===== עמוד ' || (pos - 1) || ' (עמוד ' || (pos + 1) || ' במקור) =====' AS header
        FROM lines WHERE pos + 1 BETWEEN 3 AND 9""",
    "s7_table_query": S7_SQL.format(orders="orders", customer="customer", nation="nation"),
    "s8_run_log": """
        SELECT event_type AS action, count(*) AS runs, count(*) FILTER (value > 50) AS applied,
               date_trunc('millisecond', max(ts)) AS last_run FROM events GROUP BY event_type""",
    "s9_report_files": """
        SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY o_orderpriority""",
    "c2_row_counts": " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in tables.TABLES]
        + ["SELECT 'no_such_table', CAST(-1 AS BIGINT)"]
    ),
    "c2_file_profiles": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, "column", n_rows, filled FROM (
          SELECT (SELECT count(*) FROM {t}) AS n_rows, * FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME "column" VALUE filled))"""
        for t in PROFILED
    ),
    "c3_inclusion_check": " UNION ALL ".join(
        f"""SELECT '{c}' AS child, '{cc}' AS child_column, '{p}' AS parent, count(*) AS n_rows,
                   count(*) FILTER ({cc} IS NOT NULL AND {cc} <> 0) AS filled,
                   count(DISTINCT CASE WHEN {cc} <> 0 THEN {cc} END) AS distinct_values,
                   count(*) FILTER ({cc} <> 0 AND NOT EXISTS (SELECT 1 FROM {p} x WHERE x.{pc} = {c}.{cc})) AS orphans
            FROM {c}"""
        for c, cc, p, pc in RELATIONS
    ),
    "c4_stored_files": f"""
        WITH {inputs.ACTS}
        SELECT act_id, act_id % 17 <> 0 AS name_ok, kind <> 'error' AS file_present
        FROM acts WHERE act_id % 17 = 0 OR kind = 'error'""",
}
