"""Searches, filters and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.inputs import sql_text
from docketry.functions import patterns, text
from docketry.operators import holdings, predicates
from docketry.session import scratch_path
from docketry.sources import postings
from docketry.sources.tables import table


def p1_find(spark: SparkSession, d: str) -> DataFrame:
    return predicates.find(table(spark, d, "part"), ["p_name", "p_type"], "bolt").select("p_partkey", "p_name", "p_type")


def p2_search_fields(spark: SparkSession, d: str) -> DataFrame:
    library = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.split("p_name", " ").alias("topics"), F.array("p_brand").alias("tags"),
    )
    return predicates.search_fields(library, ["name", "description"], ["topics", "tags"], "Brand#2").select("p_partkey")


def p3_section_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = predicates.search_sections(docs, ["doc_id"], "text", "[0-9]{3}", 40)
    return hits.select("doc_id", F.md5(F.array_join("matching_lines", "\n")).alias("digest"), F.size("matching_lines").alias("n"))


def p4_phrase(spark: SparkSession, d: str) -> DataFrame:
    return predicates.find_phrase(table(spark, d, "documents"), "doc_id", "text", "License", 10)


def p5_holding_lookup(spark: SparkSession, d: str) -> DataFrame:
    return holdings.lookup(inputs.holdings(spark, d), "and", "src3", "fr").select("holding_id", "layer")


def p6_saved_views(spark: SparkSession, d: str) -> DataFrame:
    return holdings.view_sizes(inputs.holdings(spark, d), F.lit("2024-06-01").cast("date"))


SIGNS = {"#": "NUMBER SIGN", "$": "DOLLAR SIGN", "%": "PERCENT SIGN"}


def p7_forbidden_characters(spark: SparkSession, d: str) -> DataFrame:
    hits = text.forbidden_characters(F.col("text"), SIGNS)
    found = inputs.lines(spark, d).filter(F.col("text").rlike("[#$%]"))
    rows = found.select("doc_key", (F.col("pos") + 1).alias("line"), F.explode(hits).alias("h"))
    return rows.select("doc_key", "line", "h.col", "h.char", "h.name", "h.context")


def p8_typography(spark: SparkSession, d: str) -> DataFrame:
    clean = text.replace_typography(F.col("text"), quotes=True, extra={"#": "-", "é": "e"})
    return table(spark, d, "documents").select("doc_id", F.md5(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


def p9_case_state(spark: SparkSession, d: str) -> DataFrame:
    return predicates.case_state(inputs.cases(spark, d), "F").select("case_id", "state", "violation")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return inputs.lines(spark, d).select(
        "doc_key", "pos", F.explode(patterns.detect(F.col("text"), patterns.LATIN_DETECTORS)).alias("x")
    ).select("doc_key", "pos", "x.category", "x.value")


def p10_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Values that stand in more than one document count as public."""
    found = _detections(spark, d)
    public = found.groupBy("value").agg(F.count_distinct("doc_key").alias("n")).filter("n > 1")
    return predicates.without_allowed(found, "value", public, "value")


def p11_identity_filter(spark: SparkSession, d: str) -> DataFrame:
    words = inputs.words(spark, d)
    kind = F.element_at(F.array(*[F.lit(x) for x in (*fv.IDENTITY_TYPES, "phone", "email")]), (F.col("seq") % 6 + 1).cast("int"))
    typed = words.withColumn("type", kind)
    kept = typed.filter(predicates.identifying(F.col("type"), F.col("text")))
    return kept.groupBy("doc_key", "type").agg(F.count(F.lit(1)).alias("n"))


def p4_posted_phrase(spark: SparkSession, d: str) -> DataFrame:
    """The phrase looked up in a posting table first; only texts that hold all its runs are opened."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = scratch_path(spark, "postings")
    postings.write_postings(docs, ["doc_id"], "text", path)
    return predicates.find_phrase(postings.texts_with(spark, path, docs, ["doc_id"], "text", "License"), "doc_id", "text", "License", 10)


QUERIES = {
    f.__name__: f
    for f in (
        p1_find, p2_search_fields, p3_section_search, p4_phrase, p4_posted_phrase, p5_holding_lookup, p6_saved_views, p7_forbidden_characters,
        p8_typography, p9_case_state, p10_allow_list, p11_identity_filter,
    )
}

DETECTIONS = inputs.LINES + ", found AS (" + " UNION ALL ".join(
    f"SELECT doc_key, pos, '{x.category}' AS category, unnest(regexp_extract_all(text, {sql_text(x.pattern)})) AS value FROM lines"
    for x in patterns.LATIN_DETECTORS
) + ")"
SEARCH_KEY = r"""regexp_replace(lower(translate({0}, '"''`׳״.,-–—()[]/\', '')), '\s+', '', 'g')"""

ORACLE = {
    "p1_find": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'bolt') OR contains(p_type, 'bolt')",
    "p2_search_fields": """
        SELECT p_partkey FROM part WHERE contains(lower(p_name), 'brand#2') OR contains(lower(p_type), 'brand#2')
            OR contains(lower(p_brand), 'brand#2')""",
    "p3_section_search": """
        WITH h AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[0-9]{3}')),
                                                 lambda l: trim(l)) AS m
                   FROM documents WHERE regexp_matches(text, '[0-9]{3}') ORDER BY doc_id LIMIT 40)
        SELECT doc_id, md5(array_to_string(m, chr(10))) AS digest, CAST(len(m) AS INTEGER) AS n FROM h""",
    "p4_phrase": """
        WITH h AS (SELECT doc_id FROM documents WHERE contains(text, 'License'))
        SELECT 'total' AS kind, count(*) AS value FROM h UNION ALL
        SELECT 'hit', doc_id FROM (SELECT doc_id FROM h ORDER BY doc_id LIMIT 10)""",
    "p5_holding_lookup": f"""
        WITH {inputs.HOLDINGS}, l AS (
          SELECT holding_id, CASE WHEN status = 'unverified' THEN (CASE WHEN contains(name, 'and') THEN 4 END)
              WHEN contains(name, 'and') THEN 1 WHEN subject = 'src3' THEN 2 WHEN list_contains(tags, 'fr') THEN 3 END AS layer FROM holdings)
        SELECT holding_id, layer FROM l WHERE layer IS NOT NULL""",
    "p6_saved_views": f"""
        WITH {inputs.HOLDINGS}, h AS (SELECT * FROM holdings WHERE type = 'holding')
        SELECT 'all' AS view, count(*) AS n_rows FROM h UNION ALL SELECT 'approved', count(*) FROM h WHERE status = 'approved'
        UNION ALL SELECT 'pending', count(*) FROM h WHERE status = 'pending'
        UNION ALL SELECT 'negative', count(*) FROM h WHERE negative_treatment = 'yes'
        UNION ALL SELECT 'unchecked', count(*) FROM h WHERE citations_checked IS NULL
        UNION ALL SELECT 'stale', count(*) FROM h WHERE DATE '2024-06-01' - citations_checked > 90
        UNION ALL SELECT 'tracking', count(*) FROM holdings WHERE type = 'tracking'
        UNION ALL SELECT 'by_decision', count(*) FROM h WHERE decision IS NOT NULL UNION ALL SELECT 'cards', count(*) FROM h""",
    "p7_forbidden_characters": f"""
        WITH {inputs.LINES}, c AS (
          SELECT doc_key, pos, text, unnest(list_filter(range(1, length(text) + 1), lambda i: contains('#$%', substr(text, i, 1)))) AS i
          FROM lines WHERE regexp_matches(text, '[#$%]'))
        SELECT doc_key, CAST(pos + 1 AS INTEGER) AS line, CAST(i AS INTEGER) AS col, substr(text, i, 1) AS char,
               CASE substr(text, i, 1) WHEN '#' THEN 'NUMBER SIGN' WHEN '$' THEN 'DOLLAR SIGN' ELSE 'PERCENT SIGN' END AS name,
               substr(text, greatest(1, i - 20), i + 21 - greatest(1, i - 20)) AS context FROM c""",
    "p8_typography": """
        WITH c AS (SELECT doc_id, text, translate(text, '—–―‒⸻⸺‘’“”#é', '------''''' || repeat(chr(34), 2) || '-e') AS t FROM documents)
        SELECT doc_id, md5(t) AS digest, t <> text AS changed FROM c""",
    "p9_case_state": f"""
        WITH {inputs.CASES}
        SELECT case_id, CASE WHEN status = '' AND close_date IS NULL THEN 'open' WHEN status = 'F' AND close_date IS NOT NULL THEN 'closed'
                        ELSE 'in progress' END AS state,
               CASE WHEN status = 'F' AND close_date IS NULL THEN 'closed without date'
                    WHEN status <> 'F' AND close_date IS NOT NULL THEN 'date without closed status' END AS violation FROM cases""",
    "p10_allow_list": f"""
        WITH {DETECTIONS}, public AS (SELECT value FROM found GROUP BY value HAVING count(DISTINCT doc_key) > 1),
        k AS (SELECT DISTINCT {SEARCH_KEY.format('value')} AS k FROM public)
        SELECT doc_key, CAST(pos AS INTEGER) AS pos, category, value FROM found WHERE {SEARCH_KEY.format('value')} NOT IN (SELECT k FROM k)""",
    "p11_identity_filter": f"""
        WITH {inputs.WORDS}, t AS (SELECT doc_key, (['name', 'id', 'address', 'account', 'phone', 'email'])[CAST(seq % 6 + 1 AS INTEGER)] AS type, text FROM words)
        SELECT doc_key, type, count(*) AS n FROM t
        WHERE type IN ('name', 'id', 'address', 'account') AND length({SEARCH_KEY.format('text')}) >= 4 GROUP BY ALL""",
}
ORACLE["p4_posted_phrase"] = ORACLE["p4_phrase"]
