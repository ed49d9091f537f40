"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.joins import READING, j21_read_ledger
from docketry.catalog.predicates import DETECTIONS, SIGNS, _detections
from docketry.functions import patterns
from docketry.operators import changes, entities, holdings, ledger, quality, rulebooks
from docketry.sources.tables import table

SIGN_SEVERITY = {"#": "RED", "$": "ORANGE", "%": "GREEN"}


def sign_findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding per document line and sign it holds."""
    lines = inputs.lines(spark, d)
    signs = F.array(*[
        F.struct(F.lit(c).alias("sign"), F.lit(SIGNS[c]).alias("check"), F.lit(s).alias("severity")) for c, s in SIGN_SEVERITY.items()
    ])
    found = F.filter(signs, lambda x: F.contains(F.col("text"), x["sign"]))
    return lines.select("doc_key", "pos", F.explode(found).alias("f")).select("doc_key", "pos", "f.check", "f.severity")


def a1_overall_status(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"))
    return quality.overall_status(sign_findings(spark, d), subjects, "doc_key")


def a2_findings_table(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings_table(sign_findings(spark, d))


def a3_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "text")
    found = docs.select("source", F.explode(patterns.detect(F.col("text"), patterns.LATIN_DETECTORS)).alias("x"))
    return found.groupBy("source", "x.category").agg(F.count(F.lit(1)).alias("n"))


def _forty_line_pages(spark: SparkSession, d: str) -> DataFrame:
    return inputs.lines(spark, d).select("doc_key", (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page")).distinct()


def a4_page_confidence(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_confidence(_forty_line_pages(spark, d), inputs.words(spark, d))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("doc_key"), F.when(i % 3 == 0, "native").otherwise("ocr").alias("method"),
        F.when(i % 10 == 0, "failed").otherwise("pending").alias("status"),
    )


def _report(spark: SparkSession, d: str) -> DataFrame:
    confidence = a4_page_confidence(spark, d).filter("doc_key % 10 <> 1")
    return quality.document_report(_manifest(spark, d), confidence, 49.0)


def a5_document_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


def a5_status_totals(spark: SparkSession, d: str) -> DataFrame:
    return quality.status_totals(_report(spark, d))


def a6_ocr_routing(spark: SparkSession, d: str) -> DataFrame:
    metrics = quality.text_metrics(inputs.line_pages(spark, d), inputs.words(spark, d))
    routed = quality.acceptance(metrics.withColumn("mean_confidence", F.col("mean_confidence") + 11))
    return routed.select("doc_key", "chars_per_page", "valid_ratio", "engine", F.array_join("reasons", ",").alias("reasons"))


def a7_text_layer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"))
    return quality.text_layer(inputs.line_pages(spark, d), docs, 60)


def a8_coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    return ledger.coverage(j21_read_ledger(spark, d))


PHRASES = {"roadmap": ["The ", "thand"], "interim": ["eaux", "tion of"]}
WORDS = {"leil": "and", "achen": r"(^|\s)of[ ,]"}
RESTATE = "^(The|And|Le) "


def a9_writing_metrics(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = inputs.lines(spark, d).withColumn("is_heading", F.size(F.split("text", " ")) <= 2).withColumn("is_quote", F.col("pos") % 11 == 10)
    return quality.writing_metrics(paragraphs, PHRASES, WORDS, RESTATE, terms="License|eaux|heith|thand|ition", frame=["thand"])


def a10_library_statistics(spark: SparkSession, d: str) -> DataFrame:
    library = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("topics"), F.col("p_size").alias("use_count"))
    return changes.registry_statistics(library, "p_partkey")


def a11_numbering_style(spark: SparkSession, d: str) -> DataFrame:
    style = patterns.numbering_style(F.col("text"), "License", "[0-9]{2,}", ("letters", "numbers"))
    return table(spark, d, "documents").select("doc_id", style.alias("style"))


def a12_run_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"))
    plan = _detections(spark, d)
    checks = docs.filter("doc_key % 4 <> 0").withColumn(
        "residuals", F.when(F.col("doc_key") % 5 != 0, (F.col("doc_key") % 3).cast("long"))
    )
    return entities.run_summary(docs, plan, checks)


def a13_citation_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    treatment = F.when(F.col("event_type") == "error", "rejected").when(
        (F.col("event_type") == "view") & (F.col("value") > 30), None
    ).otherwise("applied")
    citers = e.select(F.floor(F.col("event_id") / 3).alias("decision"), F.col("event_id").alias("citer"), treatment.alias("treatment"))
    decisions = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 4).alias("decision"))
    return holdings.citation_status(decisions, citers, ["rejected", "narrowed"])


def a13_holding_flags(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    treatment = F.when(F.col("event_type") == "error", "rejected").when(
        (F.col("event_type") == "view") & (F.col("value") > 30), None
    ).otherwise("applied")
    citers = e.select(
        F.floor(F.col("event_id") / 3).alias("decision"), F.col("event_id").alias("citer"), treatment.alias("treatment"),
        F.when(F.col("event_id") % 3 > 0, F.floor(F.col("event_id") / 3) * 4 + F.col("event_id") % 3).alias("holding_id"),
    )
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("holding_id"), F.floor(F.col("o_orderkey") / 4).alias("decision"))
    return holdings.holding_flags(held, citers, ["rejected", "narrowed"])


ITEMS = list(fv.RUBRIC_MAX_POINTS)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    item = F.element_at(F.array(*[F.lit(i) for i in [*ITEMS[:6], "unknown item"]]), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("rater"), item.alias("item"),
        (F.col("l_quantity") % 4).cast("int").alias("points"),
    )


def a14_rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    return rulebooks.rubric_scores(_answers(spark, d))


def a14_criteria_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", rulebooks.criteria_points(F.col("p_size") % 11).alias("points"), rulebooks.duration_years(F.col("p_size")).alias("years")
    )


def a15_rater_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rulebooks.compare_raters(_answers(spark, d), "A", "R")


SERVICES = [*fv.PENSION_PERCENT, *fv.GRANT_PERCENT, *fv.FIXED_FEES, "not listed"]


def _fee_claims(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    which = F.when(c % 4 == 0, k).otherwise(c) % len(SERVICES)  # a quarter of the events name several services
    return table(spark, d, "orders").select(
        c.alias("event_id"),
        F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (which + 1).cast("int")).alias("service"),
        (F.col("o_totalprice").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("monthly"),
        F.when(k % 3 > 0, (k % 90).cast("int")).alias("eligible_months"),
        F.when(k % 5 > 0, (k % 70).cast("int")).alias("months_to_pension"),
        F.col("o_totalprice").alias("grant"),
    )


def a16_fee_caps(spark: SparkSession, d: str) -> DataFrame:
    caps = rulebooks.fee_caps(_fee_claims(spark, d))
    money = ["pension_base", "grant_sum", "cap_with_fee", "cap_without_fee"]
    return caps.select("event_id", "service", "uncovered", "mixed", *[F.col(c).cast("double").alias(c) for c in money])


QUERIES = {
    f.__name__: f
    for f in (
        a1_overall_status, a2_findings_table, a3_entity_counts, a4_page_confidence, a5_document_report, a5_status_totals, a6_ocr_routing,
        a7_text_layer, a8_coverage_gate, a9_writing_metrics, a10_library_statistics, a11_numbering_style, a12_run_summary,
        a13_citation_status, a13_holding_flags, a14_rubric_scores, a14_criteria_points, a15_rater_comparison, a16_fee_caps,
    )
}

FINDINGS = inputs.LINES + ", findings AS (" + " UNION ALL ".join(
    f"SELECT doc_key, pos, '{SIGNS[c]}' AS \"check\", '{s}' AS severity FROM lines WHERE contains(text, '{c}')" for c, s in SIGN_SEVERITY.items()
) + ")"
PAGE_CONF = inputs.WORDS + """,
pages40 AS (SELECT DISTINCT doc_key, pos // 40 + 1 AS page FROM lines),
conf AS (SELECT p.doc_key, p.page, coalesce(round_even(avg(conf) FILTER (conf >= 0), 1), 0.0::DOUBLE) AS confidence
         FROM pages40 p LEFT JOIN words w ON p.doc_key = w.doc_key AND p.page = w.page GROUP BY ALL)
"""
REPORT = PAGE_CONF + """,
per AS (SELECT doc_key, round_even(avg(confidence), 1) AS m, count(*) FILTER (confidence < 49) AS low, min(page) FILTER (confidence < 49) AS f
        FROM conf WHERE doc_key % 10 <> 1 GROUP BY doc_key),
report AS (SELECT doc_id AS doc_key, CASE WHEN doc_id % 10 <> 0 THEN m END AS mean_confidence, CASE WHEN doc_id % 10 <> 0 AND m IS NOT NULL THEN low END AS low_pages,
                  CASE WHEN doc_id % 10 <> 0 THEN CAST(f AS INTEGER) END AS first_low_page,
                  CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN m IS NULL THEN 'pending' WHEN doc_id % 3 = 0 THEN 'done'
                       WHEN low > 0 THEN 'low_confidence' ELSE 'done' END AS status
           FROM documents LEFT JOIN per ON doc_key = doc_id)
"""
_ITEM_MAX = "CASE item " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.RUBRIC_MAX_POINTS.items()) + " END"
_ANSWERS = f"""
answers AS (SELECT l_orderkey AS subject, l_returnflag AS rater, ({inputs.sql_list([*ITEMS[:6], 'unknown item'])})[l_linenumber] AS item,
                   CAST(l_quantity % 4 AS INTEGER) AS points FROM lineitem)
"""


def _band(total: str) -> str:
    return "CASE " + " ".join(f"WHEN {total} BETWEEN {a} AND {b} THEN {p}" for a, b, p in fv.RUBRIC_BANDS) + " END"


def _half_even(amount: str) -> str:
    return f"({amount}) // 10000 + CASE WHEN ({amount}) % 10000 > 5000 OR (({amount}) % 10000 = 5000 AND (({amount}) // 10000) % 2 = 1) THEN 1 ELSE 0 END"


_FEES = "[" + ", ".join(f"{{'s': '{k}', 'w': {int(float(v[0]) * 100)}, 'o': {int(float(v[2]) * 100)}}}" for k, v in fv.PENSION_PERCENT.items()) + "]"
_FIXED = "[" + ", ".join(f"{{'s': '{k}', 'a': {int(float(v) * 100)}}}" for k, v in fv.FIXED_FEES.items()) + "]"
_GRANTS = "[" + ", ".join(f"{{'s': '{k}', 'w': {int(float(v[0]) * 100)}, 'o': {int(float(v[1]) * 100)}}}" for k, v in fv.GRANT_PERCENT.items()) + "]"

ORACLE = {
    "a1_overall_status": f"""
        WITH {FINDINGS}, w AS (SELECT doc_key, bool_or(severity = 'RED') AS r, bool_or(severity = 'ORANGE') AS o FROM findings GROUP BY doc_key)
        SELECT doc_id AS doc_key, CASE WHEN r THEN 'fail' WHEN o THEN 'pass with notes' ELSE 'pass' END AS status
        FROM documents LEFT JOIN w ON doc_key = doc_id""",
    "a2_findings_table": f"""
        WITH {FINDINGS} SELECT "check", count(*) FILTER (severity = 'DOUBLE_RED') AS double_red, count(*) FILTER (severity = 'RED') AS red,
               count(*) FILTER (severity = 'ORANGE') AS orange, count(*) FILTER (severity = 'GREEN') AS green FROM findings GROUP BY "check" """,
    "a3_entity_counts": "WITH f AS ("
    + " UNION ALL ".join(
        f"SELECT source, '{x.category}' AS category, unnest(regexp_extract_all(text, {inputs.sql_text(x.pattern)})) AS v FROM documents"
        for x in patterns.LATIN_DETECTORS
    )
    + ") SELECT source, category, count(*) AS n FROM f GROUP BY ALL",
    "a4_page_confidence": f"WITH {PAGE_CONF} SELECT doc_key, CAST(page AS INTEGER) AS page, confidence FROM conf",
    "a5_document_report": f"WITH {REPORT} SELECT * FROM report",
    "a5_status_totals": f"""
        WITH {REPORT} SELECT count(*) AS documents, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'low_confidence') AS low_confidence,
               count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM report""",
    "a6_ocr_routing": rf"""
        WITH {inputs.WORDS},
        c AS (SELECT doc_key, round_even(avg(conf), 1) + 11 AS m FROM words WHERE conf >= 0 GROUP BY doc_key),
        p AS (SELECT doc_key, count(*) AS n, sum(length(text)) + 2 * (count(*) - 1) AS chars,
                     sum(length(regexp_replace(text, '[^\x{{0590}}-\x{{05FF}}A-Za-z0-9\s.,;:!?()\[\]{{}}\-–"''/\\%&@#*+=°₪$]', '', 'g'))) + 2 * (count(*) - 1) AS valid
              FROM lines GROUP BY doc_key),
        k AS (SELECT p.doc_key, coalesce(m, 11.0) AS m, round_even(chars / n, 1) AS chars_per_page,
                     round_even(CASE WHEN chars > 0 THEN valid / chars ELSE 0.0 END, 3) AS valid_ratio FROM p LEFT JOIN c ON p.doc_key = c.doc_key),
        r AS (SELECT *, array_to_string(list_filter([CASE WHEN m < 60 THEN 'low_confidence' END, CASE WHEN chars_per_page < 80 THEN 'little_text' END,
                     CASE WHEN valid_ratio < 0.75 THEN 'invalid_characters' END], lambda v: v IS NOT NULL), ',') AS reasons FROM k)
        SELECT doc_key, chars_per_page, valid_ratio, CASE WHEN reasons = '' THEN 'local' ELSE 'fallback' END AS engine, reasons FROM r""",
    "a7_text_layer": f"""
        WITH {inputs.LINES}, c AS (SELECT doc_key, count(*) AS n, count(*) FILTER (length(trim(text)) >= 60) AS w FROM lines GROUP BY doc_key)
        SELECT doc_key, n AS pages, CASE WHEN w / n >= 0.8 THEN 'text' WHEN w / n <= 0.2 THEN 'image' ELSE 'mixed' END AS kind,
               round_even(w / n, 3) AS text_ratio FROM c""",
    "a8_coverage_gate": f"""
        WITH {READING}, r AS (SELECT DISTINCT i.doc_id, i.ten FROM issued i JOIN confirms c ON i.code_a = c.code_a AND i.code_b = c.code_b),
        u AS (SELECT doc_key, pos + 1 AS n, r.doc_id IS NOT NULL AS done FROM lines LEFT JOIN r ON r.doc_id = doc_key AND r.ten = pos // 10),
        g AS (SELECT doc_key, n, n - row_number() OVER (PARTITION BY doc_key ORDER BY n) AS g FROM u WHERE NOT done),
        s AS (SELECT doc_key, min(n) AS a, CASE WHEN min(n) = max(n) THEN CAST(min(n) AS VARCHAR) ELSE min(n) || '-' || max(n) END AS t FROM g GROUP BY doc_key, g),
        m AS (SELECT doc_key, string_agg(t, ', ' ORDER BY a) AS missing FROM s GROUP BY doc_key)
        SELECT u.doc_key AS doc_id, count(*) AS units, count(*) FILTER (done) AS read_units, bool_and(done) AS passes, any_value(missing) AS missing
        FROM u LEFT JOIN m ON u.doc_key = m.doc_key GROUP BY u.doc_key""",
    "a9_writing_metrics": rf"""
        WITH {inputs.LINES}, q AS (SELECT doc_key, pos, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS k, len(string_split(text, ' ')) <= 2 AS hd FROM lines),
        p AS (SELECT *, hd OR pos % 11 = 10 AS h FROM q),
        o AS (SELECT DISTINCT doc_key, pos, unnest(regexp_extract_all(text, 'License|eaux|heith|thand|ition')) AS term FROM p WHERE NOT h),
        cl AS (SELECT doc_key, term, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_key, term ORDER BY pos) <= 4 THEN 0 ELSE 1 END AS s FROM o WHERE term <> 'thand'),
        sc AS (SELECT doc_key, count(*) AS n FROM (SELECT doc_key, term FROM cl GROUP BY ALL HAVING sum(s) >= 2) GROUP BY doc_key),
        w AS (SELECT doc_key,
          sum(CASE WHEN h OR k = '' THEN 0 ELSE len(string_split(k, ' ')) END) AS words, count(*) FILTER (hd AND length(trim(text)) > 0) AS headings,
          coalesce((SELECT n FROM sc WHERE sc.doc_key = p.doc_key), 0) AS scattered,
          sum(CASE WHEN h THEN 0 ELSE CAST(contains(text, 'The ') AS INTEGER) + CAST(contains(text, 'thand') AS INTEGER) END) AS roadmap,
          sum(CASE WHEN h THEN 0 ELSE CAST(contains(text, 'eaux') AS INTEGER) + CAST(contains(text, 'tion of') AS INTEGER) END) AS interim,
          sum(CASE WHEN h THEN 0 ELSE len(regexp_extract_all(text, 'and')) END) AS leil,
          sum(CASE WHEN h THEN 0 ELSE CAST(regexp_matches(text, '(^|\s)of[ ,]') AS INTEGER) END) AS achen,
          count(*) FILTER (NOT h AND regexp_matches(text, '^(The|And|Le) ')) AS restate FROM p GROUP BY doc_key),
        l AS ({" UNION ALL ".join(f"SELECT doc_key, '{m}' AS metric, CAST({m} AS BIGINT) AS value, {fv.WRITING_LIMITS[m]} AS \"limit\" FROM w" for m in ("words", "headings", "roadmap", "interim", "leil", "achen", "restate", "scattered"))})
        SELECT *, value <= "limit" AS within FROM l""",
    "a10_library_statistics": """
        SELECT count(*) AS entries, (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part)) AS topics,
               CAST(sum(p_size) AS BIGINT) AS total_use, arg_min(p_partkey, (-p_size, p_partkey)) AS most_used FROM part""",
    "a11_numbering_style": """
        SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[0-9]{2,}')) > len(regexp_extract_all(text, 'License')) THEN 'numbers' ELSE 'letters' END AS style
        FROM documents""",
    "a12_run_summary": f"""
        WITH {DETECTIONS}
        SELECT count(*) AS documents, (SELECT count(*) FROM found) AS redactions, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 <> 0) AS verified_documents,
               count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 = 0) AS verification_errors, count(*) FILTER (doc_id % 4 = 0) AS not_checked,
               CAST(sum(CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN doc_id % 3 END) AS BIGINT) AS residuals FROM documents""",
    "a13_citation_status": """
        WITH c AS (SELECT event_id // 3 AS decision, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'view' AND value > 30 THEN NULL ELSE 'applied' END AS t FROM events),
        s AS (SELECT decision, count(*) AS n, bool_or(coalesce(t = 'rejected', false)) AS hit, bool_and(t IS NOT NULL) AS every FROM c GROUP BY decision)
        SELECT d.decision, coalesce(n, 0) AS citations_count, CASE WHEN hit THEN 'yes' WHEN every THEN 'no' ELSE 'unknown' END AS negative_treatment
        FROM (SELECT DISTINCT o_orderkey // 4 AS decision FROM orders) d LEFT JOIN s ON d.decision = s.decision""",
    "a13_holding_flags": """
        WITH c AS (SELECT event_id // 3 AS decision, CASE WHEN event_id % 3 > 0 THEN event_id // 3 * 4 + event_id % 3 END AS holding_id,
                          CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'view' AND value > 30 THEN NULL ELSE 'applied' END AS t FROM events),
        s AS (SELECT decision, count(*) = count(t) AS every, count(*) FILTER (t = 'rejected' AND holding_id IS NULL) > 0 AS whole FROM c GROUP BY decision)
        SELECT o_orderkey AS holding_id, o_orderkey // 4 AS decision, s.decision IS NOT NULL AS checked,
               CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.decision = o_orderkey // 4 AND c.holding_id = o_orderkey AND t = 'rejected') THEN 'yes'
                    WHEN every AND NOT whole THEN 'no' ELSE 'unknown' END AS negative_treatment
        FROM orders LEFT JOIN s ON s.decision = o_orderkey // 4""",
    "a14_rubric_scores": f"""
        WITH {_ANSWERS}, v AS (SELECT subject, item, max(points) AS points FROM answers WHERE points BETWEEN 0 AND {_ITEM_MAX} GROUP BY ALL),
        t AS (SELECT subject, CAST(sum(points) AS INTEGER) AS total, count(*) AS n FROM v GROUP BY subject),
        e AS (SELECT DISTINCT subject FROM answers)
        SELECT e.subject, total, {_band('total')} AS percent, CASE WHEN total < 10 THEN 10 - total WHEN total < 19 THEN 19 - total END AS to_next_band,
               CAST(13 - coalesce(n, 0) AS INTEGER) AS missing_items FROM e LEFT JOIN t ON e.subject = t.subject""",
    "a14_criteria_points": """
        SELECT p_partkey, CASE WHEN p_size % 11 < 6 THEN 0 WHEN p_size % 11 = 6 THEN 1 WHEN p_size % 11 = 7 THEN 2 WHEN p_size % 11 < 10 THEN 3 END AS points,
               CASE WHEN p_size < 14 THEN 2 END AS years FROM part""",
    "a15_rater_comparison": f"""
        WITH {_ANSWERS}, s AS (SELECT subject, item, max(points) FILTER (rater = 'A') AS ours, max(points) FILTER (rater = 'R') AS theirs FROM answers GROUP BY ALL),
        t AS (SELECT subject, CAST(sum(ours) AS INTEGER) AS our_total, CAST(sum(theirs) AS INTEGER) AS their_total FROM s GROUP BY subject)
        SELECT s.subject, item, ours, theirs, ours - theirs AS gap, our_total, their_total, {_band('our_total')} <> {_band('their_total')} AS crosses_band
        FROM s JOIN t ON s.subject = t.subject""",
    "a16_fee_caps": f"""
        WITH k AS (SELECT o_custkey AS event_id,
                          ({inputs.sql_list(SERVICES)})[CAST(CASE WHEN o_custkey % 4 = 0 THEN o_orderkey ELSE o_custkey END % {len(SERVICES)} + 1 AS INTEGER)] AS service,
                          CAST(o_totalprice AS DECIMAL(18,2)) AS g, o_orderkey AS k FROM orders),
        b AS (SELECT event_id, service, CAST(g * 100 AS BIGINT) AS cents, CAST(round(CAST(g AS DECIMAL(20,4)) / 100, 2) * 100 AS BIGINT) AS m,
                     least(60, coalesce(CASE WHEN k % 3 > 0 THEN k % 90 END, 60), coalesce(CASE WHEN k % 5 > 0 THEN k % 70 END, 60)) AS months FROM k),
        s AS (SELECT event_id, CASE WHEN count(DISTINCT service) = 1 THEN min(service) END AS service, count(DISTINCT service) > 1 AS mixed, CAST(sum((cents // 100 + CASE WHEN cents % 100 >= 50 THEN 1 ELSE 0 END) * months) AS BIGINT) AS base, CAST(sum(cents) AS BIGINT) AS gr FROM b GROUP BY event_id),
        f AS (SELECT unnest({_FEES}) AS f), h AS (SELECT unnest({_GRANTS}) AS h), x AS (SELECT unnest({_FIXED}) AS x)
        SELECT event_id, service, mixed, NOT mixed AND f IS NULL AND h IS NULL AND x IS NULL AS uncovered, base / 100 AS pension_base, gr / 100 AS grant_sum,
          CASE WHEN f IS NOT NULL THEN ({_half_even('base * f.w')} + 96100 + CASE WHEN base < 60 * 144000 THEN 96100 ELSE 0 END) / 100
               WHEN h IS NOT NULL THEN ({_half_even('gr * h.w')} + 96100) / 100 WHEN x IS NOT NULL THEN x.a / 100 END AS cap_with_fee,
          CASE WHEN f IS NOT NULL THEN ({_half_even('base * f.o')}) / 100 WHEN h IS NOT NULL THEN ({_half_even('gr * h.o')}) / 100 WHEN x IS NOT NULL THEN x.a / 100 END AS cap_without_fee
        FROM s LEFT JOIN f ON f.s = service LEFT JOIN h ON h.s = service LEFT JOIN x ON x.s = service""",
}
