"""Ordered work: lines, blocks, islands, numbering, ranking, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.joins import _plan_boxes
from docketry.catalog.predicates import DETECTIONS, _detections
from docketry.catalog.aggregates import FINDINGS, sign_findings
from docketry.catalog.text import LATIN_APPENDIX
from docketry.functions.arrays import lines_of, matches
from docketry.functions.text import comparison_key
from docketry.operators import cases, changes, entities, forms, holdings, layout, matching, ordered, quality, rulebooks, structure
from docketry.session import scratch_path
from docketry.sources import keyed
from docketry.sources.tables import table


def w1_printed_lines(spark: SparkSession, d: str) -> DataFrame:
    lined = layout.group_lines(inputs.words(spark, d))
    return lined.groupBy("doc_key", "page", "line").agg(F.count(F.lit(1)).alias("words"), F.min("seq").alias("first_seq"))


def plain_opening(line: Column) -> Column:
    """Short lines as headings, medium lines as sections, by word count."""
    n = F.size(F.split(line, " "))
    level = F.when(n == 1, 2).when(n == 2, 3).when(n <= 4, 4)
    built = F.struct(
        F.when(n <= 4, "heading").otherwise("section").alias("kind"), level.alias("level"),
        F.length(line).cast("string").alias("num"), F.trim(line).alias("title"), F.lit(None).cast("string").alias("amend"),
    )
    return F.when(n <= 9, built)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return structure.blocks(table(spark, d, "documents"), "doc_id", "text", plain_opening)


def w2_heading_context(spark: SparkSession, d: str) -> DataFrame:
    sections = structure.sections_in_context(table(spark, d, "documents"), "doc_id", "text", plain_opening, (2, 3, 4))
    return sections.select("doc_id", "pos", F.array_join("context", " > ").alias("context"))


def w3_section_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc_id", "pos", "kind", "num", F.md5("body").alias("digest"))


SCATTER_TERMS = ["License", "thand", "eaux", "ition", "heith"]


def w4_scattered_terms(spark: SparkSession, d: str) -> DataFrame:
    found = F.filter(F.array(*[F.lit(t) for t in SCATTER_TERMS]), lambda t: F.contains(F.col("text"), t))
    occurrences = inputs.lines(spark, d).select("doc_key", F.explode(found).alias("term"), "pos")
    return quality.scattered_terms(occurrences)


def w5_number_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The numbers to be written as ranges are those of a document's short lines."""
    short = inputs.lines(spark, d).filter(F.length("text") < 120)
    return ordered.ranges(short.select("doc_key", (F.col("pos") + 1).alias("n")), ["doc_key"], "n")


def w6_bundle_layout(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("pages"))
    order = [F.col(c) for c in ("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "pages")]
    placed = layout.bundle_layout(items, ["l_orderkey"], order, "pages", F.floor(F.col("l_partkey") / 500), 3)
    return placed.select("l_orderkey", "l_partkey", "l_linenumber", "cover_page", "start_page", "end_page")


def w7_instruction_blocks(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), lines_of(F.translate("text", ",.", "<>")).alias("paras"))
    found = quality.instruction_blocks(documents)
    return found.select("doc_key", "first_pos", "last_pos", "span", F.md5("instruction").alias("digest"))


MARKERS = ["The ", "Of ", "Le "]


def w8_operative_tail(spark: SparkSession, d: str) -> DataFrame:
    tail = quality.operative_tail(inputs.lines(spark, d), ["doc_key"], MARKERS)
    return tail.select("doc_key", "pos", "first_pos")


def w9_current_stage(spark: SparkSession, d: str) -> DataFrame:
    return cases.current_stage(inputs.flow(spark, d))


def w9_stage_durations(spark: SparkSession, d: str) -> DataFrame:
    return cases.stage_durations(inputs.flow(spark, d)).select("flow_id", "case_id", "node_id", "seconds")


def _case_pointers(spark: SparkSession, d: str) -> DataFrame:
    flow = inputs.flow(spark, d)
    return flow.groupBy("case_id").agg(F.max("flow_id").alias("hi"), F.min("flow_id").alias("lo")).select(
        "case_id", F.when(F.col("case_id") % 4 == 0, F.col("lo")).otherwise(F.col("hi")).alias("current_flow_id")
    )


STAGE_MODELS = {
    22: [("view", "opened"), ("click", "heard"), ("purchase", "decided")],
    24: [("view", "opened"), ("signup", "registered"), ("error", "returned")],
}


def w9_stage_catalog(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("case_id") % 3 == 0, 22).when(F.col("case_id") % 3 == 1, 24).otherwise(99)
    return cases.stage_catalog(_case_pointers(spark, d).withColumn("kind", kind), inputs.flow(spark, d), STAGE_MODELS)


def w9_pointer_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return cases.stage_pointer_mismatches(_case_pointers(spark, d), inputs.flow(spark, d))


def _new_cases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    return cases.number_new_cases(e, inputs.cases(spark, d), [F.col("request_id")])


def w10_case_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _new_cases(spark, d).select("request_id", "case_num", "case_num_sort")


def w11_paragraph_numbers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("doc_key"), F.filter(lines_of(F.col("text")), lambda p: F.length(F.trim(p)) > 0).alias("paras")
    )
    return holdings.internal_references(docs, "([0-9]{1,4})")


CATALOG_NAMES = ["red ring", "small widget", "blue bolts", "steel gear", "ring", "green plate", "large cog wheel", "widget"]


def t1_similar_names(spark: SparkSession, d: str) -> DataFrame:
    return cases.similar_names(table(spark, d, "part"), "p_name", CATALOG_NAMES)


def t2_box_dedupe(spark: SparkSession, d: str) -> DataFrame:
    words = inputs.words(spark, d).select("doc_key", "page", "left", "top", "width", "height", F.lit("WORD").alias("category"), F.col("text").alias("value"))
    plan = _plan_boxes(spark, d).withColumn("category", F.lit("PLAN")).withColumn("value", F.lit("plan"))
    return layout.dedupe_boxes(words.unionByName(plan)).groupBy("doc_key", "page", "category").agg(F.count(F.lit(1)).alias("kept"))


def t4_ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    found = sign_findings(spark, d).withColumn("rank", quality.severity_rank(F.col("severity")))
    return quality.ordered_findings(found)


def t5_reading_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    citers = e.select(
        F.col("user_id").alias("decision"), F.col("event_id").alias("citer"), F.col("event_type").alias("court"),
        F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("day"), (F.col("value") < 20).alias("is_list"),
    )
    return holdings.reading_order(citers, ["purchase", "error"]).select("decision", "citer", "reading_rank")


def t6_near_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = _blocks(spark, d).filter("kind = 'section'")
    return structure.near_sections(sections, "doc_id", "45")


def t7_latest_revision(spark: SparkSession, d: str) -> DataFrame:
    revisions = table(spark, d, "events").select(
        F.col("user_id").alias("title"), F.col("ts").alias("timestamp"), F.col("event_id").alias("revid"), F.col("event_type").alias("text")
    )
    return structure.latest_revision(revisions, "title", F.lit("2024-02-05").cast("timestamp")).select("title", "revid", "text", "fresh")


NAMES = "[A-Z][a-z]{4,}"


def _version_names(spark: SparkSession, d: str, side: str) -> DataFrame:
    v = inputs.versions(spark, d).filter(F.col("side") == side)
    return v.select("pair_id", F.explode(matches(comparison_key(F.col("text")), NAMES)).alias("ref"))


def d1_reference_difference(spark: SparkSession, d: str) -> DataFrame:
    sides = matching.reconcile(_version_names(spark, d, "original"), _version_names(spark, d, "reordered"), ["pair_id"], "ref")
    return sides.filter("side <> 'matched'").select("pair_id", "ref", F.when(F.col("side") == "orphaned", "lost").otherwise("invented").alias("change"))


def d2_first_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = None
    for i, (family, pattern) in enumerate(LATIN_APPENDIX):
        found = inputs.lines(spark, d).select(
            "doc_key", "pos", F.posexplode(matches(F.col("text"), pattern, 1)).alias("at", "ref_id")
        ).select("doc_key", "pos", "ref_id", F.lit(i).alias("priority"), "at", F.lit(family).alias("family"))
        hits = found if hits is None else hits.unionByName(found)
    return matching.first_hits(hits, ["doc_key", "pos", "ref_id"], ["priority", "at"]).select("doc_key", "pos", "ref_id", "family")


def d3_merged_citers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    one = e.select(F.col("user_id").alias("decision"), (F.col("event_id") % 200).alias("citer"))
    two = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("decision"), (F.col("o_orderkey") % 200).alias("citer"))
    return holdings.merge_citers([one, two])


def d4_detector_union(spark: SparkSession, d: str) -> DataFrame:
    found = _detections(spark, d).select("doc_key", "category", "value")
    forced = inputs.lines(spark, d).filter(F.contains("text", F.lit("License"))).select("doc_key", F.lit("NAME").alias("category"), F.lit("License").alias("value"))
    merged = entities.merge_detectors(patterns=found, names=forced)
    return merged.groupBy("detector", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_key").alias("documents"))


TEMPLATE = "Dear ${name}, segment ${segment}.\n${chk_urgency_urgent} urgent ${chk_vip} vip\nItems:\n${items}\n${note}"


def template_data() -> Column:
    vip = F.when(F.col("c_acctbal") > 5000, F.array(F.lit("x"))).otherwise(F.lit([]).cast("array<string>"))
    note = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("late"))).otherwise(F.array(F.lit("")))
    return F.create_map(
        F.lit("name"), F.array("c_name"), F.lit("segment"), F.array("c_mktsegment"), F.lit("chk_vip"), vip,
        F.lit("chk_urgency_urgent"), vip, F.lit("items"), F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")),
        F.lit("note"), note, F.lit("surplus"), F.array(F.lit("1")),
    )


def d5_template_keys(spark: SparkSession, d: str) -> DataFrame:
    audit = forms.template_audit(forms.placeholders(F.lit(TEMPLATE)), template_data())
    return table(spark, d, "customer").select("c_custkey", *[F.array_join(c, ",").alias(n) for n, c in audit.items()])


def d6_stage_documents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    early = o.filter("o_orderdate < '1998-01-01'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("document"))
    late = o.filter("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("document"))
    return rulebooks.stage_changes(early, late, ["case_id", "document"])


def d7_append_absent(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    more = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    return changes.append_absent(target, more, ["c_custkey"])


def d7_written_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the target in buckets of its key: absent rows are added to the buckets they belong to."""
    target = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    more = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    path = scratch_path(spark, "segments")
    keyed.create_keyed(target, path, ["c_custkey"])
    keyed.rewrite(spark, path, target.schema, ["c_custkey"], [more.select("c_custkey")], lambda rows: changes.append_absent(rows, more, ["c_custkey"]))
    return keyed.read_keyed(spark, path, target.schema)


QUERIES = {
    f.__name__: f
    for f in (
        w1_printed_lines, w2_heading_context, w3_section_bodies, w4_scattered_terms, w5_number_ranges, w6_bundle_layout, w7_instruction_blocks,
        w8_operative_tail, w9_current_stage, w9_stage_durations, w9_stage_catalog, w9_pointer_mismatches, w10_case_numbers, w11_paragraph_numbers,
        t1_similar_names, t2_box_dedupe, t4_ordered_findings, t5_reading_order, t6_near_sections, t7_latest_revision,
        d1_reference_difference, d2_first_hits, d3_merged_citers, d4_detector_union, d5_template_keys, d6_stage_documents, d7_append_absent,
        d7_written_rows,
    )
}

BLOCKS = inputs.LINES + """,
opened AS (
  SELECT doc_key AS doc_id, pos AS line_pos, text, len(string_split(text, ' ')) AS n FROM lines),
marked AS (
  SELECT *, CASE WHEN n <= 4 THEN 'heading' WHEN n <= 9 THEN 'section' END AS kind,
         CASE WHEN n = 1 THEN 2 WHEN n = 2 THEN 3 WHEN n <= 4 THEN 4 END AS level,
         sum(CASE WHEN n <= 9 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_pos) AS block FROM opened),
blocks AS (
  SELECT doc_id, CAST(block AS INTEGER) AS pos, arg_min(kind, line_pos) AS kind, arg_min(level, line_pos) AS level,
         CAST(length(arg_min(text, line_pos)) AS VARCHAR) AS num, trim(arg_min(text, line_pos)) AS title,
         string_agg(text, chr(10) ORDER BY line_pos) AS body
  FROM marked WHERE block > 0 GROUP BY doc_id, block)
"""
_SIM = """
x AS (SELECT DISTINCT p_name FROM part), c AS (SELECT unnest({names}) AS name),
s AS (SELECT p_name, name, string_split(p_name, ' ') AS a, string_split(name, ' ') AS b FROM x, c),
v AS (SELECT p_name, name, len(list_filter(a, lambda w: list_contains(b, w))) / len(list_distinct(list_concat(a, b))) AS jac,
             CASE WHEN contains(p_name, name) OR contains(name, p_name)
                  THEN least(1.0::DOUBLE, least(length(p_name), length(name)) / greatest(length(p_name), length(name)) + 0.3::DOUBLE) ELSE 0.0 END AS cont,
             1 - levenshtein(p_name, name) / greatest(length(p_name), length(name)) AS ed FROM s),
r AS (SELECT p_name, name, CASE WHEN p_name = name THEN 1.0::DOUBLE ELSE round_even(least(1.0::DOUBLE, greatest(jac, cont, ed)), 2) END AS score FROM v)
""".replace("{names}", inputs.sql_list(CATALOG_NAMES))


def _names_sql(side: str) -> str:
    return f"SELECT DISTINCT pair_id, unnest(regexp_extract_all(text, '{NAMES}')) AS ref FROM {side}"


ORACLE = {
    "w1_printed_lines": f"""
        WITH {inputs.WORDS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_key, page ORDER BY line) AS k FROM words)
        SELECT doc_key, CAST(page AS INTEGER) AS page, CAST(k AS INTEGER) AS line, count(*) AS words, min(seq) AS first_seq FROM r GROUP BY doc_key, page, k""",
    "w2_heading_context": f"""
        WITH {BLOCKS}, h AS (
          SELECT *, max(CASE WHEN kind = 'heading' AND title <> '' AND level = 2 THEN pos END) OVER w AS p2,
                 max(CASE WHEN kind = 'heading' AND title <> '' AND level = 3 THEN pos END) OVER w AS p3,
                 max(CASE WHEN kind = 'heading' AND title <> '' AND level = 4 THEN pos END) OVER w AS p4
          FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT s.doc_id, s.pos, concat_ws(' > ', a.title, b.title, c.title) AS context FROM h s
        LEFT JOIN blocks a ON a.doc_id = s.doc_id AND a.pos = s.p2
        LEFT JOIN blocks b ON b.doc_id = s.doc_id AND b.pos = s.p3 AND s.p3 > coalesce(s.p2, 0)
        LEFT JOIN blocks c ON c.doc_id = s.doc_id AND c.pos = s.p4 AND s.p4 > greatest(coalesce(s.p2, 0), coalesce(s.p3, 0))
        WHERE s.kind = 'section'""",
    "w3_section_bodies": f"WITH {BLOCKS} SELECT doc_id, pos, kind, num, md5(body) AS digest FROM blocks",
    "w4_scattered_terms": f"""
        WITH {inputs.LINES}, o AS (SELECT doc_key, term, pos FROM lines JOIN (SELECT unnest({inputs.sql_list(SCATTER_TERMS)}) AS term) t ON contains(text, term)),
        g AS (SELECT doc_key, term, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_key, term ORDER BY pos) <= 4 THEN 0 ELSE 1 END AS s FROM o)
        SELECT doc_key, term, CAST(sum(s) AS BIGINT) AS clusters FROM g GROUP BY ALL HAVING sum(s) >= 2""",
    "w5_number_ranges": f"""
        WITH {inputs.LINES}, g AS (SELECT doc_key, pos + 1 AS n, pos - row_number() OVER (PARTITION BY doc_key ORDER BY pos) AS g FROM lines WHERE length(text) < 120),
        s AS (SELECT doc_key, min(n) AS a, CASE WHEN min(n) = max(n) THEN CAST(min(n) AS VARCHAR) ELSE min(n) || '-' || max(n) END AS t FROM g GROUP BY doc_key, g)
        SELECT doc_key, string_agg(t, ', ' ORDER BY a) AS ranges FROM s GROUP BY doc_key""",
    "w6_bundle_layout": """
        WITH i AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS INTEGER) AS pages,
             coalesce(sum(CAST(l_quantity AS INTEGER) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem)
        SELECT l_orderkey, l_partkey, l_linenumber, CAST(b + 4 AS BIGINT) AS cover_page, CAST(b + 5 AS BIGINT) AS start_page, CAST(b + 4 + pages AS BIGINT) AS end_page FROM i""",
    "w7_instruction_blocks": rf"""
        WITH RECURSIVE {inputs.LINES}, t AS (SELECT doc_key, pos, translate(text, ',.', '<>') AS text FROM lines),
        x AS (SELECT doc_key, pos, text, contains(text, '>') AS hc,
                     len(regexp_extract_all(text, '<')) > len(regexp_extract_all(text, '>')) AND NOT contains(regexp_extract(text, '^(?s:.*)<((?s:.*))$', 1), '>') AS op,
                     regexp_extract(text, '^(?s:.*)<((?s:.*))$', 1) AS al, regexp_extract(text, '^((?s:[^>]*))>', 1) AS bf FROM t),
        f AS (
          SELECT doc_key, CAST(-1 AS BIGINT) AS pos, false AS open, CAST(NULL AS BIGINT) AS first_pos, '' AS buf, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS done_first
          FROM (SELECT DISTINCT doc_key FROM t)
          UNION ALL
          SELECT x.doc_key, x.pos, CASE WHEN f.open THEN NOT x.hc ELSE x.op END,
                 CASE WHEN f.open THEN (CASE WHEN x.hc THEN NULL ELSE f.first_pos END) WHEN x.op THEN x.pos END,
                 CASE WHEN f.open THEN (CASE WHEN x.hc THEN '' ELSE f.buf || ' ' || x.text END) WHEN x.op THEN x.al ELSE '' END,
                 CASE WHEN f.open AND x.hc THEN f.buf || ' ' || x.bf END, CASE WHEN f.open AND x.hc THEN f.first_pos END
          FROM f JOIN x ON x.doc_key = f.doc_key AND x.pos = f.pos + 1),
        st AS (SELECT doc_key, pos, lag(open) OVER (PARTITION BY doc_key ORDER BY pos) AS was_open FROM f)
        SELECT doc_key, CAST(done_first AS INTEGER) AS first_pos, CAST(pos AS INTEGER) AS last_pos, 'multi' AS span, md5(trim(done)) AS digest FROM f WHERE done IS NOT NULL
        UNION ALL
        SELECT x.doc_key, CAST(x.pos AS INTEGER), CAST(x.pos AS INTEGER), 'single', md5(trim(unnest(regexp_extract_all(x.text, '<([^>]+)>', 1))))
        FROM x JOIN st ON st.doc_key = x.doc_key AND st.pos = x.pos WHERE NOT st.was_open""",
    "w8_operative_tail": f"""
        WITH {inputs.LINES}, m AS (SELECT doc_key, min(pos) AS f FROM lines WHERE starts_with(text, 'The ') OR starts_with(text, 'Of ') OR starts_with(text, 'Le ') GROUP BY doc_key)
        SELECT l.doc_key, CAST(pos AS INTEGER) AS pos, CAST(f AS INTEGER) AS first_pos FROM lines l JOIN m ON l.doc_key = m.doc_key AND pos >= f""",
    "w9_current_stage": f"WITH {inputs.FLOW} SELECT case_id, arg_max(flow_id, (change_date, flow_id)) AS flow_id, arg_max(node_id, (change_date, flow_id)) AS node_id, max(change_date) AS change_date FROM flow GROUP BY case_id",
    "w9_stage_durations": f"""
        WITH {inputs.FLOW} SELECT flow_id, case_id, node_id,
          CAST(floor(epoch(lead(change_date) OVER (PARTITION BY case_id ORDER BY change_date, flow_id))) AS BIGINT) - CAST(floor(epoch(change_date)) AS BIGINT) AS seconds FROM flow""",
    "w9_stage_catalog": f"""
        WITH {inputs.FLOW}, c AS (SELECT case_id, CASE case_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 24 ELSE 99 END AS kind,
                                         CASE WHEN case_id % 4 = 0 THEN min(flow_id) ELSE max(flow_id) END AS cur FROM flow GROUP BY case_id),
        m AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', '{t}')" for k, v in STAGE_MODELS.items() for n, t in v)}) v(kind, node_id, caption))
        SELECT c.case_id, m.node_id, m.caption, m.node_id = f.node_id AS is_current
        FROM c JOIN m ON m.kind = c.kind JOIN flow f ON f.flow_id = c.cur""",
    "w9_pointer_mismatches": f"""
        WITH {inputs.FLOW}, c AS (SELECT case_id, CASE WHEN case_id % 4 = 0 THEN min(flow_id) ELSE max(flow_id) END AS current_flow_id,
                                         arg_max(flow_id, (change_date, flow_id)) AS latest_flow_id FROM flow GROUP BY case_id)
        SELECT * FROM c WHERE current_flow_id IS DISTINCT FROM latest_flow_id""",
    "w10_case_numbers": """
        WITH n AS (SELECT event_id AS request_id, CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id) AS VARCHAR) AS case_num
                   FROM events WHERE event_type = 'signup')
        SELECT request_id, case_num, lpad(case_num, 8, '0') AS case_num_sort FROM n""",
    "w11_paragraph_numbers": f"""
        WITH {inputs.LINES}, p AS (SELECT doc_key, text, row_number() OVER (PARTITION BY doc_key ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_key) AS n
                                   FROM lines WHERE length(trim(text)) > 0),
        r AS (SELECT doc_key, n, k, CAST(unnest(regexp_extract_all(text, '([0-9]{{1,4}})', 1)) AS INTEGER) AS v FROM p)
        SELECT doc_key, CAST(n AS INTEGER) AS n_paragraphs, CAST(k AS INTEGER) AS in_paragraph, v AS refers_to, v BETWEEN 1 AND n AS confirmed FROM r""",
    "t1_similar_names": f"""
        WITH {_SIM} SELECT p_name, CAST(k AS INTEGER) AS "rank", name, score
        FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, name) AS k FROM r WHERE score >= 0.5) WHERE k <= 5""",
    "t2_box_dedupe": f"""
        WITH RECURSIVE {inputs.WORDS},
        a AS (SELECT doc_key, page, "left" AS l, top AS t, width AS w, height AS h, 'WORD' AS category FROM words
              UNION ALL SELECT doc_key, page, "left" + 20, top, width - 30, 16, 'PLAN' FROM words WHERE length(text) >= 12),
        u AS (SELECT doc_key, page, l, t, w, h, min(category) AS category FROM a GROUP BY ALL),
        -- lines are 24 apart and boxes at most 20 high with their skew, so only boxes of one line can overlap
        o AS (SELECT *, t // 24 AS band, row_number() OVER (PARTITION BY doc_key, page, t // 24 ORDER BY w * h DESC, l, t, h, w, category) AS r FROM u),
        f AS (
          SELECT doc_key, page, band, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(l BIGINT, t BIGINT, w BIGINT, h BIGINT, c VARCHAR)[]) AS kept
          FROM (SELECT DISTINCT doc_key, page, band FROM o)
          UNION ALL
          SELECT f.doc_key, f.page, f.band, o.r,
                 CASE WHEN len(list_filter(f.kept, lambda k:
                        greatest(0, least(k.l + k.w, o.l + o.w) - greatest(k.l, o.l)) * greatest(0, least(k.t + k.h, o.t + o.h) - greatest(k.t, o.t))
                        / least(k.w * k.h, o.w * o.h) > {fv.DEDUPE_OVERLAP})) > 0 THEN f.kept
                      ELSE list_append(f.kept, {{'l': o.l, 't': o.t, 'w': o.w, 'h': o.h, 'c': o.category}}) END
          FROM f JOIN o ON o.doc_key = f.doc_key AND o.page = f.page AND o.band = f.band AND o.r = f.r + 1),
        k AS (SELECT doc_key, page, unnest(arg_max(kept, r)) AS b FROM f GROUP BY doc_key, page, band)
        SELECT doc_key, CAST(page AS INTEGER) AS page, b.c AS category, count(*) AS kept FROM k GROUP BY ALL""",
    "t4_ordered_findings": f"""
        WITH {FINDINGS} SELECT doc_key, CAST(pos AS INTEGER) AS pos, "check", severity, CAST(list_position({inputs.sql_list(fv.SEVERITY_ORDER)}, severity) AS BIGINT) AS "rank" FROM findings""",
    "t5_reading_order": """
        SELECT user_id AS decision, event_id AS citer, row_number() OVER (PARTITION BY user_id ORDER BY
               CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE 1 END, CAST(ts AS DATE) DESC, CASE WHEN value < 20 THEN 1 ELSE 0 END, event_id) AS reading_rank
        FROM events""",
    "t6_near_sections": f"""
        WITH {BLOCKS}, g AS (SELECT doc_id, pos, num, CASE WHEN num = '45' THEN 1 WHEN starts_with(num, '45') THEN 2 END AS grade FROM blocks WHERE kind = 'section'),
        b AS (SELECT doc_id, min(grade) AS best FROM g GROUP BY doc_id),
        k AS (SELECT g.*, row_number() OVER (PARTITION BY g.doc_id ORDER BY pos) AS r FROM g JOIN b ON g.doc_id = b.doc_id AND grade = best)
        SELECT doc_id, pos, num, grade FROM k WHERE grade = 1 OR r <= 30""",
    "t7_latest_revision": """
        SELECT user_id AS title, arg_max(event_id, (ts, event_id)) AS revid, arg_max(event_type, (ts, event_id)) AS text,
               max(ts) > TIMESTAMP '2024-01-29 00:00:00' AS fresh FROM events GROUP BY user_id""",
    "d1_reference_difference": f"""
        WITH {inputs.versions_sql()}, a AS ({_names_sql('old')}), b AS ({_names_sql('new')})
        SELECT pair_id, ref, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT pair_id, ref, 'invented' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "d2_first_hits": f"WITH {inputs.LINES}, f AS ("
    + " UNION ALL ".join(
        f"SELECT doc_key, pos, {i} AS p, '{fam}' AS family, unnest(regexp_extract_all(text, {inputs.sql_text(pat)}, 1)) AS ref_id FROM lines"
        for i, (fam, pat) in enumerate(LATIN_APPENDIX)
    )
    + ") SELECT doc_key, CAST(pos AS INTEGER) AS pos, ref_id, arg_min(family, p) AS family FROM f GROUP BY doc_key, pos, ref_id",
    "d3_merged_citers": """
        WITH u AS (SELECT user_id AS decision, event_id % 200 AS citer FROM events UNION ALL SELECT o_custkey % 150, o_orderkey % 200 FROM orders)
        SELECT decision, citer, count(*) AS found_in FROM u WHERE decision <> citer GROUP BY ALL""",
    "d4_detector_union": f"""
        WITH {DETECTIONS}, u AS (SELECT 'patterns' AS detector, category, doc_key FROM found UNION ALL
                                 SELECT 'names', 'NAME', doc_key FROM lines WHERE contains(text, 'License'))
        SELECT detector, category, count(*) AS n, count(DISTINCT doc_key) AS documents FROM u GROUP BY ALL""",
    "d5_template_keys": f"""
        SELECT c_custkey, 'surplus' AS unknown, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'note' END AS "empty",
               CASE WHEN c_acctbal > 5000 THEN '{",".join(list(fv.CHECKBOX_GROUPS)[1:])}' ELSE '{",".join(fv.CHECKBOX_GROUPS)}' END AS unchecked_groups FROM customer""",
    "d6_stage_documents": """
        WITH a AS (SELECT DISTINCT o_custkey AS case_id, o_orderpriority AS document FROM orders WHERE o_orderdate < '1998-01-01'),
        b AS (SELECT DISTINCT o_custkey AS case_id, o_orderpriority AS document FROM orders WHERE o_orderdate >= '1998-01-01')
        SELECT case_id, document, 'dropped' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT case_id, document, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "d7_append_absent": """
        SELECT c_custkey, c_mktsegment FROM customer UNION ALL
        SELECT o_custkey * 2, min(o_orderpriority) FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
}
ORACLE["d7_written_rows"] = ORACLE["d7_append_absent"]
