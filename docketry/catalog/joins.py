"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.predicates import DETECTIONS, SEARCH_KEY, _detections
from docketry.functions import patterns
from docketry.functions.arrays import matches
from docketry.functions.text import comparison_key, reroot_path
from docketry.operators import cases, entities, layout, ledger, matching, profiling, quality, rulebooks
from docketry.plans import folders
from docketry.session import cut_lineage
from docketry.sources.tables import table


def j1_orphans(spark: SparkSession, d: str) -> DataFrame:
    return profiling.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "events"), "user_id")


REFERENCE = "[A-Z][a-z]+"


def _turn_references(spark: SparkSession, d: str, role: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter(F.col("role") == role)
    return turns.select("conv_id", F.explode(matches(F.col("text"), REFERENCE)).alias("ref"))


def j2_reference_check(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised names an answer uses against those its conversation's user brought."""
    return matching.reconcile(
        _turn_references(spark, d, "assistant"), _turn_references(spark, d, "user"), ["conv_id"], "ref"
    )


def j2_reference_validity(spark: SparkSession, d: str) -> DataFrame:
    return matching.valid_groups(j2_reference_check(spark, d), ["conv_id"])


def _keyed_versions(spark: SparkSession, d: str) -> DataFrame:
    v = inputs.versions(spark, d)
    return v.select("pair_id", "side", F.col("pos").alias("row"), comparison_key(F.col("text")).alias("text"))


def j3_best_match(spark: SparkSession, d: str) -> DataFrame:
    v = _keyed_versions(spark, d)
    old, new = v.filter("side = 'original'").drop("side"), v.filter("side = 'reordered'").drop("side")
    best = matching.best_partner(old, new, ["pair_id"], fv.NEAR_MATCH_THRESHOLD)
    return best.select("pair_id", "row", "other", "score")


def j4_quotes_in_source(spark: SparkSession, d: str) -> DataFrame:
    third = F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("int")
    written = (
        F.when(F.col("pos") % 3 == 0, F.col("text"))
        .when(F.col("pos") % 3 == 1, F.concat(F.substring("text", F.lit(1), third), F.lit("..."), F.expr("right(text, greatest(1, int(length(text) / 3)))")))
        .otherwise(F.concat("text", F.lit(" never written")))
    )
    quotes = inputs.lines(spark, d).select("doc_key", "pos", written.alias("quote"))
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text")
    return matching.quotes_in_source(quotes, sources, "doc_key").select("doc_key", "pos", "found")


def j4_quotes_kept(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs as quotes: the same, slightly different or lost in the other version."""
    v = inputs.versions(spark, d).select("pair_id", "side", F.col("pos").alias("row"), comparison_key(F.col("text")).alias("text"))
    old, new = (v.filter(F.col("side") == side).drop("side") for side in ("original", "reordered"))
    return matching.quotes_kept(old, new, ["pair_id"], fv.PARAGRAPH_MATCH_THRESHOLD, "edit").select("pair_id", "row", "state")


def j5_residual_values(spark: SparkSession, d: str) -> DataFrame:
    """Mask every second detected value, then look for all of them."""
    found = _detections(spark, d).select("doc_key", "value").distinct()
    pages = inputs.line_pages(spark, d)
    email = next(x.pattern for x in patterns.LATIN_DETECTORS if x.category == "EMAIL")
    hidden = F.regexp_replace("text", r"\S*" + email + r"\S*", "█████")
    masked = pages.withColumn("text", F.when(F.contains("text", F.lit("@")), hidden).otherwise(F.col("text")))
    return entities.residuals(found, masked)


def _lines_with_words(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the keys and boxes of their words; the texts are not read again."""
    lines = layout.line_words(layout.group_lines(inputs.words(spark, d)))
    return cut_lineage(lines.withColumn("words", F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in (*layout.BOX, "key")]))))


def _page_entities(spark: SparkSession, d: str) -> DataFrame:
    """First words of every line as names seen on that page."""
    lines = inputs.lines(spark, d).filter(F.size(F.split("text", " ")) >= 2)
    return lines.select(
        "doc_key", (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page"),
        F.concat_ws(" ", F.get(F.split("text", " "), F.lit(0)), F.get(F.split("text", " "), F.lit(1))).alias("text"),
        F.lit("name").alias("type"),
    )


def j6_entity_spans(spark: SparkSession, d: str) -> DataFrame:
    wanted = entities.propagated(_page_entities(spark, d))
    hits = entities.locate(wanted, _lines_with_words(spark, d), metric="edit")
    return hits.groupBy("doc_key").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("left").cast("long")).alias("left_sum"), F.sum(F.col("width").cast("long")).alias("width_sum"))


def j7_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a document on which a value detected anywhere in it occurs."""
    found = _detections(spark, d)
    ents = found.select("doc_key", (F.col("pos") + 1).alias("page"), F.col("value").alias("text"), F.lit("account").alias("type"))
    return entities.pages_of_values(entities.propagated(ents).select("doc_key", "value", "key"), inputs.line_pages(spark, d))


def j8_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Every value of a page is intended as it is and with a word that stands nowhere."""
    seen = _page_entities(spark, d)
    plan = entities.locate(entities.propagated(seen), _lines_with_words(spark, d), fuzzy=False)
    return entities.unmapped(seen.select("doc_key", F.col("text").alias("value")).unionByName(
        seen.select("doc_key", F.concat("text", F.lit(" qqqq")).alias("value"))
    ), plan)


def _plan_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box over the middle of every word of twelve or more characters."""
    w = inputs.words(spark, d).filter(F.length("text") >= 12)
    return w.select("doc_key", "page", (F.col("left") + 20).alias("left"), "top", (F.col("width") - 30).alias("width"), F.lit(16).alias("height"))


def j9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    words = inputs.words(spark, d).select("doc_key", "page", "seq", "left", "top", "width", "height")
    hit = layout.overlapping(words, _plan_boxes(spark, d), fv.ALLOW_OVERLAP)
    return hit.select("doc_key", "page", F.col("a.seq").alias("seq"), F.col("b.left").alias("box_left"))


def _listing(spark: SparkSession, d: str, changed: bool) -> DataFrame:
    docs = table(spark, d, "documents")
    content = F.col("text")
    if changed:
        docs = docs.filter(F.col("lang") != "de")
        content = F.when(F.col("lang") == "es", F.translate("text", "e", "a")).otherwise(content)
    return docs.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".pdf")).alias("rel_path"),
        F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".pdf").alias("ext"),
        F.octet_length(content).cast("long").alias("length"), content.alias("content"),
    )


def j10_completeness(spark: SparkSession, d: str) -> DataFrame:
    return folders.lost_files(_listing(spark, d, False), _listing(spark, d, True))


def j11_two_sources(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.format_string("C-%06d", "o_custkey").alias("number"))
    b = table(spark, d, "events").select(F.format_string("Customer#%09d", "user_id").alias("number"))
    a = a.withColumn("number", F.translate("number", "-", ""))
    return matching.two_sources(a, b, "number")


def j12_citation_lint(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return matching.uncovered_citations(docs, "doc_id", "text", "[0-9]{2,5}", table(spark, d, "customer"), "c_custkey")


def j13_enrichment(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    people = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    return cases.enrich(orders, [(people, ["c_custkey"]), (nations, ["n_nationkey"])]).select("o_orderkey", "c_name", "n_name")


def j14_folder_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = cases.folder_chain(inputs.cases(spark, d))
    return chain.select("case_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def j14_children(spark: SparkSession, d: str) -> DataFrame:
    return cases.children(inputs.cases(spark, d))


STATUS_CATALOG = [(1, "1-URGENT"), (2, " 2-HIGH "), (3, "6-PARKED"), (4, "")]


def j15_status_list(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame(STATUS_CATALOG, "bank_id int, name string")
    used = table(spark, d, "orders").select(F.col("o_orderpriority").alias("status"))
    return cases.status_list(catalog, used)


def _claims(spark: SparkSession, d: str, flags: list[str]) -> DataFrame:
    return table(spark, d, "lineitem").filter(F.col("l_returnflag").isin(*flags)).select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("issue"),
        (F.col("l_quantity") * 100).cast("decimal(18,2)").alias("amount"),
    )


def j16_claim_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = rulebooks.claim_matrix(_claims(spark, d, ["A", "R"]), _claims(spark, d, ["N"]))
    return m.groupBy("status").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("claimed").cast("double").alias("claimed"),
        F.sum("answered").cast("double").alias("answered"), F.sum("gap").cast("double").alias("gap"),
        F.max(F.col("gap").cast("double") / F.col("answered").cast("double")).alias("largest_ratio"),
    )


def j16_stage_changes(spark: SparkSession, d: str) -> DataFrame:
    early = _claims(spark, d, ["A"]).select("case_id", "issue")
    late = _claims(spark, d, ["R"]).select("case_id", "issue")
    return rulebooks.stage_changes(early, late, ["case_id", "issue"])


def _bills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(
        (F.col("o_custkey") % 25).alias("municipality"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("component"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderkey",
    )
    keys = ["municipality", "year", "component"]
    bills = o.groupBy(*keys).agg(F.max("price").alias("applied"), F.min("price").alias("claimed"))
    order = o.filter("o_orderkey % 29 = 0").groupBy(*keys).agg(F.max("price").alias("ordered"))
    return bills, order


def j17_order_comparison(spark: SparkSession, d: str) -> DataFrame:
    found = rulebooks.compare_with_order(*_bills(spark, d))
    return found.select("municipality", "year", "component", "finding", "claim", *[F.col(c).cast("double").alias(c) for c in ("applied", "claimed", "ordered", "gap")])


def j18_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    pages = inputs.line_pages(spark, d)
    totals = pages.groupBy("doc_key").agg(F.max("page").alias("n_pages"))
    ranges = F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(a).alias("start_page"), F.lit(b).alias("end_page"))
        for p, a, b in (("head", 1, 3), ("middle", 4, 12), ("tail", 10, 100000))
    ])
    parts = totals.select("doc_key", F.explode(ranges).alias("r")).select("doc_key", "r.*")
    placed = layout.parts_to_pages(parts, totals, "doc_key").join(pages, ["doc_key", "page"])
    return placed.groupBy("doc_key", "part").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum(F.length("text")).alias("chars")
    )


def j19_masked_words(spark: SparkSession, d: str) -> DataFrame:
    shown = layout.masked_words(inputs.words(spark, d), _plan_boxes(spark, d))
    return shown.groupBy("doc_key", "page").agg(F.count_if("hidden").alias("hidden"), F.sum(F.length(F.translate("shown", "█", ""))).alias("visible_chars"))


TERMS = ["License", "the", "eaux", "thereisnosuchterm"]


def j20_term_scan(spark: SparkSession, d: str) -> DataFrame:
    return quality.scan_terms(inputs.line_pages(spark, d), TERMS)


def j20_terms_not_found(spark: SparkSession, d: str) -> DataFrame:
    pages = inputs.line_pages(spark, d)
    return quality.terms_not_found(quality.scan_terms(pages, TERMS), pages.select("doc_key").distinct(), TERMS)


def reading_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as units; a code pair for every ten lines; events as confirmations, some with a wrong code."""
    units = inputs.lines(spark, d).select(F.col("doc_key").alias("doc_id"), (F.col("pos") + 1).alias("n"), F.lit("text").alias("kind"), "text")
    tens = units.select("doc_id", F.floor((F.col("n") - 1) / 10).alias("ten"), "n")
    codes = lambda who, ten: (F.substring(F.md5(F.concat_ws("|", who.cast("string"), ten.cast("string"), F.lit("a"))), 1, 6).alias("code_a"),
                              F.substring(F.md5(F.concat_ws("|", who.cast("string"), ten.cast("string"), F.lit("b"))), 1, 6).alias("code_b"))
    issued = tens.groupBy("doc_id", "ten").agg(F.min("n").alias("a"), F.max("n").alias("b")).select(
        *codes(F.col("doc_id"), F.col("ten")), "doc_id", F.sequence("a", "b").alias("units")
    )
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "user_id", (F.get_json_object("props", "$.k").cast("int") % 5).alias("ten"))
    confirms = e.select(
        F.col("event_id").alias("confirm_id"), "ts", *codes(F.col("user_id"), F.col("ten")), "event_type"
    ).withColumn("code_b", F.when(F.col("event_type") == "error", F.reverse("code_b")).otherwise(F.col("code_b"))).drop("event_type")
    return units, issued, confirms


def j21_read_ledger(spark: SparkSession, d: str) -> DataFrame:
    units, issued, confirms = reading_tables(spark, d)
    read = ledger.read_units(units, issued, confirms)
    return read.select("doc_id", "n", "how")


def j22_files_present(spark: SparkSession, d: str) -> DataFrame:
    acts = inputs.acts(spark, d)
    files = acts.filter("kind <> 'error'").select(reroot_path(F.col("doc_path"), "/archive").alias("path"))
    return cases.files_present(acts, files, reroot_path(F.col("doc_path"), "/archive")).select("act_id", "file_state")


QUERIES = {
    f.__name__: f
    for f in (
        j1_orphans, j2_reference_check, j2_reference_validity, j3_best_match, j4_quotes_in_source, j4_quotes_kept, j5_residual_values, j6_entity_spans,
        j7_propagation, j8_unmapped, j9_overlaps, j10_completeness, j11_two_sources, j12_citation_lint, j13_enrichment,
        j14_folder_chain, j14_children, j15_status_list, j16_claim_matrix, j16_stage_changes, j17_order_comparison, j18_page_ranges,
        j19_masked_words, j20_term_scan, j20_terms_not_found, j21_read_ledger, j22_files_present,
    )
}

_REFS = f"""
u AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{REFERENCE}')) AS ref FROM conversations WHERE role = 'assistant'),
dd AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{REFERENCE}')) AS ref FROM conversations WHERE role = 'user'),
sides AS (SELECT coalesce(u.conv_id, dd.conv_id) AS conv_id, coalesce(u.ref, dd.ref) AS ref,
                 CASE WHEN dd.ref IS NULL THEN 'orphaned' WHEN u.ref IS NULL THEN 'missing' ELSE 'matched' END AS side
          FROM u FULL JOIN dd ON u.conv_id = dd.conv_id AND u.ref = dd.ref)
"""
_BOXES = """
boxes AS (
  SELECT doc_key, page, line, "left" + 20 AS bl, top AS bt, width - 30 AS bw, 16 AS bh,
         unnest(range(("left" + 20) // 100, ("left" + width - 11) // 100 + 1)) AS cell
  FROM words WHERE length(text) >= 12),
cells AS (SELECT *, unnest(range("left" // 100, ("left" + width - 1) // 100 + 1)) AS cell FROM words),
hits AS (  -- printed lines lie apart, so what overlaps is on one line and shares a hundred units of it
  SELECT DISTINCT w.doc_key, w.page, w.seq, w."left", w.width, w.height, b.bl, b.bw, b.bh,
         greatest(0, least(w."left" + w.width, bl + bw) - greatest(w."left", bl)) * greatest(0, least(top + height, bt + bh) - greatest(top, bt)) AS area
  FROM cells w JOIN boxes b ON w.doc_key = b.doc_key AND w.line = b.line AND w.cell = b.cell
   AND w."left" < bl + bw AND bl < w."left" + w.width AND top < bt + bh AND bt < top + height)
"""
_CLAIMS = """
c AS (SELECT l_orderkey AS case_id, l_linenumber AS issue, sum(CAST(l_quantity * 100 AS DECIMAL(18,2))) AS claimed
      FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
r AS (SELECT l_orderkey AS case_id, l_linenumber AS issue, sum(CAST(l_quantity * 100 AS DECIMAL(18,2))) AS answered
      FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
"""
READING = inputs.LINES + """,
codes AS (SELECT DISTINCT doc_key AS doc_id, pos // 10 AS ten, doc_key || '|' || (pos // 10) AS k FROM lines),
confirmed AS (
  SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS ten, event_type,
         substr(md5(user_id || '|' || (CAST(json_extract(props, '$.k') AS INTEGER) % 5) || '|a'), 1, 6) AS code_a,
         substr(md5(user_id || '|' || (CAST(json_extract(props, '$.k') AS INTEGER) % 5) || '|b'), 1, 6) AS code_b0
  FROM events),
confirms AS (SELECT event_id AS confirm_id, ts, code_a, CASE WHEN event_type = 'error' THEN reverse(code_b0) ELSE code_b0 END AS code_b FROM confirmed),
issued AS (SELECT substr(md5(k || '|a'), 1, 6) AS code_a, substr(md5(k || '|b'), 1, 6) AS code_b, doc_id, ten FROM codes)
"""

ORACLE = {
    "j1_orphans": """
        SELECT o_custkey AS orphan_key, count(*) AS n_rows FROM orders
        WHERE o_custkey <> 0 AND o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey""",
    "j2_reference_check": f"WITH {_REFS} SELECT conv_id, ref, side FROM sides",
    "j2_reference_validity": f"""
        WITH {_REFS} SELECT conv_id, count(*) FILTER (side = 'orphaned') AS orphaned, count(*) FILTER (side = 'missing') AS missing,
               bool_and(side = 'matched') AS is_valid FROM sides GROUP BY conv_id""",
    "j3_best_match": f"""
        WITH {inputs.versions_sql()},
        t AS (SELECT pair_id, text, min(pos) AS pos FROM new GROUP BY ALL),
        e AS (SELECT o.pair_id, o.pos, o.text, t.pos AS same FROM old o LEFT JOIN t ON o.pair_id = t.pair_id AND o.text = t.text),
        s AS (SELECT e.pair_id, e.pos, t.pos AS other, 1 - levenshtein({inputs.one_byte('e.text')}, {inputs.one_byte('t.text')}) / greatest(length(e.text), length(t.text)) AS score
              FROM e JOIN t ON e.pair_id = t.pair_id WHERE e.same IS NULL AND least(length(e.text), length(t.text)) >= 0.79 * greatest(length(e.text), length(t.text))),
        b AS (SELECT pair_id, pos, max(score) AS score, arg_min(other, (-score, other)) AS other FROM s WHERE score >= 0.8::DOUBLE GROUP BY ALL)
        SELECT e.pair_id, CAST(e.pos AS INTEGER) AS row, CAST(coalesce(e.same, b.other) AS INTEGER) AS other,
               CASE WHEN e.same IS NOT NULL THEN 1.0::DOUBLE ELSE b.score END AS score
        FROM e LEFT JOIN b ON e.pair_id = b.pair_id AND e.pos = b.pos""",
    "j4_quotes_in_source": f"""
        WITH {inputs.LINES}, q AS (
          SELECT doc_key, pos, trim(regexp_replace(CASE WHEN pos % 3 = 0 THEN text
             WHEN pos % 3 = 1 THEN substr(text, 1, greatest(1, length(text) // 3)) || '...' || right(text, greatest(1, length(text) // 3))
             ELSE text || ' never written' END, '\\s+', ' ', 'g')) AS q FROM lines),
        s AS (SELECT doc_id AS doc_key, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
        SELECT doc_key, CAST(pos AS INTEGER) AS pos,
               len(list_filter(string_split(q, '...'), lambda g: length(trim(g)) > 0 AND NOT contains(s, trim(g)))) = 0 AS found
        FROM q JOIN s USING (doc_key)""",
    "j4_quotes_kept": f"""
        WITH {inputs.versions_sql()},
        t AS (SELECT DISTINCT pair_id, text FROM new),
        e AS (SELECT o.pair_id, o.pos, o.text, t.text IS NOT NULL AS same FROM old o LEFT JOIN t ON o.pair_id = t.pair_id AND o.text = t.text),
        n AS (SELECT DISTINCT e.pair_id, e.pos FROM e JOIN t ON e.pair_id = t.pair_id
              WHERE NOT e.same AND least(length(e.text), length(t.text)) >= 0.94 * greatest(length(e.text), length(t.text))
                AND 1 - levenshtein({inputs.one_byte('e.text')}, {inputs.one_byte('t.text')}) / greatest(length(e.text), length(t.text)) >= {fv.PARAGRAPH_MATCH_THRESHOLD}::DOUBLE)
        SELECT e.pair_id, CAST(e.pos AS INTEGER) AS row, CASE WHEN same THEN 'same' WHEN n.pos IS NOT NULL THEN 'near' ELSE 'lost' END AS state
        FROM e LEFT JOIN n ON n.pair_id = e.pair_id AND n.pos = e.pos""",
    "j5_residual_values": f"""
        WITH {DETECTIONS}, v AS (SELECT DISTINCT doc_key, value, {SEARCH_KEY.format('value')} AS k FROM found),
        m AS (SELECT doc_key, pos, regexp_replace(text, '\\S*[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\S*', '█████', 'g') AS text FROM lines),
        p AS (SELECT doc_key, pos, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: NOT contains(w, '█')), ' ') AS t FROM m)
        SELECT DISTINCT doc_key, CAST(pos + 1 AS INTEGER) AS page, value FROM p JOIN v USING (doc_key)
        WHERE length(k) >= 4 AND contains({SEARCH_KEY.format('t')}, k)""",
    "j6_entity_spans": f"""
        WITH RECURSIVE {inputs.WORDS},
        e0 AS (SELECT doc_key, pos // 40 + 1 AS page, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS value
               FROM lines WHERE len(string_split(text, ' ')) >= 2),
        e1 AS (SELECT doc_key, page, value, {SEARCH_KEY.format('value')} AS k FROM e0),
        e AS (SELECT doc_key, k, arg_min(value, (page, value)) AS value FROM e1 WHERE length(k) >= 4 GROUP BY ALL),
        w AS (SELECT doc_key, line, i, "left", "left" + width AS r, {SEARCH_KEY.format('text')} AS k FROM words),
        a AS (SELECT doc_key, line, row_number() OVER (PARTITION BY doc_key, line ORDER BY i) - 1 AS p, "left",
                     list(k) OVER n AS ks, list(r) OVER n AS rs
              FROM w WINDOW n AS (PARTITION BY doc_key, line ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
        r AS (SELECT doc_key, line, p, "left", list_max(rs[1:m]) - "left" AS width, m, array_to_string(ks[1:m], '') AS f,
                     array_to_string(list_reverse(ks[1:m]), '') AS b
              FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS m FROM a)),
        h0 AS (SELECT r.doc_key, line, p, p + m - 1 AS q, "left", width, e.k FROM r JOIN e ON e.doc_key = r.doc_key AND e.k = r.f
              UNION SELECT r.doc_key, line, p, p + m - 1, "left", width, e.k FROM r JOIN e ON e.doc_key = r.doc_key AND e.k = r.b),
        x AS (SELECT DISTINCT doc_key, line, k FROM h0),
        n AS (SELECT r.doc_key, r.line, p, p + m - 1 AS q, "left", width, e.k, r.f, r.b FROM r JOIN e ON e.doc_key = r.doc_key
                   AND least(length(r.f), length(e.k)) >= floor(greatest(length(r.f), length(e.k)) * 0.82::DOUBLE)
              ANTI JOIN x ON x.doc_key = r.doc_key AND x.line = r.line AND x.k = e.k),
        h AS (SELECT * FROM h0 UNION SELECT doc_key, line, p, q, "left", width, k FROM n
              WHERE 1 - levenshtein({inputs.one_byte('f')}, {inputs.one_byte('k')}) / greatest(length(f), length(k)) >= 0.82::DOUBLE
                 OR 1 - levenshtein({inputs.one_byte('b')}, {inputs.one_byte('k')}) / greatest(length(b), length(k)) >= 0.82::DOUBLE),
        s AS (SELECT doc_key, line, k, p, min(q) AS q, arg_min("left", q) AS "left", arg_min(width, q) AS width FROM h GROUP BY ALL),
        g AS (
          SELECT doc_key, line, k, min(p) AS p, arg_min(q, p) AS q, arg_min("left", p) AS "left", arg_min(width, p) AS width FROM s GROUP BY doc_key, line, k
          UNION ALL
          SELECT x.doc_key, x.line, x.k, x.p, x.q, x."left", x.width
          FROM (SELECT s.*, row_number() OVER (PARTITION BY s.doc_key, s.line, s.k ORDER BY s.p) AS o
                FROM g JOIN s ON s.doc_key = g.doc_key AND s.line = g.line AND s.k = g.k AND s.p > g.q) x WHERE x.o = 1)
        SELECT doc_key, count(*) AS hits, CAST(sum("left") AS BIGINT) AS left_sum, CAST(sum(width) AS BIGINT) AS width_sum FROM g GROUP BY doc_key""",
    "j7_propagation": f"""
        WITH {DETECTIONS}, v AS (SELECT doc_key, {SEARCH_KEY.format('value')} AS k, arg_min(value, (pos, value)) AS value FROM found GROUP BY ALL)
        SELECT doc_key, value, CAST(pos + 1 AS INTEGER) AS page FROM lines JOIN v USING (doc_key)
        WHERE length(k) >= 4 AND contains({SEARCH_KEY.format('text')}, k)""",
    "j8_unmapped": f"""
        WITH {inputs.WORDS},
        e AS (SELECT doc_key, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS value FROM lines WHERE len(string_split(text, ' ')) >= 2),
        k AS (SELECT doc_key, value, {SEARCH_KEY.format('value')} AS k FROM e),
        a AS (SELECT * FROM k UNION ALL SELECT doc_key, value || ' qqqq', k || 'qqqq' FROM k)
        SELECT doc_key, min(value) AS value FROM a WHERE length(k) >= 4 AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_key = a.doc_key AND k.k = a.k AND length(k.k) >= 4)
        GROUP BY doc_key, k""",
    "j9_overlaps": f"""
        WITH {inputs.WORDS}, {_BOXES}
        SELECT doc_key, CAST(page AS INTEGER) AS page, seq, CAST(bl AS INTEGER) AS box_left FROM hits WHERE area / least(width * height, bw * bh) > 0.5""",
    "j10_completeness": """
        WITH s AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.pdf' END AS rel_path, doc_id, strlen(text) AS n, text FROM documents),
        r AS (SELECT strlen(t) AS n, t FROM (SELECT CASE WHEN lang = 'es' THEN translate(text, 'e', 'a') ELSE text END AS t FROM documents WHERE lang <> 'de'))
        SELECT rel_path, CASE WHEN n NOT IN (SELECT n FROM r) THEN 'no file of this size' ELSE 'content differs' END AS reason
        FROM s WHERE doc_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.n = s.n AND r.t = s.text)""",
    "j11_two_sources": """
        WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders),
        b AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k FROM events)
        SELECT coalesce(a.k, b.k) AS case_key, CASE WHEN b.k IS NULL THEN 'only A' WHEN a.k IS NULL THEN 'only B' ELSE 'both' END AS provenance
        FROM a FULL JOIN b ON a.k = b.k""",
    "j12_citation_lint": """
        WITH c AS (SELECT DISTINCT doc_id, CAST(CAST(unnest(regexp_extract_all(text, '[0-9]{2,5}')) AS INTEGER) AS VARCHAR) AS case_key FROM documents)
        SELECT doc_id, case_key FROM c WHERE case_key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
    "j13_enrichment": """
        SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "j14_folder_chain": f"""
        WITH RECURSIVE {inputs.CASES}, w AS (
          SELECT case_id, case_id AS here, 0 AS depth, '' AS path FROM cases
          UNION ALL
          SELECT w.case_id, c.parent_id, w.depth + 1, c.subject || CASE WHEN w.path = '' THEN '' ELSE '/' || w.path END
          FROM w JOIN cases c ON c.case_id = w.here WHERE c.kind = 77 AND c.parent_id IN (SELECT case_id FROM cases) AND w.depth < 12)
        SELECT case_id, arg_max(here, depth) AS root_id, max(depth) AS depth, arg_max(path, depth) AS path FROM w GROUP BY case_id""",
    "j14_children": f"WITH {inputs.CASES} SELECT parent_id AS case_id, count(*) AS n_children FROM cases WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "j15_status_list": """
        WITH c AS (SELECT * FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '6-PARKED')) v(bank_id, name)),
        u AS (SELECT o_orderpriority AS name, count(*) AS uses FROM orders GROUP BY ALL)
        SELECT coalesce(c.name, u.name) AS name, CASE WHEN bank_id IS NOT NULL THEN 'catalog#' || bank_id ELSE 'used-in-cases' END AS source,
               coalesce(uses, 0) AS uses FROM c FULL JOIN u ON c.name = u.name""",
    "j16_claim_matrix": f"""
        WITH {_CLAIMS}, m AS (
          SELECT claimed, answered, claimed - answered AS gap, CASE WHEN answered IS NULL THEN 'unanswered' WHEN claimed IS NULL THEN 'respondent only'
                 WHEN claimed = answered THEN 'agreed' ELSE 'disputed' END AS status
          FROM c FULL JOIN r ON c.case_id = r.case_id AND c.issue = r.issue)
        SELECT status, count(*) AS issues, CAST(sum(claimed) AS DOUBLE) AS claimed, CAST(sum(answered) AS DOUBLE) AS answered,
               CAST(sum(gap) AS DOUBLE) AS gap, max(CAST(gap AS DOUBLE) / CAST(answered AS DOUBLE)) AS largest_ratio FROM m GROUP BY status""",
    "j16_stage_changes": """
        WITH a AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS issue FROM lineitem WHERE l_returnflag = 'A'),
        b AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS issue FROM lineitem WHERE l_returnflag = 'R')
        SELECT case_id, issue, 'dropped' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT case_id, issue, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "j17_order_comparison": """
        WITH o AS (SELECT o_custkey % 25 AS municipality, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS component,
                          CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey FROM orders),
        b AS (SELECT municipality, year, component, max(price) AS applied, min(price) AS claimed FROM o GROUP BY ALL),
        r AS (SELECT municipality, year, component, max(price) AS ordered FROM o WHERE o_orderkey % 29 = 0 GROUP BY ALL)
        SELECT b.municipality, b.year, b.component,
               CASE WHEN ordered IS NOT NULL THEN CASE WHEN applied = ordered THEN 'as ordered' ELSE 'differs' END
                    WHEN EXISTS (SELECT 1 FROM r x WHERE x.municipality = b.municipality AND x.component = b.component) THEN 'only other years'
                    ELSE 'order missing' END AS finding,
               CASE WHEN claimed IS NULL THEN 'not claimed' WHEN ordered IS NULL THEN 'not checkable' WHEN claimed = ordered THEN 'as ordered' ELSE 'differs' END AS claim,
               CAST(applied AS DOUBLE) AS applied, CAST(claimed AS DOUBLE) AS claimed, CAST(ordered AS DOUBLE) AS ordered, CAST(applied - ordered AS DOUBLE) AS gap
        FROM b LEFT JOIN r ON b.municipality = r.municipality AND b.year = r.year AND b.component = r.component""",
    "j18_page_ranges": f"""
        WITH {inputs.LINES}, p AS (SELECT * FROM (VALUES ('head', 1, 3), ('middle', 4, 12), ('tail', 10, 100000)) v(part, a, b))
        SELECT doc_key, part, CAST(min(pos + 1) AS INTEGER) AS first_page, CAST(max(pos + 1) AS INTEGER) AS last_page, CAST(sum(length(text)) AS BIGINT) AS chars
        FROM lines JOIN p ON pos + 1 BETWEEN a AND b GROUP BY doc_key, part""",
    "j19_masked_words": f"""
        WITH {inputs.WORDS}, {_BOXES}, h AS (SELECT DISTINCT doc_key, page, seq FROM hits WHERE area / greatest(1, width * height) > 0.3)
        SELECT w.doc_key, CAST(w.page AS INTEGER) AS page, count(h.seq) AS hidden,
               CAST(sum(CASE WHEN h.seq IS NULL THEN length(text) ELSE 0 END) AS BIGINT) AS visible_chars
        FROM words w LEFT JOIN h ON w.doc_key = h.doc_key AND w.page = h.page AND w.seq = h.seq GROUP BY w.doc_key, w.page""",
    "j20_term_scan": f"""
        WITH {inputs.LINES}, t AS (SELECT unnest(['License', 'the', 'eaux', 'thereisnosuchterm']) AS term)
        SELECT doc_key, CAST(pos + 1 AS INTEGER) AS page, term, CASE WHEN length(trim(text)) >= 20 THEN 'text' ELSE 'image' END AS page_type,
               CASE WHEN length(trim(text)) >= 20 THEN 'high' ELSE 'medium' END AS confidence FROM lines JOIN t ON contains(text, term)""",
    "j20_terms_not_found": """
        SELECT doc_id AS doc_key, term FROM documents, (SELECT unnest(['License', 'the', 'eaux', 'thereisnosuchterm']) AS term) t
        WHERE NOT contains(text, term)""",
    "j21_read_ledger": f"""
        WITH {READING}, r AS (SELECT DISTINCT i.doc_id, i.ten FROM issued i JOIN confirms c ON i.code_a = c.code_a AND i.code_b = c.code_b)
        SELECT doc_key AS doc_id, CAST(pos + 1 AS INTEGER) AS n, CASE WHEN r.doc_id IS NOT NULL THEN 'text' END AS how
        FROM lines LEFT JOIN r ON r.doc_id = doc_key AND r.ten = pos // 10""",
    "j22_files_present": f"""
        WITH {inputs.ACTS} SELECT act_id, CASE WHEN kind <> 'error' THEN 'file OK' ELSE 'FILE MISSING' END AS file_state FROM acts""",
}
