"""Composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.aggregates import REPORT, _manifest
from docketry.catalog.joins import _page_entities
from docketry.catalog.predicates import _detections
from docketry.catalog.text import LATIN_REFERENCES
from docketry.catalog.windows import BLOCKS, MARKERS, plain_opening
from docketry.functions import patterns
from docketry.functions.arrays import lines_of
from docketry.operators import holdings, quality
from docketry.plans import folders, masking, ocr, preservation, statutes
from docketry.sources.tables import table

CONNECTORS = ["In addition,", "However,"]


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = inputs.versions(spark, d)
    found = preservation.preservation_findings(
        v, metric="edit", patterns=LATIN_REFERENCES, markers=[m.strip() for m in MARKERS], connectors=CONNECTORS, compatibility=False
    )
    return v, found


def q1_preservation_findings(spark: SparkSession, d: str) -> DataFrame:
    _, found = _findings(spark, d)
    return found.groupBy("pair_id", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def q1_preservation_status(spark: SparkSession, d: str) -> DataFrame:
    v, found = _findings(spark, d)
    return quality.overall_status(found, v, "pair_id")


def q1_preservation_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The default metric; only pairs that pass the edit-distance bound reach it."""
    found = preservation.preservation_findings(
        inputs.versions(spark, d), patterns=LATIN_REFERENCES, markers=[m.strip() for m in MARKERS], connectors=CONNECTORS
    )
    return found.groupBy("pair_id", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def _masking(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """First words of lines as names, e-mail addresses as accounts; pattern detectors on top."""
    emails = _detections(spark, d).filter("category = 'EMAIL'").select(
        "doc_key", (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page"), F.col("value").alias("text"), F.lit("account").alias("type")
    )
    ents = _page_entities(spark, d).unionByName(emails)
    manifest = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"))
    return masking.masking_run(
        inputs.words(spark, d), ents, manifest, detectors=patterns.LATIN_DETECTORS, allowed=["License", *fv.PUBLIC_ALLOW_LIST],
        metric="edit", national_ids=False,
    )


def q2_masking_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = _masking(spark, d)["plan"]
    return plan.groupBy("doc_key", "category").agg(F.count(F.lit(1)).alias("boxes"))


def q2_masking_summary(spark: SparkSession, d: str) -> DataFrame:
    return _masking(spark, d)["summary"]


def _folders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    ext = F.when(i % 7 == 0, ".txt").otherwise(".pdf")

    def listing(rows: DataFrame, content) -> DataFrame:
        path = F.concat(F.when(i % 50 == 0, "").otherwise(F.concat("source", F.lit("/"))), i.cast("string"), ext)
        return rows.select(path.alias("rel_path"), ext.alias("ext"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))

    source = listing(docs, F.col("text"))
    result = listing(docs.filter("lang <> 'de'"), F.when(F.col("lang") == "es", F.translate("text", "e", "a")).otherwise(F.col("text")))
    chars = docs.select(
        F.concat(F.when(i % 50 == 0, "").otherwise(F.concat("source", F.lit("/"))), i.cast("string"), ext).alias("rel_path"),
        F.when(i % 20 != 0, F.when(i % 9 == 0, 3).otherwise(F.length("text"))).alias("chars"),
    )
    return source, result, chars


def q3_folder_integrity(spark: SparkSession, d: str) -> DataFrame:
    return folders.folder_findings(*_folders(spark, d), summary_part="summary")


def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    """Forty lines of a document as one page, cut inside the document's row."""
    texts = lines_of(F.col("text"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(texts) - 1) / 40).cast("int"))
    cut = F.transform(
        numbers, lambda p: F.struct((p + 1).alias("page"), F.array_join(F.slice(texts, p * 40 + 1, F.lit(40)), "\n").alias("text"))
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), F.explode(cut).alias("p")).select("doc_key", "p.*")


def q4_ocr_report(spark: SparkSession, d: str) -> DataFrame:
    joined = joined_pages(spark, d)
    report = ocr.ocr_report(_manifest(spark, d), joined, inputs.words(spark, d))
    return report.select("doc_key", "mean_confidence", "low_pages", "status", "pages", "kind", "engine", F.array_join("reasons", ",").alias("reasons"))


def q5_statute_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pages = docs.select(
        F.col("doc_id").cast("string").alias("title"), F.col("text").alias("wikitext"), F.col("doc_id").alias("revid"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("timestamp"),
        F.concat(F.lit(fv.SOURCE_URL), F.col("doc_id").cast("string")).alias("url"),
    )
    found = statutes.sections(pages, plain_opening)
    return found.select("page_title", "pos", "num", F.array_join("context", " > ").alias("context"), F.md5("body_text").alias("digest"), "source")


def q5_table_of_contents(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("wikitext"))
    return statutes.table_of_contents(pages, plain_opening)


def q6_authority_pack(spark: SparkSession, d: str) -> DataFrame:
    return holdings.authority_pack(inputs.holdings(spark, d), [*fv.AUTHORITY_TIERS, (4, "withdrawn")])


QUERIES = {
    f.__name__: f
    for f in (
        q1_preservation_findings, q1_preservation_status, q1_preservation_blocks, q2_masking_plan, q2_masking_summary, q3_folder_integrity, q4_ocr_report,
        q5_statute_sections, q5_table_of_contents, q6_authority_pack,
    )
}


def _best_sql(name: str, left: str, right: str) -> str:
    return f"""
{name}_t AS (SELECT pair_id, text, min(pos) AS pos FROM {right} GROUP BY ALL),
{name}_e AS (SELECT o.pair_id, o.pos, o.text, t.pos AS same FROM {left} o LEFT JOIN {name}_t t ON o.pair_id = t.pair_id AND o.text = t.text),
{name}_s AS (SELECT e.pair_id, e.pos, t.pos AS other, 1 - levenshtein({inputs.one_byte('e.text')}, {inputs.one_byte('t.text')}) / greatest(length(e.text), length(t.text)) AS score
     FROM {name}_e e JOIN {name}_t t ON e.pair_id = t.pair_id
     WHERE e.same IS NULL AND least(length(e.text), length(t.text)) >= 0.79 * greatest(length(e.text), length(t.text))),
{name}_b AS (SELECT pair_id, pos, max(score) AS score, arg_min(other, (-score, other)) AS other FROM {name}_s WHERE score >= 0.8::DOUBLE GROUP BY ALL),
{name} AS (SELECT e.pair_id, e.pos, e.text, coalesce(e.same, b.other) AS other, CASE WHEN e.same IS NOT NULL THEN 1.0::DOUBLE ELSE b.score END AS score
     FROM {name}_e e LEFT JOIN {name}_b b ON e.pair_id = b.pair_id AND e.pos = b.pos)"""


def _refs_sql(side: str) -> str:
    return " UNION ".join(f"SELECT pair_id, unnest(regexp_extract_all(text, {inputs.sql_text(p)})) AS ref FROM {side}" for p in LATIN_REFERENCES)


def _tail_sql(side: str) -> str:
    starts = " OR ".join(f"starts_with(text, '{m.strip()}')" for m in MARKERS)
    return f"""SELECT t.pair_id, string_agg(t.text, ' ' ORDER BY t.pos) AS tail FROM {side} t
               JOIN (SELECT pair_id, min(pos) AS f FROM {side} WHERE {starts} GROUP BY pair_id) m ON t.pair_id = m.pair_id AND t.pos >= f GROUP BY t.pair_id"""


_FINDINGS = inputs.versions_sql() + "," + _best_sql("fw", "old", "new") + "," + _best_sql("bw", "new", "old") + f""",
matched AS (SELECT fw.*, n.text AS partner FROM fw LEFT JOIN new n ON n.pair_id = fw.pair_id AND n.pos = fw.other),
ro AS ({_refs_sql('old')}), rn AS ({_refs_sql('new')}), po AS ({_tail_sql('old')}), pn AS ({_tail_sql('new')}),
tails AS (SELECT coalesce(po.pair_id, pn.pair_id) AS pair_id, po.tail IS DISTINCT FROM pn.tail AS differs FROM po FULL JOIN pn ON po.pair_id = pn.pair_id),
added AS (SELECT pair_id, CASE WHEN ends_with(partner, text) AND length(partner) > length(text) THEN trim(left(partner, length(partner) - length(text)))
                  WHEN length(text) >= 40 AND instr(partner, left(text, 40)) > 1 THEN trim(left(partner, instr(partner, left(text, 40)) - 1)) END AS a
          FROM matched WHERE score < 0.999),
findings AS (
  SELECT pair_id, '1-paragraphs' AS "check", CASE WHEN score IS NULL THEN 'RED' ELSE 'ORANGE' END AS severity FROM fw WHERE score IS NULL OR score < 0.95
  UNION ALL SELECT pair_id, '1-paragraphs', 'RED' FROM bw WHERE score IS NULL
  UNION ALL SELECT pair_id, '3-refs', 'RED' FROM ((SELECT * FROM ro EXCEPT SELECT * FROM rn) UNION ALL (SELECT * FROM rn EXCEPT SELECT * FROM ro))
  UNION ALL SELECT b.pair_id, '4-operative', CASE WHEN differs IS NULL THEN 'ORANGE' ELSE 'DOUBLE_RED' END
            FROM (SELECT DISTINCT pair_id FROM old UNION SELECT DISTINCT pair_id FROM new) b LEFT JOIN tails ON tails.pair_id = b.pair_id WHERE differs IS NULL OR differs
  UNION ALL SELECT pair_id, '5-meaning', 'ORANGE' FROM matched WHERE score IS NOT NULL
            AND abs(len(string_split(partner, ' ')) - len(string_split(text, ' '))) / len(string_split(text, ' ')) > 0.1
  UNION ALL SELECT pair_id, '6-connectors', CASE WHEN a IN ('In addition,', 'However,') THEN 'GREEN' ELSE 'RED' END FROM added WHERE length(a) > 0)
"""

ORACLE = {
    "q1_preservation_findings": f'WITH {_FINDINGS} SELECT pair_id, "check", severity, count(*) AS n FROM findings GROUP BY ALL',
    "q1_preservation_status": f"""
        WITH {_FINDINGS}, w AS (SELECT pair_id, bool_or(severity IN ('RED', 'DOUBLE_RED')) AS r, bool_or(severity = 'ORANGE') AS o FROM findings GROUP BY pair_id)
        SELECT b.pair_id, CASE WHEN r THEN 'fail' WHEN o THEN 'pass with notes' ELSE 'pass' END AS status
        FROM (SELECT DISTINCT pair_id FROM old UNION SELECT DISTINCT pair_id FROM new) b LEFT JOIN w ON w.pair_id = b.pair_id""",
    "q3_folder_integrity": """
        WITH s AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE source || '/' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.pdf' END AS p,
                          strlen(text) AS n, text, lang FROM documents),
        r AS (SELECT doc_id, p, strlen(t) AS n, t FROM (SELECT *, CASE WHEN lang = 'es' THEN translate(text, 'e', 'a') ELSE text END AS t FROM s WHERE lang <> 'de'))
        SELECT '1-completeness' AS "check", 'RED' AS severity, p AS subject, CASE WHEN n NOT IN (SELECT n FROM r) THEN 'no file of this size' ELSE 'content differs' END AS detail
        FROM s WHERE doc_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.n = s.n AND r.t = s.text)
        UNION ALL SELECT '2-root', 'RED', p, 'left unsorted in the root' FROM r WHERE doc_id % 50 = 0 AND doc_id % 7 <> 0
        UNION ALL SELECT '3-textlayer', 'RED', p, 'no text layer' FROM r WHERE doc_id % 7 <> 0 AND doc_id % 20 <> 0 AND (doc_id % 9 = 0 OR length(t) < 20)
        UNION ALL SELECT '3-textlayer', 'ORANGE', '', count(*) || ' not checked' FROM r WHERE doc_id % 7 <> 0 AND doc_id % 20 = 0 HAVING count(*) > 0
        UNION ALL SELECT '4-summary', 'RED', 'summary', 'summary document not found'""",
    "q4_ocr_report": rf"""
        WITH {REPORT.replace("doc_key % 10 <> 1", "true").replace("confidence < 49", "confidence < 75")},
        pg AS (SELECT doc_key, pos // 40 + 1 AS page, string_agg(text, chr(10) ORDER BY pos) AS text FROM lines GROUP BY ALL),
        l AS (SELECT doc_key, count(*) AS n, count(*) FILTER (length(trim(text)) >= 20) AS w, sum(length(text)) + 2 * (count(*) - 1) AS chars,
                     sum(length(regexp_replace(text, '[^\x{{0590}}-\x{{05FF}}A-Za-z0-9\s.,;:!?()\[\]{{}}\-–"''/\\%&@#*+=°₪$]', '', 'g'))) + 2 * (count(*) - 1) AS valid FROM pg GROUP BY doc_key),
        c AS (SELECT doc_key, round_even(avg(conf), 1) AS m FROM words WHERE conf >= 0 GROUP BY doc_key),
        k AS (SELECT l.*, array_to_string(list_filter([CASE WHEN coalesce(m, 0) < 60 THEN 'low_confidence' END, CASE WHEN round_even(chars / n, 1) < 80 THEN 'little_text' END,
                     CASE WHEN round_even(CASE WHEN chars > 0 THEN valid / chars ELSE 0 END, 3) < 0.75 THEN 'invalid_characters' END], lambda v: v IS NOT NULL), ',') AS reasons
              FROM l LEFT JOIN c ON c.doc_key = l.doc_key)
        SELECT r.doc_key, mean_confidence, low_pages, status, n AS pages, CASE WHEN w / n >= 0.8 THEN 'text' WHEN w / n <= 0.2 THEN 'image' ELSE 'mixed' END AS kind,
               CASE WHEN reasons = '' THEN 'local' ELSE 'fallback' END AS engine, reasons FROM report r JOIN k ON k.doc_key = r.doc_key""",
    "q5_statute_sections": rf"""
        WITH {BLOCKS}, h AS (
          SELECT *, max(CASE WHEN kind = 'heading' AND title <> '' AND level = 2 THEN pos END) OVER w AS p2,
                 max(CASE WHEN kind = 'heading' AND title <> '' AND level = 3 THEN pos END) OVER w AS p3,
                 max(CASE WHEN kind = 'heading' AND title <> '' AND level = 4 THEN pos END) OVER w AS p4
          FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '''''''(.+?)''''''', '\1', 'gs'), '''''(.+?)''''', '\1', 'gs'),
              '<[^>\n]{{0,80}}>', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS b FROM blocks)
        SELECT CAST(s.doc_id AS VARCHAR) AS page_title, s.pos, s.num, concat_ws(' > ', a.title, b.title, c.title) AS context, md5(t.b) AS digest,
               'מקור: {fv.SOURCE_URL}' || s.doc_id || '#' || url_encode('סעיף_' || s.num) || ' | ויקיטקסט, גרסה מיום ' ||
               strftime(DATE '2024-01-01' + CAST(s.doc_id % 300 AS INTEGER), '%Y-%m-%d') || ' (revid ' || s.doc_id || ')' AS source
        FROM h s JOIN t ON t.doc_id = s.doc_id AND t.pos = s.pos
        LEFT JOIN blocks a ON a.doc_id = s.doc_id AND a.pos = s.p2
        LEFT JOIN blocks b ON b.doc_id = s.doc_id AND b.pos = s.p3 AND s.p3 > coalesce(s.p2, 0)
        LEFT JOIN blocks c ON c.doc_id = s.doc_id AND c.pos = s.p4 AND s.p4 > greatest(coalesce(s.p2, 0), coalesce(s.p3, 0))
        WHERE s.kind = 'section'""",
    "q5_table_of_contents": f"""
        WITH {BLOCKS} SELECT CAST(doc_id AS VARCHAR) AS page_title, pos, CAST(level - 2 AS INTEGER) AS indent, title AS line FROM blocks WHERE kind = 'heading' AND title <> ''""",
    "q6_authority_pack": f"""
        WITH {inputs.HOLDINGS}, t AS (SELECT * FROM (VALUES (1, 'approved'), (2, 'pending'), (3, 'unverified'), (4, 'withdrawn')) v(tier, tier_name))
        SELECT tier, tier_name, holding_id, CASE WHEN holding_id IS NULL THEN NULL WHEN status = 'unverified' THEN 'index entry' ELSE 'read in the decision' END AS source_trust,
               CASE WHEN holding_id IS NULL THEN NULL WHEN negative_treatment = 'yes' THEN 'negative' WHEN citations_checked IS NULL THEN 'unchecked' ELSE 'checked' END AS validity
        FROM t LEFT JOIN holdings ON status = tier_name""",
}
