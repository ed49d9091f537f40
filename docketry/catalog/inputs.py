"""Inputs the registered queries derive from the driver tables, and the same in SQL.

The driver tables hold no word boxes, case files or document versions. These
are laid out from the given rows, whole tables and whole texts, so the work
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.arrays import lines_of
from docketry.sources.tables import table
from docketry.sources.words import words_from_lines


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values) + "]"


# --- lines and words --------------------------------------------------------

def lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_key, pos, text)``: every line of every document, from 0."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("doc_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "text"))


LINES = """
lines AS (
  SELECT doc_id AS doc_key,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
         unnest(string_split(text, chr(10))) AS text
  FROM documents)
"""


def words(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return words_from_lines(docs, "doc_id", "text")


WORDS = LINES + """,
tokens AS (
  SELECT doc_key, pos AS line,
         generate_subscripts(string_split(text, ' '), 1) - 1 AS i,
         unnest(string_split(text, ' ')) AS text
  FROM lines),
words AS (
  SELECT doc_key, line // 40 + 1 AS page, row_number() OVER (PARTITION BY doc_key ORDER BY line, i) - 1 AS seq, i * 100 AS "left",
         (line % 40) * 24 + least(2, i // 40) AS top, length(text) * 9 AS width, 18 AS height,
         (doc_key * 31 + line * 7 + i * 13) % 103 - 2 AS conf, text, line, i
  FROM tokens WHERE length(text) > 0)
"""


def line_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a document as one page: ``(doc_key, page, text)``, pages from 1."""
    return lines(spark, folder).select("doc_key", (F.col("pos") + 1).alias("page"), "text")


# --- versions ---------------------------------------------------------------

ADDITION = "In addition, "
TAIL = " xx"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of every document: ``(pair_id, side, pos, text)``.

    The second one has its lines in reverse order, some dropped, some with
    words put in front, some with a changed end.
    """
    base = lines(spark, folder).filter(F.length(F.trim("text")) > 0)
    old = base.select(F.col("doc_key").alias("pair_id"), F.lit("original").alias("side"), "pos", "text")
    text = (
        F.when(F.col("pos") % 5 == 1, F.concat(F.lit(ADDITION), F.col("text")))
        .when(F.col("pos") % 5 == 2, F.concat(F.col("text"), F.lit(TAIL)))
        .otherwise(F.col("text"))
    )
    new = base.filter(F.col("pos") % 7 != 3).select(
        F.col("doc_key").alias("pair_id"), F.lit("reordered").alias("side"), (-F.col("pos")).alias("pos"), text.alias("text")
    )
    return old.unionByName(new)


# DuckDB counts bytes in an edit distance; each accented letter of the documents becomes a control character of its own.
ACCENTED = "".join(chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100)))
_STANDINS = "".join(chr(c) for c in (*range(1, 9), *range(14, 32), 127))


def one_byte(column: str) -> str:
    used = [c for c in ACCENTED if c in LETTERS]
    upper = [c.upper() for c in used if len(c.upper()) == 1 and c.upper() != c]
    letters = used + upper
    assert len(letters) <= len(_STANDINS)
    return f"translate({column}, '{''.join(letters)}', " + " || ".join(f"chr({ord(c)})" for c in _STANDINS[: len(letters)]) + ")"


# The accented letters that occur in the documents, lower case.
LETTERS = "áäçèéêíñóöüß"


def versions_sql() -> str:
    return LINES + f""",
base AS (SELECT doc_key, pos, text FROM lines WHERE length(trim(text)) > 0),
old AS (SELECT doc_key AS pair_id, pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM base),
new AS (
  SELECT doc_key AS pair_id, -pos AS pos,
         trim(regexp_replace(CASE WHEN pos % 5 = 1 THEN '{ADDITION}' || text
              WHEN pos % 5 = 2 THEN text || '{TAIL}' ELSE text END, '\\s+', ' ', 'g')) AS text
  FROM base WHERE pos % 7 <> 3)
"""


# --- cases ------------------------------------------------------------------

def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cases: sub-folders by key, status and close date from the order."""
    o = table(spark, folder, "orders")
    closed = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 != 0)
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderkey") >= 10, F.floor(F.col("o_orderkey") / 10)).alias("parent_id"),
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("subject"),
        F.col("o_orderkey").cast("string").alias("case_num"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(closed | ((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 13 == 0)), F.to_date("o_orderdate")).alias("close_date"),
        F.to_date("o_orderdate").alias("open_date"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 7 == 0, 24).otherwise(77).alias("kind"),
    )


CASES = """
cases AS (
  SELECT o_orderkey AS case_id, CASE WHEN o_orderkey >= 10 THEN o_orderkey // 10 END AS parent_id,
         'F' || o_orderkey AS subject, CAST(o_orderkey AS VARCHAR) AS case_num, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status,
         CASE WHEN (o_orderstatus = 'F' AND o_orderkey % 11 <> 0)
                OR (o_orderstatus = 'O' AND o_orderkey % 13 = 0) THEN CAST(o_orderdate AS DATE) END AS close_date,
         CAST(o_orderdate AS DATE) AS open_date, o_orderpriority AS priority, CASE WHEN o_orderkey % 7 = 0 THEN 24 ELSE 77 END AS kind
  FROM orders)
"""


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stage history of the user's case."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("flow_id"), F.col("user_id").alias("case_id"),
        F.col("event_type").alias("node_id"), F.col("ts").alias("change_date"),
    )


FLOW = "flow AS (SELECT event_id AS flow_id, user_id AS case_id, event_type AS node_id, ts AS change_date FROM events)"


def acts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as acts with the file each should have."""
    e = table(spark, folder, "events")
    name = F.concat(F.col("event_id").cast("string"), F.col("event_type"), F.when(F.col("event_id") % 17 == 0, "-old").otherwise(""))
    return e.select(
        F.col("event_id").alias("act_id"), F.col("user_id").alias("case_id"), F.col("event_type").alias("kind"),
        F.col("event_type").alias("act_text"), F.col("ts").alias("due"),
        F.concat(F.lit("C:/Office/tmpDocs/"), F.col("user_id").cast("string"), F.lit("/"), name, F.lit(".pdf")).alias("doc_path"),
    )


ACTS = """
acts AS (
  SELECT event_id AS act_id, user_id AS case_id, event_type AS kind, event_type AS act_text, ts AS due,
         'C:/Office/tmpDocs/' || user_id || '/' || event_id || event_type
           || CASE WHEN event_id % 17 = 0 THEN '-old' ELSE '' END || '.pdf' AS doc_path
  FROM events)
"""


# --- holdings ---------------------------------------------------------------

def holdings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as holdings; their labels say whether they were approved or treated negatively."""
    d = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    checked = F.when(F.col("doc_id") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7 % 200).cast("int")))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("holding_id"),
        F.when(F.col("doc_id") % 10 == 9, "tracking").otherwise("holding").alias("type"),
        F.element_at(F.split("text", "\n"), 1).alias("name"),
        F.col("source").alias("subject"),
        F.floor(F.col("doc_id") / 3).alias("decision"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "pending").otherwise("unverified").alias("status"),
        F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "no").otherwise("unknown").alias("negative_treatment"),
        checked.alias("citations_checked"),
        F.array("lang", "source").alias("tags"),
    )


HOLDINGS = """
holdings AS (
  SELECT d.doc_id AS holding_id, CASE WHEN d.doc_id % 10 = 9 THEN 'tracking' ELSE 'holding' END AS type,
         string_split(d.text, chr(10))[1] AS name, d.source AS subject, d.doc_id // 3 AS decision,
         CASE WHEN l.quality = 1 THEN 'approved' WHEN l.quality = 0 THEN 'pending' ELSE 'unverified' END AS status,
         CASE WHEN l.toxic = 1 THEN 'yes' WHEN l.toxic = 0 THEN 'no' ELSE 'unknown' END AS negative_treatment,
         CASE WHEN d.doc_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(d.doc_id * 7 % 200 AS INTEGER) END AS citations_checked,
         [d.lang, d.source] AS tags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
