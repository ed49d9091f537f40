"""Questionnaires, templates and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.catalog import inputs
from docketry.catalog.windows import TEMPLATE, template_data
from docketry.functions.arrays import lines_of
from docketry.operators import forms
from docketry.sources.tables import table


def _questionnaires(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a questionnaire in JSON: its lines are the questions of two chapters."""
    def question(line, i):
        kind = F.when(i % 4 == 0, "text").when(i % 4 == 1, "choice").when(i % 4 == 2, "yesno").otherwise("slider")
        name = F.when(i % 9 == 4, F.concat(F.lit("q"), (i - 1).cast("string"))).when(
            i % 11 == 5, F.concat(F.lit("q"), i.cast("string"), F.lit("__more"))
        ).otherwise(F.concat(F.lit("q"), i.cast("string")))
        options = F.when((i % 4 == 1) & (i % 3 > 0), F.array(F.struct(F.lit("a").alias("value"), F.lit("a").alias("he"), F.lit("a").alias("en"))))
        gate = F.when(i % 5 == 0, F.struct(F.concat(F.lit("q"), (i * 7 % 13).cast("string")).alias("id"), F.array(F.lit("yes")).alias("equals")))
        return F.struct(
            name.alias("id"), kind.alias("type"), line.alias("he"), F.when(i % 7 == 0, "").otherwise(line).alias("en"),
            options.alias("options"), gate.alias("showIf"),
        )

    questions = F.transform(lines_of(F.col("text")), question)
    chapter = lambda name, part: F.struct(F.lit(name).alias("id"), F.lit(name).alias("he"), F.lit(name).alias("en"), part.alias("questions"))
    early = F.slice(questions, 1, 20)
    late = F.slice(questions, F.lit(21), F.greatest(F.lit(1), F.size(questions)))
    chapters = F.array(chapter("s1", early), chapter("zz_completion", late))
    return table(spark, d, "documents").select(F.col("doc_id").alias("form_id"), F.to_json(chapters).alias("schema_json"))


def f24_questionnaire_lint(spark: SparkSession, d: str) -> DataFrame:
    read = _questionnaires(spark, d).withColumn("chapters", F.from_json("schema_json", forms.QUESTIONNAIRE))
    found = forms.lint_questionnaires(read, "form_id", F.col("chapters"))
    return found.groupBy("form_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def f25_question_visibility(spark: SparkSession, d: str) -> DataFrame:
    read = _questionnaires(spark, d).withColumn("chapters", F.from_json("schema_json", forms.QUESTIONNAIRE))
    q = forms.questions_of(read, "form_id", F.col("chapters"))
    numbers = F.sequence(F.lit(0), F.lit(12))
    given = F.transform(
        numbers,
        lambda n: F.struct(
            F.concat(F.lit("q"), n.cast("string")).alias("key"),
            F.array(F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("dk")), ((F.col("form_id") + n) % 3 + 1).cast("int"))).alias("value"),
        ),
    )
    answers = F.map_from_entries(given)
    shown = forms.visible(F.col("gate_id"), F.col("gate_values"), answers)
    return q.select("form_id", shown.alias("shown")).groupBy("form_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if("shown").alias("shown"))


def f26_tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    written = (
        F.when(i % 5 == 0, F.col("props"))
        .when(i % 5 == 1, F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done")))
        .when(i % 5 == 2, F.translate("props", '"', "'"))
        .when(i % 5 == 3, F.regexp_replace("props", r"\}", ", }"))
        .otherwise(F.regexp_replace("props", ":", "="))
    )
    parsed = forms.tolerant_json(written, "struct<k:int>")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed.isNotNull().alias("parsed"))


def f27_filled_templates(spark: SparkSession, d: str) -> DataFrame:
    filled = forms.fill_template(F.lit(TEMPLATE), template_data())
    return table(spark, d, "customer").select("c_custkey", filled.alias("filled"))


QUERIES = {f.__name__: f for f in (f24_questionnaire_lint, f25_question_visibility, f26_tolerant_json, f27_filled_templates)}

_QUESTIONS = inputs.LINES + """,
q AS (SELECT doc_key, CASE WHEN pos < 20 THEN 0 ELSE 1 END AS ch, pos AS i, CASE WHEN pos < 20 THEN pos ELSE pos - 20 END AS p, text,
             CASE WHEN pos % 9 = 4 THEN 'q' || (pos - 1) WHEN pos % 11 = 5 THEN 'q' || pos || '__more' ELSE 'q' || pos END AS id,
             CASE WHEN pos % 5 = 0 THEN 'q' || (pos * 7 % 13) END AS gate FROM lines)
"""

ORACLE = {
    "f24_questionnaire_lint": f"""
        WITH {_QUESTIONS}, c AS (SELECT doc_key, id, count(*) AS n FROM q GROUP BY ALL), g AS (SELECT doc_key, ch, id, min(p) AS gp FROM q GROUP BY ALL),
        r AS (SELECT q.doc_key, unnest(list_filter([
            CASE WHEN c.n > 1 THEN 'duplicate id' END, CASE WHEN ends_with(q.id, '__more') THEN 'reserved id' END,
            CASE WHEN q.gate IS NOT NULL AND (gp IS NULL OR gp >= q.p) THEN 'gate not earlier' END,
            CASE WHEN i % 4 = 1 AND i % 3 = 0 THEN 'options missing' END, CASE WHEN i % 4 = 3 THEN 'unknown type' END,
            CASE WHEN i % 7 = 0 OR length(trim(text)) = 0 THEN 'language missing' END], lambda v: v IS NOT NULL)) AS rule
          FROM q JOIN c ON c.doc_key = q.doc_key AND c.id = q.id LEFT JOIN g ON g.doc_key = q.doc_key AND g.ch = q.ch AND g.id = q.gate
          UNION ALL SELECT doc_id, 'reserved chapter' FROM documents)
        SELECT doc_key AS form_id, rule, count(*) AS n FROM r GROUP BY ALL""",
    "f25_question_visibility": f"""
        WITH {_QUESTIONS} SELECT doc_key AS form_id, count(*) AS questions,
               count(*) FILTER (gate IS NULL OR (doc_key + i * 7 % 13) % 3 = 0) AS shown FROM q GROUP BY doc_key""",
    "f26_tolerant_json": """
        SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k, event_id % 5 < 4 AS parsed FROM events""",
    "f27_filled_templates": """
        SELECT c_custkey, 'Dear ' || c_name || ', segment ' || c_mktsegment || '.' || chr(10) || CASE WHEN c_acctbal > 5000 THEN '☒' ELSE '☐' END || ' urgent '
               || CASE WHEN c_acctbal > 5000 THEN '☒' ELSE '☐' END || ' vip' || chr(10) || 'Items:' || chr(10) || c_custkey || chr(10) || c_nationkey || chr(10)
               || CASE WHEN c_custkey % 3 = 0 THEN 'late' ELSE '' END AS filled FROM customer""",
}
